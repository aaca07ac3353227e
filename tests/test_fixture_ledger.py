"""The derived ledger: order lines move twice, and large orders and addresses give the same rows."""

from pyspark.sql import functions as F

from ledgerspark.sources import fixture as fx

SF = "/root/testdata/sf0.001"


def _sizes(spark):
    return fx.table(spark, SF, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


def test_lines_move_to_their_order_and_to_their_address_only(spark):
    plan = fx._linked_lines(spark, SF, _sizes(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_orders_and_addresses_in_slices_give_the_same_ledger(spark, monkeypatch):
    usual = fx._derive(spark, SF)
    monkeypatch.setattr(fx, "LARGE_LINES", 5)
    sliced = fx._derive(spark, SF)
    for name in ("transactions", "inputs", "outputs"):
        a, b = getattr(usual, name), getattr(sliced, name)
        assert a.count() == b.count() > 0
        assert a.exceptAll(b).isEmpty()
