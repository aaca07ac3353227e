"""Steps that join only what they need: hop 0 of reported cases, hints of change outputs."""

from pyspark.sql import functions as F

from ledgerspark.operators import clusters, heuristics, trace
from ledgerspark.plans import trace_queries as tq
from ledgerspark.sources import fixture as fx

SF = "/root/testdata/sf0.001"


def test_hop0_joins_the_reported_transactions_only(spark):
    ledger, cases = fx.ledger(spark, SF), fx.fraud_cases(spark, SF)
    plain, by_buckets = trace.reported_part(ledger, cases), trace.reported_part(ledger, cases, tq._spends(spark, SF))
    assert plain.transactions.count() == cases.select("fraud_txid").distinct().count() < ledger.transactions.count()
    whole = ledger.outputs.join(cases.select(F.col("fraud_txid").alias("txid")).distinct(), "txid", "left_semi").select(*plain.outputs.columns)
    for part in (plain, by_buckets):
        assert part.outputs.exceptAll(whole.select(*part.outputs.columns)).isEmpty()
        assert part.outputs.count() == whole.count()


def test_cases_are_written_once(spark):
    assert fx.fraud_cases(spark, SF) is fx.fraud_cases(spark, SF)


def test_change_hints_move_a_row_to_its_address_and_to_its_transaction(spark):
    inputs = spark.createDataFrame(
        [("t", "a", 1), ("t", "b", 2), ("v", "c", 1)], "txid string, address string, amount_sats bigint")
    outputs = spark.createDataFrame(
        [("t", 0, "x", 20_000), ("t", 1, "a", 7), ("u", 0, "x", 5), ("u", 1, None, 9), ("v", 0, "y", 3), ("v", 1, "c", 3)],
        "txid string, vout_index int, address string, amount_sats bigint")
    types = spark.createDataFrame([("a", "P"), ("b", "P"), ("x", "Q"), ("c", "P"), ("y", "Q")], "address string, script_type string")
    flags = heuristics.change_output_flags(inputs, outputs, types)
    plan = flags._jdf.queryExecution().executedPlan().toString()
    got = {(r.txid, r.vout_index): tuple(r)[2:] for r in flags.collect()}
    assert got == {
        ("t", 0): (False, False, False, False, False), ("t", 1): (True, True, True, False, True),
        ("u", 0): (False, False, False, True, False), ("u", 1): (False, False, False, True, True),
        ("v", 0): (False, False, False, False, False), ("v", 1): (True, False, True, False, True)}
    assert plan.count("Exchange hashpartitioning") <= 3


def test_co_inputs_move_to_their_transaction_and_as_pairs(spark):
    inputs = spark.createDataFrame(
        [("t", "b"), ("t", "a"), ("t", "b"), ("u", "a"), ("u", "b"), ("v", "c"), ("v", None), (None, "d"), (None, "e")], "txid string, address string")
    edges = clusters.co_input_edges(inputs)
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert [tuple(r) for r in edges.collect()] == [("b", "a")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_ledger_is_grouped_and_joined_where_it_lies(spark, monkeypatch):
    monkeypatch.setattr(fx, "LEAST_BUCKETS", 3)
    ledger = fx._derive(spark, SF)
    key = spark.range(5).select(fx.txid_of(F.col("id")).alias("txid")).hint("merge")
    assert "Exchange" not in _plan(ledger.outputs.groupBy("txid").agg(F.max("amount_sats")))
    assert "Exchange" not in _plan(ledger.inputs.hint("merge").join(ledger.transactions, "txid"))
    for df in (ledger.inputs, ledger.outputs, ledger.transactions):
        assert _plan(df.join(key, "txid", "left_semi")).count("Exchange hashpartitioning") == 1


def test_first_outputs_come_from_the_buckets_where_they_are(spark):
    spends, cases = tq._spends(spark, SF), fx.fraud_cases(spark, SF)
    wide = trace.Spends(spends.table.hint("merge"), spends.buckets)
    queue = trace._first_queue(cases, wide)
    assert _plan(queue).count("Exchange hashpartitioning") == 1
    want = cases.join(fx.ledger(spark, SF).outputs, (F.col("txid") == F.col("fraud_txid")) & (F.col("address") == F.col("recipient"))).groupBy(
        "case_id").agg(F.min("vout_index").alias("vout_index"))
    assert queue.count() == want.count() > 0
    assert queue.select("case_id", "vout_index").exceptAll(want).isEmpty()


def test_spends_meet_their_outputs_by_one_move(spark):
    outputs = spark.createDataFrame(
        [("t", 0, "a", 5, "u"), ("t", 1, "b", 6, None), ("t", 2, None, 7, "x"), ("u", 0, "c", 8, None), ("u", 0, "d", 9, None)],
        "txid string, vout_index int, address string, amount_sats bigint, spent_by_txid string")
    inputs = spark.createDataFrame(
        [("v", "t", 0), ("u", "t", 0), ("x", "t", 2), ("u", "u", 0), ("u", "ext1", 0), ("u", None, None), ("v", "t", None)],
        "txid string, prev_txid string, prev_vout bigint")
    transactions = spark.createDataFrame([("t", 1, None), ("u", 4, None), ("v", 3, None)], "txid string, block_height bigint, first_seen timestamp")
    table = trace.spend_table(trace.Ledger(None, transactions, inputs, outputs)).table
    got = sorted(tuple(r) for r in table.select("txid", "vout_index", "sats", "flag", "spender", "spend_height", "is_loaded").collect())
    assert got == [("t", 0, 5, "u", "v", 3, True), ("t", 1, 6, None, None, None, False), ("t", 2, 7, "x", "x", None, False),
                   ("u", 0, 8, None, "u", 4, True), ("u", 0, 9, None, "u", 4, True)]
    assert table.schema["vout_index"].dataType.simpleString() == "int"
