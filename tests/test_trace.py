"""Traces, flow graphs and paths on ledgers small enough to follow by hand."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import flow, trace
from ledgerspark.operators.ledger import Ledger

KNOWN = [
    ("kraken", "Kraken", "Kraken (seed)", "exchange-intel/seed", True, False),
    ("binance", "Binance", "Binance (seed)", "exchange-intel/seed", True, True),
    ("listed", None, None, None, False, True),
]
CASE = "case_id string, fraud_txid string, recipient string"


def ledger(spark, txs, lost=()):
    """``txs``: (txid, [outpoints spent], [(receiver, sats)]) in order of height; an outpoint is "txid:n".

    Of transactions in ``lost`` only the flag on the output they spend is known.
    """
    paid = {f"{t}:{n}": (a, s) for t, _, outs in txs for n, (a, s) in enumerate(outs)}
    spent = {o: t for t, ins, _ in txs for o in ins}
    transactions = [(t, h) for h, (t, _, _) in enumerate(txs, 1) if t not in lost]
    inputs = [(t, n, *_point(o), *paid[o]) if o in paid else (t, n, None, None, o, 9000)
              for t, ins, _ in txs if t not in lost for n, o in enumerate(ins)]
    outputs = [(t, n, a, s, spent.get(f"{t}:{n}")) for t, _, outs in txs if t not in lost for n, (a, s) in enumerate(outs)]
    tx = spark.createDataFrame(transactions, "txid string, block_height bigint").withColumn(
        "first_seen", F.timestamp_seconds(F.col("block_height") * 600))
    return Ledger(
        blocks=None, transactions=tx,
        inputs=spark.createDataFrame(inputs, "txid string, vin_index int, prev_txid string, prev_vout int, address string, amount_sats bigint"),
        outputs=spark.createDataFrame(outputs, "txid string, vout_index int, address string, amount_sats bigint, spent_by_txid string"))


def _point(outpoint):
    txid, n = outpoint.split(":")
    return txid, int(n)


def traced(spark, led, max_hops=8):
    known = spark.createDataFrame(KNOWN, "address string, exchange string, label string, source string, is_evidential boolean, is_sanctioned boolean")
    cases = spark.createDataFrame([("c", "t0", "thief")], CASE)
    result = trace.trace_cases(led, cases, known, max_hops)
    to = defaultdict(list)
    for leg in result.legs.where("side = 'to'").orderBy("hop", "ord").collect():
        to[leg.hop].append((leg.address, leg.sats))
    return [(h.hop, h.txid, to[h.hop], h.chain_end_reason, h.confidence, h.exchange) for h in result.hops.orderBy("hop").collect()]


START = ("t0", ["victim"], [("thief", 5000)])


def test_money_split_to_an_exchange_and_an_unspent_rest(spark):
    led = ledger(spark, [START, ("t1", ["t0:0"], [("middle", 3000), ("thief", 2000)]), ("t2", ["t1:0"], [("kraken", 2900)]),
                         ("t3", ["t1:1"], [("rest", 1900), ("dust", 100)])])
    rows = traced(spark, led)
    assert [(txid, to, end, exchange) for _, txid, to, end, _, exchange in rows] == [
        ("t1", [("middle", 3000), ("thief", 2000)], None, None),
        ("t2", [("kraken", 2900)], "exchange", "Kraken"),
        ("t3", [("rest", 1900)], "unspent", None),
    ]


def test_money_pooled_with_much_more_ends_there(spark):
    led = ledger(spark, [START, ("f", ["other"], [("pool", 90_000)]), ("t1", ["t0:0", "f:0"], [("big", 80_000), ("small", 1000)]),
                         ("t2", ["t1:0"], [("kraken", 79_000)])])
    rows = traced(spark, led)
    assert [(txid, end) for _, txid, _, end, _, _ in rows] == [("t1", "pooling")]


def test_a_spender_nobody_recorded_is_told(spark):
    led = ledger(spark, [START, ("t1", ["t0:0"], [("middle", 4900)]), ("t2", ["t1:0"], [("far", 4800)])], lost={"t2"})
    rows = traced(spark, led)
    assert [(txid, end) for _, txid, _, end, _, _ in rows] == [("t1", "lookup_incomplete")]
    assert [end for _, _, _, end, _, _ in traced(spark, ledger(spark, [START, ("t1", ["t0:0"], [("x", 1)])], lost={"t1"}))] == ["lookup_incomplete"]


def test_money_that_meets_again_is_followed_once(spark):
    led = ledger(spark, [START, ("t1", ["t0:0"], [("left", 2500), ("right", 2500)]), ("t2", ["t1:0", "t1:1"], [("binance", 4900)])])
    assert [(txid, exchange) for _, txid, _, _, _, exchange in traced(spark, led)] == [("t1", None), ("t2", "Binance")]


@pytest.mark.parametrize("length", [1, 5])
def test_stored_links_are_followed_level_by_level(spark, length):
    txs = [START] + [(f"t{n}", [f"t{n - 1}:0"], [("thief" if n % 2 else "other", 5000 - n)]) for n in range(1, length + 1)]
    result = trace.ledger_hops(ledger(spark, txs), spark.createDataFrame([("c", "t0", "")], CASE), 10)
    assert [(h.hop, h.txid) for h in result.hops.orderBy("hop").collect()] == [(n, f"t{n}") for n in range(1, length + 1)]


def test_columns_and_way_back_of_a_chain(spark):
    led = ledger(spark, [START, ("t1", ["t0:0"], [("middle", 4900)]), ("t2", ["t1:0"], [("kraken", 4800)])])
    known = spark.createDataFrame(KNOWN, "address string, exchange string, label string, source string, is_evidential boolean, is_sanctioned boolean")
    cases = spark.createDataFrame([("c", "t0", "thief")], CASE)
    victims = spark.createDataFrame([("c", "victim")], "case_id string, address string")
    result = trace.full_trace(led, cases, victims, known)
    columns = {r.hop: r.from_column for r in flow.hop_columns(result, victims).collect()}
    assert columns == {0: 0, 1: 1, 2: 2}
    endpoints = flow.exchange_endpoints(result)
    assert [(e.address, e.name) for e in endpoints.collect()] == [("kraken", "Kraken")]
    path = flow.freeze_paths(endpoints, result, cases, victims).orderBy("position").collect()
    assert [n.subtitle for n in path] == ["victim", "thief", "middle", "kraken"]


def test_many_records_and_branches_are_followed_to_their_end(spark):
    led = ledger(spark, [START, ("w", ["t0:0"], [(f"a{n}", 700 - n) for n in range(8)])]
                 + [(f"s{n}", [f"w:{n}"], [(f"b{n}", 600)]) for n in range(8)]
                 + [("x", ["s7:0"], [("far", 590)]), ("end", ["x:0"], [("kraken", 580)])])
    want = ["w", *[f"s{n}" for n in range(8)], "x", "end"]
    rows = traced(spark, led, None)
    assert [txid for _, txid, *_ in rows] == want
    assert len(rows[0][2]) == 8 and rows[-1][3:] == ("exchange", "L2", "Kraken")
    cases = spark.createDataFrame([("c", "t0", "")], CASE)
    assert [h.txid for h in trace.ledger_hops(led, cases).hops.orderBy("hop").collect()] == want


def test_queries_on_whole_traces_go_past_the_first_hop(spark, monkeypatch):
    from ledgerspark.plans import QUERIES, trace_queries

    led = ledger(spark, [START, ("t1", ["t0:0"], [("middle", 4900)]), ("t2", ["t1:0"], [("kraken", 4800)])])
    known = spark.createDataFrame(KNOWN, "address string, exchange string, label string, source string, is_evidential boolean, is_sanctioned boolean")
    cases = spark.createDataFrame([("c", "t0", "thief")], CASE)
    victims = spark.createDataFrame([("c", "victim"), ("c", "another")], "case_id string, address string")
    whole = trace.full_trace(led, cases, victims, known)
    monkeypatch.setattr(trace_queries, "_full", lambda *_: whole)
    monkeypatch.setattr(trace_queries, "_cases", lambda *_: cases)
    monkeypatch.setattr(trace_queries, "_victims", lambda *_: victims)
    rows = lambda name: QUERIES[name + "_full"](spark, "").collect()
    assert [(r.address, r.hop) for r in rows("t13_exchange_endpoints")] == [("kraken", 2)]
    assert [(r.name, r.total_sats) for r in rows("t14_freeze_groups")] == [("Kraken", 4800)]
    assert {(r.from_address, r.to_address) for r in rows("t16_flow_edges")} >= {("thief", "middle"), ("middle", "kraken")}
    assert [r.max_column for r in rows("t17_flow_stats")] == [3] and len(rows("t17_flow_lanes")) == 4
    assert [r.member_count for r in rows("t18_collapse_victims")] == [2]
    assert ("middle", "kraken") in {(r.from_address, r.to_address) for r in rows("t18_collapsed_edges")}
    assert {r.hop for r in rows("t22_chain_of_custody")} == {r.hop for r in rows("t22_custody_legs")} == {0, 1, 2}
    assert max(r.hop_index for r in rows("c9_investigation_addresses")) == 2
