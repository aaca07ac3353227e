"""Columns and ways back of large cases, against plain loops, and what one level of a trace reads."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import flow, trace
from tests.test_trace import ledger, traced

HOPS = ("case_id string, hop int, depth int, txid string, label string, block bigint, timestamp string, confidence string, "
        "confidence_label string, method string, notes string, is_sanctioned boolean, chain_end_reason string, exchange string, exchange_source string")


def as_trace(spark, legs):
    """``legs``: DataFrame (case_id, hop, side, ord, address, sats)."""
    none = F.lit(None).cast("string")
    full = legs.select("case_id", F.col("hop").cast("int").alias("hop"), "side", F.col("ord").cast("long").alias("ord"), "address",
                       F.col("sats").cast("long").alias("sats"), F.lit(False).alias("is_exchange"), none.alias("exchange"), none.alias("source"), none.alias("label"))
    hops = full.select("case_id", "hop").distinct().select(
        "case_id", "hop", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in HOPS.split(", ")[2:]])
    return trace.Trace(hops, full)


def victims_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "case_id string, address string")


def test_columns_of_a_case_of_a_hundred_thousand_hops(spark):
    n = 100_000
    hop = spark.range(n + 1).select(F.lit("c").alias("case_id"), F.col("id").alias("hop"))
    name = lambda c: F.concat(F.lit("a"), c.cast("string"))
    sent = hop.select("case_id", "hop", F.lit("from").alias("side"), F.lit(0).alias("ord"), name(F.col("hop")).alias("address"), F.lit(9).alias("sats"))
    # Hop h pays the senders of hops 50 h + 1 to 50 h + 50.
    paid = hop.select("case_id", "hop", F.lit("to").alias("side"), F.explode(F.sequence(F.lit(1), F.lit(50))).alias("ord"), F.lit(9).alias("sats")).where(
        50 * F.col("hop") + F.col("ord") <= n).select("case_id", "hop", "side", "ord", name(50 * F.col("hop") + F.col("ord")).alias("address"), "sats")
    columns = flow.hop_columns(as_trace(spark, sent.unionByName(paid)), victims_of(spark))
    first = [0, 1, 51, 2551]
    want = sum([(F.col("hop") >= f).cast("int") for f in first[1:]], F.lit(0))
    assert columns.count() == n + 1
    assert columns.where(F.col("from_column") != want).count() == 0


def test_a_way_back_of_ten_thousand_steps(spark):
    n = 10_000
    hop = spark.range(n).select(F.lit("c").alias("case_id"), F.col("id").alias("hop"))
    name = lambda c: F.concat(F.lit("a"), c.cast("string"))
    sent = hop.select("case_id", "hop", F.lit("from").alias("side"), F.lit(0).alias("ord"), name(F.col("hop")).alias("address"), F.lit(9).alias("sats"))
    paid = hop.select("case_id", "hop", F.lit("to").alias("side"), F.lit(0).alias("ord"), name(F.col("hop") + 1).alias("address"), F.lit(8).alias("sats"))
    tr = as_trace(spark, sent.unionByName(paid))
    ends = spark.createDataFrame([("c", "Kraken", f"a{n}"), ("c", "Binance", "a7000")], "case_id string, name string, address string")
    steps = flow.branch_traces(ends, tr, victims_of(spark))
    got = steps.groupBy("endpoint").agg(F.count(F.lit(1)), F.min("step"), F.max("step"), F.sum((F.col("hop") + 1 != F.col("step")).cast("int")),
                                        F.count_distinct("to_address")).collect()
    assert sorted(map(tuple, got)) == [("a10000", n, 1, n, 0, n), ("a7000", 7000, 1, 7000, 0, 7000)]
    ends = ends.where("name = 'Binance'")
    paths = flow.freeze_paths(ends, tr, spark.createDataFrame([("c", "a1")], "case_id string, recipient string"), victims_of(spark, [("c", "a0")]))
    assert paths.where("endpoint = 'a7000'").orderBy("position").limit(2).select("position", "kind").collect() == [(1, "victim"), (2, "recipient")]
    assert paths.where("endpoint = 'a7000'").count() == 7001


def random_legs(seed):
    rng = random.Random(seed)
    rows = []
    for case in ("c", "d"):
        for hop in range(rng.randint(4, 25)):
            for n in range(1 if hop or rng.random() < 0.6 else 3):
                rows.append((case, hop, "from", n, f"a{rng.randrange(14)}", rng.randrange(99)))
            rows += [(case, hop, "to", n, f"a{rng.randrange(14)}", rng.randrange(99)) for n in range(rng.randint(1, 3))]
    return rows


def columns_by_loop(rows, victims):
    out = {}
    for case in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == case]
        out[case, 0] = 0
        for hop in range(1, 1 + max(r[1] for r in mine)):
            sender = next(r[4] for r in mine if r[1] == hop and r[2] == "from")
            known = [out[case, r[1]] + (r[2] == "to") for r in mine if r[1] < hop and r[4] == sender and (r[2] == "to" or r[1] > 0)]
            out[case, hop] = min([*known, *([0] if (case, sender) in victims else [])], default=hop)
    return out


def ways_by_loop(rows, ends):
    out = []
    for case, _, end in ends:
        mine = [r for r in rows if r[0] == case]
        senders = lambda h: [r for r in mine if r[1] == h and r[2] == "from"]  # noqa: B023, E731
        made = {}
        for r in mine:
            if r[2] == "to" and r[4] not in {s[4] for s in senders(r[1])}:
                made[r[4]] = max(made.get(r[4], (-1,)), (r[1], r[3], r[5]))
        at, met = end, []
        while at in made and at not in met:
            met.append(at)
            lone = senders(made[at][0])
            if len(lone) != 1:
                break
            at = lone[0][4]
        out += [(case, end, len(met) - i, made[a][0], a, made[a][2]) for i, a in enumerate(met)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_columns_and_ways_equal_loops(spark, seed):
    rows = random_legs(seed)
    victims = {("c", "a1"), ("d", "a2")}
    legs = spark.createDataFrame(rows, "case_id string, hop int, side string, ord int, address string, sats int").repartition(3)
    tr = as_trace(spark, legs)
    got = {(r.case_id, r.hop): r.from_column for r in flow.hop_columns(tr, victims_of(spark, victims)).collect()}
    assert got == columns_by_loop(rows, victims)
    ends = [(c, "x", f"a{k}") for c in "cd" for k in range(14)]
    steps = flow._walk_back(spark.createDataFrame(ends, "case_id string, name string, address string"), tr, victims_of(spark, victims))[0]
    found = sorted((r.case_id, r.endpoint, r.length - r.pos, r.hop, r.address, r.sats) for r in steps.collect())
    assert found == ways_by_loop(rows, ends)


def peel(n):
    return [("t0", ["victim"], [("thief", 5000)]), *[(f"t{i:02}", [f"t{i - 1:02}:0" if i > 1 else "t0:0"], [(f"next{i}", 5000 - i), (f"rest{i}", 600)]) for i in range(1, n)]]


def test_levels_are_folded_and_dropped(spark, monkeypatch):
    monkeypatch.setattr(trace, "FOLD", 2)
    led = ledger(spark, peel(6))
    rows = traced(spark, led, None)
    assert [r[1] for r in rows] == [f"t{i:02}" for i in range(1, 6)]
    links = trace.ledger_hops(led, spark.createDataFrame([("c", "t0", "thief")], "case_id string, fraud_txid string, recipient string"))
    assert [r.txid for r in links.hops.orderBy("hop").collect()] == [f"t{i:02}" for i in range(1, 6)]


def test_a_level_reads_the_buckets_it_needs_where_they_are(spark):
    spends = trace.spend_table(ledger(spark, peel(30)))
    frontier = trace.materialize(spark.createDataFrame([("c", "t03")], "case_id string, txid string"), "frontier")
    level = spends.of(frontier)
    assert sorted(r.address for r in level.collect()) == ["next3", "rest3"]
    for hint in (level, spends.of(frontier).hint("merge")):
        plan = hint._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.split("\n") if "spends" in line and "FileScan" in line)
        assert "PartitionFilters: [isnotnull(bucket" in scan or "bucket#" in scan.split("PartitionFilters:")[1].split("]")[0]
        side = plan[:plan.index(scan)].split("FileScan")[-1]
        assert "Exchange" not in side or "Broadcast" in side or "Exchange hashpartitioning" not in side.split("BucketedRead")[-1].split("\n")[-1]
