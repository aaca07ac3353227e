"""Matches and features of many seeds: put in order and joined as rows of a block, counted by hand."""

from pyspark.sql import functions as F

from ledgerspark.operators import patterns, sweep


def test_places_of_bits_are_row_numbers_whatever_the_slices(spark):
    seeds = spark.createDataFrame([(f"s{b}", 0, b) for b in (0, 1, 63, 64, 511)] + [("other", 1, 3)], "seed string, block long, bit int")
    has = lambda n, bit: n % (bit % 7 + 2) == 0
    bits = {0: (0, 1, 63, 64, 511), 1: (3,)}
    signed = lambda m: m - 2**64 if m >= 2**63 else m
    masks = lambda n, block: [signed(sum(1 << (b % 64) for b in bits[block] if b // 64 == w and has(n, b))) for w in range(sweep.WORDS)]
    rows = [(block, f"t{n:05d}", *masks(n, block)) for block in bits for n in range(3000) if any(has(n, b) for b in bits[block])]
    marked = spark.createDataFrame(rows, "block long, txid string, " + ", ".join(f"{m} long" for m in sweep.MASKS)).repartition(5)
    names = {(block, bit): f"s{bit}" if block == 0 else "other" for block in bits for bit in bits[block]}
    want = {(names[block, bit], f"t{n:05d}", at) for block in bits for bit in bits[block]
            for at, n in enumerate([n for n in range(3000) if has(n, bit)], 1)}
    got = sweep.numbered(marked, seeds, [F.col("txid")], "rank")
    assert {(r.seed, r.txid, r["rank"]) for r in got.collect()} == want
    some = sweep.numbered(marked, seeds, [F.col("txid")], "rank", 7)
    assert {(r.seed, r.txid, r["rank"]) for r in some.collect()} == {w for w in want if w[2] <= 7}


def test_no_row_of_a_seed_is_joined_or_sorted(spark):
    """Before, shapes and rules met a row per seed and transaction, and a window sorted those."""
    from ledgerspark.sources import fixture as fx

    sf = "/root/testdata/sf0.001"
    plans = [patterns.pattern_matches(fx.ledger(spark, sf), fx.seeds(spark, sf)), patterns.pattern_features(fx.ledger(spark, sf), fx.seeds(spark, sf))]
    for df in plans:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        above = plan[:plan.index("Generate")]
        assert "Window" not in above and "Join" not in above
