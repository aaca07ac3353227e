"""Blocks of seeds: a row of a level should carry many of its block's bits."""

from ledgerspark.operators import sweep


def test_seeds_that_reach_the_same_share_blocks(spark):
    hubs, each = 8, 512
    pairs = [(f"a{i:05d}", f"hub{i % hubs}") for i in range(hubs * each)]
    spends = spark.createDataFrame([(a, f"t{a}") for a, _ in pairs], "address string, txid string")
    pays = spark.createDataFrame([(f"t{a}", h) for a, h in pairs], "txid string, address string")
    found = sweep.sweep(spends.selectExpr("address AS seed"), spends, pays, 1)
    rows = [(r.seed, r.address) for r in sweep.expanded(found.levels[1], found.seeds, "address").collect()]
    assert sorted(rows) == sorted(pairs)
    blocks = found.seeds.select("block").distinct().count()
    # Blocks dealt by a hash of the seed pay every hub: blocks * hubs rows.
    assert found.levels[1].count() <= blocks + hubs
