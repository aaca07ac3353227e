"""Walks, clusters, patterns and risk on literal and random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import labels
from ledgerspark.functions.rank import ranked, top_per
from ledgerspark.operators import clusters, graph, heuristics, patterns, risk, sweep
from ledgerspark.operators.ledger import Ledger
from tests.walkers import components, simple_paths

IN = "txid string, address string"


def tables(spark, txs):
    """``txs``: (txid, [input addresses], [output addresses])."""
    ins = [(t, n, "p", n, a, 10) for t, i, _ in txs for n, a in enumerate(i)]
    outs = [(t, n, a, 10, None) for t, _, o in txs for n, a in enumerate(o)]
    return (
        spark.createDataFrame(ins, "txid string, vin_index int, prev_txid string, prev_vout int, address string, amount_sats bigint"),
        spark.createDataFrame(outs, "txid string, vout_index int, address string, amount_sats bigint, spent_by_txid string"),
    )


def random_txs(seed, n=60, addresses=14):
    rng = random.Random(seed)
    pick = lambda: [f"a{rng.randrange(addresses):02d}" for _ in range(rng.choice([1, 1, 2, 3]))]
    return [(f"t{k:03d}", pick(), pick()) for k in range(n)]


def seeds_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "seed string")


@pytest.mark.parametrize("max_hops", [1, 2, 3, 4])
def test_walk_reach_and_exposure_agree_with_path_listing(spark, max_hops):
    txs = random_txs(max_hops, n=18)
    inputs, outputs = tables(spark, txs)
    edges = {(a, b) for _, i, o in txs for a in i for b in o if a != b}
    got_edges = {(r.src, r.dst) for r in graph.address_edges(inputs, outputs).collect()}
    assert got_edges == edges
    names = ["a00", "a01", "nowhere"]
    reach = {(r.seed, r.address): r.min_hop for r in graph.reachable(seeds_of(spark, names), inputs, outputs, max_hops).collect()}
    exposure = {(r.seed, r.address): (r.min_hop, r.path_count)
                for r in graph.k_hop_exposure(seeds_of(spark, names), inputs, outputs, max_hops, 1000).collect()}
    for name in names:
        want = simple_paths(edges, name, max_hops)
        assert {a: v for (s, a), v in exposure.items() if s == name} == want
        assert {a: h for (s, a), h in reach.items() if s == name and h > 0} == {a: h for a, (h, _) in want.items()}
        assert reach[name, name] == 0
    for limit in (3,):
        rows = graph.k_hop_exposure(seeds_of(spark, names), inputs, outputs, max_hops, limit).orderBy("seed", "rank").collect()
        for name in names:
            want = sorted(simple_paths(edges, name, max_hops).items(), key=lambda kv: (kv[1][0], -kv[1][1], kv[0]))[:limit]
            assert [(r.address, (r.min_hop, r.path_count)) for r in rows if r.seed == name] == want


def test_cycle_back_to_the_seed_and_self_change(spark):
    inputs, outputs = tables(spark, [("t1", ["s"], ["b", "s"]), ("t2", ["b"], ["s", "c"]), ("t3", ["s"], ["c"])])
    rows = graph.k_hop_exposure(seeds_of(spark, ["s"]), inputs, outputs, 3, 10).orderBy("rank").collect()
    assert [(r.address, r.min_hop, r.path_count) for r in rows] == [("c", 1, 2), ("b", 1, 1)]


def test_hub_transaction_reaches_without_pairs(spark):
    """300 inputs and 300 outputs: the reach plan joins addresses with transactions only."""
    many = [f"i{n}" for n in range(300)]
    inputs, outputs = tables(spark, [("hub", many, [f"o{n}" for n in range(300)])])
    reach = graph.reachable(seeds_of(spark, ["i0", "i1"]), inputs, outputs, 2)
    assert reach.where("min_hop = 1").count() == 600


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_trim_groups_and_avoid_cross_joins(spark):
    inputs, outputs = tables(spark, random_txs(3))
    top = plan_of(top_per(inputs, ["address"], [F.col("txid")], 5))
    assert top.count("WindowGroupLimit") == 2  # once before the shuffle and once after
    found = sweep.sweep(seeds_of(spark, ["a00"]), graph.spenders(inputs), graph.receivers(outputs), 2)
    plan = plan_of(sweep.expanded(found.levels[1], found.seeds, "address"))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_more_seeds_than_a_block_holds(spark):
    """1,500 seeds in a ring: every one reaches the two that follow it, and its bits are counted apart."""
    n = 1500
    inputs, outputs = tables(spark, [(f"t{k}", [f"a{k}"], [f"a{(k + 1) % n}"]) for k in range(n)])
    seeds = seeds_of(spark, [f"a{k}" for k in range(n)] * 2)
    got = {(r.seed, r.address): r.min_hop for r in graph.reachable(seeds, inputs, outputs, 2).collect()}
    assert got == {(f"a{k}", f"a{(k + h) % n}"): h for k in range(n) for h in range(3)}
    found = sweep.sweep(seeds, graph.spenders(inputs), graph.receivers(outputs), 2, spent_from=True)
    assert {r.n for r in sweep.bits_per_seed(found.transactions, found.seeds, "n").collect()} == {2}


def test_features_are_the_nearest_transactions(spark):
    txs = random_txs(11, n=80, addresses=12)
    inputs, outputs = tables(spark, txs)
    transactions = spark.createDataFrame([(t, n) for n, (t, _, _) in enumerate(txs)], "txid string, block_height bigint")
    led = Ledger(None, transactions, inputs, outputs)
    seeds = seeds_of(spark, ["a00", "a05", "nowhere"])
    reach = graph.reachable(seeds, inputs, outputs, 3)
    hops = {(r.seed, r.address): r.min_hop for r in reach.collect() if r.min_hop > 0}
    for limit in (3, 20, None):
        want = {}
        for seed in ("a00", "a05"):
            near = sorted((min(hops[seed, a] for a in i if (seed, a) in hops), t)
                          for t, i, _ in txs if any((seed, a) in hops for a in i))
            want[seed] = near[:limit]
        got = {}
        for r in patterns.pattern_features(led, seeds, 3, limit).collect():
            got.setdefault(r.seed, []).append((r.min_hop, r.txid))
        assert {s: sorted(v) for s, v in got.items()} == want, limit


@pytest.mark.parametrize("seed,addresses", [(1, 200), (2, 90), (3, 12)])
def test_clusters_equal_union_find(spark, seed, addresses):
    txs = random_txs(seed, n=60, addresses=addresses)
    inputs, _ = tables(spark, txs)
    want = components([(i[0], a) for _, i, _ in txs for a in i])
    got = {r.address: r.cluster_id for r in clusters.cio_clusters(inputs).collect()}
    assert got == want


def test_clusters_of_a_long_chain(spark):
    """A path of 200 links in random order still needs few rounds."""
    order = list(range(200))
    random.Random(4).shuffle(order)
    inputs, _ = tables(spark, [(f"t{n}", [f"a{order[n]:03d}", f"a{order[n + 1]:03d}"], []) for n in range(199)] or [])
    got = {r.cluster_id for r in clusters.cio_clusters(inputs).collect()}
    assert got == {"a000"}


@pytest.mark.parametrize("ins,outs,ratio,hop,rules", [
    (5, 2, 0.9, 1, {"PAT-001": 0.7}), (12, 1, 1.0, 6, {"PAT-001": 0.5}), (2, 8, 0.2, 2, {"PAT-002": 0.65}),
    (1, 2, 0.7, 1, {"PAT-003": 0.55}), (1, 2, 0.69, 1, {}), (1, 10, 0.5, 9, {"PAT-002": 0.5}), (3, 5, 0.9, 1, {}),
])
def test_rules_and_confidence(spark, ins, outs, ratio, hop, rules):
    row = spark.createDataFrame([("s", "t", hop, ins, outs, ratio)],
                                "seed string, txid string, min_hop int, input_addr_count bigint, output_addr_count bigint, top_output_ratio double")
    assert {r.rule_id: r.confidence for r in patterns.evaluate_matches(row).collect()} == rules


def test_rule_table(spark):
    rows = {r.rule_id: r for r in patterns.pattern_rules(spark).collect()}
    assert rows["PAT-002"].severity_weight == 18.0 and rows["PAT-002"].min_output_addr_count == 8
    assert rows["PAT-002"].min_input_addr_count is None


@pytest.mark.parametrize("category,weight", [
    ("Sanctioned entity", 35.0), ("HIGH_RISK_EXCHANGE", 16.0), ("exchange", 8.0), ("merchant", 10.0), ("scam fraud", 22.0)])
def test_category_weight(spark, category, weight):
    one = spark.range(1).select(labels.category_weight(F.lit(category)).alias("w"), labels.reason_code(F.lit("a-b c")).alias("r")).first()
    assert (one.w, one.r) == (weight, "EXPOSURE_TO_A_B_C_ENTITY")


def test_score_is_capped_and_empty_scores_zero(spark):
    findings = spark.createDataFrame([("a", 35.0, 1.0)] * 4 + [("b", 24.995, 1.0)],
                                     "seed string, base_contribution double, confidence double")
    got = {r.seed: (r.score, r.risk_band, r.findings_count) for r in risk.compute_risk(seeds_of(spark, "abc"), findings).collect()}
    assert got == {"a": (100.0, "critical", 4), "b": (25.0, "medium", 1), "c": (0.0, "low", 0)}


def test_ranked_equals_row_number(spark):
    df = spark.range(2000).selectExpr("id % 3 AS k", "id % 7 AS c", "id")
    rows = ranked(df, ["k"], "c", ["id"], "n").collect()
    for k in range(3):
        own = sorted((r for r in rows if r.k == k), key=lambda r: (r.c, r.id))
        assert [r.n for r in own] == list(range(1, len(own) + 1))


def test_layering_and_peeling_chains(spark):
    edges = spark.createDataFrame([("x", "a"), ("a", "b"), ("b", "c"), ("c", "y"), ("c2", "y"), ("p", "q"), ("q", "p")],
                                  "src string, dst string")
    rows = heuristics.layering(edges, 2).collect()
    assert [(r["head"], r["length"], r["tail"]) for r in rows] == [("a", 3, "c")]
    shapes = spark.createDataFrame([(f"t{n}", 1, 2, 80, 100) for n in range(3)] + [("z", 2, 2, 80, 100)],
                                   "txid string, input_addr_count bigint, output_addr_count bigint, max_output_sats bigint, total_output_sats bigint")
    outs = spark.createDataFrame(
        [(f"t{n}", 0, "a", 80, f"t{n + 1}" if n < 2 else "z") for n in range(3)] + [(f"t{n}", 1, "b", 20, None) for n in range(3)],
        "txid string, vout_index int, address string, amount_sats bigint, spent_by_txid string")
    rows = heuristics.peeling_chain(shapes, outs, 2).collect()
    assert [(r["head"], r["length"], r["tail"]) for r in rows] == [("t0", 3, "t2")]
