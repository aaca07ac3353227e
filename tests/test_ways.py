"""H2 and H3 on levels of bits, against a plain search."""

import pytest

from ledgerspark.operators import graph, heuristics, sweep
from tests.test_sweep_lists import graph_of, searched


@pytest.mark.parametrize("edges", [1 << 20, 16])
def test_ways_and_dead_ends_equal_a_plain_search(spark, monkeypatch, edges):
    monkeypatch.setattr(sweep, "PIECE_EDGES", edges)
    txs = graph_of(5)
    inputs = spark.createDataFrame([(t, a) for t, (i, _) in txs.items() for a in i], "txid string, address string")
    outputs = spark.createDataFrame([(t, a) for t, (_, o) in txs.items() for a in o], "txid string, address string")
    seeds = ["a00", "a05", "nowhere", *[f"a{k}" for k in range(40, 60)]]
    found = graph.reach(spark.createDataFrame([(s,) for s in seeds], "seed string"), inputs, outputs, 3)
    ways = heuristics.reconvergence(found, graph.address_edges(inputs, outputs))
    plan = ways._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.seed, r.address): (r.min_hop, r.predecessors) for r in ways.collect()}
    ends = {(r.seed, r.address): r.min_hop for r in heuristics.dead_ends(found, inputs, outputs).collect()}
    pays = {(a, b) for i, o in txs.values() for a in i for b in o if a != b}
    onward = {a for a, _ in pays}
    want, want_ends = {}, {}
    for s in seeds:
        hops, _ = searched(txs, s, 3)
        for a, h in hops.items():
            n = sum((b, a) in pays and hops[b] == h - 1 for b in hops)
            want |= {(s, a): (h, n)} if n > 1 else {}
            want_ends |= {(s, a): h} if h and a not in onward else {}
    assert got == want and want
    assert ends == want_ends and want_ends
    assert "Generate" not in plan[:plan.index("MapInArrow")]  # no row of a seed is joined with edges
