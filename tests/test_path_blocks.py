"""Path counts when the addresses of a block are dealt to several tasks."""

from ledgerspark.operators import graph
from tests.test_graph import random_txs, seeds_of, tables


def test_pieces_count_as_one(spark, monkeypatch):
    monkeypatch.setattr(graph, "PIECE_ADDRESSES", 3)
    txs = random_txs(5, n=20)
    inputs, outputs = tables(spark, txs)
    edges = {}
    for _, ins, outs in txs:
        for a in ins:
            edges.setdefault(a, set()).update(o for o in outs if o != a)
    names = sorted(edges)
    got = graph.k_hop_exposure(seeds_of(spark, names), inputs, outputs, 3)
    # Before, walks of the last hop were rows and no task summed them in place.
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for s in names:
        paths = [(s,)]
        for hop in (1, 2, 3):
            paths = [(*p, b) for p in paths for b in edges.get(p[-1], ()) if b not in p]
            for p in paths:
                old = want.get((s, p[-1]), (hop, 0))
                want[s, p[-1]] = (old[0], old[1] + 1)
    assert {(r.seed, r.address): (r.min_hop, r.path_count) for r in got.collect()} == want
