"""Hops by lists: every seed's nearest hops and transactions against a plain search, however edges are dealt."""

import random

import pytest

from ledgerspark.operators import sweep


def graph_of(seed):
    """Random transactions; one has more receivers than its senders are paired with, one address spends in many."""
    rng = random.Random(seed)
    name = lambda: f"a{rng.randrange(60):02d}"
    txs = {f"t{k:03d}": ([name() for _ in range(rng.choice([1, 1, 2, 3]))], [name() for _ in range(rng.choice([0, 1, 2, 3]))]) for k in range(50)}
    txs["wide"] = (["a00", "a01", "a02"], [f"w{k}" for k in range(40)] + ["a03"])
    txs["next"] = (["w7", "w7"], ["a04", "far"])
    return txs | {f"hub{k}": (["a05"], [f"h{k}"]) for k in range(40)}


def searched(txs, seed, max_hops):
    hops, edge = {seed: 0}, [seed]
    for hop in range(1, max_hops + 1):
        edge = sorted({o for i, outs in txs.values() if set(i) & set(edge) for o in outs} - set(hops))
        hops |= dict.fromkeys(edge, hop)
    near = {t: min((hops[a] for a in i if hops.get(a)), default=None) for t, (i, _) in txs.items()}
    return hops, {t: h for t, h in near.items() if h}


@pytest.mark.parametrize("edges", [1 << 20, 16])
def test_hops_and_transactions_equal_a_plain_search(spark, monkeypatch, edges):
    monkeypatch.setattr(sweep, "PIECE_EDGES", edges)
    txs = graph_of(3)
    spends = spark.createDataFrame([(a, t) for t, (i, _) in txs.items() for a in i] + [(None, "t000")], "address string, txid string")
    pays = spark.createDataFrame([(t, a) for t, (_, o) in txs.items() for a in o] + [("t000", None)], "txid string, address string")
    seeds = ["a00", "a05", "a33", "nowhere", *[f"a{k}" for k in range(40, 60)]]
    only = {t for t in txs if t[-1] in "37"} | {"next"}
    found = sweep.sweep(spark.createDataFrame([(s,) for s in seeds], "seed string"), spends, pays, 3, spent_from=True,
                        only=spark.createDataFrame([(t,) for t in only], "txid string"))
    got = {(r.seed, r.address): hop for hop, level in enumerate(found.levels) for r in sweep.expanded(level, found.seeds, "address").collect()}
    seen = {(r.seed, r.txid): hop for hop, tx in enumerate(found.transactions, 1) for r in sweep.expanded(tx, found.seeds, "txid").collect()}
    counts = {r.seed: r.n for r in found.near.join(found.seeds, ["block", "bit"]).collect()}
    want = {s: searched(txs, s, 3) for s in seeds}
    assert got == {(s, a): h for s, (hops, _) in want.items() for a, h in hops.items()}
    assert seen == {(s, t): h for s, (_, near) in want.items() for t, h in near.items() if t in only}
    assert counts == {s: len(near) for s, (_, near) in want.items() if near}


def test_bits_move_once_per_address_and_not_once_per_edge(spark):
    """An address that pays 200 others sends its bits in a row for each of its lists, which are few."""
    spends = spark.createDataFrame([("hub", f"t{k}") for k in range(200)], "address string, txid string")
    pays = spark.createDataFrame([(f"t{k}", f"o{k}") for k in range(200)], "txid string, address string")
    links = sweep._links(spark.createDataFrame([("hub",)], "seed string"), spends, pays, True, None)
    assert links.pays.count() == 1 and links.spends.count() == 1
    assert links.pays.first().n == 200
