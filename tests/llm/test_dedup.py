"""Operators 1, 3 and 5 against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from ledgerspark.llm import repeats, simhash, vectors
from ledgerspark.llm.common import components


def passages_by_force(docs):
    """Every 100-byte string of every document, its first place, and what that leaves of each document."""
    seen = {}
    key = lambda d: -1 << 63 if d is None else d
    for d, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - 99):
            s = b[p:p + 100]
            seen[s] = min(seen.get(s, (key(d), p)), (key(d), p))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if seen[b[p:p + 100]] != (key(d), p):
                gone[p:p + 100] = b"\1" * 100
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeated(df):
    rows = repeats.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted(map(tuple, rows), key=str)


def made_of_passages(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 30)))
                 for _ in range(rng.randint(0, 6))]
        docs.append((i * 3, "\n".join(parts)))
    return docs + [(1000, "x" * 350), (1001, "ab" * 200), (1002, "x" * 99), (1003, "x" * 100), (1004, passages[0] * 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    docs = made_of_passages(seed, 60)
    random.Random(seed).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert repeated(df) == sorted(passages_by_force(docs), key=str)


def test_repeats_of_crowded_triggers(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 1)  # every shared trigger takes the way of large groups
    docs = made_of_passages(3, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert repeated(df) == sorted(passages_by_force(docs), key=str)


def test_repeats_of_odd_documents(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert repeated(odd_docs) == sorted(passages_by_force(docs), key=str)
    assert repeated(no_docs) == []


def test_suffix_classes():
    data = np.frombuffer(b"abracadabra" * 30, np.uint8)
    ranks = repeats.suffix_classes(data)
    strings = [bytes(data[i:i + 100]) for i in range(len(ranks))]
    assert len(ranks) == len(data) - 99
    assert [int(r) for r in ranks] == [sorted(set(strings)).index(s) for s in strings]


def prints_by_force(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_force(values, close):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if close(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_equals_brute_force(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rng = random.Random(4)
    base = [" ".join(rng.choice("la ba do mi re so ti fa".split()) + str(rng.randint(0, 9)) for _ in range(200)) for _ in range(4)]
    for i in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "zz"
        docs.append((100 + i, " ".join(words)))
    prints = [prints_by_force(t) for _, t in docs]
    group = components_by_force(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {g: min((d for (d, _), h in zip(docs, group, strict=True) if h == g and d is not None), default=None) for g in group}
    want = sorted(((d, p, least[g]) for (d, _), p, g in zip(docs, prints, group, strict=True)), key=str)
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(no_docs).collect() == []


def test_simhash_blocks_and_one_of_each(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    values = [1 << b for b in range(0, 40)]
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.node: r.component for r in components(spark, simhash.links(frame)).collect()}
    assert set(found) == set(values) and len(set(found.values())) == 1
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 6, None, 7], key=str)
    assert simhash.one_of_each(no_docs).collect() == []


def test_thresholds_share_out_the_distance():
    cost, chosen = simhash.allocate(np.array([[0, 1, 9], [0, 5, 9], [0, 2, 3]], float), 2 - 3 + 1)
    assert sum(chosen) == 0 and cost == min(
        a + b + c for x, a in enumerate([0, 1, 9]) for y, b in enumerate([0, 5, 9]) for z, c in enumerate([0, 2, 3]) if x + y + z == 3)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(7, k) for k in range(1000, 1400)] + [(5, 5), (3, 4), (4, 3)]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{k: 7 for k in [7, *range(1000, 1400)]}, 3: 3, 4: 3}


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 40)
    monkeypatch.setattr(vectors, "BLOCK", 25)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    x = [(centres[rng.integers(30)] + rng.normal(size=16) * 0.08).astype(np.float32).tolist() for _ in range(400)]
    x += [x[0], x[0], x[5], None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0] * 8, [2.0] * 8]
    rows = [(i * 2, v) for i, v in enumerate(x)] + [(None, x[1])]
    got = {(r.vec_id): r for r in vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    usable = [i for i, (_, v) in enumerate(rows) if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]

    def close(i, j):
        a, b = (np.array(rows[k][1], float) for k in (i, j))
        return len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95

    group = dict(zip(usable, components_by_force(usable, close), strict=True))
    links = {i: sum(close(i, j) for j in usable if j != i) for i in usable}
    want = sum(links.values())
    assert 0.9 * want <= sum(r.n_links for r in got.values()) <= want
    for i, (vec, _) in enumerate(rows):
        least = min((rows[j][0] for j in usable if i in group and group[j] == group[i] and rows[j][0] is not None), default=vec)
        assert got[vec].component_id == (least if i in group else vec)
        assert got[vec].kept == (vec is not None and got[vec].component_id == vec)


def test_vectors_of_an_empty_table(spark):
    assert vectors.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
