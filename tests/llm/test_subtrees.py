"""Operator 13 against counting every window."""

import random
from collections import Counter

import numpy as np
import pytest

from ledgerspark.llm import subtrees
from tests.llm.test_dedup import made_of_passages


def cut(text):
    return (text or "").encode().split()


def kept_by_force(docs):
    n = Counter(tuple(w[i:i + 35]) for _, t in docs for w in [cut(t)] for i in range(len(w) - 34))
    out = []
    for d, t in docs:
        w = cut(t)
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if n[tuple(w[i:i + 35])] > 1:
                gone[i:i + 35] = [True] * 35
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def kept(df):
    return sorted(map(tuple, subtrees.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def corpus(seed, n):
    docs = made_of_passages(seed, n)
    rng = random.Random(seed)
    line = " ".join(f"common{i}" for i in range(50))
    docs += [(2000 + i, " ".join([*(f"a{rng.random()}" for _ in range(9)), line, *(f"b{rng.random()}" for _ in range(9))])) for i in range(n // 2)]
    return docs + [(3000, "z " * 34), (3001, "z " * 35), (3002, "y " * 36), (3003, "\t".join(line.split()[:40])), (3004, "a b " * 40)]


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_equals_force(spark, seed):
    docs = corpus(seed, 60)
    assert kept(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == kept_by_force(docs)


def test_groups_and_levels_change_nothing(spark, monkeypatch):
    docs = corpus(3, 40)
    monkeypatch.setattr(subtrees, "GROUP", 50)
    monkeypatch.setattr(subtrees, "FREQUENT", (3, 9))
    monkeypatch.setattr(subtrees, "SLICE", 2000)
    assert kept(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == kept_by_force(docs)


def test_spans(spark):
    line = " ".join(f"w{i}" for i in range(40))
    docs = [(1, f"x y {line} z"), (2, line)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in subtrees.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: [(2, 42)], 2: [(0, 40)]}


def test_deep_nodes():
    labels = np.array([[1, 1, 1, 2, 2], [5, 5, 6, 5, 5], [7, 7, 7, 7, 8]], np.uint32)
    assert subtrees.deep_nodes(labels).tolist() == [True, True, False, False, False]


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert kept(odd_docs) == kept_by_force(docs)
    assert kept(no_docs) == []
