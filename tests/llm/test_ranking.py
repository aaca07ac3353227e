"""Operator 12 against a scorer of every document."""

import math
import random
import re
from collections import Counter

import pytest

from ledgerspark.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranks_by_force(docs, items, top=10):
    bags = [(d, Counter(cut(t)), len(cut(t))) for d, t in docs if cut(t)]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        asked = Counter(cut(text))
        scores = []
        for d, bag, n in bags:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
                        for t, q in asked.items() if bag[t])
            if score > 0:
                scores.append((-score, -1 << 63 if d is None else d))
        out += [(item, i + 1, None if d == -1 << 63 else d, -s) for i, (s, d) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def found(spark, docs, items, **options):
    df = ranking.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                        spark.createDataFrame(items, "item_id long, text string"), **options)
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=lambda r: r[:2])


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "ünï", "x1", "42", "the", "of", "and"] + [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ",", ".", "-", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    # A third of all documents are copies of one, others share its bag in another order.
    docs = [(i, texts[0] if i % 3 == 0 else texts[rng.randrange(n)]) for i in range(n)]
    docs += [(n + i, " ".join(reversed(texts[0].split()))) for i in range(5)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(15)]
    return docs, [*items, (20, ""), (21, None), (22, "nowhere found"), (23, texts[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_equal_force(spark, seed):
    docs, items = corpus(seed, 150)
    assert found(spark, docs, items) == ranks_by_force(docs, items)


def test_blocks_and_small_batches_change_nothing(spark, monkeypatch):
    docs, items = corpus(3, 90)
    monkeypatch.setattr(ranking, "CELLS", 40)
    assert found(spark, docs, items, tokens=20) == ranks_by_force(docs, items)
    assert found(spark, docs, items, top=3) == ranks_by_force(docs, items, top=3)


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    items = [(1, "the quick FOX"), (2, "edon nobody"), (2, "ating"), (None, "fox")]
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = ranking.search(odd_docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == ranks_by_force(docs, [(1, "the quick FOX"), (2, "edon nobody ating")])
    one = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert ranking.search(no_docs, one).collect() == []
    assert ranking.search(odd_docs, one.limit(0)).collect() == []
