"""Operator 11 against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from ledgerspark.llm import spelling


def words_by_force(docs, every=31):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_force(docs, every=31):
    n = words_by_force(docs, every)
    form, count = {}, {}
    for w in n:
        partners = [v for v in n if near(w, v)]
        count[w] = len(partners)
        best = min(partners, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], None if form[w] is None else n[form[w]]))
    return sorted(out)


def found(df, **options):
    return sorted(map(tuple, spelling.variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def corpus(seed, n):
    rng = random.Random(seed)
    letters = "aabé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ÀÉÎöüßÿ", "Streets"]
    words, weights = [], []
    for i, w in enumerate(base):
        words.append(w)
        weights.append(1000 if i % 3 == 0 else 100)
        for _ in range(4):
            k = rng.randrange(len(w))
            words.append(rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]]))
            weights.append(rng.choice([1, 5, 40]))
    return [(i, " ".join(rng.choices(words, weights, k=60)).replace("a ", "A, ")) for i in range(n)]


@pytest.mark.parametrize(("seed", "crowd"), [(1, 20_000), (2, 3), (3, 12)])
def test_variants_equal_all_pairs(spark, seed, crowd):
    docs = corpus(seed, 120)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(df, crowd=crowd) == variants_by_force(docs)


def test_small_counters_change_nothing(spark, monkeypatch):
    docs = corpus(4, 40)
    monkeypatch.setattr(spelling, "HELD", 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df, every=0) == variants_by_force(docs, every=0)


def test_forms_lead_on(spark):
    text = " ".join(["streetz"] * 2 + ["streets"] * 20 + ["streetsx"] * 300)
    assert found(spark.createDataFrame([(1, text)], "doc_id long, text string"), every=0) == [
        ("streets", "streetsx", "streetsx", 20, 2, 300), ("streetsx", None, "streetsx", 300, 1, None), ("streetz", "streets", "streetsx", 2, 1, 20)]


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(odd_docs) == variants_by_force(docs)
    assert found(no_docs) == []
