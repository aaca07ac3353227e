"""Operator 12: ranked lexical search that scores each different bag of query terms once.

Documents are cut to their bags: counts of the terms that some item has, and the length factor m. Bags are grouped by hash and verified by
their content; a class of equal bags has one score for every item, so classes are scored once, through an inverted index of the items, and
only the classes among an item's best are expanded to their members, by ascending ``doc_id``. The best ``top`` documents lie in the best
``top`` classes by score and least ``doc_id``, since every better class gives at least one document before a class's first.

Items go through in blocks of about TOKENS terms, so what a task holds of them is bounded whatever the number of items; statistics of the
corpus cover all documents, and each block reads all of them. A bag is as long as its document at most. Copies are summed before the shuffle.

A null or empty text has no terms and is neither counted nor found; an item without terms finds nothing. A null ``doc_id`` comes before all
others. Rows with equal ``doc_id`` are documents of their own and hold a rank each. Items are rows: repeated ones are ranked for each
different ``item_id``, equal rows once, texts of one ``item_id`` as one item. Very long texts are read whole. Only ``doc_id`` and ``text``, ``item_id`` and
``text`` are read. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import Shelf

TOP = 10
TOKENS = 500_000
"""Different terms of items, summed over items, that one block has, about."""
CELLS = 2_000_000
"""Scores that a task computes at once."""

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and all code points beyond ASCII, A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(_TERM).split()


def _item_terms(batches):
    for batch in batches:
        out = [(i, t.decode(), n) for i, text in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True)
               for t, n in Counter(terms(text)).items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)],
                                             names=["item_id", "term", "n"])


_BAG = "doc_id long, n long, terms array<int>, counts array<int>"


def _bags(vocabulary):
    """(doc_id, n, terms, counts) of the documents that have terms; terms by number, ascending."""

    def cut(batches):
        number = vocabulary.value
        wanted = number.keys()
        for batch in batches:
            out = []
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                found = terms(text)
                if found:
                    counts = Counter(found)
                    bag = sorted((number[t], counts[t]) for t in counts.keys() & wanted)
                    out.append((doc_id, len(found), [t for t, _ in bag], [c for _, c in bag]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 names=["doc_id", "n", "terms", "counts"])

    return cut


def _scored(index, top: int):
    """The best ``top`` classes of a task's for each item, best by score, then by the class's least ``doc_id``."""

    def score(batches):
        items, first, posting, weight = index.value
        best = {"item": np.zeros(0, np.int64), "score": np.zeros(0, np.int64), "least": np.zeros(0, np.int64), "row": np.zeros(0, np.int64)}
        rows: dict[int, tuple] = {}
        floor = np.ones(len(items), np.int64)
        seen = 0
        rows_at_once = max(1, CELLS // max(1, len(items)))
        for batch in batches:
            for begin in range(0, batch.num_rows, rows_at_once):
                some = batch.slice(begin, rows_at_once)
                bag, count = (some.column(some.schema.get_field_index(c)) for c in ("terms", "counts"))
                length = np.diff(np.asarray(bag.offsets))
                term, tf = np.asarray(bag.flatten()).astype(np.int64), np.asarray(count.flatten()).astype(np.int64)
                m = np.repeat(np.asarray(some.column(some.schema.get_field_index("m"))), length)
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
                row = np.repeat(np.arange(len(length)), length)
                size = first[term + 1] - first[term]
                at = np.repeat(first[term], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                scores = np.zeros(len(length) * len(items), np.int64)
                np.add.at(scores, np.repeat(row, size) * len(items) + posting[at], np.repeat(impact, size) * weight[at])
                scores = scores.reshape(len(length), len(items))
                r, i = np.nonzero(scores >= floor)
                if not len(r):
                    continue
                least = np.asarray(some.column(some.schema.get_field_index("least")))
                best = {"item": np.concatenate([best["item"], i]), "score": np.concatenate([best["score"], scores[r, i]]),
                        "least": np.concatenate([best["least"], least[r]]), "row": np.concatenate([best["row"], seen + r])}
                for k in np.unique(r).tolist():
                    rows[seen + k] = tuple(some.column(some.schema.get_field_index(c))[k].as_py() for c in ("h", "m", "terms", "counts"))
                seen += len(length)
                order = np.lexsort((best["least"], -best["score"], best["item"]))
                item = best["item"][order]
                opens = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
                nth = np.arange(len(item)) - np.repeat(opens, np.diff(np.append(opens, len(item))))
                order = order[nth < top]
                best = {k: v[order] for k, v in best.items()}
                full = nth == top - 1
                floor[item[full]] = best["score"][np.searchsorted(best["item"], item[full], "right") - 1]
                rows = {k: rows[k] for k in np.unique(best["row"]).tolist()}
        if len(best["item"]):
            out = [rows[k] for k in best["row"].tolist()]
            h, m, bag, count = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(items[best["item"]]), pa.array(best["score"]), pa.array(best["least"]), pa.array(h, pa.int64()), pa.array(m, pa.int64()),
                 pa.array(bag, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32()))],
                names=["item_id", "score", "least", "h", "m", "terms", "counts"])

    return score


NULL_ID = -(1 << 63)


def _block(texts: DataFrame, wanted: DataFrame, top: int, shelf: Shelf) -> DataFrame:
    """Ranks for the items of ``wanted`` (item_id, term, n), few enough to be held by every task."""
    spark = texts.sparkSession
    asked = wanted.collect()  # TOKENS rows, about
    number = {t: i for i, t in enumerate(sorted({r["term"] for r in asked}))}
    bags = shelf.put(texts.mapInArrow(_bags(spark.sparkContext.broadcast({t.encode(): i for t, i in number.items()})), _BAG), "bags")
    n_docs, n_terms = bags.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = bags.where(F.size("terms") > 0)
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = {r["term"]: r["w"] for r in df.select("term", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).alias("w")).collect()}
    items = np.array(sorted({r["item_id"] for r in asked}), np.int64)
    place = {int(v): i for i, v in enumerate(items)}
    postings = sorted((number[r["term"]], place[r["item_id"]], r["n"]) for r in asked)
    first = np.searchsorted(np.array([p[0] for p in postings], np.int64), np.arange(len(number) + 1))
    index = spark.sparkContext.broadcast((
        items, first, np.array([p[1] for p in postings], np.int64), np.array([p[2] * weight.get(p[0], 0) for p in postings], np.int64)))
    m = F.lit(25) + F.expr(f"(75L * n * {n_docs}L) div {max(1, n_terms)}L")
    members = held.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), m.alias("m"), "terms", "counts").withColumn(
        "h", F.xxhash64("terms", "counts", "m"))
    classes = members.groupBy("h", "m", "terms", "counts").agg(F.min("doc_id").alias("least"))
    first_best = classes.mapInArrow(_scored(index, top), "item_id long, score long, least long, h long, m long, terms array<int>, counts array<int>")
    order = [F.col("score").desc(), F.col("least")]
    chosen = shelf.put(first_best.withColumn("nth", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(
        F.col("nth") <= top).select("item_id", "score", "h", "m", "terms", "counts"), "classes")
    # The first members of each chosen class, then the first documents of each item.
    bag = ["h", "m", "terms", "counts"]
    own = members.join(chosen.select("h").distinct(), "h", "left_semi")  # trimmed to ``top`` rows a class before they move
    some = own.withColumn("nth", F.row_number().over(Window.partitionBy(*bag).orderBy("doc_id"))).where(F.col("nth") <= top)
    ranked = chosen.join(some.drop("nth"), bag).withColumn("rank", F.row_number().over(
        Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")))
    return ranked.where(F.col("rank") <= top).select(
        "item_id", "rank", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, tokens: int = TOKENS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id is not null").distinct().mapInArrow(_item_terms, "item_id long, term string, n long")
    asked = shelf.put(asked.groupBy("item_id", "term").agg(F.sum("n").alias("n")), "items")
    blocks = max(1, -(-asked.count() // tokens))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = [_block(texts, numbered.where(F.col("block") == b).drop("block"), top, shelf) for b in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
