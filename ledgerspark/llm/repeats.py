"""Operator 1: removal of repeated passages by prefix-free parsing.

A rolling hash runs over every document's bytes. Each LENGTH-byte string has a trigger, the leftmost GRAM-byte string in
it with the least hash; strings whose trigger is the same one make a phrase, so a document is parsed into phrases, and equal
strings lie at the same place of phrases with equal triggers wherever they occur. Equal phrases need no
comparison: all but the first occurrence are removed whole. What is left is the dictionary, one occurrence of each phrase;
phrases that share a trigger with a different phrase are compared by a suffix array: the bytes of the dictionary
phrases are ranked by their first 8, 16, 32, 64 and LENGTH bytes, and in each class of equal strings all but the first in
corpus order (``doc_id``, place) are removed.

Triggers that occur once in the corpus end the search for their phrases: a first pass counts triggers, a bit table of fixed
size (a filter; what it lets through in excess is harmless) keeps the others for the second. Repeats inside a slice of a
task are summed there before any shuffle. A trigger that more than CROWD dictionary phrases share is resolved by Spark
grouping the strings themselves.

Null and empty texts have no bytes. A null ``doc_id`` comes before all others. Documents with equal ``doc_id`` are one place in
order: repeated rows do not remove each other, and each returns a row. Only ``doc_id`` and ``text`` are read. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import Shelf, runs, slices, with_key

LENGTH = 100
GRAM = 32
WIDTH = LENGTH - GRAM + 1
CROWD = 20_000
"""Dictionary phrases of one trigger that one task compares."""
BITS = 28
"""The filter has 2 to this power bits at most (32 MB), and at least eight for each repeated trigger while that lasts."""
FIRST = -(1 << 63)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, _BACK)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def phrases(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(trigger, phrase, document, begin, count) of the phrases of documents laid end to end, ``starts`` having a last end.

    ``trigger`` and ``phrase`` are hashes of bytes; ``begin`` is the first of ``count`` string starts, within the document.
    """
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    up, down = (p[:n + 1] for p in _power_tables(n))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=total[1:])
    hashes = _mix((total[GRAM:] - total[:-GRAM]) * down[:n - GRAM + 1])
    place = np.uint64((1 << n.bit_length()) - 1)
    low = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= WIDTH:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < WIDTH:
        low = np.minimum(low[:len(low) - (WIDTH - span)], low[WIDTH - span:])
    trigger = (low & place).astype(np.int64)
    size = np.diff(starts)
    document = np.repeat(np.arange(len(size)), size)[:len(trigger)]
    at = np.flatnonzero(np.arange(len(trigger)) + LENGTH <= starts[document + 1])
    if not len(at):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    trigger, document = trigger[at], document[at]
    new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (document[1:] != document[:-1])]))
    count = np.diff(np.append(new, len(at)))
    begin = at[new]
    end = begin + count - 1 + LENGTH
    phrase = _mix((total[end] - total[begin]) * down[begin] + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes[trigger[new]], phrase, document[new], begin - starts[document[new]], count


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts end to end, and where each begins, with the last end."""
    texts = batch.column(2).cast(pa.binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def _passes(filter_of):
    """The parse of a task's documents; with a filter, phrases it keeps, else the triggers alone."""

    def parse(batches):
        for whole in batches:
            for batch in slices(whole):
                data, starts = _flat(batch)
                key, phrase, document, begin, count = phrases(data, starts)
                if filter_of is None:
                    found, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["trigger", "n"])
                    continue
                size, bits = filter_of.value
                at = key & np.uint64(size - 1)
                kept = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                key, phrase, document, begin, count = (a[kept] for a in (key, phrase, document, begin, count))
                ids, texts = (np.asarray(batch.column(i))[document] for i in (0, 1))
                # Of equal phrases in this slice, the later ones are repeats whatever the corpus holds.
                order = np.lexsort((begin, ids, phrase, key))
                same = np.zeros(len(order), bool)
                k, p = key[order], phrase[order]
                same[1:] = (k[1:] == k[:-1]) & (p[1:] == p[:-1])
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                tied = (ids[order] == ids[order][head]) & (begin[order] == begin[order][head])
                repeat = np.zeros(len(order), bool)
                repeat[order] = same & ~tied
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(ids), pa.array(texts),
                     pa.array(begin), pa.array(count), pa.array(repeat)],
                    names=["trigger", "phrase", "id", "_key", "begin", "count", "repeat"])

    return parse


def _filter(triggers: DataFrame, n: int):
    """A bit table of the triggers, put together from words that tasks have summed."""
    bits = min(BITS, max(16, (8 * n).bit_length()))
    blob = 1 << max(0, bits - 6 - 6)  # words in each of 64 pieces

    def words(batches):
        table = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            at = np.asarray(batch.column(0)).view(np.uint64) & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(table, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[some].view(np.int64))], names=["at", "word"])

    def blobs(frames):
        for (piece,), pdf in runs(frames, ["piece"]):
            table = np.zeros(blob, np.int64)
            table[pdf["at"].to_numpy() % blob] = pdf["word"].to_numpy()
            yield pd.DataFrame({"piece": [piece], "bits": [table.tobytes()]})

    summed = triggers.select("trigger").mapInArrow(words, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    pieces = summed.withColumn("piece", F.floor(F.col("at") / blob)).repartition("piece").sortWithinPartitions("piece").mapInPandas(
        blobs, "piece long, bits binary")
    table = np.zeros(1 << (bits - 3), np.uint8)
    for piece, part in pieces.collect():  # 64 pieces of at most half a megabyte
        table[piece * blob * 8:(piece + 1) * blob * 8] = np.frombuffer(bytes(part), np.uint8)
    return triggers.sparkSession.sparkContext.broadcast((1 << bits, table))


def suffix_classes(data: np.ndarray) -> np.ndarray:
    """For each place with LENGTH bytes ahead, the rank of those bytes among all such strings of ``data``.

    A suffix array to depth LENGTH by prefix doubling: ranks of 8 bytes, then of 16, 32 and 64, then of LENGTH, each from two ranks of the one before.
    """
    n = len(data) - 7
    value = np.zeros(n, np.uint64)
    for i in range(8):
        value = (value << np.uint64(8)) | data[i:i + n]
    rank, depth = np.unique(value, return_inverse=True)[1].astype(np.uint64), 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        pair = (rank[:-step] << np.uint64(32)) | rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        depth += step
    return rank


def _compare(frames):
    """Removed strings of dictionary phrases, as (id, _key, low, high) runs of bytes.

    Frames come sorted by trigger, and strings of different triggers differ, so phrases are compared some megabytes at a
    time, a trigger's phrases together.
    """
    held = None
    for pdf in frames:
        held = pdf if held is None else pd.concat([held, pdf])
        if len(held) and int(held["count"].sum()) + LENGTH * len(held) > 1 << 21:
            key = held["trigger"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last trigger may go on
            if cut:
                yield _removed(held.iloc[:cut])
                held = held.iloc[cut:]
    if held is not None and len(held):
        yield _removed(held)


def _removed(pdf: pd.DataFrame) -> pd.DataFrame:
    data = np.frombuffer(b"".join(pdf["bytes"]), np.uint8)
    count = pdf["count"].to_numpy()
    length = count + LENGTH - 1
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    rank = suffix_classes(data)
    row = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    rank = rank[first[row] + inside]
    ids, begin = pdf["id"].to_numpy()[row], pdf["begin"].to_numpy()[row] + inside
    order = np.lexsort((begin, ids, rank))
    r = rank[order]
    same = np.concatenate([[False], r[1:] == r[:-1]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    tied = (ids[order] == ids[order][head]) & (begin[order] == begin[order][head])
    gone = np.zeros(len(order), bool)
    gone[order] = same & ~tied
    # Runs of removed starts within a phrase.
    at = np.flatnonzero(gone)
    if not len(at):
        return pd.DataFrame({"id": [], "_key": [], "low": [], "high": []}, dtype="int64")
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])]))
    last = np.append(cut[1:], len(at)) - 1
    return pd.DataFrame({"id": ids[at[cut]], "_key": pdf["_key"].to_numpy()[row[at[cut]]],
                         "low": begin[at[cut]], "high": begin[at[last]] + LENGTH})


def _finish(batches):
    for batch in batches:
        out = []
        for text, low, high in zip(*(batch.column(n).to_pylist() for n in ("bytes", "low", "high")), strict=True):
            text = text or b""
            if not low:
                out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), []))
                continue
            a, b = np.array(low), np.array(high)
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.concatenate([[True], a[1:] > b[:-1]])
            begins, ends = a[new], b[np.append(np.flatnonzero(new)[1:], len(a)) - 1]
            kept = b"".join(text[x:y] for x, y in zip([0, *ends.tolist()], [*begins.tolist(), len(text)], strict=True))
            out.append((len(text), len(text) - len(kept), len(begins), hashlib.sha256(kept).hexdigest(),
                        [{"low": x, "high": y} for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]))
        if out:
            n, gone, spans, digest, cuts = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(digest, pa.string()),
                 pa.array(cuts, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(id, _key, low, high): runs of bytes that repeat an earlier passage; ``id`` is ``doc_id``, null as the least."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    rows = with_key(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("id"),
                                F.col("text").cast("string").alias("text"))).select("id", "_key", "text")
    counted = rows.mapInArrow(_passes(None), "trigger long, n long").groupBy("trigger").agg(F.sum("n").alias("n"))
    repeated = shelf.put(counted.where("n > 1").select("trigger"), "triggers")
    kept = _filter(repeated, repeated.count())
    parsed = rows.mapInArrow(_passes(kept), "trigger long, phrase long, id long, _key long, begin long, count long, repeat boolean")
    # A slice's repeats are done with; of the others the first occurrence in corpus order is the dictionary's.
    # Repeats share a place in the window only with themselves, so a phrase with many of them is spread.
    spread = F.when(F.col("repeat"), F.xxhash64("id", "_key", "begin")).otherwise(0)
    order = Window.partitionBy("trigger", "phrase", spread).orderBy("id", "begin")
    placed = shelf.put(parsed.withColumn("nth", F.when(F.col("repeat"), 2).otherwise(
        F.rank().over(order))).drop("repeat"), "phrases")
    whole = placed.where("nth > 1").select("id", "_key", F.col("begin").alias("low"), (F.col("begin") + F.col("count") - 1 + LENGTH).alias("high"))
    dictionary = placed.where("nth = 1").drop("nth")
    shared = dictionary.groupBy("trigger").agg(F.count_distinct("phrase").alias("n")).where("n > 1")
    compared = dictionary.join(shared, "trigger")
    wanted = compared.groupBy("id", "_key").agg(F.collect_list(F.struct("trigger", "begin", "count", "n")).alias("found"))
    cut = shelf.put(rows.join(wanted, ["id", "_key"]).mapInArrow(
        _cut, "id long, _key long, trigger long, begin long, count long, n long, bytes binary"), "dictionary")
    small = cut.where(F.col("n") <= CROWD).repartition("trigger").sortWithinPartitions("trigger").mapInPandas(
        _compare, "id long, _key long, low long, high long")
    strings = cut.where(F.col("n") > CROWD).select("id", "_key", "begin", F.posexplode(F.expr(
        f"transform(sequence(1, int(count)), i -> substring(bytes, i, {LENGTH}))")).alias("i", "s")).select(
        "id", "_key", (F.col("begin") + F.col("i")).alias("low"), "s")
    first = strings.groupBy("s").agg(F.min(F.struct("id", "low")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    large = strings.join(first, "s").where(F.struct("id", "low") != F.col("first")).select(
        "id", "_key", "low", (F.col("low") + LENGTH).alias("high"))
    return whole.unionByName(small).unionByName(large)


def _cut(batches):
    """The bytes of each wanted phrase."""
    for batch in batches:
        out = []
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        for i, (doc, key, found) in enumerate(zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("id", "_key", "found")), strict=True)):
            text = texts[i].as_py() or b""
            out += [(doc, key, f["trigger"], f["begin"], f["count"], f["n"], text[f["begin"]:f["begin"] + f["count"] - 1 + LENGTH]) for f in found]
        if out:
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                             names=["id", "_key", "trigger", "begin", "count", "n", "bytes"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: bytes, removed bytes and runs, the digest of what is kept, and the removed ``spans`` (bytes)."""
    spans = repeated_passages(docs).distinct().groupBy("id", "_key").agg(
        F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    rows = with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).withColumn(
        "id", F.coalesce("doc_id", F.lit(FIRST)))
    joined = rows.join(spans, ["id", "_key"], "left").select("doc_id", F.col("text").cast("binary").alias("bytes"), "low", "high")
    return joined.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                      "spans array<struct<low:long,high:long>>")
