"""Operator 4: packing documents into windows by non-negative least squares over shallow length combinations.

A document's tokens (its text's ids and the closing id) are cut into whole windows and one rest. The
histogram of rests has at most WINDOW classes, so the driver holds it whatever the corpus. Combinations of up
to DEPTH length classes that fill a window are enumerated, their repeat counts solved against the histogram
by non-negative least squares, rounded down to what the histogram holds, and dealt to the rests by their
rank in their class. Rests that no combination takes are packed greedily (best fit, longest first) in
groups of bounded size.

Null and empty texts give the closing id alone. Repeated rows are packed one by one; a null ``doc_id`` is
kept. Other columns are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from ledgerspark.llm.common import Shelf, release, slices

WINDOW = 4096
END_ID = 2
STEP = 8
"""Tokens that one length class spans."""
DEPTH = 3
GROUP = 50_000
"""Rests that one greedy task packs, about."""
SLICE = 2 << 20
"""Bytes of text that are encoded at once; one longer text stays whole."""
REMEMBERED = 40 << 20
"""Bytes of words and their ids in either of the two tables that a task keeps, about."""
ENTRY = 200
"""Bytes that a remembered word takes besides its letters and ids, about."""

# The tokenizer's own way to cut a text, for texts without white space, letters and numbers beyond these.
_ODD = re.compile("[^\\t\\n\\r -~À-ÖØ-öø-ÿ‘’“”–—…]")
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
_tokenizers: dict[tuple[str, bool], Tokenizer] = {}


def _loaded(path: str, plain: bool) -> Tokenizer:
    """The tokenizer, or one for words that are cut, in lower case and composed already."""
    if (path, plain) not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        if plain:
            tokenizer.normalizer = normalizers.Sequence([])
            tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        _tokenizers[path, plain] = tokenizer
    return _tokenizers[path, plain]


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, each different word encoded once.

    The tokenizer cuts a text into words before anything else, so the ids of a text are those of its words in a row. Texts of Latin
    letters, digits and usual marks are cut here, in lower case, and new words go to the tokenizer many at a time and come back apart at the ids
    that end a word; other texts, and those that spell a token of the tokenizer's own like an end mark, go to the tokenizer whole. Two tables of bounded size remember words: when the
    younger is full it becomes the older, whose words return as they are met again. An encoder lives as long as a task.
    """

    def __init__(self, path: str) -> None:
        self.path, self.plain = path, _loaded(path, True)
        vocabulary = self.plain.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.added = [t.content.lower() for t in self.plain.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def one(self, text: str) -> bytes:
        return np.array(_loaded(self.path, False).encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        known, older, new = self.known, self.older, []
        for word in words:
            if word in older:
                known[word] = older[word]
            else:
                new.append(word)
        chunks = [new[i:i + 500] for i in range(0, len(new), 500)]
        for some, found in zip(chunks, self.plain.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(some):
                data = ids.tobytes()
                known.update(zip(some, map(data.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))
            else:
                known.update((w, self.one(w)) for w in some)
        self.held += sum(map(len, words)) + sum(len(known[w]) for w in words) + ENTRY * len(words)

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [None if _ODD.search(t) or any(map(low.__contains__, self.added)) else _CUT.findall(low)
               for t, low in ((t, t.lower()) for t in texts)]
        if self.held > REMEMBERED:
            self.older, self.known, self.held = self.known, {}, 0
        self.learn(set().union(*filter(None, cut)).difference(self.known))
        get = self.known.__getitem__
        return [self.one(t) if words is None else b"".join(map(get, words)) for t, words in zip(texts, cut, strict=True)]


_PIECE = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(),
          "part": pa.int64(), "nth": pa.int64(), "kind": pa.int32()}


def _cutter(path: str):
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches):
        encode, part = Encoder(path), TaskContext.get().partitionId()
        nth: dict[int, int] = {}
        for whole in batches:
            for batch in slices(whole, most=SLICE):
                out = []
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, WINDOW):
                        piece = ids[4 * start:4 * (start + WINDOW)]
                        length = len(piece) // 4
                        kind = -(-length // STEP) if length < WINDOW else 0
                        k = nth[kind] = nth.get(kind, -1) + 1
                        out.append((doc_id, start, length, zlib.crc32(piece), n, part, k, kind))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECE.values(), strict=True)], names=list(_PIECE))
        del encode
        release()

    return cut


def combinations(classes: int, depth: int = DEPTH) -> np.ndarray:
    """Rows of up to ``depth`` classes, largest first and 0 for none, whose sizes fill ``classes`` exactly."""
    rows = [(classes, 0, 0)]
    if depth >= 2:
        rows += [(classes - b, b, 0) for b in range(1, classes // 2 + 1)]
    if depth >= 3:
        rows += [(classes - b - c, b, c) for c in range(1, classes // 3 + 1) for b in range(c, (classes - c) // 2 + 1)]
    return np.array(rows)


def solve(histogram: np.ndarray, rows: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Whole repeat counts of ``rows`` that use no class more often than ``histogram[class]`` has it.

    min |A x - h|^2 over x >= 0 by multiplicative updates, A having a row's classes as a column.
    """
    h = histogram.astype(float)
    h[0] = 0
    usable = ((rows == 0) | (histogram[rows] > 0)).all(axis=1)
    picked = rows[usable]
    x = np.full(len(picked), h.sum() / max(1, 2 * len(picked)))
    want = np.where(picked > 0, h[picked], 0).sum(axis=1)
    for _ in range(rounds if len(picked) else 0):
        used = np.bincount(picked.ravel(), np.repeat(x, picked.shape[1]), len(h))
        used[0] = 0
        x *= want / np.maximum(used[picked].sum(axis=1), 1e-9)
    counts, left = np.zeros(len(rows), np.int64), histogram.astype(np.int64).copy()
    for i in np.argsort(-x, kind="stable"):
        need = np.bincount(picked[i][picked[i] > 0], minlength=len(left))
        some = np.flatnonzero(need)
        n = min(int(np.round(x[i])), *(int(left[c]) // int(need[c]) for c in some))
        if n > 0:
            left[some] -= n * need[some]
            counts[np.flatnonzero(usable)[i]] = n
    return counts


def _dealer(rows: np.ndarray, counts: np.ndarray):
    """A function on (class, rank) that gives (sequence, slot), -1 for rests that no combination takes."""
    kept = np.flatnonzero(counts)
    first = np.concatenate([[0], np.cumsum(counts[kept])])
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    ends: dict[int, list[int]] = {}
    for j, i in enumerate(kept):
        for slot, c in enumerate(rows[i]):
            if c:
                before = ends.setdefault(int(c), [0])[-1]
                slots.setdefault(int(c), []).append((before, int(first[j]), slot, int(counts[i])))
                ends[int(c)].append(before + int(counts[i]))

    def deal(batches):
        for batch in batches:
            kinds, ranks = (np.asarray(batch.column(n)) for n in ("kind", "rank"))
            sequence, slot = np.full(len(kinds), -1, np.int64), np.zeros(len(kinds), np.int64)
            for i, (c, r) in enumerate(zip(kinds.tolist(), ranks.tolist(), strict=True)):
                if c in ends and r < ends[c][-1]:
                    before, at, s, _ = slots[c][bisect.bisect_right(ends[c], r) - 1]
                    sequence[i], slot[i] = at + r - before, s
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence), pa.array(slot)], names=[*batch.schema.names, "sequence", "slot"])
        release()

    return deal


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best fit, longest first: each window takes the longest rest that still fits."""
    pdf = pdf.sort_values(["length", "part", "nth"], ascending=[False, True, True], ignore_index=True)
    waiting: dict[int, list[int]] = {}
    for i, n in enumerate(pdf["length"]):
        waiting.setdefault(int(n), []).append(i)
    sizes = sorted(waiting)
    sequence, slot = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
    now = 0
    while sizes:
        room, k = WINDOW, 0
        while (j := bisect.bisect_right(sizes, room) - 1) >= 0:
            n = sizes[j]
            i = waiting[n].pop()
            if not waiting[n]:
                del sizes[j]
            sequence[i], slot[i] = now, k
            room, k = room - n, k + 1
        now += 1
    return pdf.assign(sequence=sequence, slot=slot)


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: its document, place there, length and digest, and its sequence and place in it."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long, kind int"
    pieces = shelf.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _cutter(path), schema), "pieces")
    sizes = pieces.groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "kind", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "kind"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before")
    classes = WINDOW // STEP
    histogram = np.zeros(classes + 1, np.int64)
    for kind, n in sizes.groupBy("kind").agg(F.sum("n")).collect():  # at most one row per class
        histogram[kind] = n
    full, histogram[0] = int(histogram[0]), 0
    rows = combinations(classes)
    counts = solve(histogram, rows)
    names = [*pieces.columns, "rank"]
    dealt = shelf.put(ranked.where("kind > 0").select(*names).mapInArrow(
        _dealer(rows, counts), f"{schema}, rank long, sequence long, slot long"), "dealt")
    alone = ranked.where("kind = 0").select(*names, F.col("rank").alias("sequence"), F.lit(0).cast("long").alias("slot"))
    combined = dealt.where("sequence >= 0").withColumn("sequence", F.col("sequence") + full)
    rest = dealt.where("sequence < 0")
    groups = -(-rest.count() // GROUP) or 1
    packed = rest.withColumn("heap", F.pmod(F.xxhash64("part", "nth", "kind"), F.lit(groups))).groupBy("heap").applyInPandas(
        lambda pdf: _greedy(pdf), f"{schema}, rank long, sequence long, slot long, heap long")
    done = full + int(counts.sum())
    packed = packed.withColumn("sequence", done + F.col("sequence") * groups + F.col("heap")).drop("heap")
    together = combined.unionByName(packed)
    earlier = Window.partitionBy("sequence").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = together.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).unionByName(
        alone.withColumn("offset", F.lit(0).cast("long")))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence").alias("sequence_id"), "offset")
