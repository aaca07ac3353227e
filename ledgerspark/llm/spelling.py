"""Operator 11: spelling variants by asymmetric q-chunks.

Words are runs of letters, A-Z lower-cased; those of LEAST code points or more that occur at least twice are compared. Two words are
near if one inserted, deleted or replaced code point makes them equal. The shorter word of a pair (either, when equal) contributes two disjoint
chunks, its halves; the other contributes its grams of their lengths. One edit leaves one chunk whole, and it starts in the other word where
it did or one place later: only grams within that shift can meet a chunk, so only those are sent. Words meet in groups of equal chunk, and
what the chunk leaves, the zone, holds the edit. It is verified inside the group without listing pairs: words of equal length meet under the zone
with one place blanked, a longer word meets the shorter under the zone with one code point deleted. An edit lies in one half, so a pair
counts in one group. Groups return, for each word, the number of its near words and the best of them, so nothing that grows with the
square of a group leaves it. A group of more than CROWD words is split by the chunks of its zone in the same way, until groups are small
or the zone is a single place.

Occurrences may be altered: where the unsigned crc32 of ``<doc_id>:<word>`` is a multiple of EVERY, one code point is
deleted (a test corpus made from clean text). A null ``doc_id`` counts as an empty one there. Null and empty texts have no words; very
long texts are read whole; repeated rows count again; only ``doc_id`` and ``text`` are read. An empty table gives no rows. Among near words
of equal count the smallest in code-point order is the form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import Shelf

LEAST = 7
TWICE = 2
RATIO = 10
EVERY = 31
CROWD = 20_000
"""Words of one group that one task verifies."""
HELD = 200_000
"""Different words that a task counts before it sends them on."""

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _counts(every: int):
    def count(batches):
        held: Counter[str] = Counter()

        def send():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
                    if len(word) < LEAST:
                        continue
                    h = zlib.crc32(word.encode(), seed)
                    if every and h % every == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1:]
                        if len(word) < LEAST:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield send()
                    held.clear()
        if held:
            yield send()

    return count


def count_words(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(word, n) of the words long and frequent enough; ``every`` = 0 alters none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _counts(every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TWICE)


def _grouped(zoned: DataFrame) -> DataFrame:
    """``zoned`` (word, n, long, low, high) with ``grp``: the length of the shorter word, the zone, and all that lies outside it."""
    after = F.length("word") - F.col("high") - F.col("long")
    return zoned.withColumn("grp", F.concat_ws(
        "\x00", F.length("word") - F.col("long"), "low", "high", F.substring("word", F.lit(1), F.col("low")),
        F.substring("word", F.length("word") - after + 1, after)))


def _halved(zoned: DataFrame) -> DataFrame:
    """Every row in the two groups that fix one half of its zone and leave the other."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    return _grouped(zoned.select("word", "n", "long", F.explode(F.array(
        F.struct(middle.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), middle.alias("high")))).alias("zone"))
        .select("word", "n", "long", "zone.low", "zone.high"))


def _chunked(words: DataFrame) -> DataFrame:
    """Words in the groups of their own two chunks, and as partners of words one shorter in those of their grams."""
    roles = F.when(F.length("word") > LEAST, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return _halved(words.select("word", "n", F.explode(roles).alias("long")).select(
        "word", "n", "long", F.lit(0).alias("low"), (F.length("word") - F.col("long")).alias("high")))


def near_in_group(words: list[tuple[str, int, int]], low: int, high: int) -> list[tuple[str, int, int, str]]:
    """(word, near words, best count, best word) for the (word, n, long) of one group, words without near ones left out.

    ``long`` words are one code point longer than the others, and all are equal outside the zone from ``low`` to ``high`` of the others.
    """
    found: dict[str, list] = {}

    def add(word, k, n, partner):
        held = found.get(word)
        if held is None:
            found[word] = [k, n, partner]
        else:
            held[0] += k
            if n > held[1] or (n == held[1] and partner < held[2]):
                held[1:] = n, partner

    blanked: dict[str, list[tuple[str, int]]] = defaultdict(list)
    plain: dict[str, int] = {}
    for word, n, long in words:
        if not long:
            plain[word] = n
            for i in range(low, high):
                blanked[f"{word[:i]}\0{word[i + 1:]}"].append((word, n))
    for alike in blanked.values():
        if len(alike) > 1:
            (top, most), (second, next_) = sorted(alike, key=lambda c: (-c[1], c[0]))[:2]
            for word, _ in alike:
                add(word, len(alike) - 1, *((next_, second) if word == top else (most, top)))
    for word, n, long in words:
        if long:
            end = len(word) - 1
            # Of a run of equal code points the last is the one deleted, and one after the zone's end only at the word's end.
            for i in range(low, high + (high == end)):
                if i == end or word[i] != word[i + 1]:
                    other = word[:i] + word[i + 1:]
                    m = plain.get(other)
                    if m is not None:
                        add(word, 1, m, other)
                        add(other, 1, n, word)
    return [(w, k, n, p) for w, (k, n, p) in found.items()]


_NEAR = "word string, n_near long, form_n long, form string"


def _verify(batches):
    def send(rows):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names=["word", "n_near", "form_n", "form"])

    now, zone, held, out = None, (0, 0), [], []
    for batch in batches:
        for group, word, n, long, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != now:
                if len(held) > 1:
                    out += near_in_group(held, *zone)
                now, zone, held = group, (low, high), []
            held.append((word, n, long))
        if len(out) > 50_000:
            yield send(out)
            out = []
    if len(held) > 1:
        out += near_in_group(held, *zone)
    if out:
        yield send(out)


def near_words(words: DataFrame, shelf: Shelf, crowd: int = CROWD) -> DataFrame:
    """(word, n_near, best): near words of each word that has any, and the best of them as (-n, word)."""
    columns = ["grp", "word", "n", "long", "low", "high"]
    level, ready = _chunked(words), []
    while True:
        sizes = level.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.first(F.col("high") - F.col("low")).alias("places"))
        crowded = shelf.put(sizes.where((F.col("size") > crowd) & (F.col("places") > 1)).select("grp"), "crowded")
        if crowded.limit(1).count() == 0:
            ready.append(level)
            break
        ready.append(level.join(crowded, "grp", "left_anti"))
        level = shelf.put(_halved(level.join(crowded, "grp", "left_semi")), "halved")
    together = ready[0].select(*columns)
    for more in ready[1:]:
        together = together.unionByName(more.select(*columns))
    verified = together.repartition("grp").sortWithinPartitions("grp").mapInArrow(_verify, _NEAR)
    return verified.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("word"))).alias("best"))


def variants(docs: DataFrame, every: int = EVERY, crowd: int = CROWD) -> DataFrame:
    """One row per word: its form (or null), the root that forms lead to, counts of the word, of its near words and of the form."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    words = shelf.put(count_words(docs, every), "words")
    near = near_words(words, shelf, crowd)
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))
    is_form = F.col("best_n") >= RATIO * F.col("n")
    linked = shelf.put(joined.select(
        "word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    # Counts grow tenfold along forms, so a few doublings of the pointers reach the last one.
    pointers = shelf.put(linked.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = pointers.join(pointers.select(F.col("word").alias("root"), F.col("root").alias("beyond")), "root", "left")
        further = shelf.put(step.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        shelf.drop(pointers)
        pointers = further.select("word", "root")
        if further.where("moved").limit(1).count() == 0:
            break
    return linked.join(pointers, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
