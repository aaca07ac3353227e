"""Operator 2: benchmark decontamination by template windows, with DataFrame functions only.

Texts become templates: numbers, names (a capitalised word inside a sentence) and units after a number turn
into typed placeholders, case and punctuation go. Windows of WINDOW template words of the corpus meet those of
the benchmark by a hash join. A document holds an item when it matches SHARE of the item's windows and, where
those windows lie, the values behind the placeholders are consistent: one value of the item stands for one of the
document and the other way round. It also holds an item when it has SHARE of the item's plain windows, lower-cased words
without placeholders, whatever the values. So an item is found when it is copied, in any case and with small edits, and
when only its parameters are changed throughout. A plain window also counts for the template window at its place.

Template windows with fewer than LITERALS words that are not placeholders are not compared. Items with fewer words than
a window cannot be found. Null and empty texts match nothing, on either side. Repeated documents are reported alike; documents
with a null ``doc_id`` are told apart by their text. Only ``doc_id``, ``item_id`` and ``text`` are read. Without
documents or items the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import Shelf, apart, with_key

WINDOW = 5
SHARE = 0.8
LITERALS = 3
BROADCAST_WINDOWS = 1_000_000
"""Benchmark windows (16 bytes each) up to which they are sent to all tasks; more are joined by a shuffle."""
BROADCAST_LEAKS = 100_000

UNITS = ("mm cm m km in ft yd mi mg g kg t oz lb ml l gal s sec seconds min minutes h hr hours days weeks months years "
         "percent usd eur gbp dollars euros pounds cents kmh mph hz khz mhz ghz kb mb gb tb w kw mw v a c f k").split()

_NAME = "(?<=[\\p{Ll},;] )(?=\\p{Lu}\\p{Ll})"
_NOISE = "[^\\p{L}\\p{N}.,¤]+|[.,](?!\\p{N})|(?<!\\p{N})[.,]"


def _marked(text: Column) -> Column:
    """The words of a text in a row, names marked with a leading sign, inner points of numbers kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "¤", " "), _NAME, "¤"), _NOISE, " "))


def _template(marked: Column) -> Column:
    low = F.lower(marked)
    slots = F.regexp_replace(F.regexp_replace(low, "¤[^ ]+", "<name>"), "(?<![^ ])\\p{N}[\\p{N}.,]*(?![^ ])", "<num>")
    slots = F.regexp_replace(slots, f"(?<=<num> )(?:{'|'.join(UNITS)})(?![^ ])", "<unit>")
    return F.when(marked.rlike("[¤\\p{N}]"), slots).otherwise(low)


def templates(rows: DataFrame, key: list[str], plain: bool = False) -> DataFrame:
    """``key`` columns with ``values`` and ``words``: the same words as written and as a template.

    With ``plain``: ``plain`` words in lower case instead of ``values``, and ``slotted``, whether the template can differ from them.
    """
    out = rows.select(*key, _marked(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("marked"))
    if plain:
        return out.select(*key, F.col("marked").rlike("[¤\\p{N}]").alias("slotted"), F.split(_template(F.col("marked")), " ").alias("words"),
                          F.split(F.translate(F.lower("marked"), "¤", ""), " ").alias("plain"))
    return out.select(*key, F.split("marked", " ").alias("values"), F.split(_template(F.col("marked")), " ").alias("words"))


def _windows(words: Column) -> Column:
    """Hash of each window, by place."""
    return F.when(F.size(words) >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(
        F.array().cast("array<bigint>"))


def _plain(values: Column) -> Column:
    """The words of ``values`` in lower case, names unmarked."""
    return F.transform(values, lambda w: F.translate(F.lower(w), "¤", ""))


def _item_windows(benchmark: DataFrame) -> DataFrame:
    """(h, item_id, at, comparable, literal, n, n_literal): the windows of each item, as template and as plain words.

    ``comparable`` places have a template window with enough literals, n of them; ``literal`` marks the plain windows, n_literal of them.
    """
    items = templates(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), ["item_id"])
    each = items.select("item_id", "words", F.posexplode(F.arrays_zip(
        _windows(F.col("words")).alias("t"), _windows(_plain(F.col("values"))).alias("p"))).alias("at", "h"))
    comparable = F.size(F.filter(F.slice("words", F.col("at") + 1, WINDOW), lambda w: ~w.startswith("<"))) >= LITERALS
    each = each.select("item_id", "at", comparable.alias("comparable"), F.explode(F.array(
        F.struct(F.col("h.t").alias("h"), F.lit(False).alias("literal")), F.struct(F.col("h.p").alias("h"), F.lit(True).alias("literal")))).alias("w"))
    each = each.where("comparable OR w.literal").groupBy("item_id", "at", "comparable", "w.h").agg(F.bool_or("w.literal").alias("literal"))
    counts = each.groupBy("item_id").agg(
        F.count_distinct(F.when(F.col("comparable"), F.struct("at"))).alias("n"), F.count_if("literal").alias("n_literal"))
    return each.join(counts, "item_id")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, _key, item_id, start, share): the items that documents hold, ``start`` being the word they begin at."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    keyed = with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    items = shelf.put(_item_windows(benchmark), "items")
    small = items.count() <= BROADCAST_WINDOWS
    side = F.broadcast(items) if small else items
    # Both hashes of a place are the same unless the window has a placeholder.
    hashed = templates(keyed, ["doc_id", "_key"], plain=True).select(
        "doc_id", "_key", "slotted", "plain", _windows(F.col("words")).alias("t")).select(
        "doc_id", "_key", F.posexplode(F.arrays_zip("t", F.when(F.col("slotted"), _windows(F.col("plain"))).otherwise(F.col("t")).alias("p"))).alias("place", "w"))
    windows = hashed.select("doc_id", "_key", "place", F.explode(
        F.when(F.col("w.t") == F.col("w.p"), F.array("w.t")).otherwise(F.array("w.t", "w.p"))).alias("h"))
    hits = shelf.put(windows.join(side, "h").select(
        "doc_id", "_key", "item_id", "n", "n_literal", "at", "comparable", "literal", (F.col("place") - F.col("at")).alias("start")), "hits")
    met = [F.count_if("literal").alias("literal"), F.count_if("comparable").alias("met")]
    one = ["doc_id", "_key", "item_id"]
    at_line = hits.groupBy(*one, "start", "at", "comparable").agg(F.bool_or("literal").alias("literal"))
    lines = at_line.groupBy(*one, "start").agg(*met)
    # Small changes of length move the rest of an item, so its windows are counted over all starts.
    whole = hits.groupBy(*one, "n", "n_literal", "at", "comparable").agg(F.bool_or("literal").alias("literal")).groupBy(
        *one, "n", "n_literal").agg(*met)
    is_literal = F.col("literal") >= SHARE * F.col("n_literal")
    whole = whole.where(is_literal | (F.col("n") > 0) & (F.col("met") >= SHARE * F.col("n"))).withColumn("is_literal", is_literal)
    best = lines.groupBy(*one).agg(F.max(F.struct("literal", "met", -F.col("start")))["col3"].alias("back"))
    by_template = (F.col("n") > 0) & (F.col("met") >= SHARE * F.col("n"))
    found = shelf.put(_same(whole, best).select(
        *one, "n", "is_literal", (-F.col("back")).alias("start"),
        F.when(by_template, F.col("met") / F.col("n")).otherwise(F.col("literal") / F.col("n_literal")).alias("share"),
        F.monotonically_increasing_id().alias("pid")), "leaks")
    values = templates(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), ["item_id"])
    slots = values.select("item_id", F.greatest(F.lit(1), F.floor(F.size("words") / 2)).alias("half"), F.posexplode(
        F.arrays_zip("words", _plain(F.col("values")).alias("plain"))).alias("slot", "w")).where(F.col("w.words").startswith("<")).select(
        "item_id", "half", "slot", F.col("w.plain").alias("theirs"))
    slots = shelf.put(slots, "slots")
    slotted = slots.select("item_id", "half").distinct()
    slotted = F.broadcast(slotted) if small else slotted
    columns = [*one, "start", "share"]
    sure = found.join(slotted, "item_id", "left").where(F.col("is_literal") | F.col("half").isNull()).select(*columns)
    asked = shelf.put(found.where(~F.col("is_literal")).join(slotted, "item_id"), "asked")
    if asked.isEmpty():
        return sure
    starts = _consistent(shelf, keyed, hits, asked, F.broadcast(slots) if small else slots)
    return sure.unionByName(asked.drop("start").join(starts, "pid").select(*columns))


def _same(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), F.col("item_id").alias("_i"),
                         *[c for c in right.columns if c not in ("doc_id", "_key", "item_id")])
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")) & (F.col("item_id") == F.col("_i"))
                     ).drop("_d", "_k", "_i")


def _consistent(shelf: Shelf, keyed: DataFrame, hits: DataFrame, asked: DataFrame, slots: DataFrame) -> DataFrame:
    """(pid, start) of the ``asked`` items of which some occurrence has one value of the document for one of the item, and the reverse.

    An occurrence is the hits whose starts lie within an item's length of one another, as copies of an item do not overlap; all hits
    together are one more, for a copy with much inserted. A slot's place is told by the window around it that is the least
    shifted against the occurrence's best start; slots that no matching window covers are not compared.
    """
    of = ["pid", "part"]
    part = F.floor(F.col("start") / F.col("half"))
    mine = _same(hits, asked.select("doc_id", "_key", "item_id", "pid", "half")).select("pid", "item_id", "n", "half", "at", "comparable", "start").distinct()
    near = shelf.put(mine.withColumn("part", F.explode(F.array(part, part - 1, F.lit(None).cast("long")))).withColumn(
        "part", F.coalesce("part", F.lit(-(1 << 62)))).drop("half"), "near")
    full = near.where("comparable").groupBy(*of, "n").agg(F.count_distinct("at").alias("met")).where(F.col("met") >= SHARE * F.col("n"))
    lines = near.where("comparable").groupBy(*of, "start").agg(F.count(F.lit(1)).alias("met"))
    anchors = shelf.put(lines.groupBy(*of).agg((-F.max(F.struct("met", -F.col("start")))["col2"]).alias("anchor")).join(
        full.select(*of), of), "anchors")
    cover = slots.select("item_id", "slot", "theirs", F.explode(F.sequence(F.col("slot") - WINDOW + 1, F.col("slot"))).alias("at"))
    placed = near.join(anchors, of).join(cover, ["item_id", "at"]).groupBy(*of, "slot", "theirs").agg(
        F.min(F.struct(F.abs(F.col("start") - F.col("anchor")), "start"))["start"].alias("start"))
    placed = placed.select(*of, "theirs", (F.col("start") + F.col("slot")).alias("place"))
    wanted = asked.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "pid")
    texts = keyed.join(wanted.select("_d", "_k").distinct(), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left_semi")
    words = templates(texts.dropDuplicates(["doc_id", "_key"]), ["doc_id", "_key"]).select(
        "doc_id", "_key", F.posexplode(_plain(F.col("values"))).alias("place", "ours"))
    # A document's words meet each of its places once, however many items ask for them.
    places = placed.join(asked.select("pid", "doc_id", "_key"), "pid").alias("p")
    pairs = places.join(words.alias("w"), F.col("p.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("p._key") == F.col("w._key"))
                        & (F.col("p.place") == F.col("w.place"))).select("pid", "part", "theirs", "ours").distinct()
    pairs = shelf.put(pairs, "pairs")
    bad = pairs.groupBy(*of, "theirs").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*of).unionByName(
        pairs.groupBy(*of, "ours").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*of)).distinct()
    return anchors.join(bad, of, "left_anti").groupBy("pid").agg(F.min("anchor").alias("start"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    docs, names = apart(docs)
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k")).distinct()
    found = Shelf(docs.sparkSession).put(found, "leaked")
    side = F.broadcast(found) if found.count() <= BROADCAST_LEAKS else found
    return with_key(docs).join(side, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left_anti").drop("_key").toDF(*names)
