"""Operator 6: URL filtering by association rules.

Fixed rules (host and path prefix, the longest wins) come first. Every other URL is judged by rules mined
from labelled pages: a URL's tokens are its host's labels and domains, path parts, suffix and query names; FP-growth
finds the token sets that go along with a bad label, and rules with enough support and confidence are
kept, of nested ones with equal confidence the shorter. An inverted index holds each rule under its rarest
token, so a URL meets only rules whose rarest token it has; the rest of the rule is then compared.

A null URL, or one without ``://``, has no host, path or tokens and is allowed. Repeated rows and rows with a null ``page_id``
each return a row; only ``page_id`` and ``url`` are read. Null labels are left out. Without usable labels nothing is mined
and the method allows. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import Shelf

FIXED_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
SUPPORT = 0.001
LEAST = 5
"""A rule's tokens and the bad label occur together in this share of labelled pages, and on so many, at least."""
CONFIDENCE = 0.7
BAD = "label=bad"
BROADCAST_RULES = 200_000

_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), *_ASCII)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def fixed_rule() -> Column:
    """The longest fixed rule that fits ``host`` and ``path``, as a struct of verdict and rule."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, host, path in sorted(FIXED_RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(host + path).alias("rule"))).otherwise(out)
    return out


def tokens() -> Column:
    """The different tokens of ``url`` with its ``host`` and ``path``, digits read as one sign."""
    labels = F.split("host", "\\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(
        F.lit("domain="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.transform(F.filter(F.split("path", "/"), lambda p: p != ""), lambda p: F.concat(
        F.lit("path="), F.regexp_replace(F.lower(p), "[0-9]+", "#")))
    names = F.transform(F.regexp_extract_all(F.coalesce(F.col("url"), F.lit("")), F.lit("[?&]([^=&#]+)="), F.lit(1)),
                        lambda p: F.concat(F.lit("query="), p))
    host = F.transform(labels, lambda p: F.concat(F.lit("host="), F.regexp_replace(p, "[0-9]+", "#")))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(domains, host, parts, names)))


def mine(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule_id, items, confidence, lift, support) from pages whose ``page_id`` is labelled; bad: low quality or toxic."""
    spark = urls.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where(
        "page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.bool_or("bad").alias("bad"))
    shelf = Shelf(spark)
    baskets = shelf.put(urls.where(F.size("tokens") > 0).join(marks, "page_id").select(
        F.when(F.col("bad"), F.array_append("tokens", BAD)).otherwise(F.col("tokens")).alias("items")), "baskets")
    n = baskets.count()
    none = spark.createDataFrame([], "rule_id long, items array<string>, confidence double, lift double, support double")
    if not n:
        return none
    # A token that never occurs often enough beside the bad label is in no rule: leave it out of the baskets.
    least = max(SUPPORT * n, LEAST)
    useful = [r[0] for r in baskets.where(F.array_contains("items", BAD)).select(F.explode("items").alias("t")).groupBy("t").count().where(
        F.col("count") >= least).select("t").collect()]  # at most tokens of a page / SUPPORT
    if BAD not in useful:
        return none
    slim = baskets.select(F.array_intersect("items", F.array(*[F.lit(t) for t in useful])).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), minConfidence=CONFIDENCE).fit(slim)
    rules = model.associationRules.where(F.element_at("consequent", 1) == BAD).select(
        F.array_sort("antecedent").alias("items"), "confidence", "lift", "support")
    rules = shelf.put(rules.withColumn("rule_id", F.xxhash64("items")), "rules")
    # A rule that adds tokens to another without more confidence says nothing new.
    a, b = rules.alias("a"), rules.withColumn("t", F.explode("items")).alias("b")
    longer = rules.select(F.explode("items").alias("t"), F.col("items").alias("whole"), F.col("confidence").alias("c"), F.col("rule_id").alias("r"))
    nested = b.join(longer.alias("l"), F.col("b.t") == F.col("l.t")).where(
        (F.col("b.rule_id") != F.col("r")) & (F.size("whole") > F.size("b.items")) & (F.size(F.array_except("b.items", "whole")) == 0)
        & (F.col("c") <= F.col("b.confidence"))).select(F.col("r").alias("rule_id")).distinct()
    return shelf.put(a.join(nested, "rule_id", "left_anti").select("rule_id", "items", "confidence", "lift", "support"), "rules")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, items, confidence) of the surest mined rule that each different URL meets."""
    shelf = Shelf(urls.sparkSession)
    different = urls.where(F.size("tokens") > 0).select("url", "tokens").distinct()
    counts = different.select(F.explode("tokens").alias("token")).groupBy("token").count()
    parts = rules.select("rule_id", "items", "confidence", F.explode("items").alias("token")).join(counts, "token", "left")
    index = shelf.put(parts.groupBy("rule_id", "items", "confidence").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("token")))["token"].alias("token")), "index")
    side = F.broadcast(index) if index.count() <= BROADCAST_RULES else index
    met = different.withColumn("token", F.explode("tokens")).join(side, "token").where(F.size(F.array_except("items", "tokens")) == 0)
    return met.groupBy("url").agg(F.max(F.struct("confidence", F.array_join("items", " ").alias("mined"))).alias("best")).select(
        "url", "best.mined", "best.confidence")


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per page: host, path, the fixed rule that fits if any, verdict, and the mined rule with its confidence."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("tokens", tokens())
    shelf = Shelf(pages.sparkSession)
    found = shelf.put(matches(urls, mine(urls, labels)), "met")
    side = F.broadcast(found) if found.count() <= BROADCAST_RULES else found
    fixed = urls.withColumn("fixed", fixed_rule()).join(side, "url", "left")
    return fixed.select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "mined", "confidence")
