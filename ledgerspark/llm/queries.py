"""The queries of this folder, each a thin digest of its operator's result, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import (
    chat,
    decontaminate,
    packing,
    ranking,
    repeats,
    secrets,
    simhash,
    spelling,
    subtrees,
    surrogates,
    toxicity,
    urlrules,
    vectors,
)
from ledgerspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, the linked parts among the spans."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and the window that each lies in."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, with the items."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), "share")


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urlrules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of all turns, recovered without looking at the given ones, learnt from a fifth of the conversations."""
    turns = table(spark, sf_dir, "conversations")
    known = turns.where(F.pmod(F.xxhash64("conv_id"), F.lit(5)) == 0)
    return chat.parse(turns, known)


@query
def op5_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return vectors.link(table(spark, sf_dir, "embeddings"))


@query
def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to passages that occur earlier."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return surrogates.replace_personal_data(table(spark, sf_dir, "documents"), key="demonstration key, to be replaced")


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op12_ranked_search"] = f"""
WITH held AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{_TERM}') AS found FROM documents WHERE text IS NOT NULL),
sized AS (SELECT r, doc_id, found, len(found)::BIGINT AS n FROM held WHERE len(found) > 0),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS q
  FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark WHERE text IS NOT NULL)
  GROUP BY ALL),
tf AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(found) AS term FROM sized)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, r, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM tf JOIN asked USING (term) JOIN weights USING (term) JOIN sized USING (r), corpus GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""


@query
def op13_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to passages of words that occur elsewhere."""
    found = subtrees.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
