"""Cleaning a corpus: toxic documents go, then near copies and leaked benchmark items, secrets are blanked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import decontaminate, packing, secrets, simhash, toxicity
from ledgerspark.llm.common import Shelf, table


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents scored below the threshold; the network learns from those of ``docs`` that have labels."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", keep_clean),
    ("simhash", keep_one_of_each),
    ("decontamination", keep_unleaked),
    ("secrets", blank_secrets),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    shelf = Shelf(spark)
    for name, stage in STAGES:
        docs = shelf.put(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
