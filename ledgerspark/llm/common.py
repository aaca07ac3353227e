"""What several operators share: tables, intermediate tables, row numbers, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Shelf:
    """Intermediate tables in the shared folder, each dropped as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((kept, path))
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for kept, path in self.held:
            if any(kept is df for df in frames):
                where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Give memory that a task has freed back to the machine: Python workers live on, and others need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # elsewhere than with glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns other than ``doc_id`` and ``text`` under names that clash with none in use, and the true names."""
    return docs.toDF(*[n if n in ("doc_id", "text") else f"other{i}" for i, n in enumerate(docs.columns)]), docs.columns


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``: the text's hash, which with ``doc_id`` names a row up to repetition."""
    return docs.withColumn("_key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about ``most`` bytes of ``column`` (one longer row stays whole)."""
    texts = batch.column(batch.schema.get_field_index(column))
    begin = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > begin and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


def runs(frames, keys: list[str]):
    """Runs of rows with equal keys from frames sorted by them; a run may cross frames."""
    held, last = [], None
    for pdf in frames:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(k[a].tolist())
            if held and now != last:
                yield last, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            last = now
            held.append(pdf.iloc[a:b])
    if held:
        yield last, pd.concat(held) if len(held) > 1 else held[0]


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes that ``edges`` (a, b: long) name; the component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Each round is a partial
    aggregation (the least neighbour of every node) and a join with it, so a node that a third of all
    edges meet is summed before the shuffle and its join partition can be split. Each round is written
    to the shared folder and the one before is dropped.
    """
    shelf = Shelf(spark)
    links = shelf.put(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    last = None
    while True:
        # Large star: every larger neighbour of a node is tied to the node's least neighbour (or the node).
        least = links.groupBy("v").agg(F.min("u").alias("m"))
        large = (links.join(least.withColumnRenamed("v", "u"), "u", "left")
                 .select("v", F.coalesce("m", "u").alias("u")))
        # Small star: the smaller neighbours of a node, and the node, are tied to the least of them.
        large = shelf.put(large.distinct(), "links")
        low = large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (large.join(low.where("n > 1"), "v", "left")
                 .select(F.explode(F.when(F.col("m").isNull(), F.array(F.struct("v", "u"))).otherwise(
                     F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")),
                             F.struct("v", F.col("m").alias("u"))))).alias("e"))
                 .select("e.v", "e.u").where("v <> u").distinct())
        small = shelf.put(small, "links")
        shelf.drop(links, large)
        links = small
        # Done when every node has one parent and no parent has a parent.
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == last:
            return links.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
                links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
        last = state
