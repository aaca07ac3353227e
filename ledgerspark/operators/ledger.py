"""The fact tables of a ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Ledger:
    blocks: DataFrame
    transactions: DataFrame
    inputs: DataFrame
    outputs: DataFrame
    addresses: DataFrame | None = None


def ledger_tables(spark: SparkSession, directory: str) -> Ledger:
    """S3: the fact tables under ``directory``."""
    read = lambda name: spark.read.parquet(f"{directory}/{name}")
    return Ledger(
        blocks=read("blocks"), transactions=read("transactions"), inputs=read("tx_inputs"),
        outputs=read("tx_outputs"), addresses=read("addresses"),
    )
