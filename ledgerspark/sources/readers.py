"""Reading documents, labels, policies and intake files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators.ledger import ledger_tables



def _struct(**columns: str) -> str:
    return "struct<" + ", ".join(f"{name}: {kind}" for name, kind in columns.items()) + ">"


def _table(**columns: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


AMOUNT = "decimal(38,10)"
SCRIPT = _struct(address="string", addresses="array<string>", type="string")
PREVOUT = _struct(scriptpubkey_address="string", scriptPubKey=SCRIPT, value=AMOUNT)
VIN = _struct(coinbase="string", txid="string", vout="int", prevout=PREVOUT)
VOUT = _struct(n="int", value=AMOUNT, scriptPubKey=SCRIPT, scriptpubkey_address="string")
TX = dict(txid="string", fee=AMOUNT, vsize="int", vin=f"array<{VIN}>", vout=f"array<{VOUT}>")
BLOCK_SCHEMA = _table(height="bigint", hash="string", time="bigint", tx=f"array<{_struct(**TX)}>")
STATUS = _struct(confirmed="boolean", block_height="bigint", block_hash="string", block_time="bigint")
TX_SCHEMA = _table(**TX, blockhash="string", blockheight="bigint", blocktime="bigint", status=STATUS)
CASE_SCHEMA = (
    "case_id string, created_at string, status string, "
    "victim struct<name: string, email: string, country: string>, "
    "incident struct<date: string, discovery_date: string, wallet_brand: string, wallet_type: string, "
    "description: string>, "
    "blockchain struct<fraud_txid: string, fraud_amount_btc: string, fraud_amount_eur: string, "
    "victim_addresses: array<string>, recipient_address: string>"
)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Verbose block documents, one per line, read in parallel; amounts never pass through floats."""
    return spark.read.schema(BLOCK_SCHEMA).json(path)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Transaction documents of the node and the explorer dialect."""
    return spark.read.schema(TX_SCHEMA).json(path)


def read_gold_labels(spark: SparkSession, path: str) -> DataFrame:
    """S4."""
    return spark.read.schema("case_id string, address string, expected_label string, notes string").json(path)


def read_policy(spark: SparkSession, path: str, **overrides: float) -> DataFrame:
    """One row of thresholds; keywords override single values."""
    policy = spark.read.option("multiLine", True).json(path)
    for name, value in overrides.items():
        policy = policy.withColumn(name, F.lit(value))
    return policy


def read_manual_attributions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON arrays of analyst entries, one per file or, without ``multi_line``, one per line."""
    schema = ("address string, entity_name string, entity_type string, is_sanctioned boolean, "
              "abuse_category string, notes string")
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_case_intake(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Intake documents as flat case rows; victim entries may be links that end in the address."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    brand, kind = text("incident.wallet_brand"), text("incident.wallet_type")
    wallet = (
        F.when((brand != "") & (kind != ""), F.concat(brand, F.lit(" ("), kind, F.lit(")")))
        .when(brand != "", brand).when(kind != "", kind).otherwise("—")
    )
    raw = spark.read.schema(CASE_SCHEMA).option("multiLine", multi_line).json(path)
    return raw.select(
        "case_id", F.coalesce("victim.name", F.lit("")).alias("victim_name"),
        F.coalesce("victim.email", F.lit("")).alias("victim_contact"),
        F.coalesce("incident.date", F.lit("")).alias("incident_date"),
        F.coalesce("incident.discovery_date", F.lit("")).alias("discovery_date"),
        F.coalesce("blockchain.fraud_amount_btc", F.lit("")).alias("fraud_amount"),
        F.coalesce("blockchain.fraud_amount_eur", F.lit("")).alias("fraud_amount_eur"),
        wallet.alias("wallet_type"), F.col("blockchain.fraud_txid").alias("fraud_txid"),
        F.col("blockchain.recipient_address").alias("recipient"),
        F.transform("blockchain.victim_addresses",
                    lambda a: F.regexp_extract(a, r"([^/?#]+)/*(?:[?#].*)?$", 1)).alias("victim_addresses"))


def read_intel_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Address-intel answers, kept as text for the lookup operators."""
    return spark.read.text(path).select(
        F.get_json_object("value", "$.address").alias("address"), F.col("value").alias("payload"))


__all__ = [
    "ledger_tables", "read_blocks", "read_case_intake", "read_gold_labels", "read_intel_payloads",
    "read_manual_attributions", "read_policy", "read_transactions",
]
