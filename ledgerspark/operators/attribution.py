"""Who an address belongs to: label sources, intel answers, manual entries, sanctions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.labels import (
    COMPLIANCE_MAIL, canonical_exchange_name, first_match, is_evidential, source_type_confidence,
)

# Source key, confidence level, priority, authoritative.
SOURCES = [
    ("MANUAL", 1, 1, True),
    ("OFAC", 1, 2, True),
    ("BITCOINABUSE", 2, 3, False),
    ("WALLETEXPLORER", 2, 4, False),
    ("CIO_HEURISTIC", 2, 5, False),
    ("BLOCKCHAIR", 2, 6, False),
    ("GITHUB_LABELS", 3, 7, False),
    ("INVESTIGATION", 1, 3, True),
]
CLUSTER_SOURCE, CLUSTER_PRIORITY, WORST_LEVEL = "CIO_HEURISTIC", 5, 4


def attribution_sources(spark: SparkSession) -> DataFrame:
    """A3: the source registry."""
    return spark.createDataFrame(
        SOURCES, "source_key string, confidence_level int, priority int, is_authoritative boolean")


def _with_sources(attributions: DataFrame, sources: DataFrame) -> DataFrame:
    registry = sources.select("source_key", "priority", "is_authoritative")
    return attributions.join(registry, "source_key")


def best_attribution(attributions: DataFrame, sources: DataFrame) -> DataFrame:
    """A1: per address the row of the lowest priority, then level, then source key."""
    labelled = _with_sources(attributions, sources)
    rest = [c for c in labelled.columns if c not in ("address", "priority", "confidence_level", "source_key")]
    body = F.struct("priority", "confidence_level", "source_key", *rest)
    order = F.struct("priority", "confidence_level", "source_key")
    return labelled.groupBy("address").agg(F.min_by(body, order).alias("best")).select("address", "best.*")


def full_attribution(
    attributions: DataFrame, sources: DataFrame, membership: DataFrame, clusters: DataFrame
) -> DataFrame:
    """A2: direct labels and those inherited from an attributed cluster, one level weaker."""
    direct = _with_sources(attributions, sources).select(
        "address", "entity_name", "entity_type", "confidence_level", "is_sanctioned", "source_key",
        F.col("priority").alias("source_priority"), F.lit("DIRECT").alias("attribution_method"))
    named = clusters.where(F.col("entity_name").isNotNull()).select(
        "cluster_id", "entity_name", "entity_type", "confidence_level")
    derived = membership.select("address", "cluster_id").join(named, "cluster_id").select(
        "address", "entity_name", "entity_type",
        F.least(F.col("confidence_level") + 1, F.lit(WORST_LEVEL)).alias("confidence_level"),
        F.lit(False).alias("is_sanctioned"), F.lit(CLUSTER_SOURCE).alias("source_key"),
        F.lit(CLUSTER_PRIORITY).alias("source_priority"), F.lit("CIO_CLUSTER").alias("attribution_method"))
    return direct.unionByName(derived)


def _present(text: Column) -> Column:
    return F.when(F.trim(text) != "", F.trim(text))


def intel_entity_name(payload: Column) -> Column:
    """A5: entity name of an answer, from the object, the text or the first usable label; else empty."""
    answer = F.try_parse_json(payload)
    kind = F.schema_of_variant(F.try_variant_get(answer, "$.entity", "variant"))
    from_object = F.try_variant_get(answer, "$.entity.name", "string")
    from_text = F.when(kind == "STRING", F.try_variant_get(answer, "$.entity", "string"))
    labels = F.from_json(F.get_json_object(payload, "$.labels"),
                         "array<struct<entity_name: string, source_name: string>>")
    named = F.transform(labels, lambda x: _present(
        F.coalesce(F.when(x["entity_name"] != "", x["entity_name"]), x["source_name"])))
    from_labels = F.get(F.filter(named, lambda n: n.isNotNull()), F.lit(0))
    return F.coalesce(_present(from_object), _present(from_text), from_labels, F.lit(""))


def payload_lookup(payloads: DataFrame) -> DataFrame:
    """Answers that found something, as one attribution per address."""
    answer = F.try_parse_json("payload")
    found = F.coalesce(F.try_variant_get(answer, "$.found", "boolean"), F.lit(False))
    source_type = F.coalesce(F.try_variant_get(answer, "$.best_source_type", "string"), F.lit("exchange_intel"))
    hits = payloads.where(found).select(
        "address", intel_entity_name(F.col("payload")).alias("raw_name"), source_type.alias("source_type"))
    name = F.when(F.col("raw_name") == "", "Unknown Exchange").otherwise(canonical_exchange_name(F.col("raw_name")))
    rows = hits.withColumn("exchange", name).select(
        "address", "exchange",
        F.concat("exchange", F.lit(" ("), "source_type", F.lit(")")).alias("label"),
        F.concat(F.lit("exchange-intel/"), "source_type").alias("source"),
        source_type_confidence(F.col("source_type")).alias("confidence"))
    body = F.struct("exchange", "label", "source", "confidence")
    return rows.groupBy("address").agg(F.min(body).alias("hit")).select("address", "hit.*")


def manual_attributions(names: DataFrame) -> DataFrame:
    """Analyst entries (address, exchange_name), with the mailbox of a known exchange."""
    exchange = canonical_exchange_name(F.col("exchange_name"))
    mail = first_match([(exchange == e, F.lit(m)) for e, m in COMPLIANCE_MAIL], F.lit(""))
    return names.groupBy("address").agg(F.min("exchange_name").alias("exchange_name")).select(
        "address", exchange.alias("exchange"),
        F.concat(exchange, F.lit(" (manually confirmed)")).alias("label"),
        F.lit("manual").alias("source"), F.lit("L2").alias("confidence"), mail.alias("compliance_email"))


def sanctions_flag(addresses: DataFrame, sanctions: DataFrame) -> DataFrame:
    """A10: whether any identification is on file."""
    listed = sanctions.select("address").distinct().withColumn("hit", F.lit(True))
    return addresses.join(listed, "address", "left").select(
        *addresses.columns, F.coalesce("hit", F.lit(False)).alias("is_sanctioned"))


def resolve_addresses(
    addresses: DataFrame, manual: DataFrame, intel: DataFrame, sanctions: DataFrame
) -> DataFrame:
    """Attribution of every distinct address; a manual entry ends the lookup.

    ``manual`` comes from :func:`manual_attributions`, ``intel`` from :func:`payload_lookup`.
    """
    fields = ["exchange", "label", "source", "confidence"]
    pack = lambda df, name: df.select("address", F.struct(*fields).alias(name))
    joined = (
        sanctions_flag(addresses.select("address").distinct(), sanctions)
        .join(pack(intel, "intel"), "address", "left")
        .join(pack(manual, "manual"), "address", "left")
    )
    hit = F.coalesce("manual", "intel")
    out = joined.select(
        "address", hit["exchange"].alias("exchange"), hit["label"].alias("label"), hit["source"].alias("source"),
        F.coalesce(hit["confidence"], F.lit("L1")).alias("confidence"),
        (F.col("is_sanctioned") & F.col("manual").isNull()).alias("is_sanctioned"))
    return out.withColumn("is_evidential", is_evidential(F.col("exchange"), F.col("source"), F.col("confidence")))
