"""Queries over labels: attribution and common-input clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.functions.labels import (
    COMPLIANCE_MAIL, EXCHANGE_NAMES, SOURCE_NOTES, canonical_exchange_name, compliance_contact, is_evidential,
    source_note, source_type_confidence,
)
from ledgerspark.operators import attribution, clusters
from ledgerspark.plans.catalog import query
from ledgerspark.plans.sqlparts import part, pick
from ledgerspark.plans.sqlparts import query as sql
from ledgerspark.sources import fixture as fx
from ledgerspark.sources import readers

part("sources", "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', {lvl}, {prio}, {str(auth).lower()})" for k, lvl, prio, auth in attribution.SOURCES)
    + ") AS s(source_key, source_level, priority, is_authoritative)")

part("attributions", """
SELECT p.address, s.source_key, e.name AS entity_name, upper(e.category) AS entity_type,
       s.source_level AS confidence_level, s.source_key = 'OFAC' AS is_sanctioned,
       CASE WHEN s.source_key = 'BITCOINABUSE' THEN e.category END AS abuse_category,
       CASE WHEN s.source_key = 'BITCOINABUSE' THEN p_size ELSE 1 END AS report_count,
       s.priority, s.is_authoritative
FROM part_entities p JOIN entities e USING (entity_id) JOIN sources s ON
     (s.source_key = 'WALLETEXPLORER' AND p_type IN ('ECONOMY', 'PROMO'))
  OR (s.source_key = 'BITCOINABUSE' AND p_type = 'ECONOMY')
  OR (s.source_key = 'MANUAL' AND p_type = 'PROMO' AND p_size <= 5)
  OR (s.source_key = 'INVESTIGATION' AND p_type = 'ECONOMY' AND p_size <= 3)
  OR (s.source_key = 'OFAC' AND p_size >= 48)""")

part("best", """
SELECT * FROM attributions
QUALIFY row_number() OVER (PARTITION BY address ORDER BY priority, confidence_level, source_key) = 1""")


def canonical_sql(name: str) -> str:
    cases = " ".join(f"WHEN contains(lower({name}), '{k}') THEN '{v}'" for k, v in EXCHANGE_NAMES)
    return f"CASE {cases} ELSE {name} END"


def contact_sql(name: str) -> str:
    cases = " ".join(f"WHEN {name} = '{k}' THEN '{v}'" for k, v in COMPLIANCE_MAIL)
    return f"CASE {cases} ELSE 'compliance@' || replace(replace(lower({name}), ' ', ''), '.', '') || '.com' END"


def note_sql(source: str) -> str:
    cases = " ".join(f"WHEN {source} = '{k}' THEN '{v}'" for k, v in SOURCE_NOTES)
    return f"CASE {cases} ELSE 'Identified via ' || {source} || '.' END"


part("intel", f"""
SELECT address, exchange, exchange || ' (' || source_type || ')' AS label, 'exchange-intel/' || source_type AS source,
       CASE WHEN source_type IN ('official_por', 'seed') THEN 'L1' ELSE 'L2' END AS confidence
FROM (SELECT 'addr' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS address, p_size,
             {canonical_sql(f"upper({pick([k for k, _ in EXCHANGE_NAMES], f'p_partkey % {len(EXCHANGE_NAMES)}')}) || ' wallet'")}
               AS exchange,
             {pick(fx.SOURCE_TYPES, 'p_size % 4')} AS source_type
      FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))
WHERE p_size <> 13""")

part("manual", """
SELECT 'addr' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS address,
       CASE WHEN p_size <= 2 THEN 'Huobi' ELSE 'Corner Exchange' END AS exchange,
       CASE WHEN p_size <= 2 THEN 'Huobi' ELSE 'Corner Exchange' END || ' (manually confirmed)' AS label,
       'manual' AS source, 'L2' AS confidence,
       CASE WHEN p_size <= 2 THEN 'compliance@huobi.com' ELSE '' END AS compliance_email
FROM part WHERE p_type = 'MEDIUM' AND p_size <= 4""")

part("ledger_addresses", """
SELECT address FROM tx_inputs WHERE address IS NOT NULL UNION SELECT address FROM tx_outputs""")

part("sanctioned", """
SELECT 'addr' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS address FROM part WHERE p_size = 50""")

part("resolved", """
SELECT a.address, coalesce(m.exchange, i.exchange) AS exchange, coalesce(m.label, i.label) AS label,
       coalesce(m.source, i.source) AS source, coalesce(m.confidence, i.confidence, 'L1') AS confidence,
       s.address IS NOT NULL AND m.address IS NULL AS is_sanctioned,
       coalesce(m.exchange, i.exchange, '') <> '' AS is_evidential
FROM ledger_addresses a LEFT JOIN manual m ON m.address = a.address LEFT JOIN intel i ON i.address = a.address
LEFT JOIN sanctioned s ON s.address = a.address""")


def ledger_addresses(spark, sf):
    led = fx.ledger(spark, sf)
    return led.inputs.select("address").union(led.outputs.select("address")).where(
        F.col("address").isNotNull()).distinct()


def resolved(spark, sf):
    """Attribution of every ledger address, as tracing uses it."""
    return attribution.resolve_addresses(
        ledger_addresses(spark, sf), attribution.manual_attributions(fx.manual_names(spark, sf)),
        attribution.payload_lookup(fx.intel_payloads(spark, sf)), fx.sanctions(spark, sf))


def _best(spark, sf):
    return attribution.best_attribution(fx.attributions(spark, sf), attribution.attribution_sources(spark))


@query("a1_best_attribution", sql("SELECT * EXCLUDE (priority), priority FROM best"))
def _(spark, sf):
    return _best(spark, sf)


@query("a4_canonical_exchange_name", sql(
    f"SELECT entity_id, {canonical_sql(chr(39) + 'OKX ' + chr(39) + ' || name')} AS canonical FROM entities"))
def _(spark, sf):
    return fx.entities(spark, sf).select(
        "entity_id", canonical_exchange_name(F.concat(F.lit("OKX "), "name")).alias("canonical"))


@query("a5_a13_intel_lookup", sql("SELECT * FROM intel"))
def _(spark, sf):
    return attribution.payload_lookup(fx.intel_payloads(spark, sf))


@query("a6_source_type_confidence", sql(f"""
SELECT p_partkey, CASE WHEN p_size % 4 <= 1 THEN 'L1' ELSE 'L2' END AS confidence FROM part"""))
def _(spark, sf):
    kind = fx.pick(fx.SOURCE_TYPES, F.col("p_size") % 4)
    return fx.table(spark, sf, "part").select("p_partkey", source_type_confidence(kind).alias("confidence"))


@query("a7_is_evidential", sql("""
SELECT address, source_key, confidence_level <= 1 AND source_key <> 'WALLETEXPLORER' AS is_evidential
FROM attributions"""))
def _(spark, sf):
    level = F.when(F.col("confidence_level") == 1, "L1").otherwise("L3")
    source = F.when(F.col("source_key") == "WALLETEXPLORER", "downstream-analysis/x").otherwise(F.col("source_key"))
    return fx.attributions(spark, sf).select(
        "address", "source_key", is_evidential(F.col("entity_name"), source, level).alias("is_evidential"))


@query("a8_resolve_addresses", sql("SELECT * FROM resolved"))
def _(spark, sf):
    return resolved(spark, sf)


@query("a9_manual_attributions", sql("SELECT * FROM manual"))
def _(spark, sf):
    return attribution.manual_attributions(fx.manual_names(spark, sf))


@query("a10_sanctions_flag", sql("""
SELECT a.address, s.address IS NOT NULL AS is_sanctioned
FROM ledger_addresses a LEFT JOIN sanctioned s ON s.address = a.address"""))
def _(spark, sf):
    return attribution.sanctions_flag(ledger_addresses(spark, sf), fx.sanctions(spark, sf))


@query("a11_compliance_contact", sql(f"""
SELECT address, exchange, {contact_sql('exchange')} AS contact
FROM (SELECT address, exchange FROM resolved WHERE exchange IS NOT NULL
      UNION ALL SELECT address, entity_name FROM best)"""))
def _(spark, sf):
    names = resolved(spark, sf).where(F.col("exchange").isNotNull()).select("address", "exchange").unionByName(
        _best(spark, sf).select("address", F.col("entity_name").alias("exchange")))
    return names.withColumn("contact", compliance_contact(F.col("exchange")))


@query("a12_source_note", sql(f"""
SELECT address, source, {note_sql('source')} AS note
FROM (SELECT address, source FROM resolved WHERE source IS NOT NULL UNION ALL SELECT address, source_key FROM best)"""))
def _(spark, sf):
    names = resolved(spark, sf).where(F.col("source").isNotNull()).select("address", "source").unionByName(
        _best(spark, sf).select("address", F.col("source_key").alias("source")))
    return names.withColumn("note", source_note(F.col("source")))


@query("s8_read_intel_payloads", sql("SELECT address, exchange FROM intel"))
def _(spark, sf):
    path = fx.fresh_path(spark, "intel-json")
    fx.intel_payloads(spark, sf).select("payload").write.text(path)
    return attribution.payload_lookup(readers.read_intel_payloads(spark, path)).select("address", "exchange")


# -- clusters ----------------------------------------------------------------------------

part("hubs", "SELECT txid, min(address) AS hub FROM tx_inputs WHERE address IS NOT NULL GROUP BY 1")
part("co_edges", """
SELECT DISTINCT i.address, h.hub FROM tx_inputs i JOIN hubs h USING (txid) WHERE i.address > h.hub""")
part("co_links", "SELECT address AS u, hub AS v FROM co_edges UNION SELECT hub, address FROM co_edges")
part("members", """
SELECT u AS address, label AS cluster_id FROM (
  WITH RECURSIVE cc(u, label) USING KEY (u) AS (
    SELECT DISTINCT address, address FROM tx_inputs WHERE address IS NOT NULL
    UNION
    SELECT l.u, min(c.label) FROM cc c JOIN co_links l ON l.v = c.u JOIN recurring.cc r ON r.u = l.u
    WHERE c.label < r.label GROUP BY l.u)
  SELECT u, label FROM cc)""")
part("cluster_labels", """
SELECT m.cluster_id, b.* FROM members m JOIN best b ON b.address = m.address
QUALIFY row_number() OVER (PARTITION BY m.cluster_id ORDER BY b.priority, b.confidence_level, b.address) = 1""")
part("named_clusters", """
SELECT c.cluster_id, c.address_count, l.entity_name, l.entity_type, l.source_key AS attribution_source,
       l.confidence_level
FROM (SELECT cluster_id, count(*) AS address_count FROM members GROUP BY 1) c
LEFT JOIN cluster_labels l ON l.cluster_id = c.cluster_id""")

_memberships: dict[tuple[str, str], object] = {}


def membership(spark, sf):
    """The clusters of the whole ledger, found once per session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _memberships:
        _memberships[key] = clusters.cio_clusters(fx.ledger(spark, sf).inputs)
    return _memberships[key]


def _named(spark, sf):
    return clusters.attribute_clusters(
        membership(spark, sf), fx.attributions(spark, sf), attribution.attribution_sources(spark))


@query("k1_co_input_edges", sql("SELECT address, hub FROM co_edges"))
def _(spark, sf):
    return clusters.co_input_edges(fx.ledger(spark, sf).inputs)


@query("k2_cio_clusters", sql("SELECT address, cluster_id FROM members"))
def _(spark, sf):
    return clusters.cio_clusters(fx.ledger(spark, sf).inputs)


@query("k3_cio_evidence", sql("""
SELECT txid, cluster_id, count(DISTINCT address) AS merged_count, count(*) AS input_count
FROM tx_inputs JOIN members USING (address) GROUP BY 1, 2 HAVING count(DISTINCT address) > 1"""))
def _(spark, sf):
    return clusters.cio_evidence(fx.ledger(spark, sf).inputs, membership(spark, sf))


@query("k3_cio_evidence_members", sql("""
SELECT DISTINCT txid, cluster_id, address FROM tx_inputs JOIN members USING (address)
WHERE txid IN (SELECT txid FROM tx_inputs GROUP BY 1 HAVING count(DISTINCT address) > 1)"""))
def _(spark, sf):
    return clusters.cio_evidence_members(fx.ledger(spark, sf).inputs, membership(spark, sf))


@query("k4_attribute_clusters", sql("SELECT * FROM named_clusters"))
def _(spark, sf):
    return _named(spark, sf)


@query("k5_cluster_id_of", sql("""
SELECT a.address, m.cluster_id FROM ledger_addresses a LEFT JOIN members m ON m.address = a.address"""))
def _(spark, sf):
    return clusters.cluster_id_of(ledger_addresses(spark, sf), membership(spark, sf))


@query("k6_first_seen_txid", sql("""
SELECT address, (min({'h': block_height, 't': txid})).t AS first_seen_txid
FROM tx_inputs JOIN transactions USING (txid) WHERE address IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    led = fx.ledger(spark, sf)
    return clusters.first_seen_txid(led.inputs, led.transactions)


@query("a2_full_attribution", sql("""
SELECT address, entity_name, entity_type, confidence_level, is_sanctioned, source_key, priority AS source_priority,
       'DIRECT' AS attribution_method FROM attributions
UNION ALL
SELECT m.address, c.entity_name, c.entity_type, least(c.confidence_level + 1, 4), false, 'CIO_HEURISTIC', 5,
       'CIO_CLUSTER'
FROM members m JOIN named_clusters c USING (cluster_id) WHERE c.entity_name IS NOT NULL"""))
def _(spark, sf):
    return attribution.full_attribution(
        fx.attributions(spark, sf), attribution.attribution_sources(spark), membership(spark, sf), _named(spark, sf))
