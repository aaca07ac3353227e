"""Queries over the address graph: walks, exposure, patterns, risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.functions.labels import category_weight, reason_code
from ledgerspark.operators import graph, patterns, risk
from ledgerspark.operators.sweep import sweep
from ledgerspark.plans.catalog import query
from ledgerspark.plans.sqlparts import CATEGORY_WEIGHT
from ledgerspark.plans.sqlparts import query as sql
from ledgerspark.sources import fixture as fx


def _reach(spark, sf):
    led = fx.ledger(spark, sf)
    return graph.reachable(fx.seeds(spark, sf), led.inputs, led.outputs)


def _exposures(spark, sf):
    led, links = fx.ledger(spark, sf), fx.entity_links(spark, sf)
    found = sweep(fx.seeds(spark, sf), graph.spenders(led.inputs), graph.receivers(led.outputs), 3)
    return graph.sweep_exposure(found, links, fx.entities(spark, sf))


@query("g1_address_edges", sql("SELECT src, dst FROM edges"))
def _(spark, sf):
    led = fx.ledger(spark, sf)
    return graph.address_edges(led.inputs, led.outputs)


@query("g2_bounded_walk", sql("""
SELECT seed, seed AS address, 0 AS hop, seed AS path FROM seeds
UNION ALL SELECT seed, dst, 1, seed || '>' || dst FROM seeds JOIN edges ON src = seed
UNION ALL SELECT seed, b.dst, 2, seed || '>' || a.dst || '>' || b.dst
FROM seeds JOIN edges a ON a.src = seed JOIN edges b ON b.src = a.dst WHERE b.dst <> seed"""))
def _(spark, sf):
    led = fx.ledger(spark, sf)
    walks = graph.bounded_walk(fx.seeds(spark, sf), graph.address_edges(led.inputs, led.outputs), 2)
    return walks.withColumn("path", F.array_join("path", ">"))


@query("g3_reachable", sql("SELECT seed, address, min_hop FROM reach"))
def _(spark, sf):
    return _reach(spark, sf)


@query("g4_k_hop_exposure", sql("""
SELECT seed, address, CAST(min(hop) AS INTEGER) AS min_hop, CAST(sum(n) AS BIGINT) AS path_count,
       CAST(row_number() OVER (PARTITION BY seed ORDER BY min(hop), sum(n) DESC, address) AS INTEGER) AS rank
FROM (
  SELECT seed, a.dst AS address, 1 AS hop, count(*) AS n FROM seeds JOIN edges a ON a.src = seed GROUP BY 1, 2
  UNION ALL
  SELECT seed, b.dst, 2, count(*) FROM seeds JOIN edges a ON a.src = seed JOIN edges b ON b.src = a.dst
  WHERE b.dst <> seed GROUP BY 1, 2
  UNION ALL
  SELECT seed, c.dst, 3, count(*) FROM seeds JOIN edges a ON a.src = seed JOIN edges b ON b.src = a.dst
  JOIN edges c ON c.src = b.dst WHERE b.dst <> seed AND c.dst <> seed AND c.dst <> a.dst GROUP BY 1, 2)
GROUP BY seed, address QUALIFY rank <= 100"""))
def _(spark, sf):
    led = fx.ledger(spark, sf)
    return graph.k_hop_exposure(fx.seeds(spark, sf), led.inputs, led.outputs, limit=100)


@query("g4_k_hop_exposure_full", sql("""
SELECT seed, address, CAST(min(hop) AS INTEGER) AS min_hop, CAST(sum(n) AS BIGINT) AS path_count,
       CAST(row_number() OVER (PARTITION BY seed ORDER BY min(hop), sum(n) DESC, address) AS INTEGER) AS rank
FROM (
  SELECT seed, a.dst AS address, 1 AS hop, count(*) AS n FROM seeds JOIN edges a ON a.src = seed GROUP BY 1, 2
  UNION ALL
  SELECT seed, b.dst, 2, count(*) FROM seeds JOIN edges a ON a.src = seed JOIN edges b ON b.src = a.dst
  WHERE b.dst <> seed GROUP BY 1, 2
  UNION ALL
  SELECT seed, c.dst, 3, count(*) FROM seeds JOIN edges a ON a.src = seed JOIN edges b ON b.src = a.dst
  JOIN edges c ON c.src = b.dst WHERE b.dst <> seed AND c.dst <> seed AND c.dst <> a.dst GROUP BY 1, 2)
GROUP BY seed, address"""))
def _(spark, sf):
    led = fx.ledger(spark, sf)
    return graph.k_hop_exposure(fx.seeds(spark, sf), led.inputs, led.outputs)


@query("g5_entity_exposure", sql("SELECT * FROM exposures"))
def _(spark, sf):
    return _exposures(spark, sf)


@query("g6_tx_stats", sql("SELECT * FROM stats"))
def _(spark, sf):
    led = fx.ledger(spark, sf)
    return graph.tx_stats(led.transactions, led.inputs, led.outputs)


@query("g7_address_tx_projection", sql("SELECT DISTINCT address, txid FROM tx_inputs WHERE address IS NOT NULL"))
def _(spark, sf):
    return graph.address_tx_projection(fx.ledger(spark, sf).inputs)


@query("p1_pattern_features", sql("""
SELECT seed, txid, min_hop, input_addr_count, output_addr_count, vin_count, vout_count, total_output_sats,
       top_output_ratio FROM features WHERE pos <= 200"""))
def _(spark, sf):
    return patterns.pattern_features(fx.ledger(spark, sf), fx.seeds(spark, sf), limit=200)


@query("p1_pattern_features_full", sql("""
SELECT seed, txid, min_hop, input_addr_count, output_addr_count, vin_count, vout_count, total_output_sats,
       top_output_ratio FROM features"""))
def _(spark, sf):
    return patterns.pattern_features(fx.ledger(spark, sf), fx.seeds(spark, sf))


@query("p3_rule_predicate", sql("""
SELECT s.txid, r.rule_id FROM stats s JOIN rules r
  ON (r.min_input_addr_count IS NULL OR s.input_addr_count >= r.min_input_addr_count)
 AND (r.max_input_addr_count IS NULL OR s.input_addr_count <= r.max_input_addr_count)
 AND (r.min_output_addr_count IS NULL OR s.output_addr_count >= r.min_output_addr_count)
 AND (r.max_output_addr_count IS NULL OR s.output_addr_count <= r.max_output_addr_count)
 AND (r.min_output_ratio IS NULL OR CASE WHEN s.total_output_sats = 0 THEN 0.0::DOUBLE
      ELSE CAST(s.max_output_sats AS DOUBLE) / CAST(s.total_output_sats AS DOUBLE) END >= r.min_output_ratio)"""))
def _(spark, sf):
    led = fx.ledger(spark, sf)
    ratio = F.coalesce(F.try_divide(F.col("max_output_sats").cast("double"),
                                    F.col("total_output_sats").cast("double")), F.lit(0.0))
    shapes = graph.tx_stats(led.transactions, led.inputs, led.outputs).withColumn("top_output_ratio", ratio)
    hits = [F.when(patterns.rule_predicate(r.bounds), F.lit(r.rule_id)) for r in patterns.RULES]
    rule = F.explode(F.filter(F.array(*hits), lambda r: r.isNotNull()))
    return shapes.select("txid", rule.alias("rule_id"))


@query("p2_pattern_rules", sql("""
SELECT r.rule_id, r.pattern_name, r.severity_weight, count(s.txid) AS transactions FROM rules r LEFT JOIN stats s
  ON (r.min_input_addr_count IS NULL OR s.input_addr_count >= r.min_input_addr_count)
 AND (r.max_input_addr_count IS NULL OR s.input_addr_count <= r.max_input_addr_count)
 AND (r.min_output_addr_count IS NULL OR s.output_addr_count >= r.min_output_addr_count)
 AND (r.max_output_addr_count IS NULL OR s.output_addr_count <= r.max_output_addr_count)
 AND (r.min_output_ratio IS NULL OR CASE WHEN s.total_output_sats = 0 THEN 0.0::DOUBLE
      ELSE CAST(s.max_output_sats AS DOUBLE) / CAST(s.total_output_sats AS DOUBLE) END >= r.min_output_ratio)
GROUP BY ALL"""))
def _(spark, sf):
    """The rule table beside the number of transactions on which each rule holds."""
    led = fx.ledger(spark, sf)
    hits = patterns.evaluate_matches(patterns.rule_hits(led).withColumn("min_hop", F.lit(1))).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("transactions"))
    return patterns.pattern_rules(spark).join(hits, "rule_id", "left").select(
        "rule_id", "pattern_name", "severity_weight", F.coalesce("transactions", F.lit(0)).alias("transactions"))


@query("p5_evaluate_matches", sql(f"""
SELECT seed, txid, min_hop, rule_id, pattern_name, 'PATTERN_' || pattern_name AS reason_code, confidence,
       severity_weight, input_addr_count, output_addr_count,
       CAST(round(CAST(top_output_ratio AS DECIMAL(28,12)), 4) AS DOUBLE) AS top_output_ratio
FROM matches """))
def _(spark, sf):
    found = patterns.pattern_matches(fx.ledger(spark, sf), fx.seeds(spark, sf), ranked=False)
    return found.select("seed", "txid", "min_hop", "rule_id", "pattern_name", "reason_code", "confidence",
                        "severity_weight", "input_addr_count", "output_addr_count", "top_output_ratio")


@query("p6_pattern_matches", sql("""
SELECT seed, txid, min_hop, pattern_name, rule_id, 'PATTERN_' || pattern_name AS reason_code, confidence,
       CAST(row_number() OVER (PARTITION BY seed ORDER BY min_hop, confidence DESC, pattern_name, txid)
            AS INTEGER) AS rank
FROM matches"""))
def _(spark, sf):
    return patterns.pattern_matches(fx.ledger(spark, sf), fx.seeds(spark, sf)).select(
        "seed", "txid", "min_hop", "pattern_name", "rule_id", "reason_code", "confidence", "rank")


@query("p8_pattern_signals", sql("""
SELECT seed, pattern_name, rule_ids, 'btc_behavioral_patterns' AS ruleset_id, '1.0.0' AS ruleset_version,
       tx_count, closest_hop, avg_confidence, density, severity_weight, rank FROM signals"""))
def _(spark, sf):
    return patterns.pattern_signals(fx.ledger(spark, sf), fx.seeds(spark, sf))


def _findings(spark, sf):
    return risk.risk_findings(fx.ledger(spark, sf), fx.seeds(spark, sf),
                              fx.entity_links(spark, sf), fx.entities(spark, sf))


@query("r1_r2_category_weight_reason", sql(f"""
SELECT entity_id, {CATEGORY_WEIGHT} AS weight,
       'EXPOSURE_TO_' || replace(replace(upper(category), ' ', '_'), '-', '_') || '_ENTITY' AS reason_code
FROM entities"""))
def _(spark, sf):
    category = F.col("category")
    return fx.entities(spark, sf).select(
        "entity_id", category_weight(category).alias("weight"), reason_code(category).alias("reason_code"))


@query("r4_entity_findings", sql("SELECT * EXCLUDE (source_ord) FROM entity_findings"))
def _(spark, sf):
    return risk.entity_findings(_exposures(spark, sf)).drop("source_ord", "metadata")


@query("r5_pattern_findings", sql("SELECT * EXCLUDE (source_ord) FROM pattern_findings"))
def _(spark, sf):
    signals = patterns.pattern_signals(fx.ledger(spark, sf), fx.seeds(spark, sf))
    return risk.pattern_findings(signals).drop("source_ord", "metadata")


_SECTION = """
SELECT '{name}' AS section, seed, CAST(row_number() OVER (PARTITION BY seed ORDER BY {order}) AS INTEGER) AS rank,
       finding_type, reason_code, base_contribution, confidence, effective_contribution
FROM findings WHERE {where} QUALIFY rank <= 10"""
_EFFECT = "effective_contribution DESC, source_ord, position"


@query("r7_risk_report", sql(" UNION ALL ".join([
    _SECTION.format(name="findings", order="source_ord, position", where="true"),
    _SECTION.format(name="finding_rows", order=_EFFECT, where="true"),
    _SECTION.format(name="top_entity_drivers", order=_EFFECT, where="source_ord = 0"),
    _SECTION.format(name="top_pattern_drivers", order=_EFFECT, where="source_ord = 1")])))
def _(spark, sf):
    report = risk.risk_report(fx.seeds(spark, sf), _findings(spark, sf))
    out = None
    for name in ("findings", "finding_rows", "top_entity_drivers", "top_pattern_drivers"):
        rows = report.select(F.lit(name).alias("section"), F.col("address").alias("seed"),
                             F.explode(name).alias("f")).select("section", "seed", "f.*").drop("metadata")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("r8_batch_risk", sql("SELECT * FROM risk"))
def _(spark, sf):
    return risk.batch_risk(fx.ledger(spark, sf), fx.seeds(spark, sf),
                           fx.entity_links(spark, sf), fx.entities(spark, sf))


@query("s10_write_risk_assessments", sql("""
SELECT r.seed AS address, 3 AS max_hops, CAST(NULL AS INTEGER) AS result_limit, CAST(r.score AS DOUBLE) AS score, r.risk_band,
       CASE WHEN p.seed IS NOT NULL THEN 'btc_behavioral_patterns' END AS ruleset_id,
       CASE WHEN p.seed IS NOT NULL THEN '1.0.0' END AS ruleset_version,
       coalesce(f.n, 0) AS finding_rows
FROM risk r LEFT JOIN (SELECT DISTINCT seed FROM signals) p ON p.seed = r.seed
LEFT JOIN (SELECT seed, least(10, count(*)) AS n FROM findings GROUP BY 1) f ON f.seed = r.seed"""))
def _(spark, sf):
    report = risk.risk_report(fx.seeds(spark, sf), _findings(spark, sf))
    summary, rows = risk.write_risk_assessments(report, risk.scratch_directory(spark), fx.AS_OF)
    counts = rows.groupBy("assessment_id").agg(F.count(F.lit(1)).alias("finding_rows"))
    return summary.join(counts, "assessment_id", "left").select(
        "address", "max_hops", "result_limit", F.col("score").cast("double").alias("score"), "risk_band",
        "ruleset_id", "ruleset_version", F.coalesce("finding_rows", F.lit(0)).alias("finding_rows"))
