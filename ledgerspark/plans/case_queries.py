"""Queries over cases, actors, quality gates, metric windows and heuristics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerspark.operators import cases, graph, heuristics, quality, risk
from ledgerspark.plans.catalog import query
from ledgerspark.plans.label_queries import membership, resolved
from ledgerspark.plans.sqlparts import part
from ledgerspark.plans.sqlparts import query as sql
from ledgerspark.session import fresh_path
from ledgerspark.sources import fixture as fx
from ledgerspark.sources import readers
from ledgerspark.streaming import ingest, metrics

part("case_actions", """
SELECT event_id AS action_id, user_id AS case_id,
       CASE event_type WHEN 'view' THEN 'NOTE' WHEN 'signup' THEN 'SYSTEM_REPORT_GENERATED'
            WHEN 'purchase' THEN 'USER_FREEZE_REQUEST_SENT' WHEN 'click' THEN 'USER_POLICE_REPORT_FILED'
            WHEN 'error' THEN 'RESPONSE_EXCHANGE' END AS action_type,
       (['DONE', 'PENDING', 'FAILED', 'CANCELLED'])[event_id % 4 + 1] AS status,
       CAST(ts AS DATE) AS action_date, event_type || ' ' || event_id AS title, ts AS created_at FROM events""")
part("user_cases", """
SELECT user_id AS case_id, 'Case ' || user_id AS title,
       (['OPEN', 'PENDING', 'RESOLVED', 'CLOSED', 'ARCHIVED'])[user_id % 5 + 1] AS status,
       min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY 1""")
part("metrics", """
SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value / 100 AS latency_s,
       event_type = 'purchase' AS is_hit, event_type IN ('purchase', 'view') AS is_lookup,
       event_type = 'signup' AS is_started, event_type = 'error' AS is_failed FROM events""")


@query("c1_case_dashboard", sql("""
SELECT c.*, l.title AS last_action_title, l.action_date AS last_action_date,
       coalesce(p.n, 0) AS pending_actions, coalesce(d.n, 0) AS document_count,
       CAST(datesub('day', c.updated_at, TIMESTAMP '2024-02-01') AS INTEGER) AS days_since_update
FROM user_cases c
LEFT JOIN (SELECT * FROM case_actions QUALIFY row_number() OVER (
             PARTITION BY case_id ORDER BY action_date DESC, created_at DESC, action_id DESC) = 1) l USING (case_id)
LEFT JOIN (SELECT case_id, count(*) AS n FROM case_actions WHERE status = 'PENDING' GROUP BY 1) p USING (case_id)
LEFT JOIN (SELECT user_id AS case_id, count(*) AS n FROM events WHERE event_type IN ('signup', 'purchase')
           GROUP BY 1) d USING (case_id)""").replace("SELECT c.*, l.title", "SELECT c.case_id, c.title, c.status, c.created_at, c.updated_at, l.title"))
def _(spark, sf):
    return cases.case_dashboard(fx.user_cases(spark, sf), fx.case_actions(spark, sf), fx.case_documents(spark, sf), fx.AS_OF)


@query("c2_case_flags", sql("""
SELECT case_id, coalesce(n_report > 0, false) AS report_generated, coalesce(n_freeze > 0, false) AS freeze_request_sent,
       coalesce(n_police > 0, false) AS police_report_filed, coalesce(n_lawyer > 0, false) AS lawyer_engaged,
       coalesce(n_exchange > 0, false) AS exchange_responded
FROM user_cases LEFT JOIN (
  SELECT case_id, count(*) FILTER (kind = 'SYSTEM_REPORT_GENERATED') AS n_report,
         count(*) FILTER (done AND kind IN ('SYSTEM_FREEZE_REQUEST_CREATED', 'USER_FREEZE_REQUEST_SENT')) AS n_freeze,
         count(*) FILTER (done AND kind = 'USER_POLICE_REPORT_FILED') AS n_police,
         count(*) FILTER (done AND kind = 'USER_LAWYER_CONTACTED') AS n_lawyer,
         count(*) FILTER (kind = 'RESPONSE_EXCHANGE' AND (done OR status = 'PENDING')) AS n_exchange
  FROM (SELECT case_id, action_type AS kind, status, status = 'DONE' AS done FROM case_actions)
  GROUP BY case_id) USING (case_id)"""))
def _(spark, sf):
    return cases.case_flags(fx.user_cases(spark, sf), fx.case_actions(spark, sf))


@query("c3_case_timeline", sql("SELECT * FROM case_actions"))
def _(spark, sf):
    return cases.case_timeline(fx.case_actions(spark, sf))


# Addresses of the reported transactions in the roles an investigation gives them.
part("investigations", """
SELECT c.case_id, o.address,
       CASE WHEN o.address = c.recipient THEN 'FRAUD_ORIGIN' WHEN r.is_evidential THEN 'EXCHANGE_DEPOSIT'
            ELSE 'HOP' END AS address_role,
       CASE WHEN o.address = c.recipient THEN 'L1' WHEN r.is_evidential THEN 'L2' END AS confidence_level,
       CAST(o.amount_sats / 100000000.0 AS DECIMAL(20,8)) AS amount_btc, c.incident_date AS seen_at
FROM fraud_cases c JOIN tx_outputs o ON o.txid = c.fraud_txid JOIN resolved r ON r.address = o.address""")
part("evidence_rows", """
SELECT 'SAME_ADDRESS' AS match_type, address AS shared_value, * EXCLUDE (address) FROM investigations
WHERE address_role <> 'EXCHANGE_DEPOSIT'
UNION ALL SELECT 'SAME_CIO_CLUSTER', m.cluster_id, i.* EXCLUDE (address) FROM investigations i JOIN members m
  ON m.address = i.address WHERE address_role <> 'EXCHANGE_DEPOSIT'
UNION ALL SELECT 'SAME_EXCHANGE_DEPOSIT', address, * EXCLUDE (address) FROM investigations
WHERE address_role = 'EXCHANGE_DEPOSIT'""")
part("actor_matches", """
SELECT match_type, shared_value, count(DISTINCT case_id) AS case_count,
       CAST(sum(amount_btc) AS DECIMAL(38,8)) AS total_btc_involved, min(seen_at) AS first_seen,
       max(seen_at) AS last_seen, coalesce(min(confidence_level), 'L3') AS confidence_level
FROM evidence_rows GROUP BY 1, 2 HAVING count(DISTINCT case_id) > 1""")
part("profiled", "SELECT *, right(shared_value, 1) AS profile_id FROM actor_matches")
part("profiles", """
SELECT s.profile_id, c.total_cases, CAST(a.total AS DOUBLE) AS total_btc_stolen, s.first_case_date, s.last_case_date,
       s.known_address_count, s.known_cluster_count, s.known_exchange_count, s.match_count,
       CAST(least(100, c.total_cases * 10 + CASE WHEN a.total > 100 THEN 20 WHEN a.total > 10 THEN 10 ELSE 0 END)
            AS INTEGER) AS risk_score
FROM (SELECT profile_id, min(first_seen) AS first_case_date, max(last_seen) AS last_case_date,
             count(*) FILTER (match_type = 'SAME_ADDRESS') AS known_address_count,
             count(*) FILTER (match_type = 'SAME_CIO_CLUSTER') AS known_cluster_count,
             count(*) FILTER (match_type = 'SAME_EXCHANGE_DEPOSIT') AS known_exchange_count, count(*) AS match_count
      FROM profiled GROUP BY 1) s
JOIN (SELECT p.profile_id, count(DISTINCT e.case_id) AS total_cases FROM profiled p
      JOIN evidence_rows e USING (match_type, shared_value) GROUP BY 1) c USING (profile_id)
JOIN (SELECT profile_id, sum(DISTINCT total_btc_involved) AS total FROM profiled GROUP BY 1) a USING (profile_id)""")


def investigations(spark, sf):
    out = fx.ledger(spark, sf).outputs
    role = (
        F.when(F.col("address") == F.col("recipient"), "FRAUD_ORIGIN")
        .when(F.col("is_evidential"), "EXCHANGE_DEPOSIT").otherwise("HOP")
    )
    level = F.when(F.col("address") == F.col("recipient"), "L1").when(F.col("is_evidential"), "L2")
    return (
        fx.fraud_cases(spark, sf).join(out, F.col("txid") == F.col("fraud_txid"))
        .join(resolved(spark, sf).select("address", "is_evidential"), "address")
        .select("case_id", "address", role.alias("address_role"), level.alias("confidence_level"),
                fx._btc(F.col("amount_sats")).alias("amount_btc"), F.col("incident_date").alias("seen_at"))
    )


def _matches(spark, sf):
    return cases.actor_matches(investigations(spark, sf), membership(spark, sf))


def _profiles(spark, sf):
    matches = _matches(spark, sf).withColumn("profile_id", F.right("shared_value", F.lit(1)))
    return cases.actor_profile_refresh(matches, cases.actor_match_members(investigations(spark, sf), membership(spark, sf)))


_SAME = """
SELECT DISTINCT i.case_id, 'SAME_ADDRESS' AS match_type, i.address AS shared_value,
       coalesce(i.confidence_level, 'L3') AS confidence_level, s.n_cases - 1 AS matching_case_count
FROM investigations i JOIN (
  SELECT o.address, count(DISTINCT o.case_id) AS n_cases FROM investigations o WHERE {sharing} GROUP BY 1) s USING (address)
WHERE {where} AND s.n_cases > 1"""


@query("c4_actor_matches_same_address", sql(_SAME.format(where="true", sharing="true")))
def _(spark, sf):
    return cases.actor_matches_same_address(investigations(spark, sf))


@query("c4_actor_matches_members", sql("""
SELECT address, case_id, n FROM (SELECT DISTINCT address, case_id FROM investigations)
JOIN (SELECT address, count(DISTINCT case_id) AS n FROM investigations GROUP BY 1 HAVING count(DISTINCT case_id) > 1)
USING (address)"""))
def _(spark, sf):
    return cases.shared_addresses(investigations(spark, sf))


@query("c5_validate", sql("""
SELECT action_id, action_type NOT IN ('NOTE', 'SYSTEM_REPORT_GENERATED', 'USER_FREEZE_REQUEST_SENT',
       'USER_POLICE_REPORT_FILED') AS is_bad_type, status = 'FAILED' AS is_bad_status
FROM case_actions WHERE action_type = 'RESPONSE_EXCHANGE' OR status = 'FAILED'"""))
def _(spark, sf):
    spoiled = fx.case_actions(spark, sf).withColumn(
        "action_type", F.when(F.col("action_type") == "RESPONSE_EXCHANGE", "REPLY").otherwise(F.col("action_type"))
    ).withColumn("status", F.when(F.col("status") == "FAILED", "BROKEN").otherwise(F.col("status")))
    _valid, bad = cases.split_valid(spoiled, "case_actions")
    has = lambda name: F.array_contains("reasons", f"{name} not allowed")
    return bad.select("action_id", has("action_type").alias("is_bad_type"), has("status").alias("is_bad_status"))


@query("c6_actor_matches", sql("SELECT * REPLACE (CAST(total_btc_involved AS DOUBLE) AS total_btc_involved) FROM actor_matches"))
def _(spark, sf):
    return _matches(spark, sf).withColumn("total_btc_involved", F.col("total_btc_involved").cast("double"))


@query("c6_actor_match_members", sql("""
SELECT DISTINCT match_type, shared_value, case_id FROM evidence_rows JOIN actor_matches USING (match_type, shared_value)"""))
def _(spark, sf):
    return cases.actor_match_members(investigations(spark, sf), membership(spark, sf))


@query("c7_actor_profile_refresh", sql("SELECT * FROM profiles"))
def _(spark, sf):
    return _profiles(spark, sf).withColumn("total_btc_stolen", F.col("total_btc_stolen").cast("double"))


@query("c8_actor_overview", sql("""
SELECT profile_id, total_cases, total_btc_stolen, risk_score, first_case_date, last_case_date,
       nullif(known_address_count, 0) AS address_count, nullif(known_cluster_count, 0) AS cluster_count,
       nullif(known_exchange_count, 0) AS exchange_count, match_count,
       CAST(datesub('day', last_case_date, TIMESTAMP '2024-02-01') AS INTEGER) AS days_since_last_case
FROM profiles"""))
def _(spark, sf):
    return cases.actor_overview(_profiles(spark, sf), fx.AS_OF).withColumn(
        "total_btc_stolen", F.col("total_btc_stolen").cast("double"))


@query("c10_exclude_exchange_deposits", sql(_SAME.format(
    where="i.address_role <> 'EXCHANGE_DEPOSIT'", sharing="o.address_role <> 'EXCHANGE_DEPOSIT'")))
def _(spark, sf):
    rows = investigations(spark, sf).where(F.col("address_role") != "EXCHANGE_DEPOSIT")
    return cases.actor_matches_same_address(rows, exclude_exchange_deposits=True)


@query("c11_usage_rollup", sql("""
SELECT CAST(ts AS DATE) AS day, user_id AS key_id, event_type AS endpoint, count(*) AS calls,
       count(*) FILTER (event_type = 'error') AS errors,
       CAST(round(CAST(sum(CAST(value AS DECIMAL(18,4))) / count(*) AS DECIMAL(28,12)), 4) AS DOUBLE) AS mean_ms
FROM events GROUP BY ROLLUP (day, key_id, endpoint)"""))
def _(spark, sf):
    return cases.usage_rollup(fx.usage_log(spark, sf))


# -- gates -------------------------------------------------------------------------------

part("scored", """
SELECT score, toxic = 1 AS positive FROM labels
JOIN risk ON seed = 'addr' || lpad(CAST(doc_id AS VARCHAR), 8, '0')""")


def confusion_sql(threshold: str) -> str:
    rate = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0::DOUBLE)"
    return f"""
SELECT tp, fp, fn, tn, {rate('tp', '(tp + fp)')} AS precision, {rate('tp', '(tp + fn)')} AS recall,
       {rate('2 * tp', '(2 * tp + fp + fn)')} AS f1, {rate('fp', '(fp + tn)')} AS fpr, {rate('fn', '(fn + tp)')} AS fnr,
       {rate('(tp + tn)', '(tp + fp + fn + tn)')} AS accuracy
FROM (SELECT count(*) FILTER (score >= {threshold} AND positive) AS tp,
             count(*) FILTER (score >= {threshold} AND NOT positive) AS fp,
             count(*) FILTER (score < {threshold} AND positive) AS fn,
             count(*) FILTER (score < {threshold} AND NOT positive) AS tn FROM scored)"""


part("base_metrics", confusion_sql("100"))
part("candidate_metrics", confusion_sql("50"))


def _scored(spark, sf):
    scores = risk.batch_risk(fx.ledger(spark, sf), fx.seeds(spark, sf), fx.entity_links(spark, sf),
                             fx.entities(spark, sf))
    return fx.gold_labels(spark, sf).join(scores.withColumnRenamed("seed", "address"), "address")


@query("e2_confusion_metrics", sql("SELECT * FROM candidate_metrics"))
def _(spark, sf):
    return quality.confusion_metrics(_scored(spark, sf))


@query("e3_quality_gate", sql("""
SELECT precision >= 0.85 AS precision_ok, recall >= 0.75 AS recall_ok, fpr <= 0.10 AS fpr_ok,
       precision >= 0.85 AND recall >= 0.75 AND fpr <= 0.10 AS all_ok FROM candidate_metrics"""))
def _(spark, sf):
    return quality.quality_gate(quality.confusion_metrics(_scored(spark, sf)))


@query("e4_regression_gate", sql("""
SELECT metric, base, candidate, CASE WHEN metric IN ('fpr', 'fnr') THEN candidate - base ELSE base - candidate END
       AS worsening, 0.0::DOUBLE AS allowed,
       CASE WHEN metric IN ('fpr', 'fnr') THEN candidate - base ELSE base - candidate END <= 0 AS ok
FROM (UNPIVOT (SELECT precision, recall, f1, fpr, fnr FROM base_metrics) ON COLUMNS(*) INTO NAME metric VALUE base)
JOIN (UNPIVOT (SELECT precision, recall, f1, fpr, fnr FROM candidate_metrics) ON COLUMNS(*) INTO NAME metric VALUE candidate)
USING (metric)"""))
def _(spark, sf):
    from ledgerspark.session import materialize

    scored = materialize(_scored(spark, sf), "scored")
    return quality.regression_gate(quality.confusion_metrics(scored, 100.0), quality.confusion_metrics(scored, 50.0))


@query("s5_read_policy_gate", sql("""
SELECT metric, CASE WHEN metric IN ('fpr', 'fnr') THEN candidate - base ELSE base - candidate END AS worsening,
       CASE WHEN metric = 'recall' THEN 0.02::DOUBLE WHEN metric = 'fpr' THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS allowed
FROM (UNPIVOT (SELECT precision, recall, f1, fpr, fnr FROM base_metrics) ON COLUMNS(*) INTO NAME metric VALUE base)
JOIN (UNPIVOT (SELECT precision, recall, f1, fpr, fnr FROM candidate_metrics) ON COLUMNS(*) INTO NAME metric VALUE candidate)
USING (metric)"""))
def _(spark, sf):
    """A policy document, one threshold overridden, decides over the scored labels."""
    from ledgerspark.session import materialize

    path = fresh_path(spark, "policy")
    spark.createDataFrame([(0.02, 0.5)], "max_recall_drop double, max_fpr_increase double").write.json(path)
    policy = readers.read_policy(spark, path, max_fpr_increase=0.01)
    scored = materialize(_scored(spark, sf), "scored")
    return quality.regression_gate(quality.confusion_metrics(scored, 100.0), quality.confusion_metrics(scored, 50.0), policy).select(
        "metric", "worsening", "allowed")


part("dq", """
SELECT (SELECT count(*) FROM blocks) AS blocks, (SELECT count(*) FROM transactions) AS transactions,
       (SELECT count(*) FROM tx_outputs) AS tx_outputs, (SELECT count(*) FROM tx_inputs) AS tx_inputs,
       (SELECT count(*) FROM tx_inputs WHERE prev_txid IS NOT NULL) AS non_coinbase_inputs,
       (SELECT count(*) FROM tx_outputs o WHERE spent_by_txid IS NOT NULL AND NOT EXISTS (
          SELECT 1 FROM transactions t WHERE t.txid = o.spent_by_txid)) AS dangling_spent_links,
       (SELECT count(*) FROM tx_outputs o WHERE spent_by_txid IS NOT NULL AND NOT EXISTS (
          SELECT 1 FROM tx_inputs i WHERE i.txid = o.spent_by_txid AND i.prev_txid = o.txid
          AND i.prev_vout = o.vout_index)) AS invalid_spent_links,
       (SELECT count(*) FROM tx_inputs i JOIN tx_outputs o ON o.txid = i.prev_txid AND o.vout_index = i.prev_vout)
         AS resolvable_inputs,
       (SELECT count(*) FROM tx_inputs i JOIN tx_outputs o ON o.txid = i.prev_txid AND o.vout_index = i.prev_vout
          WHERE o.spent_by_txid = i.txid) AS covered,
       (SELECT count(*) FROM tx_inputs WHERE prev_txid IS NOT NULL AND address IS NOT NULL) AS with_address,
       (SELECT count(*) FROM tx_inputs WHERE prev_txid IS NOT NULL AND amount_sats IS NOT NULL) AS with_amount""")


@query("e5_data_quality", sql("""
SELECT *, dangling_spent_links_ok AND invalid_spent_links_ok AND input_address_fill_ok AND input_amount_fill_ok
          AND spent_link_coverage_ok AS all_ok FROM (
  SELECT *, dangling_spent_links <= 0 AS dangling_spent_links_ok, invalid_spent_links <= 0 AS invalid_spent_links_ok,
         input_address_fill_rate >= 0.95 AS input_address_fill_ok, input_amount_fill_rate >= 0.95 AS input_amount_fill_ok,
         spent_link_coverage >= 0.98 AS spent_link_coverage_ok
  FROM (SELECT * EXCLUDE (with_address, with_amount, covered),
               CAST(with_address AS DOUBLE) / non_coinbase_inputs AS input_address_fill_rate,
               CAST(with_amount AS DOUBLE) / non_coinbase_inputs AS input_amount_fill_rate,
               CAST(covered AS DOUBLE) / resolvable_inputs AS spent_link_coverage FROM dq))"""))
def _(spark, sf):
    return quality.data_quality(fx.ledger(spark, sf))


# -- metric windows ----------------------------------------------------------------------


def windows_sql(part_expr: str, whole_expr: str, minutes: int, slide: int, test: str) -> str:
    offsets = ", ".join(str(k * slide) for k in range(minutes // slide))
    return f"""
SELECT window_start, window_start + INTERVAL {minutes} MINUTE AS window_end, part, whole,
       CAST(part AS DOUBLE) / nullif(whole, 0) AS rate, coalesce(CAST(part AS DOUBLE) / nullif(whole, 0) {test}, false)
         AS is_breach
FROM (SELECT time_bucket(INTERVAL {slide} MINUTE, ts) - to_minutes(k) AS window_start,
             count(*) FILTER ({part_expr}) AS part, count(*) FILTER ({whole_expr}) AS whole
      FROM metrics, (SELECT unnest([{offsets}]) AS k) GROUP BY 1)"""


part("hit_windows", windows_sql("is_hit", "is_lookup", 30, 30, "< 0.3"))


def _ntz(df, *names):
    for name in names:
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


def _windows(df):
    return _ntz(df, "window_start", "window_end")


@query("w2_error_rate", sql(windows_sql("status_code >= 500", "true", 5, 5, "> 0.05")))
def _(spark, sf):
    return _windows(metrics.error_rate(fx.metrics(spark, sf)))


@query("w2_upstream_error_rate_sliding", sql(windows_sql("status_code >= 500", "true", 10, 5, "> 0.20")))
def _(spark, sf):
    return _windows(metrics.error_rate(fx.metrics(spark, sf), metrics.UPSTREAM_ERRORS))


@query("w2_failure_rate_sliding", sql(windows_sql("is_failed", "is_started", 60, 15, "> 0.10")))
def _(spark, sf):
    return _windows(metrics.failure_rate(fx.metrics(spark, sf)))


@query("w3_latency_p95", sql("""
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, quantile_cont(latency_s, 0.95) AS p95,
       quantile_cont(latency_s, 0.95) > 1 AS is_breach FROM metrics GROUP BY 1"""))
def _(spark, sf):
    return _ntz(metrics.latency_p95(fx.metrics(spark, sf), limit=1.0), "window_start")


@query("w4_hit_rate", sql("SELECT * FROM hit_windows"))
def _(spark, sf):
    return _windows(metrics.hit_rate(fx.metrics(spark, sf)))


@query("w5_absence", sql("""
SELECT ts AS silent_from, after AS silent_until FROM (SELECT ts, lead(ts) OVER (ORDER BY ts) AS after FROM metrics)
WHERE after - ts > INTERVAL 3 MINUTE"""))
def _(spark, sf):
    return _ntz(metrics.absence(fx.metrics(spark, sf)), "silent_from", "silent_until")


@query("w6_sustained_alert", sql("""
SELECT min(window_start) AS pending_from, max(window_end) AS until, count(*) AS windows
FROM (SELECT *, sum(CASE WHEN is_breach THEN 0 ELSE 1 END) OVER (ORDER BY window_start) AS calm FROM hit_windows)
WHERE is_breach GROUP BY calm HAVING max(window_end) - min(window_start) >= INTERVAL 60 MINUTE"""))
def _(spark, sf):
    return _ntz(metrics.sustained_alert(metrics.hit_rate(fx.metrics(spark, sf)), 60), "pending_from", "until")


@query("w7_gauge_thresholds", sql("""
SELECT event_id, alert, is_breach FROM (
  SELECT event_id, 'CPUTemperatureCritical' AS alert, value > 80 AS is_breach FROM events
  UNION ALL SELECT event_id, 'CPUTemperatureWarning', value > 70 FROM events)"""))
def _(spark, sf):
    samples = fx.table(spark, sf, "events").select("event_id", F.lit("cpu_temp_celsius").alias("gauge"), "ts", "value")
    return metrics.gauge_thresholds(samples).select("event_id", "alert", "is_breach")


def _event_stream(spark, sf):
    """The events table as a stream of metrics."""
    source = fx.table(spark, sf, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    kind = F.col("event_type")
    return stream.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(kind == "error", 500).otherwise(200).alias("status_code"),
        (F.col("value") / 100).alias("latency_s"))


def _latest_windows(spark, windows, keys, name):
    """Run an updating stream to its end; the last update of each window wins."""
    from ledgerspark.sources.sinks import read_upsert, write_upsert

    table, marks = fresh_path(spark, name), fresh_path(spark, "stream-checkpoint")
    (windows.writeStream.outputMode("update").option("checkpointLocation", marks)
     .foreachBatch(lambda batch, batch_id: write_upsert(batch, table, batch_id))
     .trigger(availableNow=True).start().awaitTermination())
    return read_upsert(spark, table, keys)


@query("w2_w8_error_rate_stream", sql(windows_sql("status_code >= 500", "true", 5, 5, "> 0.05")))
def _(spark, sf):
    windows = metrics.error_rate(metrics.with_watermark(_event_stream(spark, sf)))
    return _windows(_latest_windows(spark, windows, ["window_start", "window_end"], "error-windows"))


@query("w3_latency_p95_stream", sql("""
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, quantile_disc(latency_s, 0.95) AS p95,
       quantile_disc(latency_s, 0.95) > 1 AS is_breach FROM metrics GROUP BY 1"""))
def _(spark, sf):
    windows = metrics.latency_p95_stream(_event_stream(spark, sf).withWatermark("ts", metrics.LATE_AFTER), 1.0)
    return _ntz(_latest_windows(spark, windows, ["window_start"], "latency-windows"), "window_start")


@query("w1_stream_ingest", sql("""
SELECT o.txid, o.vout_index, o.address, s.script_type, o.amount_sats, o.spent_by_txid
FROM tx_outputs o JOIN script_types s USING (address)"""))
def _(spark, sf):
    tables, marks = fresh_path(spark, "ingest"), fresh_path(spark, "stream-checkpoint")
    documents = fx.block_documents(spark, sf)
    ingest.stream_ingest(spark, documents, tables, marks).awaitTermination()
    return ingest.ingested_ledger(spark, tables).outputs


# -- heuristics --------------------------------------------------------------------------


def _edges(spark, sf):
    led = fx.ledger(spark, sf)
    return graph.address_edges(led.inputs, led.outputs)


@query("h1_fan_degrees", sql("""
SELECT address, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, sum(i) >= 30 AS is_fan_in,
       sum(o) >= 30 AS is_fan_out
FROM (SELECT src AS address, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY 1"""))
def _(spark, sf):
    return heuristics.fan_degrees(_edges(spark, sf))


@query("h2_reconvergence", sql("""
SELECT b.seed, b.address, b.min_hop, count(*) AS predecessors
FROM reach a JOIN edges e ON e.src = a.address
JOIN reach b ON b.seed = a.seed AND b.address = e.dst AND b.min_hop = a.min_hop + 1
WHERE b.min_hop <= 2 GROUP BY 1, 2, 3 HAVING count(*) > 1"""))
def _(spark, sf):
    led = fx.ledger(spark, sf)
    return heuristics.reconvergence(graph.reach(fx.seeds(spark, sf), led.inputs, led.outputs, 2), _edges(spark, sf))


def _purchases(spark, sf):
    """(inputs, outputs) of a sparser ledger: each order is a payment of its customer to the suppliers of its lines."""
    orders = fx.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey")).alias("address"))
    lines = fx.table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey")).alias("address"))
    return (orders.select("address", F.col("o_orderkey").cast("string").alias("txid")),
            lines.select(F.col("l_orderkey").cast("string").alias("txid"), "address"))


@query("h3_dead_ends", """
SELECT DISTINCT 'c' || o_custkey AS seed, 's' || l_suppkey AS address, 1 AS min_hop
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def _(spark, sf):
    inputs, outputs = _purchases(spark, sf)
    seeds = inputs.select(F.col("address").alias("seed")).distinct()
    return heuristics.dead_ends(graph.reach(seeds, inputs, outputs, 3), inputs, outputs)


@query("h4_layering", """
SELECT head, length, tail FROM (
  SELECT o_custkey, count(*) - 2 AS length, (list(node ORDER BY o_orderdate, o_orderkey))[2] AS head,
         (list(node ORDER BY o_orderdate, o_orderkey))[-2] AS tail
  FROM (SELECT *, 'o' || o_orderkey AS node FROM orders) GROUP BY 1) WHERE length >= 2""")
def _(spark, sf):
    """Each customer's orders in a row make one chain; its ends have no payer or no payee."""
    orders = fx.table(spark, sf, "orders").withColumn("src", F.concat(F.lit("o"), F.col("o_orderkey")))
    after = F.lead("src").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = orders.withColumn("dst", after).where(F.col("dst").isNotNull()).select("src", "dst")
    return heuristics.layering(edges)


@query("h5_change_output_flags", sql("""
SELECT o.txid, o.vout_index,
       coalesce(o.mine AND count(*) FILTER (o.mine) OVER t = 1, false) AS by_script_type,
       NOT o.is_round AND count(*) FILTER (o.is_round) OVER t > 0 AS by_round_amount,
       EXISTS (SELECT 1 FROM tx_inputs i WHERE i.txid = o.txid AND i.address = o.address) AS by_reuse,
       count(*) FILTER (o.out_of_order) OVER t = 0 AS is_bip69, o.vout_index = max(o.vout_index) OVER t AS by_position
FROM (SELECT o.txid, o.vout_index, o.address, o.amount_sats % 10000 = 0 AS is_round,
             coalesce(it.low = it.high AND s.script_type = it.low, false) AS mine,
             coalesce((lead(amount_sats) OVER w < amount_sats) OR
                      (lead(amount_sats) OVER w = amount_sats AND lead(o.address) OVER w < o.address), false)
               AS out_of_order
      FROM tx_outputs o JOIN script_types s ON s.address = o.address
      LEFT JOIN (SELECT txid, min(script_type) AS low, max(script_type) AS high
                 FROM tx_inputs JOIN script_types USING (address) GROUP BY 1) it ON it.txid = o.txid
      WINDOW w AS (PARTITION BY o.txid ORDER BY o.vout_index)) o
WINDOW t AS (PARTITION BY o.txid)"""))
def _(spark, sf):
    led = fx.ledger(spark, sf)
    return heuristics.change_output_flags(led.inputs, led.outputs, fx.script_types(spark, sf))


@query("h6_activity_hours", sql("""
SELECT key, arg_min(start, (n, start)) AS quiet_start, min(n) AS quiet_activity, any_value(total) AS total FROM (
  SELECT c.key, s.start, sum(CASE WHEN (c.hour - s.start + 24) % 24 < 8 THEN c.n ELSE 0 END)::BIGINT AS n,
         sum(c.n)::BIGINT AS total
  FROM (SELECT user_id AS key, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2) c,
       (SELECT CAST(unnest(range(24)) AS INTEGER) AS start) s GROUP BY 1, 2) GROUP BY 1""").replace("(n, start))", "{'n': n, 's': start})"))
def _(spark, sf):
    return heuristics.activity_hours(fx.table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts"))


def _flows(spark, sf):
    return fx.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts",
        F.round(F.col("value") * 100).cast("bigint").alias("amount"))


part("flows", """
SELECT event_id AS id, user_id AS key, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
       CAST(round(value * 100) AS BIGINT) AS amount FROM events""")


@query("h7_window_24h_volume", sql("""
SELECT id, key, ts, amount, CAST(sum(amount) OVER (PARTITION BY key ORDER BY sec
       RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS BIGINT) AS volume_24h FROM flows"""))
def _(spark, sf):
    return heuristics.window_24h_volume(_flows(spark, sf))


@query("h8_velocity_change", sql("""
SELECT id, key, sec - prev AS gap_seconds, CAST(prev - first AS DOUBLE) / (n - 2) AS mean_gap_seconds,
       CAST(sec - prev AS DOUBLE) / nullif(CAST(prev - first AS DOUBLE) / (n - 2), 0) AS ratio
FROM (SELECT id, key, sec, lag(sec) OVER w AS prev, min(sec) OVER (PARTITION BY key) AS first, row_number() OVER w AS n
      FROM flows WINDOW w AS (PARTITION BY key ORDER BY sec, id)) WHERE n > 2"""))
def _(spark, sf):
    return heuristics.velocity_change(_flows(spark, sf))


@query("h9_amount_time_match", sql("""
SELECT o.id, CASE WHEN o.is_direct THEN 'L1' WHEN bool_or(i.is_exchange AND i.at - o.at <= 21600) THEN 'L2'
                  WHEN count(i.at) > 0 THEN 'L3' ELSE 'L4' END AS level
FROM (SELECT event_id AS id, epoch(date_trunc('hour', ts)) AS at, CAST(round(value * 1000000) AS BIGINT) AS amount, event_type = 'view' AS is_direct
      FROM events WHERE event_type IN ('view', 'click', 'error')) o
LEFT JOIN (SELECT DISTINCT epoch(date_trunc('hour', ts)) AS at, CAST(round(value * 1000000) AS BIGINT) AS amount, event_type = 'purchase' AS is_exchange
           FROM events WHERE event_type IN ('purchase', 'signup')) i
  ON i.at > o.at AND i.at <= o.at + 172800 AND abs(i.amount - o.amount) <= 100000
GROUP BY o.id, o.is_direct"""))
def _(spark, sf):
    kind = F.col("event_type")
    rows = fx.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"),
        F.round(F.col("value") * 1_000_000).cast("bigint").alias("amount_sats"), (kind == "view").alias("is_direct"),
        (kind == "purchase").alias("is_exchange"), kind)
    return heuristics.amount_time_match(
        rows.where(kind.isin("view", "click", "error")), rows.where(kind.isin("purchase", "signup")))


part("peels", """
SELECT s.txid FROM stats s WHERE input_addr_count = 1 AND output_addr_count = 2
AND max_output_sats >= 0.70 * total_output_sats""")
part("peel_steps", """
SELECT p.txid AS node, l.follower FROM peels p JOIN (
  SELECT txid, (max({'a': amount_sats, 'v': -vout_index, 's': spent_by_txid})).s AS follower FROM tx_outputs GROUP BY 1) l
USING (txid) WHERE l.follower IN (SELECT txid FROM peels)""")


@query("h10_peeling_chain", sql("""
WITH walk AS (
  SELECT txid AS head, txid AS node, 1 AS length FROM peels WHERE txid NOT IN (SELECT follower FROM peel_steps)
  UNION ALL SELECT head, follower, length + 1 FROM walk JOIN peel_steps USING (node))
SELECT head, CAST(max(length) AS BIGINT) AS length, arg_max(node, length) AS tail FROM walk GROUP BY 1""", recursive=True))
def _(spark, sf):
    led = fx.ledger(spark, sf)
    shapes = graph.tx_stats(led.transactions, led.inputs, led.outputs)
    return heuristics.peeling_chain(shapes, led.outputs, min_length=1)
