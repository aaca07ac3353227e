"""Queries that read documents, normalise them, merge batches and link spends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import attribution, normalize, upsert
from ledgerspark.plans.catalog import query
from ledgerspark.plans.sqlparts import part
from ledgerspark.plans.sqlparts import query as sql
from ledgerspark.session import fresh_path
from ledgerspark.sources import fixture as fx
from ledgerspark.sources import readers, sinks


def _blocks(spark, sf):
    return readers.read_blocks(spark, fx.block_documents(spark, sf))


def _txs(spark, sf):
    return readers.read_transactions(spark, fx.transaction_documents(spark, sf))


part("fraud_cases", """
SELECT 'case' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS case_id, o.txid AS fraud_txid, o.recipient,
       o_orderdate AS incident_date, o_totalprice AS fraud_amount_eur
FROM orders JOIN (
  SELECT txid, (max({'s': amount_sats, 'v': -vout_index, 'a': address})).a AS recipient FROM tx_outputs GROUP BY 1) o
ON o.txid = 'tx' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0')
WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""")
part("case_victims", """
SELECT DISTINCT case_id, address FROM fraud_cases JOIN tx_inputs ON txid = fraud_txid WHERE address IS NOT NULL""")
part("script_types", """
SELECT 'addr' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS address, p_type AS script_type FROM part""")
part("resolved_inputs", """
SELECT i.txid, i.vin_index, i.prev_txid, i.prev_vout, o.address, o.amount_sats
FROM tx_inputs i LEFT JOIN tx_outputs o ON o.txid = i.prev_txid AND o.vout_index = i.prev_vout""")
part("addresses", """
SELECT address, (max({'h': block_height, 's': script_type}) FILTER (script_type IS NOT NULL)).s AS script_type,
       min(first_seen) AS first_seen, max(first_seen) AS last_seen
FROM (SELECT txid, address, NULL AS script_type FROM tx_inputs WHERE address IS NOT NULL
      UNION ALL SELECT txid, address, script_type FROM tx_outputs JOIN script_types USING (address))
JOIN transactions USING (txid) GROUP BY 1""")


@query("s1_read_blocks", sql("""
SELECT t.block_height AS height, sha256(CAST(t.block_height AS VARCHAR)) AS hash, count(*) AS tx_count,
       CAST(sum(coalesce(i.n, 0)) AS BIGINT) AS vin_count, CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS vout_count
FROM transactions t LEFT JOIN (SELECT txid, count(*) AS n FROM tx_inputs GROUP BY 1) i USING (txid)
LEFT JOIN (SELECT txid, count(*) AS n FROM tx_outputs GROUP BY 1) o USING (txid) GROUP BY 1"""))
def _(spark, sf):
    tx = _blocks(spark, sf).select("height", "hash", F.explode("tx").alias("tx"))
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).cast("bigint")
    return tx.groupBy("height", "hash").agg(
        F.count(F.lit(1)).alias("tx_count"), F.sum(F.greatest(F.lit(0), size("tx.vin"))).alias("vin_count"),
        F.sum(F.greatest(F.lit(0), size("tx.vout"))).alias("vout_count"))


@query("s2_n8_read_transactions", sql("""
SELECT txid, vout_index, address, CAST(amount_sats / 100000000.0 AS DOUBLE) AS btc
FROM tx_outputs"""))
def _(spark, sf):
    return normalize.lookup_outputs(_txs(spark, sf)).withColumn("btc", F.col("btc").cast("double"))


@query("s3_ledger_tables", sql("""
SELECT 'blocks' AS name, count(*) AS n FROM blocks UNION ALL SELECT 'transactions', count(*) FROM transactions
UNION ALL SELECT 'tx_inputs', count(*) FROM tx_inputs UNION ALL SELECT 'tx_outputs', count(*) FROM tx_outputs
UNION ALL SELECT 'addresses', count(*) FROM addresses"""))
def _(spark, sf):
    led, base = fx.ledger(spark, sf), fresh_path(spark, "ledger")
    outputs = led.outputs.join(fx.script_types(spark, sf), "address")
    written = {"blocks": led.blocks, "transactions": led.transactions, "tx_inputs": led.inputs,
               "tx_outputs": led.outputs,
               "addresses": normalize.derive_addresses(led.inputs, outputs, led.transactions)}
    for name, df in written.items():
        df.write.parquet(f"{base}/{name}")
    back = readers.ledger_tables(spark, base)
    tables = {"blocks": back.blocks, "transactions": back.transactions, "tx_inputs": back.inputs,
              "tx_outputs": back.outputs, "addresses": back.addresses}
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("s4_e1_read_gold_labels", sql("""
SELECT 'gold' || CAST(doc_id AS VARCHAR) AS case_id, 'addr' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS address,
       toxic = 1 AS is_positive FROM labels"""))
def _(spark, sf):
    from ledgerspark.functions.labels import is_positive_label

    path = fresh_path(spark, "gold-json")
    fx.gold_labels(spark, sf).write.json(path)
    return readers.read_gold_labels(spark, path).select(
        "case_id", "address", is_positive_label(F.col("expected_label")).alias("is_positive"))


@query("s6_read_manual_attributions", sql("""
SELECT 'addr' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS address,
       CASE WHEN p_size <= 2 THEN 'HTX desk' ELSE 'Corner Exchange' END AS entity_name, 'EXCHANGE' AS entity_type,
       false AS is_sanctioned
FROM part WHERE p_type = 'MEDIUM' AND p_size <= 4"""))
def _(spark, sf):
    path = fresh_path(spark, "manual-json")
    entry = F.struct("address", F.col("exchange_name").alias("entity_name"), F.lit("EXCHANGE").alias("entity_type"),
                     F.lit(False).alias("is_sanctioned"))
    fx.manual_names(spark, sf).select(F.to_json(F.array(entry)).alias("value")).write.text(path)
    return readers.read_manual_attributions(spark, path, multi_line=False).drop("abuse_category", "notes")


@query("s7_read_case_intake", sql("""
SELECT c.case_id, 'Person ' || c.case_id AS victim_name, strftime(c.incident_date, '%Y-%m-%d') AS incident_date,
       printf('%.8f', o.amount_sats / 100000000.0) AS fraud_amount,
       CASE WHEN fraud_amount_eur > 250000 AND fraud_amount_eur < 400000 THEN 'Acme (Hardware)' WHEN fraud_amount_eur > 250000 THEN 'Acme'
            ELSE 'Hardware' END AS wallet_type, c.fraud_txid, c.recipient, coalesce(v.victim, '') AS victim
FROM fraud_cases c
JOIN (SELECT txid, address, arg_min(amount_sats, vout_index) AS amount_sats FROM tx_outputs GROUP BY 1, 2) o
  ON o.txid = c.fraud_txid AND o.address = c.recipient
LEFT JOIN (SELECT case_id, min(address) AS victim FROM case_victims GROUP BY 1) v ON v.case_id = c.case_id"""))
def _(spark, sf):
    raw = readers.read_case_intake(spark, fx.intake_documents(spark, sf), multi_line=False)
    return raw.select("case_id", "victim_name", "incident_date", "fraud_amount", "wallet_type", "fraud_txid",
                      "recipient", F.coalesce(F.get("victim_addresses", F.lit(0)), F.lit("")).alias("victim"))


@query("s11_to_report_json", sql("SELECT txid, vout_index, amount_sats FROM tx_outputs"))
def _(spark, sf):
    path = fresh_path(spark, "report")
    df = fx.ledger(spark, sf).outputs.select("txid", "vout_index", "amount_sats")
    sinks.to_report_json(df, path)
    return spark.read.schema(df.schema).json(f"{path}/rows")


@query("s12_init_source_cursors", sql("""
SELECT source_key, CASE WHEN is_authoritative THEN 'OK' ELSE 'NEVER' END AS last_status FROM (
  SELECT DISTINCT s.source_key, s.is_authoritative FROM attributions a JOIN sources s USING (source_key))"""))
def _(spark, sf):
    seen = fx.attributions(spark, sf).select("source_key").distinct().join(
        F.broadcast(attribution.attribution_sources(spark)), "source_key")
    stored = seen.where("is_authoritative").select("source_key", F.lit("OK").alias("last_status"))
    return sinks.init_source_cursors(stored, seen)


@query("n1_normalize_blocks", sql("SELECT height, hash, timestamp FROM blocks"))
def _(spark, sf):
    return normalize.normalize_blocks(_blocks(spark, sf)).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("n2_normalize_transactions", sql("SELECT txid, block_height, fee_sats, vsize, first_seen FROM transactions"))
def _(spark, sf):
    return normalize.normalize_transactions(_blocks(spark, sf)).withColumn(
        "first_seen", F.col("first_seen").cast("timestamp_ntz"))


@query("n3_normalize_inputs", sql("SELECT txid, vin_index, prev_txid, prev_vout FROM tx_inputs"))
def _(spark, sf):
    return normalize.normalize_inputs(_blocks(spark, sf))


@query("n4_n5_n6_normalize_outputs", sql("""
SELECT txid, vout_index, address, script_type, amount_sats FROM tx_outputs JOIN script_types USING (address)"""))
def _(spark, sf):
    return normalize.normalize_outputs(_blocks(spark, sf))


@query("n7_resolve_prevouts", sql("SELECT * FROM resolved_inputs"))
def _(spark, sf):
    raw = _blocks(spark, sf)
    return normalize.resolve_prevouts(normalize.normalize_inputs(raw), normalize.normalize_outputs(raw))


@query("n9_tx_block_info", sql("""
SELECT txid, block_height, strftime(first_seen, '%d.%m.%Y %H:%M UTC') AS timestamp FROM transactions"""))
def _(spark, sf):
    return normalize.tx_block_info(_txs(spark, sf))


@query("n10_derive_addresses", sql("SELECT * FROM addresses"))
def _(spark, sf):
    led = fx.ledger(spark, sf)
    outputs = led.outputs.join(fx.script_types(spark, sf), "address")
    return normalize.derive_addresses(led.inputs, outputs, led.transactions)


@query("n11_normalize_single_tx", sql("""
SELECT t.txid, t.block_height, t.fee_sats, coalesce(i.n, 0) AS inputs, coalesce(o.n, 0) AS outputs
FROM transactions t
LEFT JOIN (SELECT txid, count(*) AS n FROM tx_inputs WHERE prev_txid IS NOT NULL GROUP BY 1) i USING (txid)
LEFT JOIN (SELECT txid, count(*) AS n FROM tx_outputs GROUP BY 1) o USING (txid) WHERE t.fee_sats IS NOT NULL"""))
def _(spark, sf):
    transactions, inputs, outputs = normalize.normalize_single_tx(_txs(spark, sf))
    count = lambda df, name: df.groupBy("txid").agg(F.count(F.lit(1)).alias(name))
    return (
        transactions.select("txid", "block_height", "fee_sats")
        .join(count(inputs, "inputs"), "txid", "left").join(count(outputs, "outputs"), "txid", "left")
        .na.fill(0, ["inputs", "outputs"])
    )


# -- merges: the stored half holds transactions before mid-1998, the batch those from 1997 on --

_STORED, _BATCH = "first_seen < TIMESTAMP '1998-07-01'", "first_seen >= TIMESTAMP '1997-01-01'"


def _halves(spark, sf):
    txs = fx.ledger(spark, sf).transactions
    stored = txs.where("first_seen < TIMESTAMP_NTZ '1998-07-01'").select("txid", "vsize", "block_height")
    batch = txs.where("first_seen >= TIMESTAMP_NTZ '1997-01-01'").select(
        "txid", (F.col("vsize") + 1).alias("vsize"), "block_height")
    return stored, batch


_MERGE = """
SELECT txid, CASE WHEN {new} THEN vsize + 1 ELSE vsize END AS vsize, block_height FROM transactions"""


@query("u1_upsert_latest", sql(_MERGE.format(new=_BATCH)))
def _(spark, sf):
    stored, batch = _halves(spark, sf)
    repeated = batch.withColumn("seq", F.lit(2)).unionByName(
        batch.withColumn("seq", F.lit(1)).withColumn("vsize", F.lit(0)))
    fresh = upsert.last_per_key(repeated, ["txid"], "seq").drop("seq")
    return upsert.upsert_latest(stored, fresh, ["txid"], ["vsize", "block_height"])


@query("u2_insert_ignore", sql(_MERGE.format(new=f"NOT ({_STORED})")))
def _(spark, sf):
    stored, batch = _halves(spark, sf)
    return upsert.insert_ignore(stored, batch, ["txid"])


@query("s9_write_upsert", sql(_MERGE.format(new=_BATCH)))
def _(spark, sf):
    stored, batch = _halves(spark, sf)
    table = fresh_path(spark, "upsert")
    sinks.write_upsert(stored, table, 0)
    sinks.write_upsert(batch, table, 1)
    sinks.write_upsert(batch, table, 1)
    return sinks.read_upsert(spark, table, ["txid"])


@query("u3_upsert_coalesce", sql("SELECT * FROM addresses"))
def _(spark, sf):
    led = fx.ledger(spark, sf)
    outputs = led.outputs.join(fx.script_types(spark, sf), "address")
    early = led.transactions.where("first_seen < TIMESTAMP_NTZ '1998-07-01'")
    late = led.transactions.where("first_seen >= TIMESTAMP_NTZ '1998-07-01'")
    return upsert.upsert_coalesce(normalize.derive_addresses(led.inputs, outputs, early),
                                  normalize.derive_addresses(led.inputs, outputs, late))


@query("u4_link_spent_outputs", sql("SELECT * FROM tx_outputs"))
def _(spark, sf):
    led = fx.ledger(spark, sf)
    bare = led.outputs.withColumn("spent_by_txid", F.lit("stale"))
    linked = upsert.link_spent_outputs(bare, led.inputs, led.transactions)
    return linked.withColumn("spent_by_txid", F.nullif("spent_by_txid", F.lit("stale")))


@query("u5_link_spent_if_null", sql("""
SELECT txid, vout_index, address, amount_sats,
       CASE WHEN vout_index = 0 THEN 'first' ELSE spent_by_txid END AS spent_by_txid FROM tx_outputs"""))
def _(spark, sf):
    led = fx.ledger(spark, sf)
    bare = led.outputs.withColumn("spent_by_txid", F.when(F.col("vout_index") == 0, "first"))
    return upsert.link_spent_if_null(bare, led.inputs, led.transactions)


@query("u6_u7_cursor_plan_range", sql("""
SELECT b.height, b.hash FROM blocks b,
  (SELECT max(block_height) AS cursor FROM transactions WHERE first_seen < TIMESTAMP '2000-01-01') c,
  (SELECT max(height) AS tip FROM blocks) t
WHERE b.height BETWEEN c.cursor + 1 AND t.tip"""))
def _(spark, sf):
    blocks = fx.ledger(spark, sf).blocks
    done = blocks.where("timestamp < TIMESTAMP_NTZ '2000-01-01'")
    stored = done.agg(F.min("height").alias("last_height")).select(F.lit("main").alias("cursor_key"), "last_height")
    cursors = upsert.set_cursor(stored, "main", done.agg(F.max("height").alias("last_height")))
    span = upsert.plan_range(spark, upsert.get_cursor(cursors, "main"), blocks.agg(F.max("height").alias("tip")))
    # Scalar subqueries: the bounds reach the scan as a filter.
    return blocks.where(F.col("height").between(span.select("lo").scalar(), span.select("hi").scalar())).select("height", "hash")


@query("u8_upsert_attributions", sql("""
SELECT address, source_key, is_authoritative,
       CASE WHEN is_authoritative THEN entity_name ELSE 'new ' || entity_name END AS entity_name FROM attributions"""))
def _(spark, sf):
    stored = fx.attributions(spark, sf).join(
        F.broadcast(attribution.attribution_sources(spark)).select("source_key", "is_authoritative"), "source_key",
    ).select("address", "source_key", "is_authoritative", "entity_name")
    scraped = stored.withColumn("is_authoritative", F.lit(False)).withColumn(
        "entity_name", F.concat(F.lit("new "), "entity_name"))
    return upsert.upsert_attributions(stored, scraped)
