"""Queries that trace the reported cases and describe the traces.

The SQL follows a whole trace by recursion keyed by case and spending transaction (``whole_trace``), and the sequences of
outputs that lead to a transaction as lists, whose order is the order of the queue. Traces of one hop with at most ONE_HOP_BRANCHES
receivers (``_one_hop``) have SQL of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerspark.operators import flow, trace
from ledgerspark.plans.catalog import query
from ledgerspark.plans.label_queries import contact_sql, note_sql, resolved
from ledgerspark.plans.sqlparts import PARTS, part
from ledgerspark.plans.sqlparts import query as sql
from ledgerspark.session import materialize
from ledgerspark.sources import fixture as fx

ONE_HOP_BRANCHES = 5

_traces: dict[tuple, trace.Trace] = {}


def _cached(spark, sf, name, make):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _traces:
        _traces[key] = make()
    return _traces[key]


def _cases(spark, sf):
    return _cached(spark, sf, "cases", lambda: fx.fraud_cases(spark, sf))


def _victims(spark, sf):
    return _cached(spark, sf, "victims", lambda: materialize(fx.case_victims(spark, sf), "victims"))


def _attribution(spark, sf):
    return _cached(spark, sf, "attribution", lambda: materialize(resolved(spark, sf), "attribution"))


def _spends(spark, sf):
    return _cached(spark, sf, "spends", lambda: trace.spend_table(fx.ledger(spark, sf)))


def _full(spark, sf, max_hops=None, max_branches=None):
    return _cached(spark, sf, f"full{max_hops}-{max_branches}", lambda: trace.full_trace(
        fx.ledger(spark, sf), _cases(spark, sf), _victims(spark, sf), _attribution(spark, sf), max_hops, max_branches, _spends(spark, sf)))


def _one_hop(spark, sf):
    return _full(spark, sf, 1, ONE_HOP_BRANCHES)


def _trace(spark, sf, max_hops=None, max_branches=None):
    return trace.trace_cases(fx.ledger(spark, sf), _cases(spark, sf), _attribution(spark, sf), max_hops, max_branches, _spends(spark, sf))


# -- SQL: hop 0 and the first hop ----------------------------------------------------------

part("case_amounts", """
SELECT c.case_id, coalesce(r.s, 0) AS recipient_sats, CAST(coalesce(v.s, 0) AS BIGINT) AS victim_sats,
       CAST(CASE WHEN coalesce(r.s, 0) > 0 THEN r.s ELSE coalesce(v.s, 0) END AS BIGINT) AS stolen_sats
FROM fraud_cases c
LEFT JOIN (SELECT c.case_id, arg_min(o.amount_sats, o.vout_index) AS s FROM fraud_cases c JOIN tx_outputs o
           ON o.txid = c.fraud_txid AND o.address = c.recipient GROUP BY 1) r ON r.case_id = c.case_id
LEFT JOIN (SELECT c.case_id, sum(i.amount_sats) AS s FROM fraud_cases c JOIN tx_inputs i ON i.txid = c.fraud_txid
           JOIN case_victims v ON v.case_id = c.case_id AND v.address = i.address GROUP BY 1) v ON v.case_id = c.case_id""")
part("zero_legs", """
SELECT c.case_id, 'from' AS side, CAST(i.vin_index AS BIGINT) AS ord, i.address, coalesce(i.amount_sats, 0) AS sats,
       false AS is_exchange, NULL AS exchange, NULL AS source, NULL AS label, false AS is_sanctioned
FROM fraud_cases c JOIN tx_inputs i ON i.txid = c.fraud_txid AND i.address IS NOT NULL
UNION ALL
SELECT c.case_id, 'to', 0, c.recipient, a.stolen_sats, r.is_evidential,
       CASE WHEN r.is_evidential THEN r.exchange END, CASE WHEN r.is_evidential THEN r.source END,
       CASE WHEN r.is_evidential THEN r.label END, r.is_sanctioned AND r.is_evidential
FROM fraud_cases c JOIN case_amounts a USING (case_id) JOIN resolved r ON r.address = c.recipient
UNION ALL
SELECT case_id, 'to', CAST(min(vout_index) + 1 AS BIGINT), o.address, arg_max(amount_sats, vout_index), true,
       any_value(r.exchange), any_value(r.source), any_value(r.label), any_value(r.is_sanctioned)
FROM fraud_cases c JOIN tx_outputs o ON o.txid = c.fraud_txid AND o.address <> c.recipient
JOIN resolved r ON r.address = o.address AND r.is_evidential GROUP BY case_id, o.address""")
part("zero_hits", """
SELECT case_id, arg_min(exchange, ord) AS exchange, arg_min(source, ord) AS source, arg_min(label, ord) AS label,
       min(ord) AS ord, string_agg(DISTINCT exchange, ', ' ORDER BY exchange) AS names, bool_or(is_sanctioned) AS is_sanctioned
FROM zero_legs WHERE is_exchange GROUP BY 1""")
part("first_hop", """
SELECT c.case_id, c.recipient AS current, o.sats AS from_sats, o.spender AS txid
FROM fraud_cases c JOIN (
  SELECT txid, address, arg_min(amount_sats, vout_index) AS sats,
         (min({'v': vout_index, 's': spent_by_txid})).s AS spender FROM tx_outputs GROUP BY 1, 2) o
ON o.txid = c.fraud_txid AND o.address = c.recipient WHERE o.spender IS NOT NULL""")
part("first_outs", """
SELECT h.case_id, h.txid, h.from_sats, o.vout_index, o.address, o.amount_sats AS sats, o.address = h.current AS is_self,
       r.is_evidential AND o.address <> h.current AS is_exchange, r.is_sanctioned AND o.address <> h.current AS is_sanctioned,
       r.exchange, r.source, r.label
FROM first_hop h JOIN tx_outputs o ON o.txid = h.txid JOIN resolved r ON r.address = o.address""")
part("first_shown", """
SELECT case_id, ord, address, sats, is_exchange, CASE WHEN is_exchange THEN exchange END AS exchange,
       CASE WHEN is_exchange THEN source END AS source, CASE WHEN is_exchange THEN label END AS label FROM (
  SELECT *, CAST(vout_index AS BIGINT) AS ord FROM first_outs WHERE is_exchange
  UNION ALL
  SELECT *, 1099511627776 + row_number() OVER (PARTITION BY case_id ORDER BY sats DESC, vout_index) AS ord
  FROM first_outs WHERE NOT is_exchange AND (is_self OR sats > 546)
  QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY sats DESC, vout_index) <= 5)""")
part("first_facts", """
SELECT case_id, bool_or(is_exchange) AS has_exchange, max(sats) AS max_sats, bool_or(is_sanctioned) AS is_sanctioned,
       min(from_sats) AS from_sats, arg_min(exchange, vout_index) FILTER (is_exchange) AS exchange,
       arg_min(source, vout_index) FILTER (is_exchange) AS source, arg_min(label, vout_index) FILTER (is_exchange) AS label,
       coalesce(string_agg(DISTINCT exchange, ', ' ORDER BY exchange) FILTER (is_exchange), '') AS names,
       min(from_sats) > 0 AND max(sats) > 3 * min(from_sats) AND NOT bool_or(is_exchange) AS is_pooling
FROM first_outs GROUP BY 1""")
_BTC = "printf('%.8f', {} / 100000000.0)"
_TIME = "strftime(t.first_seen, '%d.%m.%Y %H:%M UTC')"
part("one_hops", f"""
SELECT h.case_id, 1 AS hop, 1 AS depth, h.txid,
       CASE WHEN f.has_exchange THEN 'Exchange deposit -> ' || f.names WHEN f.is_pooling THEN '{trace.POOLING_LABEL}'
            ELSE 'UTXO forwarding' END AS label,
       t.block_height AS block, {_TIME} AS timestamp, CASE WHEN f.has_exchange OR f.is_pooling THEN 'L2' ELSE 'L1' END AS confidence,
       CASE WHEN f.has_exchange THEN 'Exchange Intel Agent attribution (' || f.label || ')'
            WHEN f.is_pooling THEN '{trace.POOLING_METHOD}' ELSE 'Direct UTXO link' END AS method,
       CASE WHEN f.has_exchange THEN '{trace.FOUND_TEXTS[0]}' || f.names || '{trace.FOUND_TEXTS[1]}' || f.source || '.'
            WHEN f.is_pooling THEN '{trace.POOLED_TEXTS[0]}' || {_BTC.format('f.from_sats')} || '{trace.POOLED_TEXTS[1]}'
              || {_BTC.format('f.max_sats')} || '{trace.POOLED_TEXTS[2]}'
            ELSE '{trace.FORWARD_NOTE}' END || CASE WHEN f.is_sanctioned THEN '{trace.SANCTION_NOTE}' ELSE '' END AS notes,
       coalesce(f.is_sanctioned, false) AS is_sanctioned, CASE WHEN f.has_exchange THEN 'exchange' WHEN f.is_pooling THEN 'pooling' END AS chain_end_reason,
       f.exchange, f.source AS exchange_source
FROM first_hop h LEFT JOIN first_facts f USING (case_id) JOIN transactions t ON t.txid = h.txid""")
part("zero_hops", f"""
SELECT c.case_id, 0 AS hop, 0 AS depth, c.fraud_txid AS txid,
       CASE WHEN h.exchange IS NOT NULL THEN 'Theft → ' || h.exchange ELSE 'Theft — Consolidation' END AS label,
       t.block_height AS block, {_TIME} AS timestamp, CASE WHEN h.exchange IS NOT NULL THEN 'L2' ELSE 'L1' END AS confidence,
       CASE WHEN h.exchange IS NOT NULL THEN 'Direct exchange attribution (' || h.label || ')' ELSE 'Direct UTXO link' END AS method,
       coalesce(v.n, 0) || '{trace.ZERO_TEXTS[0]}' || {_BTC.format('a.stolen_sats')} || '{trace.ZERO_TEXTS[1]}' ||
         CASE WHEN h.ord > 0 THEN '{trace.DIRECT_TEXT}' || h.names || '.'
              WHEN h.ord = 0 THEN '{trace.DEPOSIT_TEXTS[0]}' || h.exchange || '{trace.DEPOSIT_TEXTS[1]}'
              ELSE '' END AS notes,
       coalesce(h.is_sanctioned, false) AS is_sanctioned, CAST(NULL AS VARCHAR) AS chain_end_reason, h.exchange, h.source AS exchange_source
FROM fraud_cases c JOIN case_amounts a USING (case_id) JOIN transactions t ON t.txid = c.fraud_txid
LEFT JOIN zero_hits h USING (case_id)
LEFT JOIN (SELECT case_id, count(*) AS n FROM case_victims GROUP BY 1) v USING (case_id)""")
part("all_hops", """
SELECT z.* REPLACE (CASE WHEN o.case_id IS NULL AND h.ord = 0 THEN 'exchange' END AS chain_end_reason)
FROM zero_hops z LEFT JOIN one_hops o USING (case_id) LEFT JOIN zero_hits h USING (case_id)
UNION ALL SELECT * FROM one_hops""")
part("all_legs", """
SELECT case_id, 0 AS hop, side, ord, address, sats, is_exchange, exchange FROM zero_legs
UNION ALL SELECT case_id, 1, 'from', 0, current, from_sats, false, NULL FROM first_hop
UNION ALL SELECT case_id, 1, 'to', ord, address, sats, is_exchange, exchange FROM first_shown""")
part("endpoints", f"""
SELECT case_id, hop, name, address, sats, source, 'L2' AS confidence, {contact_sql('name')} AS compliance_email,
       {note_sql('source')} AS note
FROM (SELECT h.case_id, h.hop, h.exchange AS name, h.exchange_source AS source, l.address, l.sats
      FROM all_hops h JOIN all_legs l ON l.case_id = h.case_id AND l.hop = h.hop AND l.side = 'to'
      WHERE h.exchange IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY h.case_id, h.hop
                                 ORDER BY CASE WHEN l.exchange = h.exchange THEN 0 ELSE 1 END, l.ord) = 1)
QUALIFY row_number() OVER (PARTITION BY case_id, address ORDER BY hop) = 1""")

part("first_paid", """
SELECT txid, address, min(vout_index) AS vout_index, arg_min(amount_sats, vout_index) AS sats,
       (min({'v': vout_index, 's': spent_by_txid})).s AS spender FROM tx_outputs WHERE address IS NOT NULL GROUP BY 1, 2""")
# Outputs of hops with what the trace makes of them; {hops} has case_id, txid, current and from_sats.
_OUTS = """
SELECT h.*, o.vout_index, o.address, o.amount_sats AS sats, o.address = h.current AS is_self,
       r.is_evidential AND o.address <> h.current AS is_exchange, r.is_sanctioned AND o.address <> h.current AS is_sanctioned,
       r.exchange, r.source, r.label,
       count(*) FILTER ((r.is_evidential AND o.address <> h.current) OR o.address = h.current OR o.amount_sats > 546) OVER hop AS visible,
       row_number() OVER (PARTITION BY h.case_id, h.txid ORDER BY o.amount_sats DESC, o.vout_index) AS by_size,
       row_number() OVER (PARTITION BY h.case_id, h.txid, (r.is_evidential AND o.address <> h.current)
                            OR NOT (o.address = h.current OR o.amount_sats > 546) ORDER BY o.amount_sats DESC, o.vout_index) AS place,
       h.from_sats > 0 AND max(o.amount_sats) OVER hop > 3 * h.from_sats
         AND NOT bool_or(r.is_evidential AND o.address <> h.current) OVER hop AS is_pooling
FROM {hops} h JOIN tx_outputs o ON o.txid = h.txid JOIN resolved r ON r.address = o.address
WINDOW hop AS (PARTITION BY h.case_id, h.txid)"""
_FOLLOWED = """
SELECT o.case_id, o.depth + 1 AS depth, list_append(o.path, CASE WHEN o.visible = 0 THEN 1 ELSE o.place END) AS path,
       f.address, f.sats, f.spender
FROM ({outs}) o JOIN first_paid f ON f.txid = o.txid AND f.address = o.address
WHERE NOT o.is_exchange AND NOT o.is_pooling AND (o.is_self OR o.sats > 546 OR (o.visible = 0 AND o.by_size = 1))"""
part("whole_trace", f"""
SELECT * FROM (
  WITH RECURSIVE w(case_id, txid, depth, path, current, from_sats) USING KEY (case_id, txid) AS (
    SELECT case_id, txid, 1, CAST([0] AS BIGINT[]), current, from_sats FROM first_hop
    UNION
    SELECT case_id, spender, depth, path, address, sats FROM (
      SELECT *, row_number() OVER (PARTITION BY case_id, spender ORDER BY path) AS nth
      FROM ({_FOLLOWED.format(outs=_OUTS.format(hops="w"))}) WHERE spender IS NOT NULL) n
    WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.case_id = n.case_id AND r.txid = n.spender))
  SELECT * FROM w)""")
part("trace_order", """
SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY depth, path) AS hop_no,
       CAST(row_number() OVER (PARTITION BY case_id ORDER BY depth, txid) AS INTEGER) AS hop FROM whole_trace""")
part("trace_outs", _OUTS.format(hops="trace_order"))
part("trace_shown", """
SELECT case_id, hop, hop_no, CASE WHEN is_exchange THEN CAST(vout_index AS BIGINT)
         ELSE 1099511627776 + CASE WHEN visible = 0 THEN 1 ELSE place END END AS ord,
       address, sats, is_exchange, CASE WHEN is_exchange THEN exchange END AS exchange,
       CASE WHEN is_exchange THEN source END AS source, CASE WHEN is_exchange THEN label END AS label
FROM trace_outs WHERE is_exchange OR is_self OR sats > 546 OR (visible = 0 AND by_size = 1)""")
part("trace_facts", """
SELECT case_id, hop, bool_or(is_exchange) AS has_exchange, max(sats) AS max_sats, bool_or(is_sanctioned) AS is_sanctioned,
       arg_min(exchange, vout_index) FILTER (is_exchange) AS exchange, arg_min(source, vout_index) FILTER (is_exchange) AS source,
       arg_min(label, vout_index) FILTER (is_exchange) AS label,
       coalesce(string_agg(DISTINCT exchange, ', ' ORDER BY exchange) FILTER (is_exchange), '') AS names, bool_or(is_pooling) AS is_pooling
FROM trace_outs GROUP BY 1, 2""")
part("trace_ended", f"""
SELECT i.*, (SELECT count(*) FROM trace_order h WHERE h.case_id = i.case_id
             AND (h.depth < i.depth OR (h.depth = i.depth AND h.path < i.path))) AS before
FROM ({_FOLLOWED.format(outs="SELECT * FROM trace_outs")}) i WHERE i.spender IS NULL""")
part("trace_marks", f"""
SELECT e.case_id, e.hop_no, string_agg(CASE WHEN r.is_evidential THEN ' Address identified as ' || r.exchange || '.'
         ELSE '{trace.UNSPENT_TEXTS[0]}' || substr(e.address, 1, 20) || '{trace.UNSPENT_TEXTS[1]}' END, '' ORDER BY e.depth, e.path) AS added,
       arg_max(CASE WHEN r.is_evidential THEN 'exchange' ELSE 'unspent' END, {{'d': e.depth, 'p': e.path}}) AS reason,
       arg_max(r.exchange, {{'d': e.depth, 'p': e.path}}) FILTER (r.is_evidential) AS exchange,
       arg_max(r.source, {{'d': e.depth, 'p': e.path}}) FILTER (r.is_evidential) AS source,
       arg_max(r.label, {{'d': e.depth, 'p': e.path}}) FILTER (r.is_evidential) AS label
FROM (SELECT e.case_id, e.depth, e.path, e.address, max(s.hop_no) AS hop_no
      FROM trace_ended e JOIN trace_shown s ON s.case_id = e.case_id AND s.address = e.address AND s.hop_no <= e.before
      GROUP BY 1, 2, 3, 4) e JOIN resolved r ON r.address = e.address GROUP BY 1, 2""")
part("later_hops", f"""
SELECT h.case_id, h.hop, h.depth, h.txid,
       CASE WHEN m.exchange IS NOT NULL THEN 'Exchange deposit -> ' || m.exchange WHEN f.has_exchange THEN 'Exchange deposit -> ' || f.names
            WHEN f.is_pooling THEN '{trace.POOLING_LABEL}' ELSE '{trace.FORWARD_LABEL}' END AS label,
       t.block_height AS block, {_TIME} AS timestamp,
       CASE WHEN m.exchange IS NOT NULL OR f.has_exchange OR f.is_pooling THEN 'L2' ELSE 'L1' END AS confidence,
       CASE WHEN m.exchange IS NOT NULL THEN 'Exchange Intel Agent attribution (' || m.label || ')'
            WHEN f.has_exchange THEN 'Exchange Intel Agent attribution (' || f.label || ')'
            WHEN f.is_pooling THEN '{trace.POOLING_METHOD}' ELSE '{trace.FORWARD_METHOD}' END AS method,
       CASE WHEN f.has_exchange THEN '{trace.FOUND_TEXTS[0]}' || f.names || '{trace.FOUND_TEXTS[1]}' || f.source || '.'
            WHEN f.is_pooling THEN '{trace.POOLED_TEXTS[0]}' || {_BTC.format('h.from_sats')} || '{trace.POOLED_TEXTS[1]}'
              || {_BTC.format('f.max_sats')} || '{trace.POOLED_TEXTS[2]}'
            ELSE '{trace.FORWARD_NOTE}' END || CASE WHEN f.is_sanctioned THEN '{trace.SANCTION_NOTE}' ELSE '' END
         || coalesce(m.added, '') AS notes,
       coalesce(f.is_sanctioned, false) AS is_sanctioned,
       coalesce(m.reason, CASE WHEN f.has_exchange THEN 'exchange' WHEN f.is_pooling THEN 'pooling' END) AS chain_end_reason,
       coalesce(m.exchange, f.exchange) AS exchange, CASE WHEN m.exchange IS NOT NULL THEN m.source ELSE f.source END AS exchange_source
FROM trace_order h LEFT JOIN trace_facts f USING (case_id, hop) LEFT JOIN trace_marks m ON m.case_id = h.case_id AND m.hop_no = h.hop_no
JOIN transactions t ON t.txid = h.txid""")
part("full_hops", """
SELECT z.* REPLACE (CASE WHEN o.case_id IS NULL AND h.ord = 0 THEN 'exchange' END AS chain_end_reason)
FROM zero_hops z LEFT JOIN (SELECT DISTINCT case_id FROM later_hops) o USING (case_id) LEFT JOIN zero_hits h USING (case_id)
UNION ALL SELECT * FROM later_hops""")
part("full_legs", """
SELECT case_id, 0 AS hop, side, ord, address, sats, is_exchange, exchange FROM zero_legs
UNION ALL SELECT case_id, hop, 'from', 0, current, from_sats, false, NULL FROM trace_order
UNION ALL SELECT case_id, hop, 'to', ord, address, sats, is_exchange, exchange FROM trace_shown""")
part("full_senders", """
SELECT l.case_id, l.hop, l.address, bool_or(v.address IS NOT NULL) AS is_victim FROM full_legs l
LEFT JOIN case_victims v ON v.case_id = l.case_id AND v.address = l.address WHERE l.side = 'from' AND l.hop > 0 GROUP BY 1, 2, 3""")
part("column_steps", """
SELECT DISTINCT s.case_id, s.hop, p.hop AS at, 1 AS w FROM full_senders s
JOIN full_legs p ON p.case_id = s.case_id AND p.address = s.address AND p.side = 'to' AND p.hop < s.hop
UNION SELECT s.case_id, s.hop, p.hop, 0 FROM full_senders s
JOIN full_senders p ON p.case_id = s.case_id AND p.address = s.address AND p.hop < s.hop""")
part("full_columns", """
SELECT case_id, hop, col AS from_column FROM (
  WITH RECURSIVE c(case_id, hop, col) USING KEY (case_id, hop) AS (
    SELECT case_id, 0, 0 FROM zero_hops
    UNION
    SELECT s.case_id, s.hop, CAST(coalesce(min(CASE WHEN s.is_victim THEN 0 ELSE r.col + e.w END), s.hop) AS INTEGER)
    FROM c JOIN full_senders s ON s.case_id = c.case_id AND s.hop = c.hop + 1
    LEFT JOIN column_steps e ON e.case_id = s.case_id AND e.hop = s.hop
    LEFT JOIN recurring.c r ON r.case_id = e.case_id AND r.hop = e.at GROUP BY s.case_id, s.hop)
  SELECT * FROM c)""")
_WHOLE = {"all_hops": "full_hops", "all_legs": "full_legs"}


def whole(name: str) -> None:
    """The part ``name`` of one-hop traces again, as ``full_<name>`` over whole ones."""
    _WHOLE[name] = f"full_{name}"
    body = re.sub(r"[a-z_0-9]+", lambda m: _WHOLE.get(m[0], m[0]), PARTS[name])
    if name == "graph_legs":
        head, _, tail = body.partition("       CASE WHEN l.hop = 0 THEN 0 WHEN EXISTS")
        body = head + "       k.from_column,\n" + tail[tail.index("       l.hop * 2"):] + (
            " JOIN full_columns k ON k.case_id = l.case_id AND k.hop = l.hop")
    part(f"full_{name}", body)


def whole_sql(body: str) -> str:
    """``body`` over whole traces."""
    return sql(re.sub(r"[a-z_0-9]+", lambda m: _WHOLE.get(m[0], m[0]), body))


whole("endpoints")

_HOP = ("SELECT case_id, hop, depth, txid, label, block, timestamp, confidence, method, notes, is_sanctioned, "
        "chain_end_reason, exchange, exchange_source FROM {}")
_HOP_COLUMNS = ["case_id", "hop", "depth", "txid", "label", "block", "timestamp", "confidence", "method", "notes",
                "is_sanctioned", "chain_end_reason", "exchange", "exchange_source"]
_LEG_COLUMNS = ["case_id", "hop", "side", "ord", "address", "sats", "is_exchange", "exchange"]


@query("t1_t2_stolen_amount", sql("SELECT * FROM case_amounts"))
def _(spark, sf):
    return trace.stolen_amount(_cases(spark, sf), _victims(spark, sf), fx.ledger(spark, sf))


@query("t3_spend_state", sql("""
SELECT txid, vout_index, CASE WHEN spender IS NOT NULL THEN 'spent' WHEN vout_index > 5 THEN 'unknown'
       WHEN spent_by_txid IS NULL THEN 'unspent' ELSE 'spent_unresolved' END AS state, spender
FROM (SELECT o.*, t.txid AS spender FROM tx_outputs o
      LEFT JOIN transactions t ON t.txid = o.spent_by_txid AND t.first_seen < TIMESTAMP '2001-01-01')"""))
def _(spark, sf):
    led = fx.ledger(spark, sf)
    known = led.outputs.where("vout_index <= 5")  # deeper outputs play the unknown ones
    late = led.transactions.where("first_seen >= TIMESTAMP_NTZ '2001-01-01'").select("txid")
    inputs = led.inputs.join(late, "txid", "left_anti")
    return trace.spend_state(led.outputs, known, inputs, led.transactions)


@query("t4_forward_spend_scan", sql("""
SELECT o.txid, o.vout_index, i.txid AS spender FROM tx_outputs o
JOIN transactions t ON t.txid = o.txid JOIN tx_inputs i ON i.prev_txid = o.txid AND i.prev_vout = o.vout_index
JOIN transactions s ON s.txid = i.txid
WHERE t.block_height > 0 AND s.block_height > t.block_height"""))
def _(spark, sf):
    led = fx.ledger(spark, sf)
    points = led.outputs.join(led.transactions, "txid").select("txid", "vout_index", F.col("block_height").alias("hint"))
    return trace.forward_spend_scan(points, led.inputs, led.transactions)


@query("t5_trace_cases", sql(_HOP.format("later_hops")))
def _(spark, sf):
    return _trace(spark, sf).hops.select(*_HOP_COLUMNS)


@query("t5_t8_trace_one_hop", sql(_HOP.format("one_hops")))
def _(spark, sf):
    return _trace(spark, sf, 1, ONE_HOP_BRANCHES).hops.select(*_HOP_COLUMNS)


@query("t6_hop_outputs", sql("SELECT * FROM all_legs WHERE hop = 1"))
def _(spark, sf):
    return _trace(spark, sf, 1, ONE_HOP_BRANCHES).legs.select(*_LEG_COLUMNS)


@query("t7_pooling_flag", sql("SELECT case_id, max_sats, from_sats, is_pooling FROM first_facts"))
def _(spark, sf):
    known = trace.known_addresses(_attribution(spark, sf))
    spends = _spends(spark, sf)
    items = materialize(trace._process(trace._first_queue(_cases(spark, sf), spends), None, 1, 1), "trace-items")
    return trace.hop_facts(trace._receivers_of(items, spends, known)).select("case_id", "max_sats", "from_sats", "is_pooling")


@query("t9_t10_full_trace_legs", sql("SELECT * FROM full_legs"))
def _(spark, sf):
    return _full(spark, sf).legs.select(*_LEG_COLUMNS)


@query("t11_build_hop0", sql(_HOP.format("zero_hops")))
def _(spark, sf):
    return trace.build_hop0(fx.ledger(spark, sf), _cases(spark, sf), _victims(spark, sf), _attribution(spark, sf)).hops.select(
        *_HOP_COLUMNS)


@query("t11_build_hop0_legs", sql("SELECT * FROM all_legs WHERE hop = 0"))
def _(spark, sf):
    return trace.build_hop0(fx.ledger(spark, sf), _cases(spark, sf), _victims(spark, sf), _attribution(spark, sf)).legs.select(
        *_LEG_COLUMNS)


part("link_nodes", """
SELECT * FROM (
  WITH RECURSIVE n(case_id, txid, depth, path) USING KEY (case_id, txid) AS (
    SELECT case_id, fraud_txid, 0, CAST([0] AS INTEGER[]) FROM fraud_cases
    UNION
    SELECT n.case_id, o.spent_by_txid, n.depth + 1, min(list_append(n.path, o.vout_index))
    FROM n JOIN tx_outputs o ON o.txid = n.txid AND o.spent_by_txid IS NOT NULL
    WHERE NOT EXISTS (SELECT 1 FROM recurring.n r WHERE r.case_id = n.case_id AND r.txid = o.spent_by_txid)
    GROUP BY n.case_id, o.spent_by_txid, n.depth)
  SELECT * FROM n)""")


@query("t12_ledger_hops", sql("""
SELECT n.case_id, n.hop, 'Hop ' || n.hop || ' - UTXO forwarding' AS label, n.to_txid AS txid, t.block_height AS block,
       strftime(t.first_seen, '%Y-%m-%d %H:%M UTC') AS timestamp, 'L1' AS confidence
FROM (SELECT n.case_id, n.txid, o.spent_by_txid AS to_txid,
             row_number() OVER (PARTITION BY n.case_id ORDER BY n.depth, n.path, o.vout_index) AS hop
      FROM link_nodes n JOIN tx_outputs o ON o.txid = n.txid AND o.spent_by_txid IS NOT NULL
      WHERE NOT EXISTS (SELECT 1 FROM link_nodes m WHERE m.case_id = n.case_id AND m.txid = o.spent_by_txid
                        AND (m.depth < n.depth OR (m.depth = n.depth AND m.path <= n.path)))) n
JOIN transactions t ON t.txid = n.txid"""))
def _(spark, sf):
    return trace.ledger_hops(fx.ledger(spark, sf), _cases(spark, sf), spends=_spends(spark, sf)).hops


@query("t12_ledger_hops_one_level", sql("""
SELECT c.case_id, CAST(row_number() OVER (PARTITION BY c.case_id ORDER BY o.vout_index) AS BIGINT) AS hop,
       o.spent_by_txid AS txid, t.block_height AS block
FROM fraud_cases c JOIN (SELECT * FROM tx_outputs WHERE spent_by_txid IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY txid ORDER BY vout_index) <= 5) o ON o.txid = c.fraud_txid
JOIN transactions t ON t.txid = c.fraud_txid"""))
def _(spark, sf):
    return trace.ledger_hops(fx.ledger(spark, sf), _cases(spark, sf), 1, ONE_HOP_BRANCHES, _spends(spark, sf)).hops.select(
        "case_id", "hop", "txid", "block")


@query("t13_exchange_endpoints", sql("SELECT * FROM endpoints"))
def _(spark, sf):
    return flow.exchange_endpoints(_one_hop(spark, sf))


part("freeze_rows", f"""
SELECT case_id, name, CAST(sum(sats) AS BIGINT) AS total_sats, count(*) AS address_count,
       arg_min(address, {{'h': hop, 'a': address}}) AS first_address,
       arg_min(compliance_email, {{'h': hop, 'a': address}}) AS compliance_email,
       arg_min(source, {{'h': hop, 'a': address}}) AS source, 'L2' AS confidence,
       '{flow.FREEZE_TEXTS[0]}' || {_BTC.format('sum(sats)')} || '{flow.FREEZE_TEXTS[1]}' || count(*) || '{flow.FREEZE_TEXTS[2]}' AS note
FROM endpoints GROUP BY 1, 2""")
whole("freeze_rows")


@query("t14_freeze_groups", sql("SELECT * FROM freeze_rows"))
def _(spark, sf):
    return flow.freeze_groups(flow.exchange_endpoints(_one_hop(spark, sf)))


part("graph_legs", """
SELECT l.*, h.exchange AS hop_exchange, h.is_sanctioned, h.chain_end_reason, c.recipient,
       EXISTS (SELECT 1 FROM case_victims v WHERE v.case_id = l.case_id AND v.address = l.address) AS is_victim,
       EXISTS (SELECT 1 FROM all_legs x WHERE x.case_id = l.case_id AND x.hop = l.hop AND x.side = 'to'
               AND x.address = l.address AND x.is_exchange) AS is_hit,
       EXISTS (SELECT 1 FROM all_legs x WHERE x.case_id = l.case_id AND x.hop = l.hop AND x.side = 'from'
               AND x.address = l.address) AS is_sender,
       CASE WHEN l.hop = 0 THEN 0 WHEN EXISTS (SELECT 1 FROM case_victims v WHERE v.case_id = l.case_id
            AND v.address = c.recipient) THEN 0 ELSE 1 END AS from_column,
       l.hop * 2 + CASE WHEN l.side = 'to' THEN 1 ELSE 0 END AS turn
FROM all_legs l JOIN all_hops h ON h.case_id = l.case_id AND h.hop = l.hop JOIN fraud_cases c ON c.case_id = l.case_id""")
whole("graph_legs")
part("nodes", """
SELECT case_id, address, CAST(min(col) AS INTEGER) AS "column",
       (['address', 'recipient', 'victim', 'exchange'])[max(kind) + 1] AS kind,
       coalesce(arg_min(exchange, {'t': turn, 'o': ord}) FILTER (exchange IS NOT NULL), '') AS exchange,
       bool_or(is_sanctioned) AS is_sanctioned, CAST(coalesce(sum(sats_in), 0) AS BIGINT) AS total_in_sats,
       CAST(coalesce(sum(sats_out), 0) AS BIGINT) AS total_out_sats,
       coalesce(arg_min(sats_in, {'t': turn, 'o': ord}) FILTER (sats_in IS NOT NULL), 0) AS display_in_sats,
       coalesce(arg_min(sats_out, {'t': turn, 'o': ord}) FILTER (sats_out IS NOT NULL), 0) AS display_out_sats,
       bool_or(is_change) AS has_change_output,
       coalesce(arg_min(reason, {'t': turn, 'o': ord}) FILTER (reason IS NOT NULL), '') AS chain_end_reason
FROM (
  SELECT case_id, address, 0 AS col, 2 AS kind, NULL AS exchange, false AS is_sanctioned, NULL::BIGINT AS sats_in,
         NULL::BIGINT AS sats_out, false AS is_change, NULL AS reason, -1 AS turn, 0::BIGINT AS ord FROM case_victims
  UNION ALL SELECT case_id, recipient, 1, 1, NULL, false, NULL, NULL, false, NULL, -1, 0 FROM fraud_cases
  UNION ALL SELECT case_id, address, from_column + CASE WHEN side = 'to' THEN 1 ELSE 0 END,
         CASE WHEN is_hit THEN 3 WHEN side = 'from' AND is_victim THEN 2
              WHEN address = recipient AND (side = 'from' OR hop = 0) THEN 1 ELSE 0 END,
         CASE WHEN is_hit THEN hop_exchange END, is_sanctioned, CASE WHEN side = 'to' THEN coalesce(sats, 0) END,
         CASE WHEN side = 'from' THEN coalesce(sats, 0) END, side = 'to' AND is_sender,
         CASE WHEN side = 'to' THEN chain_end_reason END, turn, ord FROM graph_legs) GROUP BY 1, 2""")
whole("nodes")
part("pair_counts", """
SELECT case_id, hop, count(*) FILTER (side = 'from') AS sources, count(*) FILTER (side = 'to' AND NOT is_sender) AS targets
FROM graph_legs GROUP BY 1, 2""")
whole("pair_counts")
part("flow_edge_rows", """
SELECT p.case_id, p.hop, f.address AS from_address, t.address AS to_address,
       CASE WHEN p.sources = 1 THEN coalesce(t.sats, 0) ELSE coalesce(f.sats, 0) END AS sats,
       CASE WHEN p.sources = 1 THEN 'output_amount' ELSE 'input_contribution' END AS amount_context
FROM pair_counts p JOIN graph_legs f ON f.case_id = p.case_id AND f.hop = p.hop AND f.side = 'from'
JOIN graph_legs t ON t.case_id = p.case_id AND t.hop = p.hop AND t.side = 'to' AND NOT t.is_sender
WHERE p.sources = 1 OR p.targets = 1
UNION ALL
SELECT p.case_id, p.hop, CASE WHEN g.side = 'from' THEN g.address END, CASE WHEN g.side = 'to' THEN g.address END,
       NULL, 'aggregate_transaction'
FROM pair_counts p JOIN graph_legs g ON g.case_id = p.case_id AND g.hop = p.hop
WHERE p.sources > 1 AND p.targets > 1 AND (g.side = 'from' OR NOT g.is_sender)""")
whole("flow_edge_rows")


def _columns(spark, sf, tr):
    return _cached(spark, sf, ("columns", id(tr)), lambda: flow.hop_columns(tr, _victims(spark, sf)))


def _nodes(spark, sf, tr):
    return flow.flow_nodes(tr, _cases(spark, sf), _victims(spark, sf), _columns(spark, sf, tr))


@query("t15_flow_nodes", sql("SELECT * FROM nodes"))
def _(spark, sf):
    return _nodes(spark, sf, _one_hop(spark, sf)).drop("display_label", "short_address")


_SHORT = "CASE WHEN coalesce({0}, '') = '' THEN '—' WHEN length({0}) <= {1} + {2} + 1 THEN {0} ELSE substr({0}, 1, {1}) || '…' || right({0}, {2}) END"


@query("t15_flow_nodes_full", whole_sql(f"""
SELECT *, {_SHORT.format("address", 10, 6)} AS short_address,
       CASE kind WHEN 'victim' THEN 'Victim' WHEN 'recipient' THEN 'Recipient' WHEN 'exchange' THEN coalesce(nullif(exchange, ''), 'Exchange')
            ELSE {_SHORT.format("address", 10, 6)} END AS display_label FROM nodes"""))
def _(spark, sf):
    return _nodes(spark, sf, _full(spark, sf))


@query("t16_flow_edges", sql("SELECT * FROM flow_edge_rows"))
def _(spark, sf):
    return flow.flow_edges(_one_hop(spark, sf)).select(
        "case_id", "hop", "from_address", "to_address", "sats", "amount_context")


part("graph_stats", """
SELECT n.case_id, n.node_count, CAST(coalesce(e.n, 0) AS BIGINT) AS edge_count, n.exchange_count, w.max_column
FROM (SELECT case_id, count(*) AS node_count, count(*) FILTER (kind = 'exchange') AS exchange_count FROM nodes GROUP BY 1) n
JOIN (SELECT case_id, CAST(max(from_column) + 1 AS INTEGER) AS max_column FROM graph_legs GROUP BY 1) w USING (case_id)
LEFT JOIN (SELECT case_id, sum(sources * targets) AS n FROM pair_counts GROUP BY 1) e USING (case_id)""")
whole("graph_stats")


def _stats(spark, sf):
    tr = _one_hop(spark, sf)
    return flow.flow_stats(_nodes(spark, sf, tr), tr, _columns(spark, sf, tr))


@query("t17_flow_stats", sql("SELECT * FROM graph_stats"))
def _(spark, sf):
    return _stats(spark, sf)


_T17_FLOW_LANES = """
SELECT case_id, CAST(c AS INTEGER) AS "column", CASE WHEN c = 0 THEN 'Victim' ELSE 'Hop ' || (c - 1) END AS label
FROM (SELECT case_id, unnest(range(max_column + 1)) AS c FROM graph_stats)"""


@query("t17_flow_lanes", sql(_T17_FLOW_LANES))
def _(spark, sf):
    return flow.flow_lanes(_stats(spark, sf))


part("collapsed", """
SELECT DISTINCT e.case_id, '__victim_input_cluster__' AS from_address, e.to_address,
       coalesce(nullif(n.display_in_sats, 0), n.total_in_sats) AS sats
FROM flow_edge_rows e JOIN nodes n ON n.case_id = e.case_id AND n.address = e.to_address
LEFT JOIN nodes f ON f.case_id = e.case_id AND f.address = e.from_address
WHERE f.kind = 'victim' OR (e.from_address IS NULL AND e.hop = 0)""")
whole("collapsed")


_T18_COLLAPSE_VICTIMS = """
SELECT v.case_id, v.member_count, v.is_sanctioned, CAST(coalesce(c.s, 0) AS BIGINT) AS total_out_sats
FROM (SELECT case_id, count(*) AS member_count, bool_or(is_sanctioned) AS is_sanctioned FROM nodes
      WHERE kind = 'victim' GROUP BY 1 HAVING count(*) > 1) v
LEFT JOIN (SELECT case_id, sum(sats) AS s FROM collapsed GROUP BY 1) c USING (case_id)"""


@query("t18_collapse_victims", sql(_T18_COLLAPSE_VICTIMS))
def _(spark, sf):
    tr = _one_hop(spark, sf)
    return flow.collapse_victims(_nodes(spark, sf, tr), flow.flow_edges(tr))[0]


_T18_COLLAPSED_EDGES = """
SELECT * FROM collapsed WHERE case_id IN (SELECT case_id FROM nodes WHERE kind = 'victim' GROUP BY 1 HAVING count(*) > 1)
UNION ALL
SELECT e.case_id, e.from_address, e.to_address, e.sats FROM flow_edge_rows e
LEFT JOIN nodes f ON f.case_id = e.case_id AND f.address = e.from_address
WHERE NOT coalesce(f.kind = 'victim', false) AND NOT (e.from_address IS NULL AND e.hop = 0)
AND e.case_id IN (SELECT case_id FROM nodes WHERE kind = 'victim' GROUP BY 1 HAVING count(*) > 1)"""


@query("t18_collapsed_edges", sql(_T18_COLLAPSED_EDGES))
def _(spark, sf):
    tr = _one_hop(spark, sf)
    return flow.collapse_victims(_nodes(spark, sf, tr), flow.flow_edges(tr))[1]


part("full_producers", """
SELECT l.case_id, l.address, max({'hop': l.hop, 'ord': l.ord, 'sats': coalesce(l.sats, 0)}) AS p FROM full_legs l
WHERE l.side = 'to' AND NOT EXISTS (SELECT 1 FROM full_legs f WHERE f.case_id = l.case_id AND f.hop = l.hop AND f.side = 'from'
                                    AND f.address = l.address) GROUP BY 1, 2""")
part("full_links", """
SELECT l.case_id, l.hop, count(*) AS senders, count(v.address) AS victims,
       min({'ord': l.ord, 'address': l.address, 'sats': coalesce(l.sats, 0)}) AS s
FROM full_legs l LEFT JOIN (SELECT DISTINCT case_id, address FROM case_victims) v ON v.case_id = l.case_id AND v.address = l.address
WHERE l.side = 'from' GROUP BY 1, 2""")
part("full_ways", """
SELECT *, max(pos) OVER (PARTITION BY case_id, endpoint) + 1 AS length FROM (
  WITH RECURSIVE w AS (
    SELECT e.case_id, e.address AS endpoint, e.name, 0 AS pos, p.p.hop AS hop, e.address, p.p.sats AS sats, [e.address] AS met
    FROM full_endpoints e JOIN full_producers p ON p.case_id = e.case_id AND p.address = e.address
    UNION ALL
    SELECT w.case_id, w.endpoint, w.name, w.pos + 1, p.p.hop, p.address, p.p.sats, list_append(w.met, p.address)
    FROM w JOIN full_links l ON l.case_id = w.case_id AND l.hop = w.hop AND l.senders = 1
    JOIN full_producers p ON p.case_id = w.case_id AND p.address = l.s.address WHERE NOT list_contains(w.met, p.address))
  SELECT * FROM w)""")
part("full_heads", """
SELECT w.*, l.victims, l.senders > 1 AND l.victims > 0 AS together, l.s.address AS sender, l.s.sats AS sender_sats
FROM full_ways w JOIN full_links l ON l.case_id = w.case_id AND l.hop = w.hop
WHERE w.pos = w.length - 1 AND ((l.senders > 1 AND l.victims > 0) OR (l.senders = 1 AND NOT list_contains(w.met, l.s.address)))""")


@query("t19_freeze_paths", sql(f"""
SELECT n.case_id, n.endpoint, CAST(n.position AS INTEGER) AS position, kind,
       CASE kind WHEN 'exchange' THEN name WHEN 'recipient' THEN 'Recipient' WHEN 'victim' THEN 'Victim inputs' ELSE 'Traced address' END AS title,
       CASE WHEN members IS NOT NULL THEN members || ' addresses' ELSE {_SHORT.format("node", 12, 8)} END AS subtitle, sats
FROM (SELECT n.*, CASE WHEN members IS NOT NULL THEN 'victim' WHEN node = endpoint THEN 'exchange' WHEN node = c.recipient THEN 'recipient'
                       WHEN EXISTS (SELECT 1 FROM case_victims v WHERE v.case_id = n.case_id AND v.address = n.node) THEN 'victim'
                       ELSE 'address' END AS kind
      FROM (SELECT case_id, endpoint, name, 1 AS position, CASE WHEN NOT together THEN sender END AS node,
                   CASE WHEN together THEN sats ELSE sender_sats END AS sats, CASE WHEN together THEN victims END AS members FROM full_heads
            UNION ALL
            SELECT w.case_id, w.endpoint, w.name, w.length - w.pos + CASE WHEN h.case_id IS NULL THEN 0 ELSE 1 END, w.address, w.sats, NULL
            FROM full_ways w LEFT JOIN full_heads h ON h.case_id = w.case_id AND h.endpoint = w.endpoint) n
      JOIN fraud_cases c ON c.case_id = n.case_id) n"""))
def _(spark, sf):
    tr = _full(spark, sf)
    return flow.freeze_paths(flow.exchange_endpoints(tr), tr, _cases(spark, sf), _victims(spark, sf))


@query("t20_branch_traces", sql("""
SELECT w.case_id, w.endpoint, CAST(w.length - w.pos AS INTEGER) AS step, w.hop, w.address AS to_address, w.sats AS to_sats,
       coalesce(l.senders, 0) AS senders, coalesce(l.senders > 1 AND l.victims > 0, false) AS victim_senders, h.label, h.txid, h.block, h.timestamp
FROM full_ways w JOIN full_hops h ON h.case_id = w.case_id AND h.hop = w.hop
LEFT JOIN full_links l ON l.case_id = w.case_id AND l.hop = w.hop"""))
def _(spark, sf):
    tr = _full(spark, sf)
    return flow.branch_traces(flow.exchange_endpoints(tr), tr, _victims(spark, sf))


_END = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in flow.END_TEXTS.items())
_END_TEXT = " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in flow.END_TEXTS.items())


@query("t22_chain_of_custody", sql(f"""
SELECT case_id, hop, 'Hop ' || hop || ' - ' || label AS title,
       confidence || CASE WHEN confidence = 'L2' THEN ' — Forensically corroborated' ELSE ' — Mathematically proven' END AS confidence,
       txid, block, timestamp, method, notes AS note, exchange, CASE chain_end_reason {_END} END AS end_title
FROM all_hops"""))
def _(spark, sf):
    return flow.chain_of_custody(_one_hop(spark, sf)).drop("verification", "end_text")


_T22_CUSTODY_LEGS = """
SELECT case_id, hop, CASE side WHEN 'from' THEN 'From' ELSE 'To' END AS line, ord, address,
       CASE WHEN sats > 0 THEN printf('%.8f', sats / 100000000.0) || ' BTC' ELSE '—' END AS amount FROM all_legs"""


@query("t22_custody_legs", sql(_T22_CUSTODY_LEGS))
def _(spark, sf):
    return flow.custody_legs(_one_hop(spark, sf))


def _json(columns: str) -> str:
    """The row as Spark writes it: fields that are null are left out; a ``:n`` after a name marks a number or truth value."""
    field = lambda c: (
        f"coalesce(',\"{c[:-2]}\":' || {c[:-2]}, '')" if c.endswith(":n") else f"coalesce(',\"{c}\":' || CAST(to_json({c}) AS VARCHAR), '')")
    return "'{' || substr(" + " || ".join(field(c) for c in columns.split()) + ", 2) || '}'"


part("digest_legs", f"""
SELECT case_id, hop, sha256(string_agg(h, chr(10) ORDER BY side, slice, h)) AS legs FROM (
  SELECT case_id, hop, side, ord // 1024 AS slice, sha256(string_agg(j, chr(10) ORDER BY ord, address, j)) AS h
  FROM (SELECT *, {_json("ord:n address sats:n is_exchange:n")} AS j FROM full_legs) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""")
part("digest_hops", f"""
SELECT case_id, string_agg(h, chr(10) ORDER BY hop, h) AS hops FROM (
  SELECT case_id, hop, sha256({_json("block:n chain_end_reason confidence confidence_label depth:n exchange exchange_source hop:n is_sanctioned:n "
                                     "label method notes timestamp txid legs")}) AS h
  FROM (SELECT *, CASE confidence WHEN 'L2' THEN '{trace.CONFIDENCE_LABELS["L2"]}' ELSE '{trace.CONFIDENCE_LABELS["L1"]}' END AS confidence_label
        FROM full_hops) LEFT JOIN digest_legs USING (case_id, hop)) GROUP BY 1""")


@query("t23_report_digest", sql(f"""
SELECT case_id, sha256(concat_ws(chr(10), hops, {_json("case_id fraud_amount_eur:n fraud_txid incident_date recipient")})) AS report_hash
FROM (SELECT * REPLACE (strftime(incident_date, '%Y-%m-%dT%H:%M:%S.000') AS incident_date) FROM fraud_cases) LEFT JOIN digest_hops USING (case_id)"""))
def _(spark, sf):
    return flow.report_digest(_full(spark, sf), _cases(spark, sf))


part("summary", f"""
SELECT h.case_id, h.hops_found, h.sanctioned_addresses, coalesce(e.n, 0) AS exchanges_identified,
       coalesce(e.names, 0) AS freeze_requests_generated, {_BTC.format('a.stolen_sats')} AS actual_amount_btc, coalesce(e.exchanges, '') AS exchanges
FROM (SELECT case_id, count(*) AS hops_found, count(*) FILTER (is_sanctioned) AS sanctioned_addresses FROM all_hops GROUP BY 1) h
JOIN case_amounts a USING (case_id)
LEFT JOIN (SELECT case_id, count(*) AS n, count(DISTINCT name) AS names, string_agg(DISTINCT name, ', ' ORDER BY name) AS exchanges
           FROM endpoints GROUP BY 1) e USING (case_id)""")
whole("summary")


def _summary(spark, sf, tr):
    amounts = trace.stolen_amount(_cases(spark, sf), _victims(spark, sf), fx.ledger(spark, sf))
    return flow.case_summary(tr, flow.exchange_endpoints(tr), amounts)


@query("t24_case_summary", sql("SELECT * FROM summary"))
def _(spark, sf):
    return _summary(spark, sf, _one_hop(spark, sf))


@query("t24_case_summary_full", whole_sql("SELECT * FROM summary"))
def _(spark, sf):
    return _summary(spark, sf, _full(spark, sf))


_C9_INVESTIGATION_ADDRESSES = """
SELECT l.case_id, l.address, CASE WHEN l.is_exchange THEN 'EXCHANGE_DEPOSIT'
       WHEN l.hop = 0 AND l.address = c.recipient THEN 'FRAUD_ORIGIN' ELSE 'HOP' END AS address_role,
       l.hop AS hop_index, h.confidence AS confidence_level, CAST(l.sats / 100000000.0 AS DOUBLE) AS amount_btc,
       h.block AS block_height
FROM all_legs l JOIN all_hops h ON h.case_id = l.case_id AND h.hop = l.hop JOIN fraud_cases c ON c.case_id = l.case_id
WHERE l.side = 'to'"""


@query("c9_investigation_addresses", sql(_C9_INVESTIGATION_ADDRESSES))
def _(spark, sf):
    return flow.investigation_addresses(_one_hop(spark, sf), _cases(spark, sf)).withColumn(
        "amount_btc", F.col("amount_btc").cast("double"))


# -- the same on whole traces -------------------------------------------------


@query("t13_exchange_endpoints_full", whole_sql("SELECT * FROM endpoints"))
def _(spark, sf):
    return flow.exchange_endpoints(_full(spark, sf))


@query("t14_freeze_groups_full", whole_sql("SELECT * FROM freeze_rows"))
def _(spark, sf):
    return flow.freeze_groups(flow.exchange_endpoints(_full(spark, sf)))


@query("t16_flow_edges_full", whole_sql("""
SELECT e.*, h.txid, h.confidence, h.label, h.chain_end_reason, h.is_sanctioned FROM (
  SELECT p.case_id, p.hop, f.address AS from_address, t.address AS to_address,
         CASE WHEN p.sources = 1 THEN coalesce(t.sats, 0) ELSE coalesce(f.sats, 0) END AS sats,
         CASE WHEN p.sources = 1 THEN 'output_amount' ELSE 'input_contribution' END AS amount_context,
         CASE WHEN p.sources = 1 THEN t.ord ELSE f.ord END AS ord, t.is_exchange AS is_exchange_edge
  FROM pair_counts p JOIN graph_legs f ON f.case_id = p.case_id AND f.hop = p.hop AND f.side = 'from'
  JOIN graph_legs t ON t.case_id = p.case_id AND t.hop = p.hop AND t.side = 'to' AND NOT t.is_sender
  WHERE p.sources = 1 OR p.targets = 1
  UNION ALL
  SELECT p.case_id, p.hop, CASE WHEN g.side = 'from' THEN g.address END, CASE WHEN g.side = 'to' THEN g.address END, NULL,
         'aggregate_transaction', g.ord, g.side = 'to' AND g.is_exchange
  FROM pair_counts p JOIN graph_legs g ON g.case_id = p.case_id AND g.hop = p.hop
  WHERE p.sources > 1 AND p.targets > 1 AND (g.side = 'from' OR NOT g.is_sender)) e
JOIN all_hops h ON h.case_id = e.case_id AND h.hop = e.hop"""))
def _(spark, sf):
    return flow.flow_edges(_full(spark, sf))


def _full_stats(spark, sf):
    tr = _full(spark, sf)
    return flow.flow_stats(_nodes(spark, sf, tr), tr, _columns(spark, sf, tr))


@query("t17_flow_stats_full", whole_sql("SELECT * FROM graph_stats"))
def _(spark, sf):
    return _full_stats(spark, sf)


@query("t17_flow_lanes_full", whole_sql(_T17_FLOW_LANES))
def _(spark, sf):
    return flow.flow_lanes(_full_stats(spark, sf))


@query("t18_collapse_victims_full", whole_sql(_T18_COLLAPSE_VICTIMS))
def _(spark, sf):
    tr = _full(spark, sf)
    return flow.collapse_victims(_nodes(spark, sf, tr), flow.flow_edges(tr))[0]


@query("t18_collapsed_edges_full", whole_sql(_T18_COLLAPSED_EDGES))
def _(spark, sf):
    tr = _full(spark, sf)
    return flow.collapse_victims(_nodes(spark, sf, tr), flow.flow_edges(tr))[1]


@query("t22_chain_of_custody_full", whole_sql(f"""
SELECT case_id, hop, 'Hop ' || hop || ' - ' || label AS title,
       confidence || CASE WHEN confidence = 'L2' THEN ' — Forensically corroborated' ELSE ' — Mathematically proven' END AS confidence,
       txid, block, timestamp, method, notes AS note, exchange,
       CASE WHEN length(txid) = 64 THEN 'Verification: {flow.EXPLORER_URL}' || txid END AS verification,
       CASE chain_end_reason {_END} END AS end_title, CASE chain_end_reason {_END_TEXT} END AS end_text
FROM all_hops"""))
def _(spark, sf):
    return flow.chain_of_custody(_full(spark, sf))


@query("t22_custody_legs_full", whole_sql(_T22_CUSTODY_LEGS))
def _(spark, sf):
    return flow.custody_legs(_full(spark, sf))


@query("c9_investigation_addresses_full", whole_sql(_C9_INVESTIGATION_ADDRESSES))
def _(spark, sf):
    return flow.investigation_addresses(_full(spark, sf), _cases(spark, sf)).withColumn(
        "amount_btc", F.col("amount_btc").cast("double"))
