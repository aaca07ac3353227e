"""Shared SQL for the DuckDB oracle: named parts, assembled into one WITH clause."""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def part(name: str, body: str) -> None:
    PARTS[name] = body.strip()


def query(body: str, recursive: bool = False) -> str:
    """``body`` preceded by every part it names, directly or through other parts."""
    needed: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"[a-z_0-9]+", text))
        for name in PARTS:
            if name in words and name not in needed:
                needed.append(name)
                visit(PARTS[name])

    visit(body)
    ordered = [n for n in PARTS if n in needed]
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in ordered)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        ctes = ctes + ",\n" + body[5:]
    else:
        ctes = ctes + "\n" + body
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}"


def rnd(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(28,12)), {digits}) AS DOUBLE)"


def pick(values: list[str], index: str) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"([{items}])[CAST({index} AS INT) + 1]"


TIE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate"

part("lines", f"""
SELECT 'tx' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS txid, o_orderkey, o_orderdate, l_linestatus AS side,
       CAST(row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY {TIE}) - 1 AS INTEGER) AS idx,
       'addr' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS address,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS sats, l_discount, l_tax
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")

part("placed", """
SELECT *, row_number() OVER (PARTITION BY side, address ORDER BY o_orderdate, o_orderkey, idx) AS k FROM lines""")

part("tx_inputs", """
SELECT u.txid, u.idx AS vin_index,
       CASE WHEN m.txid IS NOT NULL THEN m.txid
            WHEN u.l_discount = 0 AND u.l_tax = 0 THEN NULL
            ELSE 'ext' || CAST(u.o_orderkey AS VARCHAR) END AS prev_txid,
       CASE WHEN m.txid IS NOT NULL THEN m.idx
            WHEN u.l_discount = 0 AND u.l_tax = 0 THEN NULL ELSE u.idx END AS prev_vout,
       CASE WHEN m.txid IS NULL AND u.l_discount = 0 AND u.l_tax = 0 THEN NULL ELSE u.address END AS address,
       CASE WHEN m.txid IS NOT NULL THEN m.sats WHEN u.l_tax = 0 THEN NULL ELSE u.sats END AS amount_sats
FROM placed u LEFT JOIN placed m
  ON m.side = 'O' AND m.address = u.address AND m.k = u.k AND m.o_orderdate < u.o_orderdate
WHERE u.side = 'F'""")

part("tx_outputs", """
SELECT o.txid, o.idx AS vout_index, o.address, o.sats AS amount_sats, i.txid AS spent_by_txid
FROM placed o LEFT JOIN tx_inputs i ON i.prev_txid = o.txid AND i.prev_vout = o.idx
WHERE o.side = 'O'""")

part("transactions", """
SELECT t.txid, t.block_height, CASE WHEN i.hidden = 0 THEN CAST(i.s - coalesce(o.s, 0) AS BIGINT) END AS fee_sats,
       CAST(100 + 10 * coalesce(l.n, 0) AS INTEGER) AS vsize, t.first_seen
FROM (SELECT 'tx' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS txid, o_orderkey,
             datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS block_height,
             o_orderdate AS first_seen FROM orders) t
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = t.o_orderkey
LEFT JOIN (SELECT txid, sum(amount_sats) AS s, count(*) FILTER (amount_sats IS NULL) AS hidden
           FROM tx_inputs GROUP BY 1) i ON i.txid = t.txid
LEFT JOIN (SELECT txid, sum(amount_sats) AS s FROM tx_outputs GROUP BY 1) o ON o.txid = t.txid""")

part("blocks", """
SELECT DISTINCT block_height AS height, sha256(CAST(block_height AS VARCHAR)) AS hash, first_seen AS timestamp
FROM transactions""")

part("seeds", """
SELECT DISTINCT 'addr' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS seed FROM labels""")

part("edges", """
SELECT DISTINCT i.address AS src, o.address AS dst FROM tx_inputs i JOIN tx_outputs o USING (txid)
WHERE i.address IS NOT NULL AND o.address IS NOT NULL AND i.address <> o.address""")

part("walk_one", "SELECT DISTINCT seed, dst AS address FROM seeds JOIN edges ON src = seed")
part("walk_two", "SELECT DISTINCT w.seed, dst AS address FROM walk_one w JOIN edges ON src = w.address")
part("walk_three", "SELECT DISTINCT w.seed, dst AS address FROM walk_two w JOIN edges ON src = w.address")
part("reach", """
SELECT seed, address, CAST(min(hop) AS INTEGER) AS min_hop FROM (
  SELECT seed, seed AS address, 0 AS hop FROM seeds
  UNION ALL SELECT seed, address, 1 FROM walk_one
  UNION ALL SELECT seed, address, 2 FROM walk_two
  UNION ALL SELECT seed, address, 3 FROM walk_three) GROUP BY seed, address""")

part("part_entities", """
SELECT 'addr' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS address, e.entity_id, p_type, p_size, p_brand
FROM part JOIN (
  SELECT l_partkey, (min({'d': l_shipdate, 's': l_suppkey})).s AS entity_id FROM lineitem GROUP BY 1) e
ON e.l_partkey = p_partkey""")

CATEGORIES = ["sanctioned", "ransomware", "darknet", "mixer", "scam",
              "fraud", "high_risk_exchange", "exchange", "merchant", "unknown"]
part("entities", f"""
SELECT s_suppkey AS entity_id, s_name AS name, {pick(CATEGORIES, 's_suppkey % 10')} AS category FROM supplier""")

part("links", """
SELECT address, entity_id, CAST((p_size + 49) / 100.0 AS DECIMAL(4,3)) AS confidence
FROM part_entities WHERE p_type IN ('ECONOMY', 'PROMO')""")

part("exposures", f"""
SELECT *, CAST(row_number() OVER (PARTITION BY seed ORDER BY weighted_exposure DESC, min_hop, name, entity_id)
          AS INTEGER) AS rank
FROM (
  SELECT r.seed, l.entity_id, e.name, e.category, min(r.min_hop) AS min_hop,
         CAST(max(l.confidence) AS DOUBLE) AS max_link_confidence,
         CAST(round(sum(CAST(CAST(l.confidence AS DOUBLE) / (r.min_hop + 1) AS DECIMAL(28,10))), 3) AS DOUBLE)
           AS weighted_exposure
  FROM reach r JOIN links l ON l.address = r.address JOIN entities e ON e.entity_id = l.entity_id
  WHERE r.min_hop > 0 GROUP BY 1, 2, 3, 4)""")

part("stats", """
SELECT t.txid, coalesce(i.a, 0) AS input_addr_count, coalesce(o.a, 0) AS output_addr_count,
       coalesce(i.n, 0) AS vin_count, coalesce(o.n, 0) AS vout_count,
       CAST(coalesce(o.s, 0) AS BIGINT) AS total_output_sats, coalesce(o.m, 0) AS max_output_sats
FROM transactions t
LEFT JOIN (SELECT txid, count(*) AS n, count(DISTINCT address) AS a FROM tx_inputs GROUP BY 1) i ON i.txid = t.txid
LEFT JOIN (SELECT txid, count(*) AS n, count(DISTINCT address) AS a, sum(amount_sats) AS s, max(amount_sats) AS m
           FROM tx_outputs GROUP BY 1) o ON o.txid = t.txid""")

part("near_tx", """
SELECT seed, txid, min_hop, row_number() OVER (PARTITION BY seed ORDER BY min_hop, txid) AS pos FROM (
  SELECT r.seed, i.txid, min(r.min_hop) AS min_hop FROM reach r JOIN tx_inputs i ON i.address = r.address
  WHERE r.min_hop > 0 GROUP BY 1, 2)""")

part("features", """
SELECT n.seed, n.txid, n.min_hop, n.pos, s.input_addr_count, s.output_addr_count, s.vin_count, s.vout_count,
       s.total_output_sats,
       CASE WHEN s.total_output_sats = 0 THEN 0.0::DOUBLE
            ELSE CAST(s.max_output_sats AS DOUBLE) / CAST(s.total_output_sats AS DOUBLE) END AS top_output_ratio
FROM near_tx n JOIN stats s USING (txid)""")

part("rules", """
SELECT * FROM (VALUES
  ('PAT-001', 'CONSOLIDATION_PATTERN', 14.0::DOUBLE, 5, NULL, NULL, 2, NULL::DOUBLE),
  ('PAT-002', 'RAPID_SPLIT_PATTERN', 18.0, NULL, 2, 8, NULL, NULL),
  ('PAT-003', 'PEELING_CANDIDATE_PATTERN', 12.0, 1, 1, 2, 2, 0.70)
) AS r(rule_id, pattern_name, severity_weight, min_input_addr_count, max_input_addr_count,
       min_output_addr_count, max_output_addr_count, min_output_ratio)""")

_raw_confidence = """greatest(0.35::DOUBLE, least(0.95::DOUBLE, 0.45::DOUBLE + CASE pattern_name
  WHEN 'CONSOLIDATION_PATTERN' THEN least(0.25::DOUBLE, CAST(input_addr_count AS DOUBLE) / 20)
  WHEN 'RAPID_SPLIT_PATTERN' THEN least(0.25::DOUBLE, CAST(output_addr_count AS DOUBLE) / 25)
  ELSE least(0.20::DOUBLE, greatest(0.0::DOUBLE, top_output_ratio - 0.60::DOUBLE)) END
  - least(0.20::DOUBLE, (greatest(1, min_hop) - 1) * 0.05::DOUBLE)))"""

part("matches", f"""
SELECT f.*, r.rule_id, r.pattern_name, r.severity_weight, {rnd(_raw_confidence, 3)} AS confidence
FROM features f JOIN rules r
  ON (r.min_input_addr_count IS NULL OR f.input_addr_count >= r.min_input_addr_count)
 AND (r.max_input_addr_count IS NULL OR f.input_addr_count <= r.max_input_addr_count)
 AND (r.min_output_addr_count IS NULL OR f.output_addr_count >= r.min_output_addr_count)
 AND (r.max_output_addr_count IS NULL OR f.output_addr_count <= r.max_output_addr_count)
 AND (r.min_output_ratio IS NULL OR f.top_output_ratio >= r.min_output_ratio)""")

part("signals", f"""
SELECT *, CAST(row_number() OVER (PARTITION BY seed ORDER BY tx_count DESC, closest_hop, pattern_name)
          AS INTEGER) AS rank FROM (
  SELECT m.seed, m.pattern_name, string_agg(DISTINCT m.rule_id, ',') AS rule_ids,
         count(*) AS tx_count, min(m.min_hop) AS closest_hop,
         {rnd('CAST(sum(CAST(m.confidence AS DECIMAL(10,3))) AS DOUBLE) / count(*)', 3)} AS avg_confidence,
         {rnd('CAST(count(*) AS DOUBLE) / greatest(1, min(t.total_tx))', 4)} AS density,
         min(m.severity_weight) AS severity_weight
  FROM matches m JOIN (SELECT seed, count(*) AS total_tx FROM features GROUP BY 1) t USING (seed)
  GROUP BY 1, 2)""")

_weight = ("CASE " + " ".join(
    f"WHEN contains(lower(category), '{w}') THEN {v}::DOUBLE" for w, v in [
        ("sanction", 35.0), ("ransomware", 30.0), ("darknet", 28.0), ("mixer", 24.0), ("scam", 22.0),
        ("fraud", 20.0), ("high_risk_exchange", 16.0), ("exchange", 8.0)]) + " ELSE 10.0::DOUBLE END")
CATEGORY_WEIGHT = _weight
_near = "(1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * greatest(1, {hop})))"
_base = f"{_weight} * least(1.0::DOUBLE, weighted_exposure) * {_near.format(hop='min_hop')}"
_act = "least(1.0::DOUBLE, CAST(tx_count AS DOUBLE) / 5)"
_pbase = f"severity_weight * density * {_near.format(hop='closest_hop')} * {_act}"

part("entity_findings", f"""
SELECT seed, 0 AS source_ord, rank AS position, 'entity_exposure' AS finding_type,
       'EXPOSURE_TO_' || replace(replace(upper(category), ' ', '_'), '-', '_') || '_ENTITY' AS reason_code,
       {rnd(_base, 3)} AS base_contribution, max_link_confidence AS confidence,
       {rnd(f'{_base} * max_link_confidence', 3)} AS effective_contribution
FROM exposures""")

part("pattern_findings", f"""
SELECT seed, 1 AS source_ord, rank AS position, 'pattern_signal' AS finding_type,
       'PATTERN_' || pattern_name AS reason_code, {rnd(_pbase, 3)} AS base_contribution,
       avg_confidence AS confidence, {rnd(f'{_pbase} * avg_confidence', 3)} AS effective_contribution
FROM signals""")

part("findings", "SELECT * FROM entity_findings UNION ALL SELECT * FROM pattern_findings")

part("risk", """
SELECT seed, score, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high'
                         WHEN score >= 25 THEN 'medium' ELSE 'low' END AS risk_band, findings_count
FROM (SELECT s.seed, coalesce(least(100.0::DOUBLE, CAST(round(sum(
        CAST(greatest(0, f.base_contribution) AS DECIMAL(12,3)) * CAST(f.confidence AS DECIMAL(4,3))), 2) AS DOUBLE)),
        0.0::DOUBLE) AS score, count(f.seed) AS findings_count
      FROM seeds s LEFT JOIN findings f ON f.seed = s.seed GROUP BY 1)""")
