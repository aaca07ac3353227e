"""Documents, merges, links, cursors, labels and the shared workspace."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerspark import session
from ledgerspark.functions.labels import canonical_exchange_name, compliance_contact, is_evidential, short_address
from ledgerspark.functions.money import btc_text, btc_to_sats
from ledgerspark.operators import attribution, normalize, quality, trace, upsert
from ledgerspark.operators.ledger import Ledger
from ledgerspark.sources import readers, sinks
from ledgerspark.streaming import ingest

BLOCK = {
    "height": 7, "hash": "h7", "time": 1_700_000_000,
    "tx": [
        {"txid": "cb", "vsize": 100, "vin": [{"coinbase": "03"}],
         "vout": [{"n": 0, "value": 6.25, "scriptPubKey": {"address": "m", "type": "p2pkh"}},
                  {"n": 1, "value": 0, "scriptPubKey": {"type": "nulldata"}}]},
        {"txid": "t", "fee": 0.00000001, "vin": [{"txid": "cb", "vout": 0}, {"txid": "cb", "vout": 9}, {"txid": "zz", "vout": 0}],
         "vout": [{"n": 0, "value": 0.123456785, "scriptPubKey": {"addresses": ["x", "y"], "type": "multisig"}},
                  {"n": 1, "scriptPubKey": {"address": "m", "type": "p2pkh"}}]},
    ],
}


def write(path, *documents):
    path.mkdir(parents=True, exist_ok=True)
    (path / "part.json").write_text("\n".join(json.dumps(d) for d in documents))
    return str(path)


def test_block_documents(spark, tmp_path):
    raw = readers.read_blocks(spark, write(tmp_path / "b", BLOCK))
    assert normalize.normalize_blocks(raw).first().height == 7
    txs = {r.txid: r for r in normalize.normalize_transactions(raw).collect()}
    assert (txs["cb"].fee_sats, txs["cb"].vsize, txs["t"].fee_sats, txs["t"].vsize) == (None, 100, 1, None)
    outs = normalize.normalize_outputs(raw)
    assert {(r.txid, r.vout_index, r.address, r.amount_sats) for r in outs.collect()} == {
        ("cb", 0, "m", 625_000_000), ("t", 0, "x", 12_345_679), ("t", 1, "m", 0)}
    assert normalize.normalize_outputs(raw, keep_addressless=True).count() == 4
    rows = {(r.txid, r.vin_index): r for r in normalize.resolve_prevouts(normalize.normalize_inputs(raw), outs).collect()}
    assert (rows["cb", 0].prev_txid, rows["cb", 0].address) == (None, None)
    assert (rows["t", 0].address, rows["t", 0].amount_sats) == ("m", 625_000_000)
    assert rows["t", 1].address is None and rows["t", 2].address is None  # index out of range, unknown transaction


def test_single_transactions_in_both_dialects(spark, tmp_path):
    node = {**BLOCK["tx"][1], "blockhash": "h", "blockheight": 5, "blocktime": 1_700_000_000}
    coin = {**BLOCK["tx"][0], "blockhash": "h", "blockheight": 5, "blocktime": 1_700_000_000}
    open_tx = {"txid": "u", "vin": [], "vout": []}
    explorer = {"txid": "e", "vin": [], "vout": [{"value": 150_000_000, "scriptpubkey_address": "q"}],
                "status": {"confirmed": True, "block_height": 9, "block_time": 1_700_000_060}}
    raw = readers.read_transactions(spark, write(tmp_path / "t", node, coin, open_tx, explorer))
    btc = {(r.txid, r.vout_index): float(r.btc) for r in normalize.lookup_outputs(raw).collect()}
    assert btc == {("cb", 0): 6.25, ("t", 0): 0.12345679, ("t", 1): 0.0, ("e", 0): 1.5}
    info = {r.txid: (r.block_height, r.timestamp) for r in normalize.tx_block_info(raw).collect()}
    assert info["e"] == (9, "14.11.2023 22:14 UTC") and info["u"] == (0, "—") and info["t"][0] == 5
    txs, ins, outs = normalize.normalize_single_tx(raw)
    assert {r.txid for r in txs.collect()} == {"t", "cb"}
    assert ins.where("txid = 'cb'").count() == 0 and outs.where("txid = 'cb'").count() == 2


def test_embedded_prevouts_speak_where_the_ledger_is_silent(spark, tmp_path):
    node = {"txid": "n", "blockhash": "h", "blockheight": 5, "vin": [
        {"prevout": {"scriptpubkey_address": "victim", "value": 0.25015009}}, {"txid": "cb", "vout": 0, "prevout": {"scriptPubKey": {"address": "other"}, "value": 1}},
        {"txid": "zz", "vout": 3, "prevout": {"scriptPubKey": {"addresses": ["second", "third"]}, "value": 2}}, {"coinbase": "03"}, {"txid": "zz", "vout": 4}],
        "vout": [{"n": 0, "value": 0.25015009, "scriptPubKey": {"address": "thief"}}]}
    explorer = {"txid": "e", "status": {"confirmed": True, "block_height": 9}, "vin": [
        {"txid": "yy", "vout": 0, "prevout": {"scriptpubkey_address": "victim", "value": 700}}], "vout": []}
    raw = readers.read_transactions(spark, write(tmp_path / "p", node, explorer))
    embedded = normalize.embedded_prevouts(raw)
    inputs = normalize.input_rows(raw.withColumn("tx", F.struct(*raw.columns)))
    outputs = normalize.normalize_outputs(readers.read_blocks(spark, write(tmp_path / "b", BLOCK)))
    resolved = normalize.resolve_prevouts(inputs, outputs, embedded)
    got = {(r.txid, r.vin_index): (r.address, r.amount_sats) for r in resolved.collect()}
    assert got == {("n", 0): ("victim", 25_015_009), ("n", 1): ("m", 625_000_000), ("n", 2): ("second", 200_000_000), ("n", 3): (None, None),
                   ("n", 4): (None, None), ("e", 0): ("victim", 700)}
    cases = spark.createDataFrame([("c", "n", "thief")], "case_id string, fraud_txid string, recipient string")
    owners = spark.createDataFrame([("c", "victim")], "case_id string, address string")
    assert trace.victim_amount(cases, owners, resolved).first().victim_sats == 25_015_009
    assert normalize.resolve_prevouts(inputs, outputs, embedded.limit(0)).where("txid = 'e' AND address IS NOT NULL").count() == 0


@pytest.mark.parametrize("text,sats", [("0.000000005", 1), ("0.0000000049", 0), ("20999999.9769", 2_099_999_997_690_000), (None, None)])
def test_btc_to_sats(spark, text, sats):
    assert spark.range(1).select(btc_to_sats(F.lit(text).cast("decimal(38,10)")).alias("s")).first().s == sats


def test_text_helpers(spark):
    row = spark.range(1).select(
        btc_text(F.lit(1e-8)).alias("b"), short_address(F.lit("abcdefghijklmnopqrstuvwxyz")).alias("s"),
        short_address(F.lit("short")).alias("t"), canonical_exchange_name(F.lit("My Gate.IO wallet")).alias("g"),
        canonical_exchange_name(F.lit("Nobody")).alias("n"), compliance_contact(F.lit("Corner St. Desk")).alias("c"),
        is_evidential(F.lit("X"), F.lit("downstream-analysis/1"), F.lit("L1")).alias("d"),
        is_evidential(F.lit("X"), F.lit(None).cast("string"), F.lit("L2")).alias("e")).first()
    assert tuple(row) == ("0.00000001", "abcdefghij…uvwxyz", "short", "Gate.io", "Nobody",
                          "compliance@cornerstdesk.com", False, True)


def test_intel_answers_and_resolution(spark):
    answers = [
        ("a", {"found": True, "entity": {"name": " Kraken hot ", "type": "x"}, "best_source_type": "official_por"}),
        ("b", {"found": True, "entity": "OKX", "best_source_type": "wallet_label"}),
        ("c", {"found": True, "entity": None, "labels": [{"entity_name": " "}, {"source_name": "bybit 3"}], "best_source_type": "seed"}),
        ("d", {"found": True, "best_source_type": "seed"}),
        ("e", {"found": False, "entity": "OKX"}),
    ]
    payloads = spark.createDataFrame([(a, json.dumps({"address": a, **p})) for a, p in answers], "address string, payload string")
    hits = {r.address: (r.exchange, r.confidence, r.source) for r in attribution.payload_lookup(payloads).collect()}
    assert hits == {
        "a": ("Kraken", "L1", "exchange-intel/official_por"), "b": ("OKX", "L2", "exchange-intel/wallet_label"),
        "c": ("Bybit", "L1", "exchange-intel/seed"), "d": ("Unknown Exchange", "L1", "exchange-intel/seed")}
    names = spark.createDataFrame([("a", "htx desk")], "address string, exchange_name string")
    listed = spark.createDataFrame([("a",), ("e",)], "address string")
    got = {r.address: r for r in attribution.resolve_addresses(
        payloads.select("address"), attribution.manual_attributions(names), attribution.payload_lookup(payloads), listed).collect()}
    assert (got["a"].exchange, got["a"].source, got["a"].is_sanctioned) == ("Huobi", "manual", False)
    assert (got["e"].exchange, got["e"].confidence, got["e"].is_sanctioned, got["e"].is_evidential) == (None, "L1", True, False)


def test_equal_priority_is_settled_by_level_then_source(spark):
    rows = [("x", "BITCOINABUSE", 2, "p"), ("x", "INVESTIGATION", 1, "q"), ("y", "BITCOINABUSE", 1, "p"), ("y", "INVESTIGATION", 1, "q")]
    best = attribution.best_attribution(
        spark.createDataFrame(rows, "address string, source_key string, confidence_level int, entity_name string"),
        attribution.attribution_sources(spark))
    assert {r.address: r.entity_name for r in best.collect()} == {"x": "q", "y": "p"}


def test_merging_twice_equals_merging_once(spark):
    schema = "k string, v int, kept string"
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], schema)
    new = spark.createDataFrame([("b", 5, None), ("c", 6, None)], schema)
    once = upsert.upsert_latest(old, new, ["k"], ["v"])
    assert {tuple(r) for r in once.collect()} == {("a", 1, "x"), ("b", 5, "y"), ("c", 6, None)}
    assert {tuple(r) for r in upsert.upsert_latest(once, new, ["k"], ["v"]).collect()} == {tuple(r) for r in once.collect()}
    kept = upsert.insert_ignore(old, new, ["k"])
    assert {tuple(r) for r in kept.collect()} == {("a", 1, "x"), ("b", 2, "y"), ("c", 6, None)}


def test_authoritative_labels_stay(spark):
    schema = "address string, source_key string, is_authoritative boolean, entity_name string"
    old = spark.createDataFrame([("a", "OFAC", True, "old"), ("a", "X", False, "old")], schema)
    new = spark.createDataFrame([("a", "OFAC", False, "new"), ("a", "X", False, "new"), ("b", "X", False, "new")], schema)
    got = {(r.address, r.source_key): r.entity_name for r in upsert.upsert_attributions(old, new).collect()}
    assert got == {("a", "OFAC"): "old", ("a", "X"): "new", ("b", "X"): "new"}


@pytest.mark.parametrize("cursor,args,want", [
    (None, {}, (0, 100)), (50, {}, (51, 100)), (None, {"max_blocks": 10}, (91, 100)), (50, {"max_blocks": 10}, (51, 60)), (100, {}, None), (95, {}, (96, 100)), (None, {"start": 3, "end": 4}, (3, 4)),
    (None, {"max_blocks": 500}, (0, 100)), (10, {"end": 12}, (11, 12)),
])
def test_plan_range(spark, cursor, args, want):
    cursors = spark.createDataFrame([] if cursor is None else [("main", cursor)], "cursor_key string, last_height bigint")
    tip = spark.createDataFrame([(100,)], "tip bigint")
    rows = upsert.plan_range(spark, upsert.get_cursor(cursors, "main"), tip, **args).collect()
    assert [tuple(r) for r in rows] == ([want] if want else [])
    moved = upsert.set_cursor(cursors, "main", 77)
    assert moved.collect()[0].last_height == 77


def test_upsert_log_policies(spark, tmp_path):
    table = str(tmp_path / "log")
    for n, rows in enumerate([[("a", 1, "x")], [("a", 2, None), ("b", 3, None)]]):
        sinks.write_upsert(spark.createDataFrame(rows, "k string, v int, s string"), table, n)
    read = lambda policy: {tuple(r) for r in sinks.read_upsert(spark, table, ["k"], policy).collect()}
    assert read("latest") == {("a", 2, None), ("b", 3, None)}
    assert read("ignore") == {("a", 1, "x"), ("b", 3, None)}
    assert read("coalesce") == {("a", 2, "x"), ("b", 3, None)}
    sinks.compact(spark, table, str(tmp_path / "small"), ["k"])
    assert sinks.read_upsert(spark, str(tmp_path / "small"), ["k"]).count() == 2
    with pytest.raises(ValueError):
        sinks.read_upsert(spark, table, ["k"], "other")


def test_stream_ingest_resumes_and_replays(spark, tmp_path):
    source, tables, marks = tmp_path / "src", str(tmp_path / "tables"), str(tmp_path / "marks")
    source.mkdir()
    (source / "1.json").write_text(json.dumps(BLOCK))
    ingest.stream_ingest(spark, str(source), tables, marks).awaitTermination()
    late = {"height": 8, "hash": "h8", "time": 1_700_000_600, "tx": [
        {"txid": "w", "vin": [{"txid": "t", "vout": 0}], "vout": []}]}
    (source / "2.json").write_text(json.dumps(late))
    ingest.stream_ingest(spark, str(source), tables, marks).awaitTermination()
    # The first block arrives again, as after a lost checkpoint.
    (source / "3.json").write_text(json.dumps(BLOCK))
    ingest.stream_ingest(spark, str(source), tables, marks).awaitTermination()
    led = ingest.ingested_ledger(spark, tables)
    assert led.blocks.count() == 2 and led.inputs.count() == 5
    assert {(r.txid, r.vout_index): r.spent_by_txid for r in led.outputs.collect()} == {
        ("cb", 0): "t", ("t", 0): "w", ("t", 1): None}


def test_case_intake(spark, tmp_path):
    path = tmp_path / "case.json"
    path.write_text(json.dumps({
        "case_id": "k", "victim": {"name": "N"}, "incident": {"date": "2024-01-02", "wallet_type": "Hardware"},
        "blockchain": {"fraud_txid": "f", "victim_addresses": ["https://x.example/address/v1", "v2", "https://x.example/a/v3/?q=1"],
                       "recipient_address": "r"}}, indent=1))
    row = readers.read_case_intake(spark, str(path)).first()
    assert row.victim_addresses == ["v1", "v2", "v3"]
    assert (row.wallet_type, row.victim_contact, row.recipient) == ("Hardware", "", "r")


def test_policy_file_and_overrides(spark, tmp_path):
    path = tmp_path / "policy.json"
    path.write_text(json.dumps(quality.DATA_QUALITY_POLICY, indent=1))
    row = readers.read_policy(spark, str(path), min_spent_link_coverage=0.5).first()
    assert (row.min_spent_link_coverage, row.min_input_address_fill_rate) == (0.5, 0.95)


def test_data_quality_of_an_empty_ledger_fails(spark):
    led = Ledger(
        spark.createDataFrame([(1,)], "height bigint"), spark.createDataFrame([("t",)], "txid string"),
        spark.createDataFrame([("t", 0, None, None, None, None)],
                              "txid string, vin_index int, prev_txid string, prev_vout int, address string, amount_sats bigint"),
        spark.createDataFrame([], "txid string, vout_index int, address string, amount_sats bigint, spent_by_txid string"))
    row = quality.data_quality(led).first()
    assert (row.tx_inputs, row.non_coinbase_inputs, row.input_address_fill_rate) == (1, 0, 0.0)
    assert row.dangling_spent_links_ok and not row.spent_link_coverage_ok and not row.all_ok


def test_metrics_of_no_labels_are_zero(spark):
    row = quality.confusion_metrics(spark.createDataFrame([], "score double, expected_label string")).first()
    assert (row.precision, row.recall, row.f1, row.accuracy) == (0.0, 0.0, 0.0, 0.0)


def test_workspace_needs_a_shared_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="app")
    with pytest.raises(RuntimeError):
        session.workspace(SimpleNamespace(sparkContext=sc, conf=conf))
