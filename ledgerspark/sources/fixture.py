"""A ledger, labels, cases and metrics derived from the star-schema test tables.

Every table is derived in Spark from whole input tables; ``FIXTURES.md`` states the
rules. The four ledger tables are written once per session and input folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.functions.labels import EXCHANGE_NAMES
from ledgerspark.functions.rank import ranked
from ledgerspark.operators.ledger import Ledger
from ledgerspark.session import bucketed, fresh_path, materialize

EPOCH = "1995-01-01"
AS_OF = "2024-02-01"
TASK_LINES = 500_000
"""Order lines that one task sorts, about."""
LEAST_BUCKETS = 16
LARGE_LINES = 4_000_000
"""Lines of an order or an address above which several tasks number them."""

ENTITY_CATEGORIES = [
    "sanctioned", "ransomware", "darknet", "mixer", "scam",
    "fraud", "high_risk_exchange", "exchange", "merchant", "unknown",
]
SOURCE_TYPES = ["seed", "official_por", "wallet_label", "address_lookup"]
ACTION_TYPES = {
    "view": "NOTE",
    "signup": "SYSTEM_REPORT_GENERATED",
    "purchase": "USER_FREEZE_REQUEST_SENT",
    "click": "USER_POLICE_REPORT_FILED",
    "error": "RESPONSE_EXCHANGE",
}
ACTION_STATUSES = ["DONE", "PENDING", "FAILED", "CANCELLED"]

_ledgers: dict[tuple[str, str], Ledger] = {}
_cases: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def address_of(key) -> F.Column:
    return F.concat(F.lit("addr"), F.lpad(key.cast("string"), 8, "0"))


def txid_of(key) -> F.Column:
    return F.concat(F.lit("tx"), F.lpad(key.cast("string"), 10, "0"))


def case_of(key) -> F.Column:
    return F.concat(F.lit("case"), F.lpad(key.cast("string"), 10, "0"))


def height_of(day) -> F.Column:
    return F.datediff(day.cast("date"), F.lit(EPOCH).cast("date")).cast("bigint")


def _share(rows: int) -> int:
    """How many tasks share so many lines."""
    return max(8, -(-rows // TASK_LINES))


def _numbered(rows: DataFrame, key: str, large: list, keys: list[str], order: list[str], out: str, parts: int) -> DataFrame:
    """``row_number()`` over ``key`` and ``keys`` ordered by ``order``; rows move once, to the task of their ``key``.

    Groups named in ``large`` are cut into slices of the first order column instead, see :func:`ranked`.
    """
    whole = Window.partitionBy(key, *keys).orderBy(*order)
    known = rows.where(F.col(key).isNotNull() & F.col(order[0]).isNotNull())
    small = known.where(~F.col(key).isin(large)) if large else known
    numbered = small.repartition(parts, key).withColumn(out, F.row_number().over(whole))
    if not large:
        return numbered
    return numbered.unionByName(ranked(known.where(F.col(key).isin(large)), [key, *keys], order[0], order[1:], out))


def _large(sizes: DataFrame, key: str) -> list:
    """The groups with more than LARGE_LINES lines; there are at most as many as that number divides all lines."""
    return [r[0] for r in sizes.where((F.col("lines") > LARGE_LINES) & F.col(key).isNotNull()).select(key).collect()]


def _linked_lines(spark: SparkSession, sf_dir: str, sizes: DataFrame) -> DataFrame:
    """Order lines with their position in the order and the line of the other status that they are linked with.

    A line moves twice: to the task of its order and to the task of its address, where outputs and inputs of one place in the life
    of the address meet without a join. ``sizes`` has the lines of each order.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    whole = table(spark, sf_dir, "lineitem")
    parts = _share(whole.count())
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"]
    lines = whole.where(F.col("l_linestatus").isin("O", "F")).select("l_orderkey", "l_linestatus", *order)
    placed = _numbered(lines, "l_orderkey", _large(sizes, "l_orderkey"), ["l_linestatus"], order, "n", parts)
    dated = placed.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_linestatus").alias("side"), (F.col("n") - 1).cast("int").alias("idx"), "o_orderkey", "o_orderdate",
        address_of(F.col("l_partkey")).alias("address"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("sats"),
        ((F.col("l_discount") == 0) & (F.col("l_tax") == 0)).alias("is_new_coin"),
        (F.col("l_tax") == 0).alias("is_amount_hidden"),
    )
    lives = whole.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("lines")).select(address_of(F.col("l_partkey")).alias("address"), "lines")
    lived = _numbered(dated, "address", _large(lives, "address"), ["side"], ["o_orderdate", "o_orderkey", "idx"], "k", parts)
    place = Window.partitionBy("address", "k")
    other = lambda name, side, *columns: F.max(F.when(F.col("side") == side, F.struct(*columns))).over(place).alias(name)
    met = lived.select("*", other("m", "O", "o_orderdate", "o_orderkey", "idx", "sats"), other("u", "F", "o_orderdate", "o_orderkey"))
    return met.withColumn("is_linked", F.coalesce(F.col("m.o_orderdate") < F.col("u.o_orderdate"), F.lit(False)))


def _derive(spark: SparkSession, sf_dir: str) -> Ledger:
    line_counts = materialize(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines")), "fixture-lines")
    is_linked, is_new, is_made = F.col("is_linked"), F.col("is_new_coin"), F.col("side") == "O"
    own = F.concat(F.lit("ext"), F.col("o_orderkey").cast("string"))
    linked = _linked_lines(spark, sf_dir, line_counts).select(
        "side", txid_of(F.col("o_orderkey")).alias("txid"), "idx",
        F.when(is_made | is_linked | ~is_new, F.col("address")).alias("address"),
        F.when(is_made, F.col("sats")).when(is_linked, F.col("m.sats")).when(is_new | F.col("is_amount_hidden"), F.lit(None))
        .otherwise(F.col("sats")).alias("amount_sats"),
        F.when(is_made, F.when(is_linked, txid_of(F.col("u.o_orderkey")))).when(is_linked, txid_of(F.col("m.o_orderkey")))
        .when(is_new, F.lit(None)).otherwise(own).alias("other"),
        F.when(is_made, F.lit(None)).when(is_linked, F.col("m.idx")).when(is_new, F.lit(None)).otherwise(F.col("idx")).alias("other_idx"),
    )
    # What follows joins and groups by transaction, so the lines move there once.
    buckets = max(LEAST_BUCKETS, _share(table(spark, sf_dir, "lineitem").count()))
    lines = bucketed(linked, "txid", buckets, "fixture-linked", "side")
    half = lambda side: lines.where(F.col("side") == side)
    inputs = half("F").select(
        "txid", F.col("idx").alias("vin_index"), F.col("other").alias("prev_txid"), F.col("other_idx").alias("prev_vout"), "address", "amount_sats")
    outputs = half("O").select("txid", F.col("idx").alias("vout_index"), "address", "amount_sats", F.col("other").alias("spent_by_txid"))

    orders = table(spark, sf_dir, "orders")
    spent = inputs.groupBy("txid").agg(F.sum("amount_sats").alias("in_sats"), F.sum(F.col("amount_sats").isNull().cast("bigint")).alias("hidden"))
    made = outputs.groupBy("txid").agg(F.sum("amount_sats").alias("out_sats"))
    transactions = (
        orders.select(txid_of(F.col("o_orderkey")).alias("txid"), "o_orderdate").join(spent, "txid", "left").join(made, "txid", "left")
        .join(line_counts.select(txid_of(F.col("l_orderkey")).alias("txid"), "lines"), "txid", "left")
        .select(
            "txid",
            height_of(F.col("o_orderdate")).alias("block_height"),
            F.when(F.col("hidden") == 0, F.col("in_sats") - F.coalesce("out_sats", F.lit(0))).alias("fee_sats"),
            (100 + 10 * F.coalesce("lines", F.lit(0))).cast("int").alias("vsize"),
            F.col("o_orderdate").alias("first_seen"),
        )
    )
    days = orders.select("o_orderdate").distinct()
    blocks = days.select(
        height_of(F.col("o_orderdate")).alias("height"), F.col("o_orderdate").alias("timestamp"),
    ).select("height", F.sha2(F.col("height").cast("string"), 256).alias("hash"), "timestamp")
    return Ledger(
        blocks=materialize(blocks, "fixture-blocks"),
        transactions=bucketed(transactions, "txid", buckets, "fixture-transactions", None, placed=True),
        inputs=inputs,
        outputs=outputs,
    )


def ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _ledgers:
        _ledgers[key] = _derive(spark, sf_dir)
    return _ledgers[key]


# -- labels ------------------------------------------------------------------------------


def script_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        address_of(F.col("p_partkey")).alias("address"), F.col("p_type").alias("script_type"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("entity_id"), F.col("s_name").alias("name"),
        pick(ENTITY_CATEGORIES, key % 10).alias("category"))


def _part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with the supplier of its first shipment."""
    first = (
        table(spark, sf_dir, "lineitem").groupBy("l_partkey")
        .agg(F.min(F.struct("l_shipdate", "l_suppkey"))["l_suppkey"].alias("entity_id"))
    )
    return (
        table(spark, sf_dir, "part").join(first, F.col("p_partkey") == F.col("l_partkey"))
        .select(address_of(F.col("p_partkey")).alias("address"), "entity_id", "p_type", "p_size", "p_brand")
    )


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_entities(spark, sf_dir).where(F.col("p_type").isin("ECONOMY", "PROMO")).select(
        "address", "entity_id", ((F.col("p_size") + 49) / 100).cast("decimal(4,3)").alias("confidence"))


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (address, source_key) as several label providers would deliver them."""
    size, kind = F.col("p_size"), F.col("p_type")
    provided = F.filter(
        F.array(
            F.when(kind.isin("ECONOMY", "PROMO"), "WALLETEXPLORER"),
            F.when(kind == "ECONOMY", "BITCOINABUSE"),
            F.when((kind == "PROMO") & (size <= 5), "MANUAL"),
            F.when((kind == "ECONOMY") & (size <= 3), "INVESTIGATION"),
            F.when(size >= 48, "OFAC"),
        ),
        lambda s: s.isNotNull(),
    )
    level = F.when(F.col("source_key").isin("MANUAL", "OFAC", "INVESTIGATION"), 1).otherwise(2)
    return (
        _part_entities(spark, sf_dir)
        .withColumn("source_key", F.explode(provided))
        .join(entities(spark, sf_dir), "entity_id")
        .select(
            "address", "source_key", F.col("name").alias("entity_name"), F.upper("category").alias("entity_type"),
            level.alias("confidence_level"), (F.col("source_key") == "OFAC").alias("is_sanctioned"),
            F.when(F.col("source_key") == "BITCOINABUSE", F.col("category")).alias("abuse_category"),
            F.when(F.col("source_key") == "BITCOINABUSE", size).otherwise(1).alias("report_count"),
        )
    )


def sanctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_size") == 50).select(
        address_of(F.col("p_partkey")).alias("address"), F.lit("SDN").alias("identification"))


def intel_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers in the three shapes: entity as object, as text, and only in labels."""
    size = F.col("p_size")
    raw = F.concat(F.lit(" "), F.upper(pick([k for k, _ in EXCHANGE_NAMES], F.col("p_partkey") % len(EXCHANGE_NAMES))),
                   F.lit(" wallet "))
    found = (size != 13).cast("string")
    source_type = pick(SOURCE_TYPES, size % 4)
    entity = (
        F.when(size % 3 == 0, F.concat(F.lit('{"name":"'), raw, F.lit('","type":"exchange"}')))
        .when(size % 3 == 1, F.concat(F.lit('"'), raw, F.lit('"')))
        .otherwise("null")
    )
    labels = F.when(size % 3 == 2, F.concat(F.lit('[{"entity_name":"  "},{"source_name":"'), raw, F.lit('"}]'))) \
        .otherwise("[]")
    address = address_of(F.col("p_partkey"))
    return (
        table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"))
        .select(
            address.alias("address"),
            F.concat(F.lit('{"address":"'), address, F.lit('","network":"bitcoin","found":'), found,
                     F.lit(',"entity":'), entity, F.lit(',"labels":'), labels,
                     F.lit(',"best_source_type":"'), source_type, F.lit('"}')).alias("payload"),
        )
    )


def manual_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where((F.col("p_type") == "MEDIUM") & (F.col("p_size") <= 4)).select(
        address_of(F.col("p_partkey")).alias("address"),
        F.when(F.col("p_size") <= 2, "HTX desk").otherwise("Corner Exchange").alias("exchange_name"))


def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("gold"), F.col("doc_id").cast("string")).alias("case_id"),
        address_of(F.col("doc_id")).alias("address"),
        F.when(F.col("toxic") == 1, "scam").otherwise("clean").alias("expected_label"),
        F.lit("").alias("notes"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled address is a seed."""
    return gold_labels(spark, sf_dir).select(F.col("address").alias("seed")).distinct()


# -- cases -------------------------------------------------------------------------------


def fraud_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed urgent orders that pay someone; the recipient is the largest output. Written once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _cases:
        _cases[key] = materialize(_fraud_cases(spark, sf_dir), "fixture-cases")
    return _cases[key]


def _fraud_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = ledger(spark, sf_dir).outputs
    largest = outputs.groupBy("txid").agg(
        F.max_by("address", F.struct("amount_sats", (-F.col("vout_index")).alias("v"))).alias("recipient"))
    return (
        table(spark, sf_dir, "orders")
        .where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))
        .select(case_of(F.col("o_orderkey")).alias("case_id"), txid_of(F.col("o_orderkey")).alias("txid"),
                F.col("o_orderdate").alias("incident_date"), F.col("o_totalprice").alias("fraud_amount_eur"))
        .join(largest, "txid")
        .select("case_id", F.col("txid").alias("fraud_txid"), "recipient", "incident_date", "fraud_amount_eur")
    )


def case_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, address) of every input address of the reported transaction."""
    cases = fraud_cases(spark, sf_dir).select("case_id", F.col("fraud_txid").alias("txid"))
    return (
        ledger(spark, sf_dir).inputs.where(F.col("address").isNotNull())
        .join(cases, "txid").select("case_id", "address").distinct()
    )


def case_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in ACTION_TYPES.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("action_id"), F.col("user_id").alias("case_id"),
        kinds[F.col("event_type")].alias("action_type"),
        pick(ACTION_STATUSES, F.col("event_id") % 4).alias("status"),
        F.col("ts").cast("date").alias("action_date"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("title"),
        F.col("ts").alias("created_at"))


def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").where(kind.isin("signup", "purchase")).select(
        F.col("event_id").alias("document_id"), F.col("user_id").alias("case_id"),
        F.when(kind == "signup", "FORENSIC_REPORT").otherwise("FREEZE_REQUEST").alias("doc_type"),
        F.col("ts").alias("uploaded_at"))


def user_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_id"))
        .agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
        .select("case_id", F.concat(F.lit("Case "), F.col("case_id").cast("string")).alias("title"),
                pick(["OPEN", "PENDING", "RESOLVED", "CLOSED", "ARCHIVED"], F.col("case_id") % 5).alias("status"),
                "created_at", "updated_at")
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "error", 500).otherwise(200).alias("status_code"),
        (F.col("value") / 100).alias("latency_s"),
        (kind == "purchase").alias("is_hit"), kind.isin("purchase", "view").alias("is_lookup"),
        (kind == "signup").alias("is_started"), (kind == "error").alias("is_failed"))


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key_id"), F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.col("value").alias("response_ms"), F.col("ts").alias("called_at"))


# -- documents ---------------------------------------------------------------------------


def _btc(sats) -> F.Column:
    return (sats.cast("decimal(20,0)") / 100_000_000).cast("decimal(20,8)")


def _tx_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transaction with its inputs and outputs as the arrays of one document."""
    led = ledger(spark, sf_dir)
    is_new = F.col("prev_txid").isNull()
    vin = F.struct(
        F.col("vin_index"), F.when(is_new, "00").alias("coinbase"),
        F.col("prev_txid").alias("txid"), F.col("prev_vout").alias("vout"))
    vins = led.inputs.groupBy("txid").agg(F.array_sort(F.collect_list(vin)).alias("vin"))
    listed = F.col("script_type") == "LARGE"
    script = F.struct(
        F.when(~listed, F.col("address")).alias("address"),
        F.when(listed, F.array("address")).alias("addresses"), F.col("script_type").alias("type"))
    vout = F.struct(F.col("vout_index").alias("n"), _btc(F.col("amount_sats")).alias("value"),
                    script.alias("scriptPubKey"), F.col("address").alias("plain_address"), F.col("amount_sats"))
    vouts = led.outputs.join(script_types(spark, sf_dir), "address").groupBy("txid").agg(
        F.array_sort(F.collect_list(vout)).alias("vout"))
    return led.transactions.join(vins, "txid", "left").join(vouts, "txid", "left")


def _node_vin(v):
    return F.struct(v["coinbase"].alias("coinbase"), v["txid"].alias("txid"), v["vout"].alias("vout"))


def _node_vout(v):
    return F.struct(v["n"].alias("n"), v["value"].alias("value"), v["scriptPubKey"].alias("scriptPubKey"))


def _explorer_vout(v):
    return F.struct(v["amount_sats"].alias("value"), v["plain_address"].alias("scriptpubkey_address"))


def _epoch(ts) -> F.Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def _lists(vout) -> list[F.Column]:
    nothing = F.array()
    return [F.coalesce(F.transform("vin", _node_vin), nothing.cast("array<struct<coinbase:string,txid:string,vout:int>>"))
            .alias("vin"), vout.alias("vout")]


def block_documents(spark: SparkSession, sf_dir: str) -> str:
    """Verbose block documents; a block is split into one document per transaction."""
    height = F.col("block_height")
    tx = F.struct("txid", _btc(F.col("fee_sats")).alias("fee"), "vsize", *_lists(F.transform("vout", _node_vout)))
    path = fresh_path(spark, "blocks-json")
    _tx_parts(spark, sf_dir).select(
        height.alias("height"), F.sha2(height.cast("string"), 256).alias("hash"),
        _epoch(F.col("first_seen")).alias("time"), F.array(tx).alias("tx"),
    ).write.json(path)
    return path


def transaction_documents(spark: SparkSession, sf_dir: str) -> str:
    """Single transactions: those with a known fee as node documents, the others as explorer documents."""
    is_node = F.col("fee_sats").isNotNull()
    parts = _tx_parts(spark, sf_dir)
    height, seconds = F.col("block_height"), _epoch(F.col("first_seen"))
    node = parts.where(is_node).select(
        "txid", _btc(F.col("fee_sats")).alias("fee"), "vsize", *_lists(F.transform("vout", _node_vout)),
        F.sha2(height.cast("string"), 256).alias("blockhash"), height.alias("blockheight"), seconds.alias("blocktime"))
    explorer = parts.where(~is_node).select(
        "txid", "vsize", *_lists(F.transform("vout", _explorer_vout)),
        F.struct(F.lit(True).alias("confirmed"), height.alias("block_height"), seconds.alias("block_time")).alias("status"))
    path = fresh_path(spark, "tx-json")
    node.write.json(path)
    explorer.write.mode("append").json(path)
    return path


def intake_documents(spark: SparkSession, sf_dir: str) -> str:
    """Case intake, one document per reported case; victims are given as links."""
    led = ledger(spark, sf_dir)
    cases = fraud_cases(spark, sf_dir)
    first_victim = case_victims(spark, sf_dir).groupBy("case_id").agg(F.min("address").alias("victim"))
    amount = led.outputs.groupBy(F.col("txid").alias("fraud_txid"), F.col("address").alias("recipient")).agg(
        F.min_by("amount_sats", "vout_index").alias("sats"))
    brand = F.when(F.col("fraud_amount_eur") > 250000, "Acme")
    kind = F.when(F.col("fraud_amount_eur") < 400000, "Hardware")
    path = fresh_path(spark, "intake-json")
    cases.join(first_victim, "case_id", "left").join(amount, ["fraud_txid", "recipient"]).select(
        "case_id",
        F.struct(F.concat(F.lit("Person "), "case_id").alias("name")).alias("victim"),
        F.struct(F.date_format("incident_date", "yyyy-MM-dd").alias("date"), brand.alias("wallet_brand"),
                 kind.alias("wallet_type")).alias("incident"),
        F.struct("fraud_txid", _btc(F.col("sats")).cast("string").alias("fraud_amount_btc"),
                 F.array(F.concat(F.lit("https://explorer.example/address/"), "victim")).alias("victim_addresses"),
                 F.col("recipient").alias("recipient_address")).alias("blockchain"),
    ).write.json(path)
    return path
