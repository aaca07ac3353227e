"""Following stolen funds, all cases at once.

A trace is two tables. ``hops`` has one row per transaction on the path of a case;
``legs`` has its senders and receivers as rows (side, ord, address, sats), because one
transaction may have more outputs than fit one record.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.money import btc_text, sats_to_btc
from ledgerspark.functions.rank import ranked, running, top_per
from ledgerspark.operators.ledger import Ledger
from ledgerspark.session import bucket_of, bucketed, discard, materialize

# Thresholds of the trace. A trace is not bounded unless a caller gives ``max_hops`` or ``max_branches``.
DUST_SATS = 546
POOLING_FACTOR = 3
FOLD = 16
BUCKET_ROWS = 500_000
"""Outputs of one bucket of the spend table, about."""
LEAST_BUCKETS = 16
HOPS_SLICE = 256
"""Hops of a case whose outputs one window orders."""

# Our own sentences, with the amounts and names between their parts.
POOLED_TEXTS = (
    "Of a payment of ", " BTC nothing can be told apart after this transaction: its largest output has ",
    " BTC and mixes in money of others, as exchanges do inside and as mixers do. The trace of this branch stops here.")
FOUND_TEXTS = ("This transaction pays ", ", known from ")
UNSPENT_TEXTS = (" Not spent when this was analysed: the output at ", "... may still be frozen.")
ZERO_TEXTS = (" victim address(es) lost ", " BTC here.")
DIRECT_TEXT = " Paid to exchanges by the same transaction: "
DEPOSIT_TEXTS = (" The recipient itself belongs to ", "; later transactions are listed for context and do not weaken that finding.")

CONFIDENCE_LABELS = {"L1": "Mathematically proven", "L2": "Forensically corroborated"}

# Texts of hop records.
POOLING_LABEL = "Consolidation — forwarding path no longer uniquely attributable"
POOLING_METHOD = "Direct UTXO link (input), pooling detected (output)"
FORWARD_LABEL, FORWARD_METHOD = "UTXO forwarding", "Direct UTXO link"
FORWARD_NOTE = "Automatically identified via the local node and Blockstream."
SANCTION_NOTE = " SANCTIONED ADDRESS (OFAC SDN)."
UNRESOLVED_LABEL = "Forwarding path not fully resolved"
UNRESOLVED_METHOD = "Direct UTXO link to recipient; spend resolution incomplete"
UNRESOLVED_NOTES = {
    "spent_unresolved": " The output was demonstrably spent, but the spending transaction could not be loaded "
                        "conclusively with the current spend-resolution path.",
    "unknown": " Spend resolution was technically incomplete; the next hop could not be determined reliably.",
}
UNRESOLVED_HEAD = "Receipt by this address is proven on-chain."
UNRESOLVED_TAIL = (" The report is technically incomplete at this point and must not be interpreted as an unspent "
                   "conclusion.")

# Receivers that are no exchange come after all that are, whatever their output index.
AFTER_EXCHANGES = 1 << 40


@dataclass(frozen=True)
class Trace:
    hops: DataFrame
    legs: DataFrame


def confidence_label(level: Column) -> Column:
    return F.when(level == "L2", CONFIDENCE_LABELS["L2"]).otherwise(CONFIDENCE_LABELS["L1"])


def time_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts.cast("timestamp"), "dd.MM.yyyy HH:mm 'UTC'"), F.lit("—"))


# -- single steps --------------------------------------------------------------------------


def recipient_amount(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per case the first output to the recipient, zero if there is none."""
    paid = cases.join(
        outputs.select(F.col("txid").alias("fraud_txid"), F.col("address").alias("recipient"), "vout_index", "amount_sats"),
        ["fraud_txid", "recipient"],
    ).groupBy("case_id").agg(F.min_by("amount_sats", "vout_index").alias("recipient_sats"))
    return cases.select("case_id").join(paid, "case_id", "left").select(
        "case_id", F.coalesce("recipient_sats", F.lit(0)).alias("recipient_sats"))


def victim_amount(cases: DataFrame, victims: DataFrame, inputs: DataFrame) -> DataFrame:
    """Per case the sum of inputs owned by its victims."""
    own = (
        cases.select("case_id", F.col("fraud_txid").alias("txid")).join(inputs, "txid")
        .join(victims.select("case_id", "address").distinct(), ["case_id", "address"], "left_semi")
        .groupBy("case_id").agg(F.sum("amount_sats").alias("victim_sats"))
    )
    return cases.select("case_id").join(own, "case_id", "left").select(
        "case_id", F.coalesce("victim_sats", F.lit(0)).alias("victim_sats"))


def stolen_amount(cases: DataFrame, victims: DataFrame, ledger: Ledger) -> DataFrame:
    """T1 with T2 as fallback."""
    both = recipient_amount(cases, ledger.outputs).join(victim_amount(cases, victims, ledger.inputs), "case_id")
    return both.select("case_id", "recipient_sats", "victim_sats", F.when(
        F.col("recipient_sats") > 0, F.col("recipient_sats")).otherwise(F.col("victim_sats")).alias("stolen_sats"))


def spenders_of(outpoints: DataFrame, inputs: DataFrame, transactions: DataFrame) -> DataFrame:
    """Every input that spends an outpoint (txid, vout_index), with the height and time of its transaction."""
    spends = inputs.where(F.col("prev_txid").isNotNull()).select(
        F.col("txid").alias("spender"), F.col("prev_txid").alias("txid"), F.col("prev_vout").alias("vout_index"))
    blocks = transactions.select(
        F.col("txid").alias("spender"), F.col("block_height").alias("spend_height"), F.col("first_seen").alias("spend_seen"),
        F.lit(True).alias("is_loaded"))
    return outpoints.join(spends, ["txid", "vout_index"]).join(blocks, "spender", "left")


def spend_state(
    outpoints: DataFrame, outputs: DataFrame, inputs: DataFrame, transactions: DataFrame
) -> DataFrame:
    """(txid, vout_index, state, spender) of each distinct outpoint; the lowest spend counts."""
    points = outpoints.select("txid", "vout_index").distinct()
    first = spenders_of(points, inputs, transactions).groupBy("txid", "vout_index").agg(
        F.min(F.struct(F.coalesce("spend_height", F.lit(2**62)), "spender"))["spender"].alias("spender"))
    known = outputs.select("txid", "vout_index", "spent_by_txid", F.lit(True).alias("is_known"))
    state = (
        F.when(F.col("spender").isNotNull(), "spent").when(F.col("is_known").isNull(), "unknown")
        .when(F.col("spent_by_txid").isNotNull(), "spent_unresolved").otherwise("unspent")
    )
    return points.join(known, ["txid", "vout_index"], "left").join(first, ["txid", "vout_index"], "left").select(
        "txid", "vout_index", state.alias("state"), "spender")


def forward_spend_scan(
    outpoints: DataFrame, inputs: DataFrame, transactions: DataFrame, max_blocks: int | None = None
) -> DataFrame:
    """T4: the spender of each outpoint (txid, vout_index, hint) in the blocks after its ``hint`` height.

    The join is on the outpoint and needs no bound; ``max_blocks`` limits the search to so many blocks where a caller wants that.
    """
    near = spenders_of(outpoints.where(F.col("hint") > 0), inputs, transactions).where(F.col("spend_height") > F.col("hint"))
    if max_blocks is not None:
        near = near.where(F.col("spend_height") <= F.col("hint") + max_blocks)
    return near.groupBy("txid", "vout_index").agg(
        F.min(F.struct("spend_height", "spender"))["spender"].alias("spender"))


# -- the trace -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Spends:
    """Every output with its lowest spend, in buckets of its transaction: what one level of a trace reads."""

    table: DataFrame
    buckets: int

    def of(self, frontier: DataFrame) -> DataFrame:
        """The outputs of the transactions of ``frontier`` (txid, ..., a written table).

        Only the buckets that the frontier names are read, and they stay where they are: the frontier moves to them.
        """
        named = frontier.select(bucket_of("txid", self.buckets).alias("b")).where("b IS NOT NULL").distinct()
        wanted = [r.b for r in named.collect()]  # at most ``buckets`` numbers
        return frontier.join(self.table.where(F.col("bucket").isin(wanted)).drop("bucket"), "txid")


def spend_table(ledger: Ledger) -> Spends:
    """Written once for all levels of all traces over ``ledger``."""
    outputs = ledger.outputs.select("txid", "vout_index", "address", F.col("amount_sats").alias("sats"), F.col("spent_by_txid").alias("flag"))
    blocks = ledger.transactions.select("txid", F.col("block_height").alias("height"), "first_seen", F.lit(True).alias("is_loaded"))
    # A spend meets its block where it is and then moves to its output once; there is no join of outputs with spends.
    spends = ledger.inputs.where(F.col("prev_txid").isNotNull() & F.col("prev_vout").isNotNull()).join(blocks, "txid", "left").select(
        F.col("prev_txid").alias("txid"), F.col("prev_vout").cast(outputs.schema["vout_index"].dataType).alias("vout_index"),
        F.col("txid").alias("spender"), "height", "first_seen", "is_loaded", F.lit(False).alias("is_output"))
    buckets = max(LEAST_BUCKETS, -(-ledger.outputs.count() // BUCKET_ROWS))
    both = outputs.withColumn("is_output", F.lit(True)).unionByName(spends, allowMissingColumns=True).repartition(buckets, "txid")
    spend = F.when(~F.col("is_output"), F.struct(
        F.coalesce("height", F.lit(2**62)).alias("h"), "spender", F.col("height").alias("spend_height"), F.col("first_seen").alias("spend_seen"),
        F.coalesce("is_loaded", F.lit(False)).alias("is_loaded")))
    lowest = F.min(spend).over(Window.partitionBy("txid", "vout_index"))
    rows = both.select(*outputs.columns, "is_output", lowest.alias("s")).where("is_output").select(
        *outputs.columns, "s.spender", "s.spend_height", "s.spend_seen", F.coalesce("s.is_loaded", F.lit(False)).alias("is_loaded"))
    return Spends(bucketed(rows, "txid", buckets, "spends", placed=True), buckets)


_SPENT = ["spender", "spend_height", "spend_seen", "is_loaded"]


def _first_queue(cases: DataFrame, spends: Spends) -> DataFrame:
    """The recipient's first output of each reported transaction."""
    reported = materialize(cases.select("case_id", F.col("fraud_txid").alias("txid"), F.col("recipient")), "trace-reported")
    # Compared inside the aggregate: as a condition it becomes a key of the join, and the spend table would move to its address.
    is_paid = F.col("address") == F.col("recipient")
    first = spends.of(reported).groupBy("case_id", "txid", "recipient").agg(
        F.min(F.when(is_paid, F.struct("vout_index", "sats", "flag", *_SPENT))).alias("o")).where("o IS NOT NULL").withColumnRenamed("recipient", "address")
    zero = F.lit(0).cast("bigint")
    return first.select("case_id", zero.alias("parent"), zero.alias("ord"), zero.alias("used"), "txid", "address", "o.*")


def _process(queue: DataFrame, visited: DataFrame | None, depth: int, max_hops: int | None) -> DataFrame:
    """Decide each queued output in order (of its parent hop, then its own there): its state, whether it makes a hop, and the hop's number."""
    state = F.when(F.col("spender").isNotNull(), "spent").when(F.col("flag").isNotNull(), "spent_unresolved").otherwise("unspent")
    queue = queue.withColumn("state", state)
    first = queue.where("spender IS NOT NULL").groupBy("case_id", "spender").agg(F.min(F.struct("parent", "ord")).alias("f")).select(
        "case_id", "spender", "f.*", F.lit(True).alias("is_first"))
    items = queue.join(first, ["case_id", "spender", "parent", "ord"], "left")
    if visited is not None:
        items = items.join(visited.withColumn("is_seen", F.lit(True)), ["case_id", "spender"], "left")
    else:
        items = items.withColumn("is_seen", F.lit(None).cast("boolean"))
    is_new = F.col("is_seen").isNull() & F.coalesce("is_first", F.lit(False))
    is_hop = is_new & F.col("is_loaded")
    # Without any hop yet, an unresolved spend leaves a record of its own.
    is_stub = (F.col("state") == "spent_unresolved") & (F.col("used") == 0) & F.lit(depth == 1)
    counted = running(
        items.withColumn("is_hop", is_hop).withColumn("is_stub", is_stub).withColumn("makes", (F.col("is_hop") | F.col("is_stub")).cast("int"))
        .withColumn("is_new", is_new).withColumn("slice", F.floor(F.col("parent") / HOPS_SLICE)),
        ["case_id"], "slice", ["parent", "ord"], earlier="makes")
    counted = counted.withColumn("before", F.col("used") + F.col("earlier")).withColumn("total", F.col("used") + F.col("earlier_all"))
    if max_hops is not None:
        counted = counted.where(F.col("before") < max_hops).withColumn("total", F.least("total", F.lit(max_hops)))
    return counted.select(
        "case_id", "parent", "ord", F.lit(depth).alias("depth"), "txid", "address", "vout_index", "sats", "state", "spender",
        "spend_height", "spend_seen", "is_hop", "is_stub", "is_new", "before",
        (F.col("before") + 1).alias("hop_no"), "total")


def _receivers_of(items: DataFrame, spends: Spends, known: DataFrame) -> DataFrame:
    """All outputs of the new hops' transactions with what is known of the address and of their own spends."""
    hops = items.where("is_hop").select(
        "case_id", "hop_no", F.col("spender").alias("txid"), F.col("address").alias("current"),
        F.col("sats").alias("from_sats"), "total")
    outs = spends.of(hops).where(F.col("address").isNotNull())
    is_self = F.col("address") == F.col("current")
    return outs.join(known, "address", "left").select(
        "case_id", "hop_no", "txid", "from_sats", "total", "vout_index", "address", "sats", "flag", *_SPENT, is_self.alias("is_self"),
        (F.coalesce("is_evidential", F.lit(False)) & ~is_self).alias("is_exchange"),
        (F.coalesce("is_sanctioned", F.lit(False)) & ~is_self).alias("is_sanctioned"),
        "exchange", "label", "source")


def hop_outputs(outs: DataFrame, max_branches: int | None = None) -> DataFrame:
    """Receivers a hop shows: every exchange, the others by size (the ``max_branches`` largest, if given), else the single largest output."""
    key = ["case_id", "hop_no"]
    columns = [*key, "ord", "address", "sats", "is_exchange", "exchange", "source", "label"]
    exchanges = outs.where("is_exchange").withColumn("ord", F.col("vout_index").cast("bigint"))
    other = outs.where(~F.col("is_exchange") & (F.col("is_self") | (F.col("sats") > DUST_SATS)))
    best = top_per(other, key, [F.col("sats").desc(), F.col("vout_index")], max_branches)
    best = best.withColumn("ord", F.col("rank") + F.lit(AFTER_EXCHANGES))
    counted = outs.groupBy(*key).agg(
        F.count_if(F.col("is_exchange") | F.col("is_self") | (F.col("sats") > DUST_SATS)).alias("n"),
        F.max(F.struct("sats", (-F.col("vout_index")).alias("v"), "address")).alias("top"))
    none = F.lit(None).cast("string")
    only = counted.where("n = 0").select(
        *key, F.lit(AFTER_EXCHANGES + 1).alias("ord"), F.col("top.address").alias("address"),
        F.col("top.sats").alias("sats"), F.lit(False).alias("is_exchange"), none.alias("exchange"), none.alias("source"),
        none.alias("label"))
    shown = exchanges.select(*columns).unionByName(best.select(*columns)).unionByName(only)
    hit = lambda c: F.when(F.col("is_exchange"), F.col(c)).alias(c)
    return shown.select(*key, "ord", "address", "sats", "is_exchange", hit("exchange"), hit("source"), hit("label"))


def pooling_flag(from_sats: Column, max_sats: Column, has_exchange: Column) -> Column:
    """The largest output is more than three times what came in, and no exchange is paid."""
    return (from_sats > 0) & (max_sats > POOLING_FACTOR * from_sats) & ~has_exchange


def hop_facts(outs: DataFrame) -> DataFrame:
    """Per hop what its receivers say: exchange hits, largest output, sanctions, pooling."""
    hit = F.when(F.col("is_exchange"), F.struct("vout_index", "exchange", "source", "label"))
    facts = outs.groupBy("case_id", "hop_no").agg(
        F.bool_or("is_exchange").alias("has_exchange"), F.max("sats").alias("max_sats"),
        F.bool_or("is_sanctioned").alias("is_sanctioned"), F.min("from_sats").alias("from_sats"),
        F.min(hit).alias("first_hit"),
        # Distinct exchange names: the vocabulary of services, not of addresses.
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_exchange"), F.col("exchange")))), ", ").alias("names"))
    return facts.withColumn("is_pooling", pooling_flag(F.col("from_sats"), F.col("max_sats"), F.col("has_exchange")))


def _next_queue(outs: DataFrame, shown: DataFrame, facts: DataFrame) -> DataFrame:
    """Shown receivers that are no exchange, unless the funds were pooled, in order."""
    key = ["case_id", "hop_no"]
    follow = shown.where(~F.col("is_exchange")).join(facts.where(~F.col("is_pooling")).select(*key), key, "left_semi")
    first = (
        outs.join(follow.select(*key, "address").distinct(), [*key, "address"], "left_semi")
        .groupBy(*key, "address", "txid", "total").agg(F.min(F.struct("vout_index", "sats", "flag", *_SPENT)).alias("o"))
    )
    return follow.select(*key, "ord", "address").join(first, [*key, "address"]).select(
        "case_id", F.col("hop_no").alias("parent"), "ord", F.col("total").alias("used"), "txid", "address", "o.*")


def hop_classify(items: DataFrame, facts: DataFrame) -> DataFrame:
    """The record of each hop; a transaction without addressed outputs forwards to nobody."""
    is_exchange, is_pooling = F.col("has_exchange"), F.col("is_pooling")
    text = lambda exchange, pooling, plain: (
        F.when(is_exchange, exchange).when(is_pooling, pooling).otherwise(plain))
    hit = F.col("first_hit")
    pooled = F.concat(
        F.lit(POOLED_TEXTS[0]), btc_text(sats_to_btc(F.col("sats"))), F.lit(POOLED_TEXTS[1]), btc_text(sats_to_btc(F.col("max_sats"))),
        F.lit(POOLED_TEXTS[2]))
    found = F.concat(F.lit(FOUND_TEXTS[0]), F.col("names"), F.lit(FOUND_TEXTS[1]), hit["source"], F.lit("."))
    level = F.when(is_exchange | is_pooling, "L2").otherwise("L1")
    flags = ["has_exchange", "is_pooling", "is_sanctioned"]
    rows = items.where("is_hop").join(facts.drop("from_sats"), ["case_id", "hop_no"], "left").na.fill(False, flags)
    return rows.select(
        "case_id", "hop_no", "depth", F.col("spender").alias("txid"), F.col("address").alias("from_address"),
        text(F.concat(F.lit("Exchange deposit -> "), F.col("names")), F.lit(POOLING_LABEL), F.lit(FORWARD_LABEL)).alias("label"),
        F.coalesce("spend_height", F.lit(0)).alias("block"), time_text(F.col("spend_seen")).alias("timestamp"),
        level.alias("confidence"),
        text(F.concat(F.lit("Exchange Intel Agent attribution ("), hit["label"], F.lit(")")),
             F.lit(POOLING_METHOD), F.lit(FORWARD_METHOD)).alias("method"),
        F.concat(text(found, pooled, F.lit(FORWARD_NOTE)),
                 F.when(F.col("is_sanctioned"), SANCTION_NOTE).otherwise("")).alias("notes"),
        "is_sanctioned",
        F.when(is_exchange, "exchange").when(is_pooling, "pooling").alias("chain_end_reason"),
        hit["exchange"].alias("exchange"), hit["source"].alias("exchange_source"))


def _stubs(items: DataFrame, transactions: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    stubs = items.where("is_stub")
    blocks = transactions.join(stubs.select("txid"), "txid", "left_semi").select("txid", "block_height", "first_seen")
    note = F.concat(F.lit(UNRESOLVED_HEAD), F.lit(UNRESOLVED_NOTES["spent_unresolved"]), F.lit(UNRESOLVED_TAIL))
    return stubs.join(blocks, "txid", "left").select(
        "case_id", "hop_no", "depth", "txid", F.col("address").alias("from_address"),
        F.lit(UNRESOLVED_LABEL).alias("label"), F.coalesce("block_height", F.lit(0)).alias("block"),
        time_text(F.col("first_seen")).alias("timestamp"), F.lit("L1").alias("confidence"),
        F.lit(UNRESOLVED_METHOD).alias("method"), note.alias("notes"), F.lit(False).alias("is_sanctioned"),
        F.lit("lookup_incomplete").alias("chain_end_reason"), none.alias("exchange"), none.alias("exchange_source"))


def endpoint_annotate(hops: DataFrame, legs: DataFrame, ended: DataFrame, known: DataFrame) -> DataFrame:
    """Write how a branch ended onto the latest earlier hop that pays its address.

    ``ended`` has the outputs where a branch stopped, ``before`` being the number of hops
    that existed then. The notes of a record are one text, so those of a hop are brought together.
    """
    paid = legs.where(F.col("side") == "to").select("case_id", "hop_no", "address").distinct()
    target = ended.join(paid, ["case_id", "address"]).where(F.col("hop_no") <= F.col("before")).groupBy(
        "case_id", "depth", "parent", "ord", "address", "state").agg(F.max("hop_no").alias("hop_no"))
    is_exchange = F.coalesce("is_evidential", F.lit(False)) & (F.col("state") == "unspent")
    unspent = F.concat(F.lit(UNSPENT_TEXTS[0]), F.substring("address", 1, 20), F.lit(UNSPENT_TEXTS[1]))
    note = (
        F.when(is_exchange, F.concat(F.lit(" Address identified as "), F.col("exchange"), F.lit(".")))
        .when(F.col("state") == "unspent", unspent)
        .when(F.col("state") == "spent_unresolved", UNRESOLVED_NOTES["spent_unresolved"])
        .otherwise(UNRESOLVED_NOTES["unknown"])
    )
    reason = F.when(is_exchange, "exchange").when(F.col("state") == "unspent", "unspent").otherwise("lookup_incomplete")
    marks = target.join(known, "address", "left").select(
        "case_id", "hop_no", F.struct("depth", "parent", "ord").alias("at"), note.alias("note"), reason.alias("reason"),
        F.when(is_exchange, F.struct("exchange", "source", "label")).alias("hit"))
    folded = marks.groupBy("case_id", "hop_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "note"))), lambda m: m["note"]), "").alias("added"),
        F.max_by("reason", "at").alias("reason"), F.max_by("hit", F.when(F.col("hit").isNotNull(), F.col("at"))).alias("hit"))
    hit = F.col("hit")
    changed = {
        "label": F.concat(F.lit("Exchange deposit -> "), hit["exchange"]), "confidence": F.lit("L2"),
        "method": F.concat(F.lit("Exchange Intel Agent attribution ("), hit["label"], F.lit(")")),
        "exchange": hit["exchange"], "exchange_source": hit["source"],
    }
    value = lambda c: (
        F.when(hit.isNotNull(), changed[c]).otherwise(F.col(c)) if c in changed
        else F.concat("notes", F.coalesce("added", F.lit(""))) if c == "notes"
        else F.coalesce("reason", "chain_end_reason") if c == "chain_end_reason" else F.col(c))
    return hops.join(folded, ["case_id", "hop_no"], "left").select(*[value(c).alias(c) for c in hops.columns])


def dedupe_hops(hops: DataFrame, legs: DataFrame) -> Trace:
    """By depth and txid, one record per transaction and first sender, numbered from 1."""
    first = hops.groupBy("case_id", "txid", "from_address").agg(F.min(F.struct("depth", "hop_no")).alias("f")).select(
        "case_id", "f.hop_no")
    placed = hops.join(first, ["case_id", "hop_no"], "left_semi").withColumn("slice", F.struct("depth", F.substring("txid", 1, 2).alias("head")))
    numbered = ranked(placed, ["case_id"], "slice", ["depth", "txid", "hop_no"], "hop").drop("slice").withColumn("hop", F.col("hop").cast("int"))
    renumbered = legs.join(numbered.select("case_id", "hop_no", "hop"), ["case_id", "hop_no"]).drop("hop_no")
    return Trace(numbered.drop("hop_no", "from_address").withColumn(
        "confidence_label", confidence_label(F.col("confidence"))), renumbered)


def known_addresses(attribution: DataFrame) -> DataFrame:
    """The rows of a resolved attribution that change a trace."""
    return attribution.where(F.col("is_evidential") | F.col("is_sanctioned")).select(
        "address", "exchange", "label", "source", "is_evidential", "is_sanctioned")


class _Pile:
    """Tables that grow level by level; FOLD levels are written as one, so that plans stay small however many there are, and the
    tables that those levels were made from are dropped."""

    def __init__(self, *names: str) -> None:
        self.names = names
        self.tiers: list[list[tuple[tuple[DataFrame, ...], tuple[DataFrame, ...]]]] = []

    def add(self, *parts: DataFrame, made_from: tuple[DataFrame, ...] = ()) -> None:
        entry = parts, made_from
        for tier in self.tiers:
            if len(tier) < FOLD:
                tier.append(entry)
                return
            # The levels before this one: nothing else reads them by now.
            written = tuple(materialize(reduce(DataFrame.unionByName, dfs), name)
                            for name, dfs in zip(self.names, zip(*[p for p, _ in tier], strict=True), strict=True))
            discard(*[df for _, sources in tier for df in sources])
            tier[:] = [entry]
            entry = written, written
        self.tiers.append([entry])

    def whole(self) -> list[DataFrame]:
        entries = [p for tier in self.tiers for p, _ in tier]
        return [reduce(DataFrame.unionByName, dfs) for dfs in zip(*entries, strict=True)]


def trace_cases(
    ledger: Ledger, cases: DataFrame, attribution: DataFrame, max_hops: int | None = None, max_branches: int | None = None,
    spends: Spends | None = None,
) -> Trace:
    """T5: the trace of every case (case_id, fraud_txid, recipient), level by level until no output is left to follow.

    Within a case the queue is first in, first out, so all items of one depth precede those
    of the next; one round treats one depth of all cases. A case follows a transaction once, so
    the rounds end. A round reads those buckets of the spend table that its transactions lie in. ``max_hops`` bounds the records of a
    case, ``max_branches`` the receivers of a hop, where a caller wants that. ``spends`` is a table that the caller already has.
    """
    spends = spends or spend_table(ledger)
    known = materialize(known_addresses(attribution), "known")
    queue = materialize(_first_queue(cases, spends), "trace-queue")
    visited: DataFrame | None = None
    found, seen = _Pile("trace-hops", "trace-legs", "trace-ended"), _Pile("trace-seen")
    for depth in count(1):
        items = materialize(_process(queue, visited, depth, max_hops), "trace-items")
        discard(queue)
        ended = items.where(F.col("state").isin("unspent", "spent_unresolved", "unknown") & ~F.col("is_stub")).drop("hop_no", "is_new")
        senders = _leg(items.where("is_hop").select("case_id", "hop_no", "address", "sats"), "from")
        outs = materialize(_receivers_of(items, spends, known), "trace-outs")
        shown = materialize(hop_outputs(outs, max_branches), "trace-legs")
        facts = hop_facts(outs)
        hops, legs = hop_classify(items, facts), senders.unionByName(shown.withColumn("side", F.lit("to")))
        if depth == 1:
            stub = items.where("is_stub").select("case_id", "hop_no", "address", "sats")
            hops = hops.unionByName(_stubs(items, ledger.transactions))
            legs = legs.unionByName(_leg(stub, "from")).unionByName(_leg(stub, "to"))
        seen.add(items.where("is_new").select("case_id", "spender"))
        found.add(hops, legs, ended, made_from=(items, outs, shown))
        if items.where("is_hop").isEmpty():
            break
        visited = seen.whole()[0]
        queue = materialize(_next_queue(outs, shown, facts), "trace-queue")
    all_hops, all_legs, all_ended = found.whole()
    marked = endpoint_annotate(all_hops, all_legs, all_ended, known)
    result = dedupe_hops(materialize(marked, "trace-hops"), all_legs)
    return Trace(materialize(result.hops, "trace"), materialize(result.legs, "trace"))


def _leg(rows: DataFrame, side: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        "case_id", "hop_no", F.lit(0).cast("bigint").alias("ord"), "address", "sats", F.lit(False).alias("is_exchange"),
        none.alias("exchange"), none.alias("source"), none.alias("label"), F.lit(side).alias("side"))


# -- the reported transaction itself -------------------------------------------------------


def reported_part(ledger: Ledger, cases: DataFrame, spends: Spends | None = None) -> Ledger:
    """The reported transactions with their inputs and outputs, written: what the steps of hop 0 join, instead of the whole ledger.

    With ``spends`` its outputs come from the buckets of that table and stay where they are.
    """
    reported = materialize(cases.select(F.col("fraud_txid").alias("txid")).distinct(), "reported")
    own = lambda df, name: materialize(df.join(reported, "txid", "left_semi"), name)
    outputs = own(ledger.outputs, "reported-outputs") if spends is None else materialize(spends.of(reported).select(
        "txid", "vout_index", "address", F.col("sats").alias("amount_sats"), F.col("flag").alias("spent_by_txid")), "reported-outputs")
    return Ledger(ledger.blocks, own(ledger.transactions, "reported-transactions"), own(ledger.inputs, "reported-inputs"), outputs)


def build_hop0(ledger: Ledger, cases: DataFrame, victims: DataFrame, attribution: DataFrame, spends: Spends | None = None) -> Trace:
    """Hop 0 of each case: victims to recipient, and exchanges paid by the same transaction."""
    ledger = reported_part(ledger, cases, spends)
    known = known_addresses(attribution).where("is_evidential")
    amounts = stolen_amount(cases, victims, ledger)
    owners = victims.select("case_id", "address").distinct()
    counts = owners.groupBy("case_id").agg(F.count(F.lit(1)).alias("victims"))

    own_inputs = cases.select("case_id", F.col("fraud_txid").alias("txid")).join(ledger.inputs, "txid").join(
        owners, ["case_id", "address"], "left_semi").select(
        "case_id", F.col("vin_index").cast("bigint").alias("ord"), "address",
        F.coalesce("amount_sats", F.lit(0)).alias("sats"))
    # Without an input of a victim every victim is named, with no amount.
    unseen = owners.join(own_inputs.select("case_id").distinct(), "case_id", "left_anti").select(
        "case_id", F.lit(0).cast("bigint").alias("ord"), "address", F.lit(None).cast("bigint").alias("sats"))
    senders = own_inputs.unionByName(unseen)

    direct = (
        cases.select("case_id", F.col("fraud_txid").alias("txid"), "recipient").join(ledger.outputs, "txid")
        .where(F.col("address") != F.col("recipient")).join(known, "address")
        .groupBy("case_id", "address", "exchange", "source", "label", "is_sanctioned")
        .agg(F.min("vout_index").alias("first"), F.max_by("amount_sats", "vout_index").alias("sats"))
    )
    to_direct = direct.select(
        "case_id", (F.col("first") + 1).cast("bigint").alias("ord"), "address", "sats",
        F.lit(True).alias("is_exchange"), "exchange", "source", "label", "is_sanctioned")
    to_recipient = cases.select("case_id", F.col("recipient").alias("address")).join(
        amounts.select("case_id", F.col("stolen_sats").alias("sats")), "case_id").join(known, "address", "left").select(
        "case_id", F.lit(0).cast("bigint").alias("ord"), "address", "sats",
        F.coalesce("is_evidential", F.lit(False)).alias("is_exchange"), "exchange", "source", "label",
        F.coalesce("is_sanctioned", F.lit(False)).alias("is_sanctioned"))
    receivers = materialize(to_recipient.unionByName(to_direct), "hop0-legs")

    hit = F.when(F.col("is_exchange"), F.struct("ord", "exchange", "source", "label"))
    found = receivers.groupBy("case_id").agg(
        F.min(hit).alias("hit"), F.bool_or(F.col("is_exchange") & F.col("is_sanctioned")).alias("is_sanctioned"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_exchange"), F.col("exchange")))), ", ").alias("names"))
    blocks = ledger.transactions.select(F.col("txid").alias("fraud_txid"), "block_height", "first_seen")
    hit = F.col("hit")
    is_direct_only = hit.isNotNull() & (hit["ord"] > 0)
    notes = F.concat(
        F.coalesce("victims", F.lit(0)).cast("string"), F.lit(ZERO_TEXTS[0]), btc_text(sats_to_btc(F.col("stolen_sats"))), F.lit(ZERO_TEXTS[1]),
        F.when(is_direct_only, F.concat(F.lit(DIRECT_TEXT), F.col("names"), F.lit(".")))
        .when(hit.isNotNull(), F.concat(F.lit(DEPOSIT_TEXTS[0]), hit["exchange"], F.lit(DEPOSIT_TEXTS[1]))).otherwise(""))
    level = F.when(hit.isNotNull(), "L2").otherwise("L1")
    hops = (
        cases.join(amounts, "case_id").join(counts, "case_id", "left").join(found, "case_id").join(blocks, "fraud_txid", "left")
        .select(
            "case_id", F.lit(0).alias("hop"), F.lit(0).alias("depth"), F.col("fraud_txid").alias("txid"),
            F.when(hit.isNotNull(), F.concat(F.lit("Theft → "), hit["exchange"])).otherwise("Theft — Consolidation").alias("label"),
            F.coalesce("block_height", F.lit(0)).alias("block"), time_text(F.col("first_seen")).alias("timestamp"),
            level.alias("confidence"), confidence_label(level).alias("confidence_label"),
            F.when(hit.isNotNull(), F.concat(F.lit("Direct exchange attribution ("), hit["label"], F.lit(")")))
            .otherwise(FORWARD_METHOD).alias("method"),
            notes.alias("notes"), "is_sanctioned", F.lit(None).cast("string").alias("chain_end_reason"),
            hit["exchange"].alias("exchange"), hit["source"].alias("exchange_source"))
    )
    shown = lambda c: F.when(F.col("is_exchange"), F.col(c)).alias(c)
    none = F.lit(None).cast("string")
    legs = senders.select(
        "case_id", F.lit(0).alias("hop"), F.lit("from").alias("side"), "ord", "address", "sats",
        F.lit(False).alias("is_exchange"), none.alias("exchange"), none.alias("source"), none.alias("label"),
    ).unionByName(receivers.select(
        "case_id", F.lit(0).alias("hop"), F.lit("to").alias("side"), "ord", "address", "sats", "is_exchange",
        shown("exchange"), shown("source"), shown("label")))
    return Trace(hops, legs)


def full_trace(
    ledger: Ledger, cases: DataFrame, victims: DataFrame, attribution: DataFrame, max_hops: int | None = None,
    max_branches: int | None = None, spends: Spends | None = None,
) -> Trace:
    """T11 and T5 together: a recipient that is an exchange ends the chain when nothing follows."""
    spends = spends or spend_table(ledger)
    start = build_hop0(ledger, cases, victims, attribution, spends)
    rest = trace_cases(ledger, cases, attribution, max_hops, max_branches, spends)
    followed = rest.hops.select("case_id").distinct().withColumn("is_followed", F.lit(True))
    at_recipient = start.legs.where((F.col("side") == "to") & (F.col("ord") == 0) & F.col("is_exchange")).select(
        "case_id", F.lit(True).alias("is_deposit"))
    ends = F.when(F.col("is_deposit") & F.col("is_followed").isNull(), "exchange")
    first = start.hops.join(followed, "case_id", "left").join(at_recipient, "case_id", "left").select(
        *[ends.alias(c) if c == "chain_end_reason" else F.col(c) for c in start.hops.columns])
    return Trace(materialize(first.unionByName(rest.hops), "trace"),
                 materialize(start.legs.unionByName(rest.legs), "trace"))


# -- following stored links ----------------------------------------------------------------


def ledger_hops(
    ledger: Ledger, cases: DataFrame, max_hops: int | None = None, max_branches: int | None = None, spends: Spends | None = None
) -> Trace:
    """Breadth first over stored spend links until none is left.

    Where a caller gives them, ``max_branches`` bounds the spent outputs per transaction, and ``max_hops`` the records; these are
    counted per level, so the last level may pass it.
    """
    spends = spends or spend_table(ledger)
    level = cases.select("case_id", F.col("fraud_txid").alias("txid"), F.lit(1).cast("bigint").alias("pos"),
                         F.lit(0).cast("bigint").alias("used"))
    visited: DataFrame | None = None
    found, seen = _Pile("ledger-hops"), _Pile("ledger-seen")
    while True:
        level = materialize(level, "ledger-level")
        candidates = spends.of(level).where("flag IS NOT NULL").select(
            *level.columns, "vout_index", "address", "sats", F.col("flag").alias("to_txid"))
        if max_branches is not None:
            candidates = top_per(candidates, ["case_id", "txid", "pos", "used"], [F.col("vout_index")], max_branches)
        # A spender counts as visited when it was expanded before, or earlier (or just now) in this level.
        own = level.select("case_id", F.col("txid").alias("to_txid"), "pos")
        earlier = (own if visited is None else own.unionByName(visited.withColumn("pos", F.lit(0).cast("bigint")))).groupBy(
            "case_id", "to_txid").agg(F.min("pos").alias("seen_pos"))
        fresh = candidates.join(earlier, ["case_id", "to_txid"], "left").where(
            F.col("seen_pos").isNull() | (F.col("seen_pos") > F.col("pos"))).withColumn("slice", F.floor(F.col("pos") / HOPS_SLICE))
        records = materialize(ranked(fresh, ["case_id"], "slice", ["pos", "vout_index"], "place").select(
            "case_id", (F.col("used") + F.col("place")).alias("hop"), "txid", "to_txid", "address", "sats"), "ledger-hops")
        found.add(records, made_from=(records,))
        if records.isEmpty():
            break
        seen.add(level.select("case_id", F.col("txid").alias("to_txid")), made_from=(level,))
        visited = seen.whole()[0]
        nxt = records.groupBy("case_id", F.col("to_txid").alias("txid")).agg(F.min("hop").alias("pos"))
        totals = records.groupBy("case_id").agg(F.max("hop").alias("used"))
        if max_hops is not None:
            totals = totals.where(F.col("used") < max_hops)
        level = (
            nxt.join(totals, "case_id")
            .join(visited.select("case_id", F.col("to_txid").alias("txid")), ["case_id", "txid"], "left_anti")
            .select("case_id", "txid", "pos", "used")
        )
    return _ledger_trace(found.whole()[0], ledger, spends)


def _ledger_trace(records: DataFrame, ledger: Ledger, spends: Spends) -> Trace:
    records = materialize(records, "ledger-records")
    blocks = ledger.transactions.join(records.select("txid"), "txid", "left_semi").select("txid", "block_height", "first_seen")
    hops = records.join(blocks, "txid", "left").select(
        "case_id", "hop", F.concat(F.lit("Hop "), F.col("hop").cast("string"), F.lit(" - UTXO forwarding")).alias("label"),
        F.col("to_txid").alias("txid"), F.coalesce("block_height", F.lit(0)).alias("block"),
        F.coalesce(F.date_format(F.col("first_seen").cast("timestamp"), "yyyy-MM-dd HH:mm 'UTC'"), F.lit("—")).alias("timestamp"),
        F.lit("L1").alias("confidence"))
    sender = records.select("case_id", "hop", F.lit("from").alias("side"), F.lit(0).cast("bigint").alias("ord"), "address", "sats")
    # Receivers are ordered by amount, largest first: -sats, then output index.
    paid = materialize(records.select("case_id", "hop", F.col("to_txid").alias("txid")), "ledger-paid")
    receiver = spends.of(paid).where(F.col("address").isNotNull()).select(
        "case_id", "hop", F.lit("to").alias("side"), (-F.col("sats")).alias("ord"), "address", "sats")
    return Trace(hops, sender.unionByName(receiver))
