"""What a report says about a trace: endpoints, flow graph, paths, custody rows, digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.labels import compliance_contact, short_address, source_note
from ledgerspark.functions.money import btc_text, sats_to_btc
from ledgerspark.functions.rank import running_min
from ledgerspark.operators.trace import HOPS_SLICE, Trace
from ledgerspark.session import discard, materialize

DEFAULT_SOURCE = "walletexplorer"
ENDPOINT_CONFIDENCE = "L2"
EXPLORER_URL = "https://blockstream.info/tx/"
DIGEST_SLICE = 1024

# Our own sentence, with the amount and the number of addresses between its parts.
FREEZE_TEXTS = ("", " BTC reached this exchange at ", " address(es) of the case.")

# Node kinds by priority, lowest first.
KINDS = ["address", "recipient", "victim", "exchange"]

# Title and text by the reason a chain ended.
END_TEXTS = {
    "exchange": (
        "CHAIN END - Exchange identified",
        "The stolen funds were deposited to a cryptocurrency exchange. The L1 evidentiary chain ends at this point. "
        "A formal freeze request has been prepared for this exchange."),
    "pooling": (
        "CHAIN END - Pooling / consolidation detected",
        "The stolen funds were combined with third-party funds. A mathematically unique attribution (L1) is no longer "
        "possible beyond this point. The evidentiary chain ends here under forensic standards."),
    "unspent": (
        "CHAIN END - UTXO unspent",
        "The stolen funds remain unspent at this address as of the time of analysis. The trace therefore ends here "
        "naturally. A direct preservation or freeze request is recommended."),
    "lookup_incomplete": (
        "CHAIN END - Forwarding path not fully resolved",
        "The funds were not classified as unspent. Instead, spend resolution was incomplete with the current "
        "infrastructure, so the next hop could not be determined to an evidentiary standard. The report is incomplete "
        "at this point and must not be read as a final endpoint assessment."),
}


def side(legs: DataFrame, name: str) -> DataFrame:
    return legs.where(F.col("side") == name)


def exchange_endpoints(trace: Trace) -> DataFrame:
    """Per exchange address of a case the first hop that reaches it."""
    named = trace.hops.where(F.coalesce("exchange", F.lit("")) != "").select(
        "case_id", "hop", F.col("exchange").alias("name"), F.coalesce("exchange_source", F.lit(DEFAULT_SOURCE)).alias("source"))
    paid = side(trace.legs, "to").select("case_id", "hop", "ord", "address", "sats", F.col("exchange").alias("of"))
    # The first receiver that belongs to the exchange, else the first receiver.
    is_other = F.coalesce(F.col("of") != F.col("name"), F.lit(True))
    chosen = named.join(paid, ["case_id", "hop"]).groupBy("case_id", "hop", "name", "source").agg(
        F.min(F.struct(is_other.alias("o"), "ord", "address", "sats")).alias("to"))
    first = chosen.groupBy("case_id", F.col("to.address").alias("address")).agg(
        F.min(F.struct("hop", "name", "source", F.col("to.sats").alias("sats"))).alias("e"))
    return first.select(
        "case_id", "e.hop", "e.name", "address", "e.sats", "e.source", F.lit(ENDPOINT_CONFIDENCE).alias("confidence"),
        compliance_contact(F.col("e.name")).alias("compliance_email"), source_note(F.col("e.source")).alias("note"))


def freeze_groups(endpoints: DataFrame) -> DataFrame:
    """One request per case and exchange; its addresses are the endpoints of that name."""
    order = F.struct("hop", "address")
    grouped = endpoints.groupBy("case_id", "name").agg(
        F.sum("sats").alias("total_sats"), F.count(F.lit(1)).alias("address_count"),
        F.min_by("address", order).alias("first_address"), F.min_by("compliance_email", order).alias("compliance_email"),
        F.min_by("source", order).alias("source"))
    note = F.concat(
        F.lit(FREEZE_TEXTS[0]), btc_text(sats_to_btc(F.col("total_sats"))), F.lit(FREEZE_TEXTS[1]), F.col("address_count").cast("string"),
        F.lit(FREEZE_TEXTS[2]))
    return grouped.withColumn("note", note).withColumn("confidence", F.lit(ENDPOINT_CONFIDENCE))


# -- flow graph ----------------------------------------------------------------------------


def hop_columns(trace: Trace, victims: DataFrame) -> DataFrame:
    """Column of the senders of every hop, as (case_id, hop, from_column).

    A victim sends from column 0. Any other sender stands one column after the least of the hops before that paid it, or where it
    stood when it sent before, whatever is less; a sender that no hop before knows stands at its hop's number. That is a least sum over
    hops, found level by level: a round takes the hops whose column fell, offers it to the later hops of the addresses that they
    pay or send from, and keeps what is less. The rounds end when nothing falls, after as many as the longest chain has hops.
    """
    key = ["case_id", "address"]
    slice_ = F.floor(F.col("hop") / HOPS_SLICE)
    owners = victims.select(*key).distinct().withColumn("is_victim", F.lit(True))
    sender = materialize(side(trace.legs, "from").where(F.col("hop") > 0).select("case_id", "hop", "address").distinct().join(
        owners, key, "left").withColumn("is_victim", F.coalesce("is_victim", F.lit(False))), "senders")
    paid = materialize(side(trace.legs, "to").select("case_id", "address", "hop").distinct(), "paid")
    first = paid.unionByName(sender.select("case_id", "address", "hop")).groupBy(*key).agg(F.min("hop").alias("first"))
    start = sender.join(first, key, "left").groupBy("case_id", "hop").agg(F.min(
        F.when(F.col("is_victim"), F.lit(0)).when(F.col("first") >= F.col("hop"), F.col("hop"))).alias("from_column"))
    zero = trace.hops.where(F.col("hop") == 0).select("case_id", "hop", F.lit(0).alias("from_column"))
    state = materialize(start.unionByName(zero), "columns")
    changed = state.where("from_column IS NOT NULL")
    while True:
        offers = changed.join(paid, ["case_id", "hop"]).select(*key, "hop", (F.col("from_column") + 1).alias("offer")).unionByName(
            changed.join(sender, ["case_id", "hop"]).select(*key, "hop", F.col("from_column").alias("offer")))
        offers = materialize(offers.groupBy(*key, "hop").agg(F.min("offer").alias("offer")), "offers")
        takers = sender.join(offers.select(*key).distinct(), key, "left_semi").select(*key, "hop")
        # An offer holds for later hops, so at the same hop the taker comes first.
        events = takers.withColumns({"offer": F.lit(None).cast("int"), "turn": F.lit(0)}).unionByName(offers.withColumn("turn", F.lit(1)))
        best = running_min(events.withColumn("slice", slice_), key, "slice", ["hop", "turn"], "offer", "best").where(
            "turn = 0 AND best IS NOT NULL").groupBy("case_id", "hop").agg(F.min("best").alias("best"))
        falls = F.col("best").isNotNull() & (F.col("from_column").isNull() | (F.col("best") < F.col("from_column")))
        after = materialize(state.join(best, ["case_id", "hop"], "left").select(
            "case_id", "hop", F.when(falls, F.col("best")).otherwise(F.col("from_column")).alias("from_column"), falls.alias("falls")), "columns")
        discard(offers, state)
        changed = after.where("falls").drop("falls")
        state = after.drop("falls")
        state._written_to = after._written_to
        if changed.isEmpty():
            break
    return state


def _appearances(trace: Trace, cases: DataFrame, victims: DataFrame, columns: DataFrame) -> DataFrame:
    """Every time an address enters the graph of a case."""
    rank = {kind: n for n, kind in enumerate(KINDS)}
    level = lambda kind: F.lit(rank[kind])
    none = F.lit(None)
    shell = dict(at=F.struct(F.lit(-1).alias("hop"), F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("ord")),
                 sats_in=none.cast("bigint"), sats_out=none.cast("bigint"), exchange=none.cast("string"),
                 is_sanctioned=F.lit(False), is_change=F.lit(False), reason=none.cast("string"))
    fill = lambda df, column, kind: df.select(
        "case_id", "address", F.lit(column).alias("column"), level(kind).alias("kind"), *[c.alias(n) for n, c in shell.items()])
    owners = victims.select("case_id", "address").distinct()
    recipients = cases.select("case_id", F.col("recipient").alias("address"))

    hop = trace.hops.select("case_id", "hop", F.col("exchange").alias("hop_exchange"), "is_sanctioned", "chain_end_reason")
    legs = trace.legs.join(hop, ["case_id", "hop"]).join(columns, ["case_id", "hop"]).join(
        owners.withColumn("is_victim", F.lit(True)), ["case_id", "address"], "left").join(
        recipients.withColumn("is_recipient", F.lit(True)), ["case_id", "address"], "left")
    hits = side(trace.legs, "to").where("is_exchange").select("case_id", "hop", "address").distinct().withColumn("is_hit", F.lit(True))
    senders = side(trace.legs, "from").select("case_id", "hop", "address").distinct().withColumn("is_sender", F.lit(True))
    legs = legs.join(hits, ["case_id", "hop", "address"], "left").join(senders, ["case_id", "hop", "address"], "left")
    is_from, is_hit = F.col("side") == "from", F.coalesce("is_hit", F.lit(False))
    kind = (
        F.when(is_hit, level("exchange")).when(is_from & F.col("is_victim"), level("victim"))
        .when((is_from | (F.col("hop") == 0)) & F.col("is_recipient"), level("recipient")).otherwise(level("address"))
    )
    amount = F.coalesce("sats", F.lit(0))
    entered = legs.select(
        "case_id", "address", (F.col("from_column") + (~is_from).cast("int")).alias("column"), kind.alias("kind"),
        F.struct("hop", (~is_from).cast("int").alias("side"), "ord").alias("at"),
        F.when(~is_from, amount).alias("sats_in"), F.when(is_from, amount).alias("sats_out"),
        F.when(is_hit & (F.col("hop_exchange") != ""), F.col("hop_exchange")).alias("exchange"), "is_sanctioned",
        (~is_from & F.coalesce("is_sender", F.lit(False))).alias("is_change"),
        F.when(~is_from, F.col("chain_end_reason")).alias("reason"))
    return fill(owners, 0, "victim").unionByName(fill(recipients, 1, "recipient")).unionByName(entered)


def flow_nodes(trace: Trace, cases: DataFrame, victims: DataFrame, columns: DataFrame) -> DataFrame:
    """One node per address of a case."""
    at = F.col("at")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at))
    nodes = _appearances(trace, cases, victims, columns).groupBy("case_id", "address").agg(
        F.min("column").alias("column"), F.max("kind").alias("kind"), F.coalesce(first("exchange"), F.lit("")).alias("exchange"),
        F.bool_or("is_sanctioned").alias("is_sanctioned"),
        F.coalesce(F.sum("sats_in"), F.lit(0)).alias("total_in_sats"), F.coalesce(F.sum("sats_out"), F.lit(0)).alias("total_out_sats"),
        F.coalesce(first("sats_in"), F.lit(0)).alias("display_in_sats"),
        F.coalesce(first("sats_out"), F.lit(0)).alias("display_out_sats"),
        F.bool_or("is_change").alias("has_change_output"), F.coalesce(first("reason"), F.lit("")).alias("chain_end_reason"))
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    short = short_address(F.col("address"))
    label = (
        F.when(kind == "victim", "Victim").when(kind == "recipient", "Recipient")
        .when(kind == "exchange", F.coalesce(F.nullif("exchange", F.lit("")), F.lit("Exchange"))).otherwise(short)
    )
    return nodes.withColumn("display_label", label).withColumn("short_address", short).withColumn("kind", kind)


def _sides(trace: Trace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Senders, receivers that are no change, and how many of each a hop has."""
    senders = side(trace.legs, "from").select("case_id", "hop", F.col("address").alias("from_address"),
                                              F.col("ord").alias("from_ord"), F.coalesce("sats", F.lit(0)).alias("from_sats"))
    own = senders.select("case_id", "hop", F.col("from_address").alias("address")).distinct()
    targets = side(trace.legs, "to").join(own, ["case_id", "hop", "address"], "left_anti").select(
        "case_id", "hop", F.col("address").alias("to_address"), F.col("ord").alias("to_ord"),
        F.coalesce("sats", F.lit(0)).alias("to_sats"), F.col("is_exchange").alias("is_exchange_edge"))
    n = lambda df, name: df.groupBy("case_id", "hop").agg(F.count(F.lit(1)).alias(name))
    counts = n(senders, "sources").join(n(targets, "targets"), ["case_id", "hop"])
    return senders, targets, counts


def flow_edges(trace: Trace) -> DataFrame:
    """Who paid whom, with the amount that can be told.

    One sender: the output amount. Many senders, one receiver: the input. Many of both: no
    amount can be told for a pair, so the transaction keeps one row per sender (no
    receiver) and one per receiver (no sender) instead of every pair.
    """
    senders, targets, counts = _sides(trace)
    key = ["case_id", "hop"]
    one_sender = counts.where("sources = 1").select(*key)
    one_target = counts.where("sources > 1 AND targets = 1").select(*key)
    many = counts.where("sources > 1 AND targets > 1").select(*key)
    columns = [*key, "from_address", "to_address", "sats", "amount_context", "ord", "is_exchange_edge"]
    single = targets.join(one_sender, key, "left_semi").join(senders, key).withColumn("sats", F.col("to_sats")).withColumn(
        "amount_context", F.lit("output_amount")).withColumn("ord", F.col("to_ord"))
    contribution = senders.join(one_target, key, "left_semi").join(targets, key).withColumn(
        "sats", F.col("from_sats")).withColumn("amount_context", F.lit("input_contribution")).withColumn("ord", F.col("from_ord"))
    half = lambda df, missing: df.join(many, key, "left_semi").withColumn(missing, F.lit(None).cast("string")).withColumn(
        "sats", F.lit(None).cast("bigint")).withColumn("amount_context", F.lit("aggregate_transaction"))
    out = half(senders, "to_address").withColumn("ord", F.col("from_ord")).withColumn("is_exchange_edge", F.lit(False))
    into = half(targets, "from_address").withColumn("ord", F.col("to_ord"))
    edges = single.select(*columns)
    for part in (contribution, out, into):
        edges = edges.unionByName(part.select(*columns))
    details = trace.hops.select(*key, "txid", "confidence", "label", "chain_end_reason", "is_sanctioned")
    return edges.join(details, key)


def flow_stats(nodes: DataFrame, trace: Trace, columns: DataFrame) -> DataFrame:
    """Sizes of the graph; every pair of sender and receiver counts as one edge."""
    _senders, _targets, counts = _sides(trace)
    edges = counts.groupBy("case_id").agg(F.sum(F.col("sources") * F.col("targets")).alias("edge_count"))
    per_case = nodes.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("kind") == "exchange").alias("exchange_count"))
    widest = columns.groupBy("case_id").agg((F.max("from_column") + 1).alias("max_column"))
    return per_case.join(edges, "case_id", "left").join(widest, "case_id", "left").select(
        "case_id", "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "exchange_count",
        F.coalesce("max_column", F.lit(1)).alias("max_column"))


def flow_lanes(stats: DataFrame) -> DataFrame:
    """One lane per column."""
    return stats.select("case_id", F.explode(F.sequence(F.lit(0), F.col("max_column"))).alias("column")).withColumn(
        "label", F.when(F.col("column") == 0, "Victim").otherwise(F.concat(F.lit("Hop "), (F.col("column") - 1).cast("string"))))


def collapse_victims(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, edges) of cases with two or more victims, drawn as one node.

    A receiver of several senders at once (no sender given) belongs to the victims at hop 0.
    """
    victim = F.col("kind") == "victim"
    many = nodes.where(victim).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("member_count"), F.bool_or("is_sanctioned").alias("is_sanctioned")).where("member_count > 1")
    drawn = edges.join(many.select("case_id"), "case_id", "left_semi")
    own = nodes.where(victim).select("case_id", F.col("address").alias("from_address"), F.lit(True).alias("is_own"))
    marked = drawn.join(own, ["case_id", "from_address"], "left")
    is_own = F.coalesce("is_own", F.lit(False)) | (F.col("from_address").isNull() & (F.col("hop") == 0))
    shown = nodes.select("case_id", F.col("address").alias("to_address"), F.coalesce(
        F.nullif("display_in_sats", F.lit(0).cast("bigint")), F.col("total_in_sats")).alias("sats"))
    joined = marked.where(is_own & F.col("to_address").isNotNull()).select("case_id", "to_address").distinct().join(
        shown, ["case_id", "to_address"]).select(
        "case_id", F.lit("__victim_input_cluster__").alias("from_address"), "to_address", "sats")
    kept = marked.where(~is_own).select("case_id", "from_address", "to_address", "sats")
    totals = joined.groupBy("case_id").agg(F.sum("sats").alias("total_out_sats"))
    clusters = many.join(totals, "case_id", "left").select(
        "case_id", "member_count", "is_sanctioned", F.coalesce("total_out_sats", F.lit(0)).alias("total_out_sats"))
    return clusters, joined.unionByName(kept)


# -- paths back from endpoints -------------------------------------------------------------


def _producers(trace: Trace) -> DataFrame:
    """Per address of a case the last hop that pays it other than as change, with the amount."""
    own = side(trace.legs, "from").select("case_id", "hop", "address").distinct()
    paid = side(trace.legs, "to").join(own, ["case_id", "hop", "address"], "left_anti")
    return paid.groupBy("case_id", "address").agg(
        F.max(F.struct("hop", "ord", F.coalesce("sats", F.lit(0)).alias("sats"))).alias("p")).select(
        "case_id", "address", F.col("p.hop").alias("hop"), F.col("p.sats").alias("sats"))


def _links(trace: Trace, victims: DataFrame) -> DataFrame:
    """Per hop its first sender, how many senders and victims it has, and the hop that paid that sender, if any."""
    owners = victims.select("case_id", "address").distinct().withColumn("is_victim", F.lit(True))
    one = side(trace.legs, "from").join(owners, ["case_id", "address"], "left").groupBy("case_id", "hop").agg(
        F.count(F.lit(1)).alias("senders"), F.count_if("is_victim").alias("victims"),
        F.min(F.struct("ord", "address", F.coalesce("sats", F.lit(0)).alias("sats"))).alias("s"))
    return one.select("case_id", "hop", "senders", "victims", F.col("s.address").alias("sender"), F.col("s.sats").alias("sender_sats"))


def _walk_back(endpoints: DataFrame, trace: Trace, victims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, links): per endpoint the hops that lead to it, ``pos`` counted from 0 at the endpoint, and the hop's links.

    Each address of a case leads back to the only sender of the last hop that paid it, if a hop paid that one too. List ranking by
    pointer doubling: jumps of 1, 2, 4, ... steps are squared until none is left, then every endpoint takes the jumps from
    the longest down, each beside the places it already has, so each place is reached once. An endpoint whose way runs in a circle
    stops before the first address that it meets again; no way has more steps than its case has addresses.
    """
    links = materialize(_links(trace, victims), "links")
    producers = materialize(_producers(trace), "producers")
    lone = links.where("senders = 1").select("case_id", "hop", F.col("sender").alias("next"))
    jump = materialize(
        producers.select("case_id", "address", "hop").join(lone, ["case_id", "hop"]).join(
            producers.select("case_id", F.col("address").alias("next")), ["case_id", "next"], "left_semi")
        .where("address <> next").select("case_id", "address", "next"), "jump")
    size = producers.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    most = size.agg(F.max("n")).first()[0] or 0
    jumps, length = [], 1
    while length < most and not jump.isEmpty():
        jumps.append(jump)
        jump = materialize(jump.join(
            jump.select("case_id", F.col("address").alias("next"), F.col("next").alias("beyond")), ["case_id", "next"]).select(
            "case_id", "address", F.col("beyond").alias("next")), "jump")
        length *= 2
    discard(jump)
    places = endpoints.select("case_id", "name", F.col("address").alias("endpoint"), "address", F.lit(0).alias("pos")).join(
        producers.select("case_id", "address"), ["case_id", "address"], "left_semi").join(size, "case_id")
    places = materialize(places, "places")
    for k in range(len(jumps) - 1, -1, -1):
        further = places.join(jumps[k], ["case_id", "address"]).withColumn("pos", F.col("pos") + F.lit(1 << k)).where("pos < n").select(
            "case_id", "name", "endpoint", F.col("next").alias("address"), "pos", "n")
        grown = materialize(places.unionByName(further), "places")
        discard(places)
        places = grown
    discard(*jumps)
    # In a circle an address comes again; the way ends where the first one does.
    once = places.groupBy("case_id", "name", "endpoint", "address").agg(F.min("pos").alias("pos"))
    length_of = once.groupBy("case_id", "endpoint").agg(F.count(F.lit(1)).cast("int").alias("length"))
    steps = once.join(length_of, ["case_id", "endpoint"]).where("pos < length").join(producers, ["case_id", "address"])
    return materialize(steps.select("case_id", "endpoint", "name", "pos", "length", "hop", "address", "sats"), "ways"), links


def freeze_paths(endpoints: DataFrame, trace: Trace, cases: DataFrame, victims: DataFrame) -> DataFrame:
    """Nodes from the origin to each endpoint, numbered from 1."""
    steps, links = _walk_back(endpoints, trace, victims)
    # Before the first step: the victims together, or a sender that no hop paid.
    origin = steps.where(F.col("pos") == F.col("length") - 1).join(links, ["case_id", "hop"])
    met = steps.select("case_id", "endpoint", F.col("address").alias("sender"), F.lit(True).alias("is_met"))
    origin = origin.join(met, ["case_id", "endpoint", "sender"], "left")
    inputs = (F.col("senders") > 1) & (F.col("victims") > 0)
    head = origin.where(inputs | ((F.col("senders") == 1) & F.col("is_met").isNull())).select(
        "case_id", "endpoint", F.when(inputs, "inputs").otherwise("node").alias("role"), F.when(~inputs, F.col("sender")).alias("node"),
        F.when(inputs, F.col("sats")).otherwise(F.col("sender_sats")).alias("sats"),
        F.when(inputs, F.col("victims")).otherwise(F.lit(1)).alias("members"), "name", F.lit(1).alias("position"))
    begun = head.select("case_id", "endpoint", F.lit(1).alias("extra"))
    rest = steps.join(begun, ["case_id", "endpoint"], "left").select(
        "case_id", "endpoint", F.lit("node").alias("role"), F.col("address").alias("node"), "sats", F.lit(1).cast("bigint").alias("members"), "name",
        (F.col("length") - F.col("pos") + F.coalesce("extra", F.lit(0))).alias("position"))
    owners = victims.select("case_id", F.col("address").alias("node"), F.lit(True).alias("is_victim")).distinct()
    flat = head.unionByName(rest).join(cases.select("case_id", "recipient"), "case_id").join(owners, ["case_id", "node"], "left")
    kind = (
        F.when(F.col("role") == "inputs", "victim").when(F.col("node") == F.col("endpoint"), "exchange")
        .when(F.col("node") == F.col("recipient"), "recipient").when(F.col("is_victim"), "victim").otherwise("address")
    )
    title = (
        F.when(kind == "exchange", F.col("name")).when(kind == "recipient", "Recipient")
        .when(kind == "victim", "Victim inputs").otherwise("Traced address")
    )
    subtitle = F.when(F.col("role") == "inputs", F.concat(F.col("members").cast("string"), F.lit(" addresses"))).otherwise(
        short_address(F.col("node"), 12, 8))
    return flat.select("case_id", "endpoint", "position", kind.alias("kind"), title.alias("title"),
                       subtitle.alias("subtitle"), "sats")


def branch_traces(endpoints: DataFrame, trace: Trace, victims: DataFrame) -> DataFrame:
    """The transactions from the origin to each endpoint with the receiver on the path.

    The senders of a step are the ``from`` legs of its hop, only victims where
    ``victim_senders`` is set.
    """
    steps, links = _walk_back(endpoints, trace, victims)
    details = trace.hops.select("case_id", "hop", "label", "txid", "block", "timestamp")
    return steps.join(links.select("case_id", "hop", "senders", "victims"), ["case_id", "hop"], "left").select(
        "case_id", "endpoint", (F.col("length") - F.col("pos")).alias("step"), "hop", F.col("address").alias("to_address"),
        F.col("sats").alias("to_sats"), F.coalesce("senders", F.lit(0)).alias("senders"),
        F.coalesce((F.col("senders") > 1) & (F.col("victims") > 0), F.lit(False)).alias("victim_senders"),
    ).join(details, ["case_id", "hop"])


# -- documents -----------------------------------------------------------------------------


def chain_of_custody(trace: Trace) -> DataFrame:
    """One evidence row per hop; its senders and receivers are in :func:`custody_legs`."""
    reason = F.col("chain_end_reason")
    text = lambda n: F.coalesce(*[F.when(reason == key, texts[n]) for key, texts in END_TEXTS.items()])
    return trace.hops.select(
        "case_id", "hop", F.concat(F.lit("Hop "), F.col("hop").cast("string"), F.lit(" - "), "label").alias("title"),
        F.concat("confidence", F.lit(" — "), "confidence_label").alias("confidence"), "txid", "block", "timestamp",
        "method", F.col("notes").alias("note"), "exchange",
        F.when(F.length("txid") == 64, F.concat(F.lit(f"Verification: {EXPLORER_URL}"), "txid")).alias("verification"),
        text(0).alias("end_title"), text(1).alias("end_text"))


def custody_legs(trace: Trace) -> DataFrame:
    """The From and To lines."""
    amount = F.when(F.coalesce("sats", F.lit(0)) > 0, F.concat(btc_text(sats_to_btc(F.col("sats"))), F.lit(" BTC"))).otherwise("—")
    return trace.legs.select("case_id", "hop", F.initcap("side").alias("line"), "ord", "address", amount.alias("amount"))


def report_digest(trace: Trace, cases: DataFrame) -> DataFrame:
    """SHA-256 of each case and its trace.

    Legs are hashed in slices of their order, so a transaction with very many outputs is
    hashed by many tasks; slices, hops and the case are then hashed in order.
    """
    leg = F.to_json(F.struct("ord", "address", "sats", "is_exchange"))
    slices = trace.legs.groupBy("case_id", "hop", "side", F.floor(F.col("ord") / DIGEST_SLICE).alias("slice")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "address", leg.alias("j"))))["j"], "\n"), 256).alias("h"))
    legs = slices.groupBy("case_id", "hop").agg(F.sha2(F.array_join(
        F.array_sort(F.collect_list(F.struct("side", "slice", "h")))["h"], "\n"), 256).alias("legs"))
    row = F.to_json(F.struct(*sorted(c for c in trace.hops.columns if c != "case_id"), "legs"))
    hops = trace.hops.join(legs, ["case_id", "hop"], "left").select("case_id", "hop", F.sha2(row, 256).alias("h"))
    body = hops.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("hop", "h")))["h"], "\n").alias("hops"))
    case = F.to_json(F.struct(*sorted(cases.columns)))
    return cases.join(body, "case_id", "left").select("case_id", F.sha2(F.concat_ws("\n", "hops", case), 256).alias("report_hash"))


def case_summary(trace: Trace, endpoints: DataFrame, amounts: DataFrame) -> DataFrame:
    """Per case how many hops, endpoints, sanctioned hops and freeze requests, the amount, and the names of the exchanges.

    The names are those of known services, so their list is short whatever the case.
    """
    hops = trace.hops.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("hops_found"), F.count_if("is_sanctioned").alias("sanctioned_addresses"))
    ends = endpoints.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("exchanges_identified"), F.count_distinct("name").alias("freeze_requests_generated"),
        F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("exchanges"))
    zero = F.lit(0).cast("bigint")
    return hops.join(amounts, "case_id").join(ends, "case_id", "left").select(
        "case_id", "hops_found", "sanctioned_addresses", F.coalesce("exchanges_identified", zero).alias("exchanges_identified"),
        F.coalesce("freeze_requests_generated", zero).alias("freeze_requests_generated"),
        btc_text(sats_to_btc(F.col("stolen_sats"))).alias("actual_amount_btc"), F.coalesce("exchanges", F.lit("")).alias("exchanges"))


def investigation_addresses(trace: Trace, cases: DataFrame) -> DataFrame:
    """The addresses of a trace in their roles, as cross-case matching reads them."""
    levels = trace.hops.select("case_id", "hop", "confidence", "block")
    paid = side(trace.legs, "to").join(levels, ["case_id", "hop"]).join(cases.select("case_id", "recipient"), "case_id")
    is_origin = (F.col("hop") == 0) & (F.col("address") == F.col("recipient"))
    role = F.when(F.col("is_exchange"), "EXCHANGE_DEPOSIT").when(is_origin, "FRAUD_ORIGIN").otherwise("HOP")
    return paid.select(
        "case_id", "address", role.alias("address_role"), F.col("hop").alias("hop_index"),
        F.col("confidence").alias("confidence_level"), sats_to_btc(F.col("sats")).cast("decimal(20,8)").alias("amount_btc"),
        F.col("block").alias("block_height"))
