"""Case dashboards, actors that recur across cases, and table rules.

Lists that can grow without bound (the cases behind a shared value, the values of a
profile) stay rows; the summary rows carry their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Admissible values per column.
CASE_STATUSES = ["OPEN", "PENDING", "RESOLVED", "CLOSED", "ARCHIVED"]
ACTION_STATUSES = ["DONE", "PENDING", "FAILED", "CANCELLED"]
ACTION_TYPES = [
    "SYSTEM_REPORT_GENERATED", "SYSTEM_FREEZE_REQUEST_CREATED", "SYSTEM_INVESTIGATION_RUN",
    "USER_POLICE_REPORT_FILED", "USER_FREEZE_REQUEST_SENT", "USER_LAWYER_CONTACTED", "USER_EXCHANGE_CONTACTED",
    "USER_BAFIN_CONTACTED", "USER_COURT_FILING", "USER_MEDIA_CONTACTED",
    "RESPONSE_POLICE", "RESPONSE_EXCHANGE", "RESPONSE_LAWYER", "RESPONSE_COURT", "RESPONSE_BAFIN",
    "STATUS_CHANGE", "NOTE",
]
DOCUMENT_TYPES = ["FORENSIC_REPORT", "FREEZE_REQUEST", "POLICE_RECEIPT", "EXCHANGE_RESPONSE", "LEGAL_DOCUMENT",
                  "EVIDENCE", "OTHER"]
CONTACT_TYPES = ["POLICE", "EXCHANGE", "LAWYER", "BAFIN", "COURT", "MEDIATOR", "OTHER"]
PROFILE_STATUSES = ["ACTIVE", "ARRESTED", "RESOLVED", "SUSPECTED"]

ENUMS = {
    "user_cases": {"status": CASE_STATUSES},
    "case_actions": {"action_type": ACTION_TYPES, "status": ACTION_STATUSES},
    "case_documents": {"doc_type": DOCUMENT_TYPES},
    "case_contacts": {"contact_type": CONTACT_TYPES},
    "serial_actor_profiles": {"status": PROFILE_STATUSES},
}
RANGES = {
    "address_entity_links": {"confidence": (0, 1)},
    "serial_actor_profiles": {"risk_score": (0, 100)},
}

DEFAULT_LEVEL = "L3"


def case_dashboard(cases: DataFrame, actions: DataFrame, documents: DataFrame, as_of: str) -> DataFrame:
    """Each case with its last action, open actions, documents and days since its update."""
    latest = F.struct("action_date", "created_at", "action_id", "title")
    acted = actions.groupBy("case_id").agg(
        F.max(latest).alias("last"), F.count_if(F.col("status") == "PENDING").alias("pending_actions"))
    filed = documents.groupBy("case_id").agg(F.count(F.lit(1)).alias("document_count"))
    days = F.timestamp_diff("DAY", F.col("updated_at").cast("timestamp"), F.lit(as_of).cast("timestamp"))
    none = F.lit(0).cast("bigint")
    return cases.join(acted, "case_id", "left").join(filed, "case_id", "left").select(
        *cases.columns, F.col("last.title").alias("last_action_title"),
        F.col("last.action_date").alias("last_action_date"),
        F.coalesce("pending_actions", none).alias("pending_actions"),
        F.coalesce("document_count", none).alias("document_count"), days.cast("int").alias("days_since_update"))


def case_flags(cases: DataFrame, actions: DataFrame) -> DataFrame:
    """Which steps a case has behind it."""
    kind, done = F.col("action_type"), F.col("status") == "DONE"
    flags = {
        "report_generated": kind == "SYSTEM_REPORT_GENERATED",
        "freeze_request_sent": kind.isin("SYSTEM_FREEZE_REQUEST_CREATED", "USER_FREEZE_REQUEST_SENT") & done,
        "police_report_filed": (kind == "USER_POLICE_REPORT_FILED") & done,
        "lawyer_engaged": (kind == "USER_LAWYER_CONTACTED") & done,
        "exchange_responded": (kind == "RESPONSE_EXCHANGE") & F.col("status").isin("DONE", "PENDING"),
    }
    rolled = actions.groupBy("case_id").agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
    return cases.select("case_id").join(rolled, "case_id", "left").select(
        "case_id", *[F.coalesce(n, F.lit(False)).alias(n) for n in flags])


def case_timeline(actions: DataFrame) -> DataFrame:
    """Actions by case, newest first: a range-partitioned sort, so a busy case may span tasks."""
    return actions.orderBy("case_id", F.col("action_date").desc(), F.col("created_at").desc(), "action_id")


def shared_addresses(investigations: DataFrame, exclude_exchange_deposits: bool = False) -> DataFrame:
    """Members of C4: (address, case_id) of every address seen in two or more cases."""
    rows = investigations
    if exclude_exchange_deposits:
        rows = rows.where(F.col("address_role") != "EXCHANGE_DEPOSIT")
    pairs = rows.select("address", "case_id").distinct()
    shared = pairs.groupBy("address").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return pairs.join(shared, "address").select("address", "case_id", "n")


def actor_matches_same_address(investigations: DataFrame, exclude_exchange_deposits: bool = False) -> DataFrame:
    """C4: per case, address and level, in how many other cases the address occurs.

    The other cases are the rows of :func:`shared_addresses` for that address less the
    case itself. They are counted, not paired: an address in a third of all cases would
    otherwise list itself quadratically.
    """
    members = shared_addresses(investigations, exclude_exchange_deposits).select(
        "address", "case_id", (F.col("n") - 1).alias("matching_case_count"))
    return (
        investigations.select("case_id", "address", F.coalesce("confidence_level", F.lit(DEFAULT_LEVEL)).alias("confidence_level"))
        .distinct().join(members, ["address", "case_id"])
        .select("case_id", F.lit("SAME_ADDRESS").alias("match_type"), F.col("address").alias("shared_value"),
                "matching_case_count", "confidence_level")
    )


def _evidence(investigations: DataFrame, membership: DataFrame, exclude_exchange_deposits: bool) -> DataFrame:
    """Investigation rows under each value they can share."""
    is_deposit = F.col("address_role") == "EXCHANGE_DEPOSIT"
    base = ["case_id", "amount_btc", "seen_at", "confidence_level"]
    actor = investigations.where(~is_deposit) if exclude_exchange_deposits else investigations
    by_address = actor.select(F.lit("SAME_ADDRESS").alias("match_type"), F.col("address").alias("shared_value"), *base)
    by_cluster = actor.join(membership, "address").select(
        F.lit("SAME_CIO_CLUSTER").alias("match_type"), F.col("cluster_id").alias("shared_value"), *base)
    by_deposit = investigations.where(is_deposit).select(
        F.lit("SAME_EXCHANGE_DEPOSIT").alias("match_type"), F.col("address").alias("shared_value"), *base)
    return by_address.unionByName(by_cluster).unionByName(by_deposit)


def actor_matches(
    investigations: DataFrame, membership: DataFrame, exclude_exchange_deposits: bool = True
) -> DataFrame:
    """Values shared by two or more cases with totals and first and last sighting."""
    rows = _evidence(investigations, membership, exclude_exchange_deposits)
    return (
        rows.groupBy("match_type", "shared_value", "case_id")
        .agg(F.sum("amount_btc").alias("amount_btc"), F.min("seen_at").alias("first_seen"),
             F.max("seen_at").alias("last_seen"), F.min("confidence_level").alias("confidence_level"))
        .groupBy("match_type", "shared_value")
        .agg(F.count(F.lit(1)).alias("case_count"), F.sum("amount_btc").alias("total_btc_involved"),
             F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
             F.coalesce(F.min("confidence_level"), F.lit(DEFAULT_LEVEL)).alias("confidence_level"))
        .where(F.col("case_count") > 1)
    )


def actor_match_members(
    investigations: DataFrame, membership: DataFrame, exclude_exchange_deposits: bool = True
) -> DataFrame:
    """Members of C6: (match_type, shared_value, case_id)."""
    rows = _evidence(investigations, membership, exclude_exchange_deposits).select(
        "match_type", "shared_value", "case_id").distinct()
    shared = rows.groupBy("match_type", "shared_value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return rows.join(shared, ["match_type", "shared_value"], "left_semi")


def actor_profile_refresh(matches: DataFrame, members: DataFrame) -> DataFrame:
    """Totals per profile over its matches; equal amounts count once, as SUM(DISTINCT) does.

    The known values of a profile are the rows of ``matches`` with its id.
    """
    key = ["match_type", "shared_value"]
    cases = members.join(matches.select(*key, "profile_id"), key).select("profile_id", "case_id").distinct()
    case_counts = cases.groupBy("profile_id").agg(F.count(F.lit(1)).alias("total_cases"))
    amounts = matches.select("profile_id", "total_btc_involved").distinct().groupBy("profile_id").agg(
        F.sum("total_btc_involved").alias("total_btc_stolen"))
    values = lambda t: F.count_if(F.col("match_type") == t)
    seen = matches.groupBy("profile_id").agg(
        F.min("first_seen").alias("first_case_date"), F.max("last_seen").alias("last_case_date"),
        values("SAME_ADDRESS").alias("known_address_count"),
        values("SAME_CIO_CLUSTER").alias("known_cluster_count"),
        values("SAME_EXCHANGE_DEPOSIT").alias("known_exchange_count"), F.count(F.lit(1)).alias("match_count"))
    btc = F.coalesce("total_btc_stolen", F.lit(0))
    bonus = F.when(btc > 100, 20).when(btc > 10, 10).otherwise(0)
    return case_counts.join(amounts, "profile_id").join(seen, "profile_id").withColumn(
        "risk_score", F.least(F.lit(100).cast("bigint"), F.col("total_cases") * 10 + bonus).cast("int"))


def actor_overview(profiles: DataFrame, as_of: str) -> DataFrame:
    """Profiles by risk and cases; an empty list has no length."""
    length = lambda c: F.nullif(F.col(c), F.lit(0).cast("bigint"))
    days = F.timestamp_diff("DAY", F.col("last_case_date").cast("timestamp"), F.lit(as_of).cast("timestamp"))
    return profiles.select(
        "profile_id", "total_cases", "total_btc_stolen", "risk_score", "first_case_date", "last_case_date",
        length("known_address_count").alias("address_count"), length("known_cluster_count").alias("cluster_count"),
        length("known_exchange_count").alias("exchange_count"), days.cast("int").alias("days_since_last_case"),
        "match_count",
    ).orderBy(F.col("risk_score").desc(), F.col("total_cases").desc(), "profile_id")


def validate(df: DataFrame, table: str) -> DataFrame:
    """The rows with the names of the rules they break; empty for a valid row."""
    rules: list[Column] = []
    for column, allowed in ENUMS.get(table, {}).items():
        if column in df.columns:
            rules.append(F.when(~F.col(column).isin(*allowed), F.lit(f"{column} not allowed")))
    for column, (low, high) in RANGES.get(table, {}).items():
        if column in df.columns:
            rules.append(F.when(~F.col(column).between(low, high), F.lit(f"{column} out of range")))
    return df.withColumn("reasons", F.filter(F.array(*rules), lambda r: r.isNotNull()))


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with reasons)."""
    checked = validate(df, table)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def usage_rollup(log: DataFrame) -> DataFrame:
    """C11: calls, errors and mean time by day, key and endpoint, with subtotals."""
    return (
        log.withColumn("day", F.to_date("called_at")).rollup("day", "key_id", "endpoint")
        .agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status_code") >= 500).alias("errors"),
             F.round(F.avg(F.col("response_ms").cast("decimal(18,4)")), 4).cast("double").alias("mean_ms"))
    )
