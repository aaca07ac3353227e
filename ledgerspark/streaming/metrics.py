"""Metric windows and alert rules, the same transformation for tables and for streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerspark.functions.rank import ranked, running

LATE_AFTER = "10 minutes"


@dataclass(frozen=True)
class RatioRule:
    """Alert when ``part`` over ``whole`` rows of a window passes ``limit``."""

    name: str
    window: str
    slide: str | None
    limit: float
    above: bool
    hold_minutes: int


# Windows, limits and holding times of the ratio alerts.
API_ERRORS = RatioRule("APIHighErrorRate", "5 minutes", None, 0.05, True, 5)
UPSTREAM_ERRORS = RatioRule("BlockstreamAPIErrors", "10 minutes", "5 minutes", 0.20, True, 5)
FAILED_INVESTIGATIONS = RatioRule("InvestigationFailureRateHigh", "1 hour", "15 minutes", 0.10, True, 15)
LOW_HIT_RATE = RatioRule("AttributionHitRateLow", "30 minutes", None, 0.30, False, 30)

# Quantile, window and limits in seconds of the latency alerts.
LATENCY_QUANTILE, LATENCY_WINDOW = 0.95, "5 minutes"
API_LATENCY_LIMIT, UPSTREAM_LATENCY_LIMIT = 10.0, 5.0

# Silence before a source counts as down.
ABSENT_MINUTES = 3

# Alert, gauge, above or below, limit, holding minutes.
GAUGE_RULES = [
    ("DiskSpaceCritical", "disk_free_share", "below", 0.10, 5),
    ("DiskSpaceWarning", "disk_free_share", "below", 0.20, 10),
    ("MemoryPressure", "memory_used_share", "above", 0.85, 5),
    ("CPUTemperatureCritical", "cpu_temp_celsius", "above", 80.0, 2),
    ("CPUTemperatureWarning", "cpu_temp_celsius", "above", 70.0, 5),
]


def _span(ts: Column, rule: RatioRule) -> Column:
    return F.window(ts, rule.window, rule.slide) if rule.slide else F.window(ts, rule.window)


def with_watermark(metrics: DataFrame, delay: str = LATE_AFTER) -> DataFrame:
    """Rows later than ``delay`` are dropped and repeats of an event count once (streams)."""
    return metrics.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def ratio_windows(metrics: DataFrame, part: Column, whole: Column, rule: RatioRule) -> DataFrame:
    """Share of ``part`` among ``whole`` per window, and whether it breaks the rule."""
    rate = F.try_divide(F.col("part").cast("double"), F.col("whole").cast("double"))
    breach = rate > rule.limit if rule.above else rate < rule.limit
    return (
        metrics.groupBy(_span(F.col("ts"), rule).alias("w"))
        .agg(F.count_if(part).alias("part"), F.count_if(whole).alias("whole"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "part", "whole",
                rate.alias("rate"), F.coalesce(breach, F.lit(False)).alias("is_breach"))
    )


def error_rate(metrics: DataFrame, rule: RatioRule = API_ERRORS) -> DataFrame:
    """W2 for response codes."""
    return ratio_windows(metrics, F.col("status_code") >= 500, F.lit(True), rule)


def failure_rate(metrics: DataFrame, rule: RatioRule = FAILED_INVESTIGATIONS) -> DataFrame:
    """W2 for investigations: failed over started."""
    return ratio_windows(metrics, F.col("is_failed"), F.col("is_started"), rule)


def hit_rate(metrics: DataFrame, rule: RatioRule = LOW_HIT_RATE) -> DataFrame:
    """W4."""
    return ratio_windows(metrics, F.col("is_hit"), F.col("is_lookup"), rule)


def latency_p95(metrics: DataFrame, limit: float = API_LATENCY_LIMIT, step: float = 0.01) -> DataFrame:
    """W3 on a table: the exact interpolated quantile per window.

    Rows are numbered in slices of ``step`` seconds of latency, so a busy window is spread
    over tasks; only the two rows next to the quantile are kept.
    """
    start = F.window("ts", LATENCY_WINDOW)["start"]
    rows = metrics.select(start.alias("window_start"), "latency_s", F.floor(F.col("latency_s") / step).alias("slice"))
    sizes = rows.groupBy("window_start").agg(F.count(F.lit(1)).alias("n"))
    at = F.lit(LATENCY_QUANTILE) * (F.col("n") - 1)
    near = ranked(rows, ["window_start"], "slice", ["latency_s"], "pos").join(sizes, "window_start").where(
        (F.col("pos") == F.floor(at) + 1) | (F.col("pos") == F.ceil(at) + 1))
    weight = at - F.floor(at)
    return near.groupBy("window_start", "n").agg(F.min("latency_s").alias("lo"), F.max("latency_s").alias("hi")).select(
        "window_start", (F.col("lo") + (F.col("hi") - F.col("lo")) * weight).alias("p95")).withColumn(
        "is_breach", F.col("p95") > limit)


def latency_p95_stream(metrics: DataFrame, limit: float = API_LATENCY_LIMIT) -> DataFrame:
    """W3 on a stream: the mergeable approximate quantile per window."""
    p95 = F.percentile_approx("latency_s", F.lit(LATENCY_QUANTILE), F.lit(10_000))
    return metrics.groupBy(F.window("ts", LATENCY_WINDOW).alias("w")).agg(p95.alias("p95")).select(
        F.col("w.start").alias("window_start"), "p95", (F.col("p95") > limit).alias("is_breach"))


def absence(metrics: DataFrame, minutes: int = ABSENT_MINUTES) -> DataFrame:
    """W5 on a table: silences longer than ``minutes``.

    Such a silence leaves its minute, so only the first and last row of each minute are
    ordered, not every sample. Minutes are ordered within their day; the first row of the next day
    that has any comes from one row a day.
    """
    edge = metrics.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last")).withColumn("day", F.date_trunc("day", "minute"))
    days = edge.groupBy("day").agg(F.min("first").alias("first")).select("day", F.lead("first").over(Window.orderBy("day")).alias("next_day"))
    inside = F.lead("first").over(Window.partitionBy("day").orderBy("minute"))
    gap = F.unix_micros("next") - F.unix_micros("last")
    return edge.withColumn("inside", inside).join(days, "day").select("last", F.coalesce("inside", "next_day").alias("next")).where(
        gap > minutes * 60_000_000).select(F.col("last").alias("silent_from"), F.col("next").alias("silent_until"))


def sustained_alert(windows: DataFrame, hold_minutes: int) -> DataFrame:
    """W6 on a table: runs of breaching windows that last ``hold_minutes``; one row per run.

    Calm windows are numbered within their day, with what came before carried over one row a day; breaches under one number are a run.
    """
    numbered = running(
        windows.withColumns({"calm": (~F.col("is_breach")).cast("int"), "day": F.date_trunc("day", "window_start")}),
        [], "day", ["window_start"], run="calm")
    islands = numbered.where("is_breach").groupBy("run").agg(
        F.min("window_start").alias("pending_from"), F.max("window_end").alias("until"), F.count(F.lit(1)).alias("windows"))
    held = (F.unix_timestamp("until") - F.unix_timestamp("pending_from")) / 60
    return islands.where(held >= hold_minutes).select("pending_from", "until", "windows")


def gauge_thresholds(samples: DataFrame) -> DataFrame:
    """One row per sample (gauge, ts, value) and rule of that gauge, with the verdict.

    A narrow map: the rules are constants.
    """
    hits = F.array(*[
        F.when(F.col("gauge") == gauge, F.struct(
            F.lit(name).alias("alert"), (F.col("value") > limit if side == "above" else F.col("value") < limit).alias("is_breach"),
            F.lit(hold).alias("hold_minutes")))
        for name, gauge, side, limit, hold in GAUGE_RULES])
    return samples.select("*", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("r")).select(
        *samples.columns, "r.*")


# -- stateful stream forms -----------------------------------------------------------------


class SustainedAlert(StatefulProcessor):
    """Per key: since when the condition holds; emits once a run has lasted long enough."""

    def __init__(self, hold_minutes: int):
        self.hold_seconds = hold_minutes * 60

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "since timestamp, fired boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("window_start")
        since, fired = self.run.get() if self.run.exists() else (None, False)
        alerts = []
        for start, end, breach in zip(batch["window_start"], batch["window_end"], batch["is_breach"]):
            if not breach:
                since, fired = None, False
                continue
            since = start if since is None else since
            if not fired and (end - pd.Timestamp(since)).total_seconds() >= self.hold_seconds:
                fired = True
                alerts.append((key[0], pd.Timestamp(since), end))
        if since is None:
            self.run.clear()
        else:
            self.run.update((pd.Timestamp(since).to_pydatetime(), fired))
        yield pd.DataFrame(alerts, columns=["alert", "pending_from", "fired_at"])

    def close(self) -> None:
        pass


def sustained_alert_stream(windows: DataFrame, hold_minutes: int) -> DataFrame:
    """W6 on a stream of closed windows (alert, window_start, window_end, is_breach)."""
    return windows.groupBy("alert").transformWithStateInPandas(
        statefulProcessor=SustainedAlert(hold_minutes),
        outputStructType="alert string, pending_from timestamp, fired_at timestamp",
        outputMode="Append", timeMode="None")


class Absence(StatefulProcessor):
    """Per source: an event-time timer that fires when nothing came for a while."""

    def __init__(self, minutes: int):
        self.millis = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "millis bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = max(int(part["ts"].max().timestamp() * 1000) for part in rows)
        if self.last.exists():
            newest = max(newest, int(self.last.get()[0]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((newest,))
        self.handle.registerTimer(newest + self.millis)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        since = pd.Timestamp(int(self.last.get()[0]), unit="ms")
        yield pd.DataFrame({"source": [key[0]], "silent_from": [since]})

    def close(self) -> None:
        pass


def absence_stream(samples: DataFrame, minutes: int = ABSENT_MINUTES, delay: str = LATE_AFTER) -> DataFrame:
    """W5 on a stream of (source, ts): one row when a source falls silent."""
    return samples.withWatermark("ts", delay).groupBy("source").transformWithStateInPandas(
        statefulProcessor=Absence(minutes), outputStructType="source string, silent_from timestamp",
        outputMode="Append", timeMode="EventTime")
