"""Stateful stream operators and late data."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerspark.streaming import metrics

START = datetime(2024, 1, 1)


def run(frame, tmp_path, name):
    out, marks = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-marks")
    (frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return out


def source(spark, tmp_path, batches, schema):
    path = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_sustained_alert_fires_once_per_run(spark, tmp_path):
    minute = lambda n: START + timedelta(minutes=n)
    breaches = [True, True, False, True, True, True, True, False]
    rows = [("hits", minute(5 * n), minute(5 * n + 5), b) for n, b in enumerate(breaches)]
    schema = "alert string, window_start timestamp, window_end timestamp, is_breach boolean"
    stream = source(spark, tmp_path, [rows[:4], rows[4:]], schema)
    out = run(metrics.sustained_alert_stream(stream, 15), tmp_path, "alert")
    fired = spark.read.parquet(out).collect()
    assert [(r.pending_from, r.fired_at) for r in fired] == [(minute(15), minute(30))]
    table = spark.createDataFrame(rows, schema)
    batch = metrics.sustained_alert(table, 15).collect()
    assert [(r.pending_from, r.until) for r in batch] == [(minute(15), minute(35))]


def test_absence_fires_when_a_source_falls_silent(spark, tmp_path):
    second = lambda n: START + timedelta(seconds=n)
    schema = "source string, ts timestamp"
    batches = [[("api", second(0)), ("node", second(0))], [("node", second(100)), ("node", second(2000))], [("node", second(2100))]]
    stream = source(spark, tmp_path, batches, schema)
    out = run(metrics.absence_stream(stream, 3, "1 minute"), tmp_path, "absence")
    silent = {(r.source, r.silent_from) for r in spark.read.parquet(out).collect()}
    assert ("api", second(0)) in silent


def test_repeated_and_late_rows(spark, tmp_path):
    at = lambda n: START + timedelta(minutes=n)
    schema = "event_id bigint, ts timestamp, status_code int, latency_s double"
    batches = [[(1, at(0), 500, 1.0), (1, at(0), 500, 1.0), (2, at(1), 200, 1.0)], [(3, at(60), 200, 1.0)],
               [(7, at(70), 200, 1.0)], [(8, at(80), 200, 1.0)], [(4, at(2), 500, 1.0), (5, at(120), 200, 1.0)], [(6, at(240), 200, 1.0)]]
    stream = source(spark, tmp_path, batches, schema)
    out = run(metrics.error_rate(metrics.with_watermark(stream)), tmp_path, "rate")
    first = spark.read.parquet(out).where(F.col("window_start") == F.lit(at(0))).first()
    assert (first.part, first.whole) == (1, 2)  # the repeat counts once, the late row not at all


def test_gauges(spark):
    rows = [("disk_free_share", START, 0.15), ("memory_used_share", START, 0.85), ("cpu_temp_celsius", START, 81.0)]
    got = {r.alert: r.is_breach for r in metrics.gauge_thresholds(
        spark.createDataFrame(rows, "gauge string, ts timestamp, value double")).collect()}
    assert got == {"DiskSpaceCritical": False, "DiskSpaceWarning": True, "MemoryPressure": False,
                   "CPUTemperatureCritical": True, "CPUTemperatureWarning": True}
