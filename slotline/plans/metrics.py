"""Queries over observations, probes, counters, logs and threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotline.operators import metrics as op
from slotline.plans.registry import query
from slotline.sources import views
from slotline.sources.views import with_views


@query("observations_explode", with_views("observations", "SELECT station, observed AS observed, air, cloud, condition FROM observations"))
def observations_explode(spark, d):
    got = op.observations(views.observation_docs(spark, d))
    return got.select(
        "station", F.col("observationTimeUtc").alias("observed"), F.col("airTemperature").alias("air"),
        F.col("cloudCover").alias("cloud"), F.col("conditionCode").alias("condition"),
    )


ZEROS = "".join(
    f" UNION ALL SELECT '{m}', station, NULL, 0.0::DOUBLE, ts_ms FROM observations"
    for f, m in op.METRICS
    if f not in ("airTemperature", "cloudCover")
)


@query("exposition_lines", with_views("observations", f"""SELECT *, metric || '{{station="' || station || CASE WHEN code IS NULL THEN '' ELSE '",code="' || code END || '"}} ' ||
    CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END || ' ' || ts_ms AS line FROM (
    SELECT 'weather_station_air_temperature_celsius' AS metric, station, NULL::VARCHAR AS code, air AS value, ts_ms FROM observations
    UNION ALL SELECT 'weather_station_cloud_cover_percent', station, NULL, cloud, ts_ms FROM observations WHERE cloud IS NOT NULL
    UNION ALL SELECT 'weather_station_condition', station, condition, 1.0, ts_ms FROM observations WHERE condition IS NOT NULL{ZEROS})"""))  # fmt: skip
def exposition_lines(spark, d):
    return op.samples(op.observations(views.observation_docs(spark, d)))


@query("observation_epoch_ms", "SELECT event_id, CAST(epoch_ms(date_trunc('second', ts)) AS BIGINT) AS ms FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 10 = 0")
def observation_epoch_ms(spark, d):
    e = views.read(spark, d, "events")
    text = F.when(F.col("event_id") % 10 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", op.epoch_ms(text).alias("ms"))


@query("any_probe_failed", with_views("log", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, bool_or(failed) AS failed, count(*) AS inputs FROM log GROUP BY ALL"))
def any_probe_failed(spark, d):
    return op.any_failed(views.log(spark, d))


@query("rolling_probe_stats", with_views("probes", """SELECT event_id, target, round(avg(CASE WHEN rtt <= 100 THEN rtt END) OVER w, 6) AS mean, min(CASE WHEN rtt <= 100 THEN rtt END) OVER w AS least,
    max(CASE WHEN rtt <= 100 THEN rtt END) OVER w AS most, round(avg(CASE WHEN rtt > 100 THEN 1.0 ELSE 0.0 END) OVER w, 6) AS loss FROM probes
    WINDOW w AS (PARTITION BY target ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""))  # fmt: skip
def rolling_probe_stats(spark, d):
    got = op.rolling_probe(views.probes(spark, d), keep=10, timeout=100.0)
    return got.withColumn("mean", F.round("mean", 6)).withColumn("loss", F.round("loss", 6))


@query("counter_increase", """SELECT * FROM (SELECT event_id, user_id, greatest(n - lag(n) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS rise FROM (
    SELECT event_id, user_id, ts, CAST(floor(value) AS BIGINT) AS n FROM events)) WHERE rise > 0""")  # fmt: skip
def counter_increase(spark, d):
    readings = views.read(spark, d, "events").select("event_id", "user_id", "ts", F.floor("value").alias("n"))
    # the first reading has nothing to rise from
    return op.counter_increase(readings, "user_id", ["ts", "event_id"], "n").select("event_id", "user_id", "rise")


@query("burst_classify", with_views("log", """SELECT event_id, n, CASE WHEN n >= 6 THEN 'reject' WHEN n >= 3 THEN 'throttle' ELSE 'ok' END AS verdict FROM (
    SELECT event_id, count(*) OVER (PARTITION BY unit ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM log)"""))  # fmt: skip
def burst_classify(spark, d):
    return op.burst_classify(views.log(spark, d), "unit", 86_400, 3, 6).select("event_id", "n", "verdict")


@query("failure_context", with_views("log", """, ranked AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ts, event_id) AS rn FROM log)
    SELECT f.unit, f.event_id AS failure, r.event_id AS record, f.rn - r.rn AS back FROM ranked f JOIN ranked r ON f.unit = r.unit AND r.rn BETWEEN f.rn - 5 AND f.rn - 1 WHERE f.failed"""))  # fmt: skip
def failure_context(spark, d):
    return op.failure_context(views.log(spark, d), 5)


@query("resample_latest", with_views("probes", "SELECT target, time_bucket(INTERVAL 10 MINUTE, ts) AS start, max_by(rtt, (ts, event_id)) AS value FROM probes GROUP BY ALL"))
def resample_latest(spark, d):
    return op.resample(views.probes(spark, d).withColumnRenamed("rtt", "value"), ["target"], "10 minutes")


@query("thread_order", """SELECT event_id, thread, dense_rank() OVER (ORDER BY latest DESC, thread) AS thread_rank, row_number() OVER (PARTITION BY thread ORDER BY ts, event_id) AS message_rank FROM (
    SELECT event_id, user_id AS thread, ts, max(ts) OVER (PARTITION BY user_id) AS latest FROM events)""")  # fmt: skip
def thread_order(spark, d):
    e = views.read(spark, d, "events").select("event_id", F.col("user_id").alias("thread"), "ts")
    got = op.thread_order(e)
    return got.select("event_id", "thread", F.col("thread_rank").cast("long"), F.col("message_rank").cast("long"))
