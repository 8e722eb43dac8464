"""The streaming jobs run over all that is there, for comparison with their batch twins on closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotline.functions import slots
from slotline.plans.registry import query
from slotline.plans.timelines import manifest
from slotline.sources import views
from slotline.sources.views import ORIGIN, with_views
from slotline.streaming import jobs


def _captures(spark, d):
    return shaped(jobs.event_stream(spark, d))


def shaped(e):
    """A stream of events shaped as captures with their slots."""
    name = F.concat(F.date_format("ts", "yyyy-MM-dd_HH:mm:ss"), F.lit(".jpg"))
    c = e.select(
        F.when(F.col("user_id") % 3 == 0, "b").otherwise("a").alias("host"), F.col("event_type").alias("camera"),
        F.substring(name, 1, 10).alias("day_dir"), name.alias("name"), F.floor(F.col("value") * 100).cast("long").alias("bytes"), "ts", "event_id",
    )
    g = views.valid(c)
    at = slots.slot_time(F.col("g"), ORIGIN)
    # ``since`` counts from the first slot, as the outage timers do
    return g.withColumn("slot_ts", at).withColumn("since", F.timestamp_seconds(F.col("g") * slots.SLOT_MINUTES * 60))


CLOSED = "<= (SELECT max(ts) FROM {}) - INTERVAL 10 MINUTE"


@query("stream_first_per_slot", with_views("valid", f"SELECT * FROM (SELECT camera, time_bucket(INTERVAL 5 MINUTE, ts) AS start, min(name) AS name FROM valid GROUP BY ALL) WHERE start + INTERVAL 5 MINUTE {CLOSED.format('valid')}"))
def stream_first_per_slot(spark, d):
    got = jobs.drained(jobs.first_per_slot(_captures(spark, d)))
    return got.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_late_handling", with_views("valid manifest finalized", """SELECT camera, g // 288 AS day, count(*) AS slots FROM (SELECT v.camera, v.g FROM valid v WHERE NOT EXISTS (
    SELECT 1 FROM finalized f WHERE f.camera = v.camera AND f.day = v.day_dir) EXCEPT SELECT camera, g FROM manifest WHERE state = 'P') GROUP BY ALL"""))  # fmt: skip
def stream_late_handling(spark, d):
    used = manifest(spark, d).filter("state = 'P'")
    return jobs.late_days(_captures(spark, d), used, views.finalized(views.captures(spark, d)))


def _outages(spark, d):
    with jobs.timed_state(spark):
        return jobs.drained(jobs.outages(_captures(spark, d).filter("host = 'a'")))


@query("stream_outage", with_views("runs valid", "SELECT camera, first, last, 'closed' AS kind FROM runs r WHERE src IS NOT NULL AND last < (SELECT max(g) FROM valid v WHERE v.camera = r.camera AND host = 'a')"))
def stream_outage(spark, d):
    return _outages(spark, d).filter("kind = 'closed'")


@query("stream_open_outage", with_views("valid", """SELECT camera, max(g) + 7 AS first, CAST(NULL AS BIGINT) AS last, 'open' AS kind FROM valid WHERE host = 'a' GROUP BY camera
    HAVING (max(g) + 7) * 5 < (SELECT max(g) FROM valid WHERE host = 'a') * 5 - 10"""))  # fmt: skip
def stream_open_outage(spark, d):
    """Cameras that are still missing when the watermark has passed their first missing slot."""
    return _outages(spark, d).filter("kind = 'open'")


@query("stream_sessions", with_views("valid", """, own AS (SELECT camera, g FROM valid WHERE host = 'a'), marked AS (SELECT camera, g, CASE WHEN g - lag(g) OVER w <= 7 THEN 0 ELSE 1 END AS begins FROM own WINDOW w AS (PARTITION BY camera ORDER BY g)),
    numbered AS (SELECT camera, g, sum(begins) OVER (PARTITION BY camera ORDER BY g ROWS UNBOUNDED PRECEDING) AS s FROM marked)
    SELECT camera, min(g) AS first, max(g) AS last, count(*) AS photos FROM numbered GROUP BY camera, s HAVING max(g) * 5 + 36 <= (SELECT max(g) FROM own) * 5 - 10"""))  # fmt: skip
def stream_sessions(spark, d):
    got = jobs.drained(jobs.sessions(_captures(spark, d).filter("host = 'a'")))
    return got.withColumn("first", F.col("first").cast("long")).withColumn("last", F.col("last").cast("long"))


@query("stream_resample", with_views("probes", f"SELECT * FROM (SELECT target, time_bucket(INTERVAL 10 MINUTE, ts) AS start, max_by(rtt, (ts, event_id)) AS value FROM probes GROUP BY ALL) WHERE start + INTERVAL 10 MINUTE {CLOSED.format('probes')}"))
def stream_resample(spark, d):
    e = jobs.event_stream(spark, d).select(F.col("user_id").alias("target"), "ts", "value", "event_id")
    return jobs.drained(jobs.resampled(e, "10 minutes")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_dedup", with_views("valid", "SELECT DISTINCT camera, name FROM valid"))
def stream_dedup(spark, d):
    c = _captures(spark, d)
    return jobs.drained(jobs.deduplicated(c.union(_captures(spark, d))))


@query("stream_failure_alert", with_views("log", """, ranked AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ts, event_id) AS rn FROM log)
    SELECT f.unit, f.event_id AS failure, r.event_id AS record, f.rn - r.rn AS back FROM ranked f JOIN ranked r ON f.unit = r.unit AND r.rn BETWEEN f.rn - 5 AND f.rn - 1 WHERE f.failed"""))  # fmt: skip
def stream_failure_alert(spark, d):
    e = jobs.event_stream(spark, d)
    log = e.select(F.col("user_id").alias("unit"), (F.col("event_type") == "error").alias("failed"), "event_id", "ts")
    return jobs.failure_alerts(log, 5)
