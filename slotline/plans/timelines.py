"""Queries over slots: the manifest, outages, captions, roll-ups, late arrivals, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotline.functions import slots
from slotline.operators import capture, timeline
from slotline.plans.registry import query
from slotline.sources import views
from slotline.sources.files import settled
from slotline.sources.views import DAYS, ORIGIN, with_views


def _valid(spark, d, host="a"):
    return views.valid(views.captures(spark, d).filter(F.col("host") == host))


def manifest(spark, d):
    return timeline.slot_manifest(_valid(spark, d), DAYS)


def _long(frame, *columns):
    return frame.withColumns({c: F.col(c).cast("long") for c in columns})


@query("slot_manifest", with_views("manifest", "SELECT camera, g, state, src FROM manifest"))
def slot_manifest(spark, d):
    return _long(manifest(spark, d), "g")


@query("slot_spine", with_views("spine filled", "SELECT s.camera, s.g, f.lo AS name FROM spine s LEFT JOIN filled f ON s.camera = f.camera AND s.g = f.g"))
def slot_spine(spark, d):
    return _long(timeline.slot_spine(_valid(spark, d), DAYS), "g")


@query("asof_seed", with_views("valid", """SELECT c.camera, d, v.name AS seed FROM (SELECT DISTINCT camera FROM valid WHERE host = 'a') c CROSS JOIN range(0, 30) r(d)
    ASOF LEFT JOIN (SELECT * FROM valid WHERE host = 'a') v ON c.camera = v.camera AND TIMESTAMP '2024-01-01' + INTERVAL (d) DAY > v.ts"""))  # fmt: skip
def asof_seed(spark, d):
    return _long(timeline.asof_seed(_valid(spark, d), DAYS).select("camera", "d", "seed"), "d")


@query("missing_runs", with_views("runs", "SELECT camera, first, last, src FROM runs"))
def missing_runs(spark, d):
    return _long(timeline.missing_runs(manifest(spark, d)), "first", "last")


@query("frame_outage_range", with_views("manifest runs", "SELECT m.camera, m.g, r.first, r.last FROM manifest m JOIN runs r ON m.camera = r.camera AND m.g BETWEEN r.first AND r.last"))
def frame_outage_range(spark, d):
    m = settled(manifest(spark, d), "manifest")  # read twice: its slots, and the runs among them
    found = timeline.frame_outage(m.select("camera", "g"), timeline.missing_runs(m))
    return _long(found.select("camera", "g", "first", "last"), "g", "first", "last")


LOCAL = "(({}) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Vilnius')"
GAP = "CASE WHEN mi < 60 THEN printf('%02dm', mi) WHEN mi < 1440 THEN printf('%02dh %02dm', mi // 60, mi % 60) ELSE printf('%dd %02dh', mi // 1440, mi // 60 % 24) END"


@query("outage_captions", with_views("manifest runs", f"""SELECT camera, g, badge, CASE WHEN day = badge THEN clock ELSE substr(day, 10, 5) || ' ' || clock END AS since, {GAP} AS gap FROM (
    SELECT *, strftime({LOCAL.format('shown')}, '%a %Y-%m-%d') AS badge, strftime({LOCAL.format('since')}, '%a %Y-%m-%d') AS day,
    strftime({LOCAL.format('since')}, '%H:%M') || CASE WHEN date_diff('hour', since, {LOCAL.format('since')}) = 3 THEN ' EEST' ELSE ' EET' END AS clock,
    (date_diff('second', since, shown) + 30) // 60 AS mi FROM (
    SELECT m.camera, m.g, TIMESTAMP '2024-01-01' + INTERVAL (m.g * 5) MINUTE AS shown, coalesce(strptime(substr(r.src, 1, 19), '%Y-%m-%d_%H:%M:%S'), TIMESTAMP '2024-01-01' + INTERVAL (r.first * 5) MINUTE) AS since
    FROM manifest m JOIN runs r ON m.camera = r.camera AND m.g BETWEEN r.first AND r.last))"""))  # fmt: skip
def outage_captions(spark, d):
    return _long(timeline.outage_captions(settled(manifest(spark, d), "manifest"), ORIGIN), "g")


@query("local_day_badge", with_views("spine", f"SELECT camera, g, strftime({LOCAL.format('TIMESTAMP ' + chr(39) + '2024-01-01' + chr(39) + ' + INTERVAL (g * 5) MINUTE')}, '%a %Y-%m-%d') AS badge FROM spine"))
def local_day_badge(spark, d):
    spine = timeline.slot_spine(_valid(spark, d), DAYS)
    return _long(spine.select("camera", "g", slots.local_day_badge(slots.slot_time(F.col("g"), ORIGIN)).alias("badge")), "g")


@query("gap_text", f"SELECT event_id, {GAP} AS gap FROM (SELECT event_id, event_id * 7 % 10000 AS mi FROM events)")
def gap_text(spark, d):
    e = views.read(spark, d, "events")
    return e.select("event_id", slots.gap_text(F.col("event_id") * 7 % 10000).alias("gap"))


@query("timeline_offsets", with_views("spine", """SELECT camera, g, printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS clock, g // 288 * 288 * 1000 // 24 AS chapter_ms
    FROM (SELECT camera, g, g * 100 // 24 AS cs FROM spine)"""))  # fmt: skip
def timeline_offsets(spark, d):
    spine = timeline.slot_spine(_valid(spark, d), DAYS)
    day = F.floor(F.col("g") / slots.SLOTS_PER_DAY)
    return _long(spine.select("camera", "g", slots.frame_clock(F.col("g")).alias("clock"), slots.chapter_ms(day).alias("chapter_ms")), "g")


@query("period_state_rollup", with_views("manifest valid", """SELECT coalesce(camera, 'all') AS camera, coalesce(month, 'all') AS month, coalesce(day, 'all') AS day, CAST(sum(photo) AS BIGINT) AS photos,
    count(*) FILTER (state = 'P') AS n_p, count(*) FILTER (state = 'H') AS n_h, count(*) FILTER (state = 'M') AS n_m, CAST(sum(photo) AS BIGINT) - count(*) FILTER (state = 'P') AS dropped FROM (
    SELECT camera, strftime(DATE '2024-01-01' + INTERVAL (g // 288) DAY, '%Y-%m') AS month, strftime(DATE '2024-01-01' + INTERVAL (g // 288) DAY, '%Y-%m-%d') AS day, state, 0::BIGINT AS photo FROM manifest
    UNION ALL SELECT camera, substr(name, 1, 7), substr(name, 1, 10), '', 1 FROM valid WHERE host = 'a') GROUP BY ROLLUP (camera, month, day)"""))  # fmt: skip
def period_state_rollup(spark, d):
    got = timeline.state_rollup(manifest(spark, d), _valid(spark, d), ORIGIN)
    return got.withColumns({c: F.coalesce(c, F.lit("all")) for c in ("camera", "month", "day")})


@query("manifest_validate", with_views("manifest", """SELECT camera, count(*) AS n_rows, count(*) = 8640 AS complete,
    count(*) FILTER (state = 'P' AND substr(src, 1, 10) <> strftime(DATE '2024-01-01' + INTERVAL (g // 288) DAY, '%Y-%m-%d')) AS misnamed FROM manifest GROUP BY camera"""))  # fmt: skip
def manifest_validate(spark, d):
    return timeline.manifest_validate(manifest(spark, d), DAYS, ORIGIN)


@query("late_arrivals", with_views("valid manifest", "SELECT camera, g // 288 AS day, count(*) AS slots FROM (SELECT camera, g FROM valid EXCEPT SELECT camera, g FROM manifest WHERE state = 'P') GROUP BY ALL"))
def late_arrivals(spark, d):
    every = views.valid(views.captures(spark, d))
    late = timeline.late_arrivals(every, manifest(spark, d).filter("state = 'P'"))
    return late.groupBy("camera", F.floor(F.col("g") / slots.SLOTS_PER_DAY).alias("day")).agg(F.count("*").alias("slots"))


@query("month_union", with_views("manifest", "SELECT camera, g AS frame, state, src FROM manifest"))
def month_union(spark, d):
    m = manifest(spark, d)
    days = m.select("camera", F.floor(F.col("g") / 288).alias("day_index"), (F.col("g") % 288).alias("frame"), "state", "src")
    return _long(timeline.month_union(days), "frame")


PICKS = views.SQL_PICKS


@query("even_sample", with_views("manifest", f"SELECT camera, g, src, ordinal FROM ({PICKS})"))
def even_sample(spark, d):
    rows = manifest(spark, d).filter("state = 'P'").select("camera", "g", "src")
    return _long(timeline.even_sample(rows, "camera", "g"), "g", "ordinal")


@query("sample_reconcile", with_views("manifest", f"""SELECT camera, count(*) FILTER (g % 11 <> 0) AS checked, count(*) FILTER (g % 11 = 0) AS skipped, count(*) FILTER (g % 11 <> 0 AND 0.9 + (g % 7 - 1) / 100.0 < 0.9) AS failing,
    count(*) FILTER (g % 11 <> 0) > 0 AND count(*) FILTER (g % 11 <> 0 AND 0.9 + (g % 7 - 1) / 100.0 < 0.9) = 0 AS passed FROM ({PICKS}) GROUP BY camera"""))  # fmt: skip
def sample_reconcile(spark, d):
    photos = manifest(spark, d).filter("state = 'P'").select("camera", "g", "src")
    picks = timeline.even_sample(photos, "camera", "g")
    scored = picks.withColumn("score", F.lit(0.9) + (F.col("g") % 7 - 1) / 100.0)
    sources = photos.filter(F.col("g") % 11 != 0).select("camera", F.col("src").alias("name"))
    return timeline.sample_reconcile(scored, sources)


@query("backfilled_manifest", with_views("valid", """SELECT camera, count(DISTINCT g) AS photos, count(DISTINCT g) AS covered FROM valid v WHERE host = 'a' OR NOT EXISTS (SELECT 1 FROM captures l
    WHERE l.host = 'a' AND l.bytes < 1024 AND l.camera = v.camera AND l.day_dir = v.day_dir AND (CAST(substr(l.name, 12, 2) AS BIGINT) * 60 + CAST(substr(l.name, 15, 2) AS BIGINT)) // 5 = v.slot) GROUP BY camera"""))  # fmt: skip
def backfilled_manifest(spark, d):
    """After backfill nothing is late: covered slots of the merged hosts."""
    a, b = _valid(spark, d), _valid(spark, d, "b")
    picks = capture.backfill_select(views.captures(spark, d).filter(F.col("host") == "a"), b).withColumn("g", slots.global_slot(F.col("day"), F.col("slot"), ORIGIN))
    merged = a.select("camera", "g", "name").unionByName(picks.select("camera", "g", "name"))
    first = timeline.slot_manifest(merged, DAYS).filter("state = 'P'")
    return first.groupBy("camera").agg(F.count("*").alias("photos"), F.countDistinct("g").alias("covered"))
