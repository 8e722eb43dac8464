"""Queries over captures: scans, sinks, quarantine, joins between hosts, completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotline.functions import slots
from slotline.operators import capture as op
from slotline.operators import reaping, timeline
from slotline.plans.registry import query
from slotline.sources import files, views
from slotline.sources.views import with_views

DONE = "SELECT DISTINCT camera, month FROM monthly WHERE NOT (camera LIKE '1%' AND month < '1995-06')"


def _done(months):
    """(camera, month) with an output: one camera has none for the first months."""
    return months.filter(~(F.col("camera").startswith("1") & (F.col("month") < "1995-06")))


def _side(spark, d, host):
    return views.captures(spark, d).filter(F.col("host") == host)


def _valid(spark, d, host=None):
    frame = views.captures(spark, d)
    return views.valid(frame if host is None else frame.filter(F.col("host") == host))


@query("capture_scan", with_views("captures", """SELECT host, camera, day_dir, name, bytes FROM captures WHERE name LIKE '2024-01-1%' AND bytes >= 1024
    AND regexp_matches(name, '^[0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{2}:[0-9]{2}:[0-9]{2}\\.jpg$')"""))  # fmt: skip
def capture_scan(spark, d):
    return op.capture_scan(views.captures(spark, d), "2024-01-1").select("host", "camera", "day_dir", "name", "bytes")


@query("capture_sink", with_views("valid", "SELECT camera, day_dir AS day, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM valid GROUP BY ALL"))
def capture_sink(spark, d):
    # a folder of its own for each call: partitions of another table's run are not counted
    back = files.land_captures(_valid(spark, d), files.scratch(spark, "captures"))
    return back.groupBy("camera", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("manifest_text", with_views("manifest", "SELECT camera, printf('%04d %s %-23s', g % 10000, state, coalesce(src, '')) AS line, g % 10000 AS frame, state, coalesce(src, '') AS src FROM manifest"))
def manifest_text(spark, d):
    from slotline.plans.timelines import manifest

    m = manifest(spark, d).withColumn("frame", F.col("g") % 10000)
    lines = m.select("camera", slots.manifest_line(F.col("frame"), F.col("state"), F.col("src")).alias("line"))
    return files.parse_manifest(lines, "line").select("camera", "line", F.col("frame").cast("long"), "state", F.coalesce("src", F.lit("")).alias("src"))


@query("listing_parse", with_views("captures", "SELECT day_dir, name, bytes FROM captures WHERE bytes >= 1024"))
def listing_parse(spark, d):
    return files.parse_listing(views.listing(spark, d))


@query("idempotent_publish", with_views("captures finalized", "SELECT DISTINCT c.camera, c.day_dir AS day FROM captures c WHERE NOT EXISTS (SELECT 1 FROM finalized f WHERE f.camera = c.camera AND f.day = c.day_dir)"))
def idempotent_publish(spark, d):
    c = views.captures(spark, d)
    wanted = c.select("camera", F.col("day_dir").alias("day")).distinct()
    return op.to_write(wanted, views.finalized(c), "camera", "day")


@query("superseded_partitions", with_views("captures finalized", "SELECT DISTINCT camera, day_dir AS day FROM captures c WHERE EXISTS (SELECT 1 FROM finalized f WHERE f.camera = c.camera AND substr(f.day, 1, 7) = substr(c.day_dir, 1, 7))"))
def superseded_partitions(spark, d):
    c = views.captures(spark, d)
    months = views.finalized(c).select("camera", F.substring("day", 1, 7).alias("month")).distinct()
    return op.superseded(c.select("camera", F.col("day_dir").alias("day")).distinct(), months)


# --- names, with some made stray, misplaced or given a bad clock -----------------------------------------------------
ODD = """SELECT camera, event_id, CASE WHEN event_id % 50 = 0 THEN '2024-02-01' ELSE day_dir END AS day_dir,
    CASE WHEN event_id % 40 = 1 THEN 'local-' || name WHEN event_id % 40 = 2 THEN replace(name, '.jpg', '.jpeg')
    WHEN event_id % 40 = 3 THEN substr(name, 1, 11) || '24:00:00.jpg' WHEN event_id % 40 = 4 THEN substr(name, 1, 11) || '12:75:00.jpg' ELSE name END AS name FROM captures"""


def _odd(spark, d):
    i, name = F.col("event_id"), F.col("name")
    made = (
        F.when(i % 40 == 1, F.concat(F.lit("local-"), name))
        .when(i % 40 == 2, F.replace(name, F.lit(".jpg"), F.lit(".jpeg")))
        .when(i % 40 == 3, F.concat(F.substring(name, 1, 11), F.lit("24:00:00.jpg")))
        .when(i % 40 == 4, F.concat(F.substring(name, 1, 11), F.lit("12:75:00.jpg")))
        .otherwise(name)
    )
    day = F.when(i % 50 == 0, "2024-02-01").otherwise(F.col("day_dir"))
    return views.captures(spark, d).withColumn("day_dir", day).withColumn("name", made)


NAMED = "regexp_matches(name, '^[0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{2}:[0-9]{2}:[0-9]{2}\\.jpg$')"
SLOT = "(CAST(substr(name, 12, 2) AS BIGINT) * 60 + CAST(substr(name, 15, 2) AS BIGINT)) // 5"


def _odd_sql(body):
    return with_views("captures", "").rstrip() + f", odd AS ({ODD}) {body}"


@query("slot_of_name", _odd_sql(f"SELECT event_id, name, {SLOT} AS slot FROM odd WHERE {NAMED}"))
def slot_of_name(spark, d):
    named, _ = op.quarantine(_odd(spark, d))
    return named.select("event_id", "name", slots.slot_of_name(F.col("name")).cast("long").alias("slot"))


@query("epoch_of_name", _odd_sql(f"SELECT event_id, CAST(epoch(try_strptime(substr(name, 1, 19), '%Y-%m-%d_%H:%M:%S')) AS BIGINT) AS epoch FROM odd WHERE {NAMED}"))
def epoch_of_name(spark, d):
    named, _ = op.quarantine(_odd(spark, d))
    return named.select("event_id", slots.epoch_of_name(F.col("name")).alias("epoch"))


@query("stray_quarantine", _odd_sql(f"SELECT camera, substr(day_dir, 1, 7) AS month, count(*) AS strays FROM odd WHERE NOT {NAMED} GROUP BY ALL"))
def stray_quarantine(spark, d):
    return op.stray_count(_odd(spark, d).withColumn("month", F.substring("day_dir", 1, 7)), "camera", "month")


@query("misplaced_partition", _odd_sql(f"SELECT event_id, day_dir, name FROM odd WHERE {NAMED} AND day_dir <> substr(name, 1, 10)"))
def misplaced_partition(spark, d):
    named, _ = op.quarantine(_odd(spark, d))
    return op.misplaced(named, "list").select("event_id", "day_dir", "name")


@query("bad_clock", _odd_sql(f"SELECT event_id, name FROM odd WHERE {NAMED} AND {SLOT} >= 288"))
def bad_clock(spark, d):
    named, _ = op.quarantine(_odd(spark, d))
    return op.bad_clock(named).select("event_id", "name")


@query("period_bounds", with_views("monthly", """SELECT month, month || '-01' AS first, strftime(CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') AS until,
    date_diff('day', CAST(month || '-01' AS DATE), CAST(CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH AS DATE)) AS days,
    date_diff('day', CAST(month || '-01' AS DATE), CAST(CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH AS DATE)) * 288 AS nslots FROM (SELECT DISTINCT month FROM monthly)"""))  # fmt: skip
def period_bounds(spark, d):
    m = views.monthly(spark, d).select("month").distinct()
    first = F.concat("month", F.lit("-01")).cast("date")
    days = F.size(F.sequence(first, F.date_sub(F.add_months(first, 1), 1), F.expr("interval 1 day"))).cast("long")
    return m.select(
        "month",
        first.cast("string").alias("first"),
        F.concat(slots.next_month(F.col("month")), F.lit("-01")).alias("until"),
        days.alias("days"),
        (days * slots.SLOTS_PER_DAY).alias("nslots"),
    )


@query("closed_periods", with_views("monthly", "SELECT DISTINCT camera, month FROM monthly WHERE CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH <= DATE '1999-03-15'"))
def closed_periods(spark, d):
    m = views.monthly(spark, d).distinct()
    return op.closed(m, F.add_months(F.concat("month", F.lit("-01")).cast("date"), 1), "1999-03-15")


@query("backfill_select", with_views("captures valid", f"""SELECT camera, day_dir AS day, {SLOT} AS slot, min(name) AS name FROM valid r WHERE host = 'b'
    AND NOT EXISTS (SELECT 1 FROM captures l WHERE l.host = 'a' AND l.camera = r.camera AND l.day_dir = r.day_dir AND
    (CAST(substr(l.name, 12, 2) AS BIGINT) * 60 + CAST(substr(l.name, 15, 2) AS BIGINT)) // 5 = r.slot) GROUP BY ALL"""))  # fmt: skip
def backfill_select(spark, d):
    got = op.backfill_select(_side(spark, d, "a"), _valid(spark, d, "b"))
    return got.select("camera", "day", F.col("slot").cast("long"), "name")


@query("skip_finalized", with_views("captures finalized", "SELECT c.event_id FROM captures c WHERE NOT EXISTS (SELECT 1 FROM finalized f WHERE f.camera = c.camera AND f.day = c.day_dir)"))
def skip_finalized(spark, d):
    c = views.captures(spark, d)
    return op.to_write(c.withColumn("day", F.col("day_dir")), views.finalized(c), "camera", "day").select("event_id")


@query("all_cameras_done", with_views("monthly", f"""SELECT m.month FROM (SELECT DISTINCT month FROM monthly) m WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT DISTINCT camera FROM monthly) c WHERE NOT EXISTS (SELECT 1 FROM ({DONE}) d WHERE d.camera = c.camera AND d.month = m.month))"""))  # fmt: skip
def all_cameras_done(spark, d):
    m = views.monthly(spark, d).distinct()
    return op.joined_months(_done(m), m)


@query("active_months", with_views("valid", "SELECT DISTINCT camera, substr(name, 1, 7) AS month FROM valid"))
def active_months(spark, d):
    return op.active_months(_valid(spark, d))


@query("first_per_slot", with_views("valid", "SELECT host, camera, g, min(name) AS name FROM valid GROUP BY ALL"))
def first_per_slot(spark, d):
    return op.first_per_slot(_valid(spark, d), "host", "camera", "g").withColumn("g", F.col("g").cast("long"))


@query("slot_coverage", with_views("valid", "SELECT DISTINCT camera, g FROM valid"))
def slot_coverage(spark, d):
    return op.slot_coverage(_valid(spark, d)).withColumn("g", F.col("g").cast("long"))


@query("merge_summary", with_views("captures valid", f"""SELECT coalesce(camera, 'all') AS camera, count(*) FILTER (side = 'l') AS n_local, count(*) FILTER (side = 'r') AS n_remote, count(*) FILTER (side = 'c') AS n_to_copy FROM (
    SELECT camera, 'l' AS side FROM captures WHERE host = 'a' UNION ALL SELECT camera, 'r' FROM valid WHERE host = 'b' UNION ALL
    SELECT camera, 'c' FROM (SELECT DISTINCT camera, g FROM valid r WHERE host = 'b' AND NOT EXISTS (SELECT 1 FROM captures l WHERE l.host = 'a' AND l.camera = r.camera AND l.day_dir = r.day_dir AND
    (CAST(substr(l.name, 12, 2) AS BIGINT) * 60 + CAST(substr(l.name, 15, 2) AS BIGINT)) // 5 = r.slot))) GROUP BY ROLLUP (camera)"""))  # fmt: skip
def merge_summary(spark, d):
    got = op.merge_summary(_side(spark, d, "a"), _valid(spark, d, "b"))
    return got.withColumn("camera", F.coalesce("camera", F.lit("all")))


@query("pending_months", with_views("monthly", f"""SELECT strftime(m, '%Y-%m') AS month, row_number() OVER (ORDER BY m) AS rank FROM (
    SELECT unnest(generate_series((SELECT min(month || '-01') FROM monthly)::DATE, DATE '2001-08-01', INTERVAL 1 MONTH)) AS m)
    WHERE strftime(m, '%Y-%m') NOT IN (SELECT month FROM ({DONE}) GROUP BY month HAVING count(*) >= (SELECT count(DISTINCT camera) FROM monthly))"""))  # fmt: skip
def pending_months(spark, d):
    from pyspark.sql import Window as W

    m = views.monthly(spark, d).distinct()
    got = op.pending_months(m, op.joined_months(_done(m), m), views.AS_OF_MONTH)
    return got.withColumn("rank", F.row_number().over(W.orderBy("month")).cast("long"))  # one row a month


@query("retention_due_months", with_views("monthly joined", "SELECT month, row_number() OVER (ORDER BY month) AS rank FROM joined WHERE month <= '2001-04'"))
def retention_due_months(spark, d):
    from pyspark.sql import Window as W

    m = views.monthly(spark, d).distinct()
    got = op.retention_due(m, op.joined_months(m, m), views.AS_OF_MONTH)
    return got.withColumn("rank", F.row_number().over(W.orderBy("month")).cast("long"))  # one row a month


# --- the report of checks before captures may go, and what may go ----------------------------------------------------
REAP_AS_OF, REAPED = "2024-06-15", "2024-01"
#: Captures of these cameras came from the other host after the output was made.
LATE_CAMERAS = "camera < 'e'"


def _reap_sql(body):
    return with_views("valid manifest", "").rstrip() + f""", odd AS ({ODD}), disk AS (SELECT DISTINCT camera, g FROM valid WHERE host = 'a' OR {LATE_CAMERAS}),
        late AS (SELECT camera, count(*) AS n FROM (SELECT camera, g FROM disk EXCEPT SELECT camera, g FROM manifest WHERE state = 'P') GROUP BY camera),
        shape AS (SELECT camera, count(*) AS n, count(*) FILTER (state = 'P' AND substr(src, 1, 10) <> strftime(DATE '2024-01-01' + INTERVAL (g // 288) DAY, '%Y-%m-%d')) AS misnamed FROM manifest GROUP BY camera),
        picks AS ({views.SQL_PICKS}), sampled AS (SELECT camera, count(*) FILTER (g % 11 <> 0) AS checked, count(*) FILTER (g % 11 <> 0 AND 0.9 + (g % 7 - 1) / 100.0 < 0.9) AS failing FROM picks GROUP BY camera),
        strays AS (SELECT camera, count(*) AS n FROM odd WHERE NOT {NAMED} GROUP BY camera),
        joined_up AS (SELECT c.camera, coalesce(s.n, 0) AS strays, coalesce(h.n, 0) AS n_rows, coalesce(h.misnamed, 0) AS misnamed, coalesce(l.n, 0) AS late, coalesce(p.failing, 0) AS failing,
            coalesce(h.misnamed = 0, false) AS good_days, coalesce(p.checked > 0 AND p.failing = 0, false) AS alike
            FROM (SELECT DISTINCT camera FROM disk) c LEFT JOIN strays s USING (camera) LEFT JOIN shape h USING (camera) LEFT JOIN late l USING (camera) LEFT JOIN sampled p USING (camera)),
        report AS (SELECT camera, '2024-01' AS period, unnest(['due', 'strays', 'shape', 'days', 'late', 'samples']) AS "check", unnest([1, strays, n_rows, misnamed, late, failing]) AS found,
            unnest([true, true, n_rows = 8640, good_days, late = 0, alike]) AS passed FROM joined_up) {body}"""


def _reap_report(spark, d):
    from slotline.plans.timelines import manifest

    m = files.settled(manifest(spark, d), "manifest")  # several checks read it
    every = views.valid(views.captures(spark, d))
    photos = m.filter("state = 'P'").select("camera", "g", "src")
    scored = timeline.even_sample(photos, "camera", "g").withColumn("score", F.lit(0.9) + (F.col("g") % 7 - 1) / 100.0)
    sources = photos.filter(F.col("g") % 11 != 0).select("camera", F.col("src").alias("name"))
    newest = op.retention_due(spark.createDataFrame([(REAPED,)], "month string"), spark.createDataFrame([(REAPED,)], "month string"), REAP_AS_OF)
    on_disk = every.filter(f"host = 'a' OR {LATE_CAMERAS}").select("camera", "g").distinct()
    return reaping.report(m, on_disk, _odd(spark, d), scored, sources, REAPED, views.DAYS, views.ORIGIN, not newest.isEmpty())


@query("reap_report", _reap_sql('SELECT camera, period, "check", found, passed FROM report'))
def reap_report(spark, d):
    return _reap_report(spark, d)


@query("reap_deletions", _reap_sql(f"SELECT event_id, camera, name FROM odd WHERE {NAMED} AND substr(name, 1, 7) = '2024-01' AND camera IN (SELECT camera FROM report GROUP BY camera HAVING bool_and(passed))"))
def reap_deletions(spark, d):
    return reaping.deletions(_odd(spark, d), _reap_report(spark, d)).select("event_id", "camera", "name")
