"""Queries over what is published: days by whole keys, days taken back and made again, snapshots only on change."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotline.operators import nightly, retention, timeline
from slotline.plans.registry import query
from slotline.sources import views
from slotline.sources.files import scratch, settled
from slotline.sources.publishing import Publication, Snapshots
from slotline.sources.views import with_views

EARLY = "2024-01-20"


def _days(valid):
    """One row for each camera and day."""
    days = valid.groupBy("camera", F.col("day_dir").alias("day"))
    return days.agg(F.count("*").alias("photos"), F.min("name").alias("first"), F.max("name").alias("last"))


DAYS = "camera, day_dir AS day, count(*) AS photos, min(name) AS first, max(name) AS last"


@query("published_days", with_views("valid", f""", early AS (SELECT {DAYS} FROM valid WHERE host = 'a' AND day_dir <= '{EARLY}' GROUP BY ALL)
    SELECT * FROM early UNION ALL SELECT {DAYS} FROM valid v WHERE NOT EXISTS (SELECT 1 FROM early e WHERE e.camera = v.camera AND e.day = v.day_dir) GROUP BY ALL"""))  # fmt: skip
def published_days(spark, d):
    """The first days from one host, published twice; then all days from both: what is finished is not written again."""
    valid = views.valid(views.captures(spark, d))
    out = Publication(spark, scratch(spark, "days"), ["camera", "day"])
    early = _days(valid.filter((F.col("host") == "a") & (F.col("day_dir") <= EARLY)))
    out.publish(early)
    out.publish(early)
    out.publish(_days(valid))
    return out.read()


@query("republished_days", with_views("valid", f""", late AS (SELECT DISTINCT camera, g // 288 AS d FROM (SELECT camera, g FROM valid EXCEPT SELECT camera, g FROM valid WHERE host = 'a'))
    SELECT {DAYS} FROM valid v WHERE host = 'a' OR EXISTS (SELECT 1 FROM late l WHERE l.camera = v.camera AND l.d = v.g // 288) GROUP BY ALL"""))  # fmt: skip
def republished_days(spark, d):
    """Days of one host; those with slots that only the other has are taken back and published again from both."""
    valid = settled(views.valid(views.captures(spark, d)), "valid")
    own = valid.filter("host = 'a'")
    out = Publication(spark, scratch(spark, "days"), ["camera", "day"])
    out.publish(_days(own))
    late = timeline.late_arrivals(valid, own.select("camera", "g").distinct())
    day = F.date_format(F.date_add(F.lit(views.ORIGIN).cast("date"), F.floor(F.col("g") / 288).cast("int")), "yyyy-MM-dd")
    out.retract(late.select("camera", day.alias("day")))
    out.publish(_days(valid))
    return out.read()


def _published(spark, d):
    old, new = views.snapshots(spark, d)
    out = Snapshots(spark, scratch(spark, "snapshots"))
    for frame in (old, old.repartition(3, "key"), new, new.orderBy("payload")):
        out.publish(frame)
    return out


@query("snapshot_current", with_views("new_side", "SELECT key, payload FROM new_side"))
def snapshot_current(spark, d):
    return _published(spark, d).current().select("key", "payload")


@query("snapshot_versions", with_views("old_side new_side", """SELECT 0 AS number, (SELECT count(*) FROM old_side) AS n, (SELECT count(*) FROM old_side) AS changes UNION ALL
    SELECT 1, (SELECT count(*) FROM new_side), count(*) FROM old_side o FULL JOIN new_side n ON o.key = n.key WHERE o.key IS NULL OR n.key IS NULL OR o.payload IS DISTINCT FROM n.payload"""))  # fmt: skip
def snapshot_versions(spark, d):
    """The versions that were published, with the keys in which each differs from the one before."""
    out = _published(spark, d)
    entries = out.log.entries()
    none = out.version(0).limit(0)
    sides = [none, *[out.version(e.number) for e in entries]]
    changes = [retention.snapshot_diff(a, b).agg(F.count("*").alias("changes")).withColumn("number", F.lit(e.number)) for e, a, b in zip(entries, sides, sides[1:])]
    every = changes[0]
    for one in changes[1:]:
        every = every.unionByName(one)
    return every.join(out.log.frame().select("number", "n"), "number").select("number", "n", "changes")


#: Slots of the first 31 days with what either host has: the first one's captures, and one of the other's where it has none.
BOTH = """, own AS (SELECT camera, g, min(name) AS lo, max(name) AS hi FROM valid WHERE host = 'a' GROUP BY ALL),
    both_hosts AS (SELECT * FROM own UNION ALL SELECT camera, g, min(name), min(name) FROM valid v WHERE host = 'b' AND NOT EXISTS (SELECT 1 FROM own o WHERE o.camera = v.camera AND o.g = v.g) GROUP BY camera, g),
    kept AS (SELECT c.camera, r.g, f.lo, max(f.g) OVER w AS lg, max_by(f.lo, f.g) OVER w AS llo, max_by(f.hi, f.g) OVER w AS lhi FROM (SELECT DISTINCT camera FROM own) c CROSS JOIN range(0, 8928) r(g)
    LEFT JOIN both_hosts f ON f.camera = c.camera AND f.g = r.g WINDOW w AS (PARTITION BY c.camera ORDER BY r.g ROWS UNBOUNDED PRECEDING))"""


@query("nightly_archive", with_views("valid", f"""{BOTH} SELECT camera, '2024-01' AS month, g AS frame, CASE WHEN lo IS NOT NULL THEN 'P' WHEN g - lg <= 6 THEN 'H' ELSE 'M' END AS state,
    CASE WHEN lg // 288 = g // 288 THEN llo ELSE lhi END AS src FROM kept"""))  # fmt: skip
def nightly_archive(spark, d):
    """The archive's runs of two nights in February: January merged from the other host, made, joined, and left alone."""
    c = views.captures(spark, d)
    archive = nightly.Archive.at(spark, scratch(spark, "archive"))
    for as_of in ("2024-02-02", "2024-02-03"):
        nightly.nightly(c.filter("host = 'a'"), c.filter("host = 'b'"), archive, as_of)
    return archive.months.read().withColumn("frame", F.col("frame").cast("long"))
