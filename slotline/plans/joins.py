"""Queries over joins that Spark has no operator for: as-of, networks, and scans of a landed tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotline.operators import asof, capture, metrics, networks, timeline
from slotline.plans.registry import query
from slotline.sources import files, views
from slotline.sources.views import with_views

#: Views by user and hour: times with many ties.
VIEWS_SQL = "SELECT user_id AS u, date_trunc('hour', ts) AS t, event_id, value FROM events WHERE event_type = 'view'"


@query("asof_join", f"""SELECT c.event_id, v.event_id AS viewed, v.value FROM (SELECT *, date_trunc('hour', ts) AS t FROM events WHERE event_type = 'click') c
    ASOF LEFT JOIN (SELECT u, t, max(event_id) AS event_id, max_by(value, event_id) AS value FROM ({VIEWS_SQL}) GROUP BY u, t) v ON c.user_id = v.u AND c.t >= v.t""")  # fmt: skip
def asof_join(spark, d):
    """Each click with its user's latest view of the same hour or before."""
    e = views.read(spark, d, "events").withColumn("at", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
    clicks, seen = e.filter("event_type = 'click'"), e.filter("event_type = 'view'")
    found = asof.asof_join(clicks.select("user_id", "at", "event_id"), seen.select("user_id", "at", "event_id", "value"), ["user_id"], "at", "at", ["event_id"])
    return found.select("event_id", F.col("match.event_id").alias("viewed"), F.col("match.value").alias("value"))


@query("asof_strict", """SELECT c.event_id, v.event_id AS before FROM events c ASOF LEFT JOIN (SELECT ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY ts) v ON c.ts > v.ts""")
def asof_strict(spark, d):
    """Each event with the last error of anyone strictly before it: no key at all."""
    e = views.read(spark, d, "events")
    found = asof.asof_join(e.select("event_id", "ts"), e.filter("event_type = 'error'").select("ts", "event_id"), [], "ts", "ts", ["event_id"], strict=True)
    return found.select("event_id", F.col("match.event_id").alias("before"))


NETS_SQL = """nets AS (SELECT (c_custkey * 2654435761 % 4294967296) AS base, 4 + c_custkey % 29 AS bits FROM customer),
    named AS (SELECT (base // (1::BIGINT << (32 - bits))) * (1::BIGINT << (32 - bits)) AS lo, bits, concat_ws('.', base // 16777216, base // 65536 % 256, base // 256 % 256, base % 256) || '/' || bits AS net FROM nets),
    picked AS (SELECT lo, bits, min(net) AS net FROM named GROUP BY lo, bits),
    asked AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id * 40503 * 65537 % 4294967296 ELSE ((event_id % (SELECT count(*) FROM customer) + 1) * 2654435761 + user_id % 16) % 4294967296 END AS ip FROM events)"""


def dotted(at):
    return F.concat_ws(".", *[F.floor(at / (1 << s)) % 256 for s in (24, 16, 8, 0)])


def _networks(spark, d):
    """Networks of 4 to 32 bits, many of which nest."""
    c = views.read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return c.select(F.concat(dotted(F.col("k") * 2654435761 % (1 << 32)), F.lit("/"), (4 + F.col("k") % 29).cast("string")).alias("net"))


@query("network_lookup", f"""WITH {NETS_SQL} SELECT event_id, net FROM (SELECT a.event_id, p.net, row_number() OVER (PARTITION BY a.event_id ORDER BY p.bits DESC NULLS LAST) AS rn
    FROM asked a LEFT JOIN picked p ON a.ip >= p.lo AND a.ip < p.lo + (1::BIGINT << (32 - p.bits))) WHERE rn = 1""")  # fmt: skip
def network_lookup(spark, d):
    """Each address with the longest network that holds it; two thirds of them lie in a network of their own."""
    e, n = views.read(spark, d, "events"), views.read(spark, d, "customer").agg(F.count("*").alias("n"))
    own = ((F.col("event_id") % F.col("n") + 1) * 2654435761 + F.col("user_id") % 16) % (1 << 32)
    asked = e.join(F.broadcast(n)).select("event_id", dotted(F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 40503 * 65537 % (1 << 32)).otherwise(own)).alias("ip"))  # one row broadcast
    return networks.longest_prefix(asked, _networks(spark, d)).select("event_id", "net")


@query("network_intervals", f"""WITH {NETS_SQL}, cuts AS (SELECT DISTINCT lo AS cut FROM picked UNION SELECT DISTINCT lo + (1::BIGINT << (32 - bits)) FROM picked),
    apart AS (SELECT cut AS lo, coalesce(lead(cut) OVER (ORDER BY cut), 4294967296) - 1 AS hi FROM cuts WHERE cut < 4294967296)
    SELECT lo, hi, net FROM (SELECT a.lo, a.hi, p.net, row_number() OVER (PARTITION BY a.lo ORDER BY p.bits DESC) AS rn FROM apart a JOIN picked p ON a.lo >= p.lo AND a.lo < p.lo + (1::BIGINT << (32 - p.bits))) WHERE rn = 1""")  # fmt: skip
def network_intervals(spark, d):
    return networks.intervals(_networks(spark, d)).select("lo", "hi", "net")


def _landed(spark, d):
    frame = views.captures(spark, d).select("host", "camera", "name", "bytes", "ts", "event_id")
    where = files.scratch(spark, "landed")
    files.land_captures(frame, where)
    return files.landed(spark, where, frame.schema)


@query("landed_scan", with_views("captures", """SELECT host, camera, day_dir AS day, name, bytes FROM captures WHERE name LIKE '2024-01-1%' AND bytes >= 1024
    AND regexp_matches(name, '^[0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{2}:[0-9]{2}:[0-9]{2}\\.jpg$')"""))  # fmt: skip
def landed_scan(spark, d):
    """All captures landed by camera and day, then those of ten days read."""
    return capture.scan_landed(_landed(spark, d), "2024-01-1").select("host", "camera", "day", "name", "bytes")


@query("landed_late_days", with_views("valid manifest", """SELECT host, camera, day_dir AS day, name FROM captures c WHERE EXISTS (SELECT 1 FROM (SELECT camera, g FROM valid WHERE day_dir <= '2024-01-03' EXCEPT SELECT camera, g FROM manifest WHERE state = 'P') l
    WHERE l.camera = c.camera AND strftime(DATE '2024-01-01' + INTERVAL (l.g // 288) DAY, '%Y-%m-%d') = c.day_dir)"""))  # fmt: skip
def landed_late_days(spark, d):
    """Captures of the first three days' late days, of which only those partitions are read."""
    from slotline.plans.timelines import manifest

    every = views.valid(views.captures(spark, d)).filter("day_dir <= '2024-01-03'")
    late = timeline.late_arrivals(every, manifest(spark, d).filter("state = 'P'"))
    day = F.date_format(F.date_add(F.lit(views.ORIGIN).cast("date"), F.floor(F.col("g") / 288).cast("int")), "yyyy-MM-dd")
    wanted = files.settled(late.select("camera", day.alias("day")).distinct(), "late")
    return capture.scan_keys(_landed(spark, d), wanted.filter("camera IS NOT NULL"), "camera", "day").select("host", "camera", "day", "name")


#: Sizes of the files, so that the tree stays small.
FILE_BYTES = 4096


@query("scan_captures", with_views("captures", f"""SELECT host, camera, day_dir, name, max(bytes % {FILE_BYTES}) AS bytes FROM captures WHERE host = 'a' AND day_dir LIKE '2024-01-1%' GROUP BY ALL"""))
def scan_captures(spark, d):
    """One host's captures as files of a tree, of which the folders of ten days are listed."""
    c = views.captures(spark, d).filter("host = 'a'")
    one = c.groupBy("camera", "day_dir", "name").agg(F.max(F.col("bytes") % FILE_BYTES).alias("bytes"))
    root = files.scratch(spark, "tree")
    files.write_tree(one, root)
    return files.scan_captures(spark, root, "a", "2024-01-1")


@query("counter_increase_by_key", """SELECT event_id, user_id, rise FROM (SELECT event_id, user_id, greatest(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS rise FROM events) WHERE rise > 0""")
def counter_increase_by_key(spark, d):
    """Rises over all events of a user, most of which are the first of their day: the border carry at work."""
    e = views.read(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return metrics.counter_increase(e, "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", "rise")
