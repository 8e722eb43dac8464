"""Queries on what may be dropped, what is newest, what changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotline.operators import retention as op
from slotline.plans.registry import query
from slotline.sources import views
from slotline.sources.views import with_views

AS_OF = "2024-02-27"
WELL = "regexp_matches(name, '^[0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9:]{8}$')"


@query("keep_last_n", with_views("archives", "SELECT event_id, subject, label, row_number() OVER (PARTITION BY subject, label ORDER BY created DESC, event_id DESC) <= 3 AS keep FROM archives"))
def keep_last_n(spark, d):
    got = op.keep_last_n(views.archives(spark, d), 3, ["subject", "label"], ["created", "event_id"])
    return got.select("event_id", "subject", "label", "keep")


@query("keep_within_or_last", with_views("archives", f"""SELECT event_id, subject, created >= TIMESTAMP '{AS_OF}' - INTERVAL 28 DAY AS fresh, created >= TIMESTAMP '{AS_OF}' - INTERVAL 28 DAY OR
    row_number() OVER (PARTITION BY subject ORDER BY created DESC, event_id DESC) <= 3 AS keep FROM archives WHERE {WELL}"""))  # fmt: skip
def keep_within_or_last(spark, d):
    return op.keep_within_or_last(views.archives(spark, d), AS_OF).select("event_id", "subject", "fresh", "keep")


@query("class_retention", with_views("archives", f"""SELECT event_id, label, date_diff('day', CAST(created AS DATE), DATE '{AS_OF}') > CASE label WHEN 'view' THEN 35 WHEN 'click' THEN 40 WHEN 'signup' THEN 45 ELSE 1000000 END
    AND NOT row_number() OVER (PARTITION BY label ORDER BY created DESC, event_id DESC) = 1 AS expired FROM archives"""))  # fmt: skip
def class_retention(spark, d):
    items = views.archives(spark, d)
    newest = op.latest_item(items, "label", "event_id", ["created", "event_id"]).withColumnRenamed("latest", "current")  # a row for each class
    marked = items.join(F.broadcast(newest), "label").withColumn("is_current", F.col("event_id") == F.col("current"))
    return op.class_retention(marked, {"view": 35, "click": 40, "signup": 45}, AS_OF).select("event_id", "label", "expired")


@query("refresh_due", """SELECT c_custkey AS key, last_ts FROM (SELECT c_custkey, CAST(epoch(max(e.ts)) AS BIGINT) AS last_ts FROM customer LEFT JOIN events e ON c_custkey = user_id GROUP BY ALL)
    WHERE 1706572800 - coalesce(last_ts, 0) >= 561600""")  # fmt: skip
def refresh_due(spark, d):
    names, times = views.activity(spark, d)
    last = names.join(times.groupBy("key").agg(F.max("at").alias("last_ts")), "key", "left")
    return op.refresh_due(last, 1_706_572_800).select("key", "last_ts")


@query("unique_key_check", "SELECT name, count(DISTINCT key) AS keys FROM (SELECT url || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '//' END AS key, regexp_replace(url || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '//' END, '[^A-Za-z0-9+._?=-]+', '-', 'g') AS name FROM pages) GROUP BY name HAVING count(DISTINCT key) > 1")
def unique_key_check(spark, d):
    p = views.read(spark, d, "pages")
    key = F.concat("url", F.when(F.col("page_id") % 2 == 0, "/").otherwise("//"))
    return op.colliding_keys(p.select(key.alias("key")), "key")


@query("newest_first_listing", """SELECT name, last_ts, row_number() OVER (ORDER BY last_ts DESC, name) AS rank FROM (
    SELECT c_name AS name, coalesce(CAST(floor(epoch(max(e.ts))) AS BIGINT), 0) AS last_ts FROM customer LEFT JOIN events e ON c_custkey = user_id GROUP BY c_name, c_custkey)""")  # fmt: skip
def newest_first_listing(spark, d):
    names, times = views.activity(spark, d)
    return op.newest_first(names, times, "key")


@query("latest_item", with_views("archives", "SELECT subject, max_by(name, (created, event_id)) AS latest FROM archives GROUP BY subject"))
def latest_item(spark, d):
    return op.latest_item(views.archives(spark, d), "subject", "name", ["created", "event_id"])


@query("default_with_fallback", with_views("refs", "SELECT repo, coalesce(max(ref) FILTER (is_default), min(ref)) AS ref FROM refs GROUP BY repo"))
def default_with_fallback(spark, d):
    return op.default_ref(views.refs(spark, d))


@query("snapshot_publish_on_change", with_views("old_side new_side", "SELECT key, payload, 'old' AS side FROM (FROM old_side EXCEPT ALL FROM new_side) UNION ALL SELECT key, payload, 'new' FROM (FROM new_side EXCEPT ALL FROM old_side)"))
def snapshot_publish_on_change(spark, d):
    return op.snapshot_changes(*views.snapshots(spark, d))


@query("snapshot_diff", with_views("old_side new_side", """SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM old_side o FULL JOIN new_side n ON o.key = n.key WHERE o.key IS NULL OR n.key IS NULL OR o.payload IS DISTINCT FROM n.payload"""))  # fmt: skip
def snapshot_diff(spark, d):
    return op.snapshot_diff(*views.snapshots(spark, d))


@query("checksum_reuse", """WITH digests AS (SELECT doc_id, md5(text) AS actual, CASE WHEN doc_id % 17 = 0 THEN substr(md5(text), 1, 20) WHEN doc_id % 19 = 0 THEN md5(text || '?')
    WHEN doc_id % 2 = 0 THEN upper(md5(text)) ELSE md5(text) END AS declared FROM documents),
    ok AS (SELECT *, lower(declared) AS md5 FROM digests WHERE regexp_matches(declared, '^[0-9a-fA-F]{32}$')),
    published AS (SELECT md5, min(doc_id) AS published FROM ok WHERE md5 = actual GROUP BY md5)
    SELECT doc_id, published, ok.md5 FROM ok JOIN published USING (md5) WHERE published < doc_id""")  # fmt: skip
def checksum_reuse(spark, d):
    return op.checksum_reuse(views.digests(spark, d))
