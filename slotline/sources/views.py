"""The input tables in the shapes that the operators take: pure expressions, each with the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.functions import slots

ORIGIN, DAYS = "2024-01-01", 30
AS_OF_MONTH = "2001-08-15"
BLOCK = 1_000  #: ids whose rows one listing or document holds at most, so that none grows with its table


def block(key: str):
    return F.floor(F.col(key) / BLOCK).alias("block")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    name = F.concat(F.date_format("ts", "yyyy-MM-dd_HH:mm:ss"), F.lit(".jpg"))
    return e.select(
        F.when(F.col("user_id") % 3 == 0, "b").otherwise("a").alias("host"),
        F.col("event_type").alias("camera"),
        F.substring(name, 1, 10).alias("day_dir"),
        name.alias("name"),
        F.floor(F.col("value") * 100).cast("long").alias("bytes"),
        "ts",
        "event_id",
    )


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("camera"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))


def observation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    row = F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("observationTimeUtc"),
        F.col("value").alias("airTemperature"),
        F.when(k % 4 != 0, k.cast("double")).alias("cloudCover"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("conditionCode"),
    )
    return e.groupBy(
        (F.col("user_id") % 5).cast("string").alias("station"), F.date_format("ts", "yyyy-MM-dd").alias("day"), block("event_id")
    ).agg(F.to_json(F.struct(F.collect_list(row).alias("observations"))).alias("doc")).drop("block")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("unit"), "ts", (F.col("event_type") == "error").alias("failed"), "event_id")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("target"), "ts", F.col("value").alias("rtt"), "event_id")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p = read(spark, sf_dir, "events"), read(spark, sf_dir, "pages").select("page_id", "url")
    n = p.agg(F.count("*").alias("n"))
    ip = F.concat(F.lit("203.0."), (96 + F.col("event_id") % 48).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    numbered = e.select("event_id", ip.alias("ip")).join(F.broadcast(n))  # one row
    return numbered.withColumn("page_id", F.col("event_id") % F.col("n")).join(p, "page_id").select("event_id", "ip", "url")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    spread = lambda m: (F.col("event_id") * m % 1000) / F.lit(1000.0)
    return e.select("event_id", F.col("event_type").alias("label"), spread(7919).alias("x"), spread(104729).alias("y"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    old = c.filter(key % 10 != 0).select(key.alias("key"), F.col("c_acctbal").alias("payload"))
    more = F.when(key % 13 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    return old, c.filter(key % 7 != 0).select(key.alias("key"), more.alias("payload"))


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    stem = F.date_format("ts", "yyyy-MM-dd_HH:mm:ss")
    return e.select(
        F.col("user_id").alias("subject"),
        F.when(F.col("event_type") == "error", F.concat(stem, F.lit(".failed"))).otherwise(stem).alias("name"),
        F.col("ts").alias("created"),
        "event_id",
        F.col("event_type").alias("label"),
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    repo = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))
    return e.select(repo.alias("repo"), F.col("event_type").alias("ref"), (F.col("event_type") == "view").alias("is_default"))


def version_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    one = F.concat(F.lit("v"), (F.col("p_size") % 4).cast("string"), F.lit("."), (F.col("p_partkey") % 30).cast("string"))
    listed = p.groupBy(F.col("p_brand").alias("grp"), block("p_partkey"))
    return listed.agg(F.array_join(F.collect_list(one), " ").alias("text")).drop("block")


def checksum_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    line = F.concat(F.sha2("text", 256), F.lit("  doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    listed = d.groupBy((F.col("doc_id") % 10).alias("bucket"), block("doc_id"))
    return listed.agg(F.array_join(F.collect_list(line), "\n").alias("text")).drop("block")


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    own, other = F.md5("text"), F.md5(F.concat(F.col("text"), F.lit("?")))
    i = F.col("doc_id")
    declared = (
        F.when(i % 17 == 0, F.substring(own, 1, 20)).when(i % 19 == 0, other).when(i % 2 == 0, F.upper(own)).otherwise(own)
    )
    return d.select("doc_id", declared.alias("declared"), own.alias("actual"))


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    digest = F.sha2("url", 256)
    doc = F.to_json(
        F.struct(
            F.struct(F.col("url"), digest.alias("hash")).alias("osm"),
            F.struct(F.col("url"), F.substring(digest, 1, 7).alias("rev"), digest.alias("hash")).alias("shelters"),
        )
    )
    return p.select("page_id", doc.alias("doc"))


def git_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    i = F.col("page_id")
    tail = F.when(i % 4 == 0, "HEAD").when(i % 4 == 1, "info/refs").when(i % 4 == 2, "objects/x").otherwise("blob")
    url = F.concat(F.lit("/o"), (i % 3).cast("string"), F.lit("/r"), i.cast("string"), F.lit(".git/"), tail)
    return p.select("page_id", url.alias("url"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = captures(spark, sf_dir)
    entry = F.concat(
        F.lit("-rw-r--r-- "), F.format_number("bytes", 0), F.lit(" 2024/01/01 00:00:00 "), "day_dir", F.lit("/"), "name"
    )
    folders = c.select("day_dir").distinct().select(F.concat(F.lit("drwxr-xr-x 4096 2024/01/01 00:00:00 "), "day_dir").alias("value"))
    return c.select(entry.alias("value")).union(folders)


def finalized(frame: DataFrame) -> DataFrame:
    """(camera, day) whose output is final: days up to 2024-01-10 for cameras other than ``view``."""
    return (
        frame.filter((F.col("day_dir") <= "2024-01-10") & (F.col("camera") != "view"))
        .select("camera", F.col("day_dir").alias("day"))
        .distinct()
    )


def activity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names, and each name's times."""
    c = read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("key"))
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return c, e


#: The same views in SQL, by name; ``with_views`` puts those that a query names, and what they need, before it.
SQL_VIEWS: dict[str, str] = {
    "captures": """SELECT CASE WHEN user_id % 3 = 0 THEN 'b' ELSE 'a' END AS host, event_type AS camera,
        strftime(ts, '%Y-%m-%d') AS day_dir, strftime(ts, '%Y-%m-%d_%H:%M:%S') || '.jpg' AS name,
        CAST(floor(value * 100) AS BIGINT) AS bytes, ts, event_id FROM events""",
    "valid": """SELECT *, ((CAST(substr(name, 12, 2) AS BIGINT) * 60 + CAST(substr(name, 15, 2) AS BIGINT)) // 5) AS slot,
        date_diff('day', DATE '2024-01-01', CAST(day_dir AS DATE)) * 288
        + ((CAST(substr(name, 12, 2) AS BIGINT) * 60 + CAST(substr(name, 15, 2) AS BIGINT)) // 5) AS g
        FROM captures WHERE bytes >= 1024
        AND regexp_matches(name, '^[0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{2}:[0-9]{2}:[0-9]{2}\\.jpg$')""",
    "filled": """SELECT camera, g, min(name) AS lo, max(name) AS hi FROM valid WHERE host = 'a' GROUP BY camera, g""",
    "spine": """SELECT camera, g FROM (SELECT DISTINCT camera FROM valid WHERE host = 'a') c, range(0, 8640) r(g)""",
    "carried": """SELECT s.camera, s.g, f.lo, max(f.g) OVER w AS lg, max_by(f.lo, f.g) OVER w AS llo, max_by(f.hi, f.g) OVER w AS lhi
        FROM spine s LEFT JOIN filled f ON s.camera = f.camera AND s.g = f.g
        WINDOW w AS (PARTITION BY s.camera ORDER BY s.g ROWS UNBOUNDED PRECEDING)""",
    "manifest": """SELECT camera, g, CASE WHEN lo IS NOT NULL THEN 'P' WHEN g - lg <= 6 THEN 'H' ELSE 'M' END AS state,
        CASE WHEN lg // 288 = g // 288 THEN llo ELSE lhi END AS src FROM carried""",
    "runs": """SELECT camera, min(g) AS first, max(g) AS last, min(src) AS src FROM (
        SELECT *, g - row_number() OVER (PARTITION BY camera ORDER BY g) AS isle FROM manifest WHERE state = 'M') GROUP BY camera, isle""",
    "finalized": """SELECT DISTINCT camera, day_dir AS day FROM captures WHERE day_dir <= '2024-01-10' AND camera <> 'view'""",
    "monthly": """SELECT o_orderpriority AS camera, strftime(o_orderdate, '%Y-%m') AS month FROM orders""",
    "log": """SELECT user_id AS unit, ts, event_type = 'error' AS failed, event_id FROM events""",
    "probes": """SELECT user_id AS target, ts, value AS rtt, event_id FROM events""",
    "requests": """SELECT e.event_id, '203.0.' || (96 + e.event_id % 48) || '.' || (e.user_id % 256) AS ip, p.url
        FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)""",
    "points": """SELECT event_id, event_type AS label, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS x,
        (event_id * 104729 % 1000) / 1000.0::DOUBLE AS y FROM events""",
    "old_side": """SELECT c_custkey AS key, c_acctbal AS payload FROM customer WHERE c_custkey % 10 <> 0""",
    "new_side": """SELECT c_custkey AS key, CASE WHEN c_custkey % 13 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS payload
        FROM customer WHERE c_custkey % 7 <> 0""",
    "archives": """SELECT user_id AS subject, strftime(ts, '%Y-%m-%d_%H:%M:%S') || CASE WHEN event_type = 'error' THEN '.failed' ELSE '' END AS name,
        ts AS created, event_id, event_type AS label FROM events""",
    "refs": """SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS repo, event_type AS ref, event_type = 'view' AS is_default FROM events""",
    "observations": """SELECT CAST(user_id % 5 AS VARCHAR) AS station, strftime(ts, '%Y-%m-%d %H:%M:%S') AS observed, value AS air,
        CASE WHEN CAST(props->>'$.k' AS INT) % 4 <> 0 THEN CAST(props->>'$.k' AS DOUBLE) END AS cloud,
        CASE WHEN event_type <> 'error' THEN event_type END AS condition, CAST(epoch_ms(date_trunc('second', ts)) AS BIGINT) AS ts_ms FROM events""",
    "joined": """SELECT month FROM (SELECT DISTINCT month FROM monthly) m WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT DISTINCT camera FROM monthly) c WHERE NOT EXISTS (
        SELECT 1 FROM monthly d WHERE d.camera = c.camera AND d.month = m.month))""",
}
#: Six photos of each camera, spread evenly, in SQL over the view ``manifest``.
SQL_PICKS = """SELECT * FROM (SELECT camera, g, src, row_number() OVER (PARTITION BY camera ORDER BY g) AS ordinal, count(*) OVER (PARTITION BY camera) AS n FROM manifest WHERE state = 'P')
    WHERE ordinal IN (SELECT 1 + i * (n - 1) // 5 FROM range(0, 6) t(i))"""
NEEDS = {
    "valid": ["captures"], "filled": ["valid"], "spine": ["valid"], "carried": ["spine", "filled"], "manifest": ["carried"],
    "runs": ["manifest"], "finalized": ["captures"], "joined": ["monthly"],
}


def with_views(names: str, body: str) -> str:
    """SQL with the named views before it."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    return ("WITH " + ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in order) + " " if order else "") + body


def valid(frame: DataFrame, origin: str = ORIGIN) -> DataFrame:
    """Captures with a well-formed name and enough bytes, and their slots."""
    ok = frame.filter((F.col("bytes") >= slots.MIN_BYTES) & slots.is_name(F.col("name")))
    slot = slots.slot_of_name(F.col("name"))
    return ok.withColumn("slot", slot).withColumn("g", slots.global_slot(F.col("day_dir"), slot, origin))
