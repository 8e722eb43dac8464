"""Queries over text, digests, addresses, paths and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotline.functions import text as tx
from slotline.plans.registry import query
from slotline.sources import views
from slotline.sources.views import with_views

SUBNETS = ["203.0.112.0/20", "198.51.100.0/24", "192.0.2.0/24"]  #: networks for documentation, as an example
#: A zone and its masks: corners in relative coordinates, fixed values.
ZONE = "0.312,1,0.311,0.269,0.354,0.172,0.396,0.154,0.431,0.102,0.495,0.044,0.61,0.039,0.774,0.097,0.837,0.219,0.758,0.995"
MASKS = [
    "0.269,0.285,0.235,0.567,0.194,0.634,0.095,1,0,1,0,0,0.321,0,0.323,0.222",
    "0.766,1,0.855,0.123,0.818,0.104,0.818,0,1,0,1,1",
]
TRACKED = ("click", "view", "signup")
RULES = [("exclude", r"/[0-9]*[13579]$"), ("include", r"example\.org"), ("exclude", r"page")]
REDIRECT_HOST = "https://blog.example.org"


@query("natural_latest_version", """SELECT grp, arg_max(v, [CAST(x AS INT) FOR x IN string_split(v, '.')]) AS latest FROM (
    SELECT p_brand AS grp, (p_size % 4) || '.' || (p_partkey % 30) AS v FROM part) GROUP BY grp""")  # fmt: skip
def natural_latest_version(spark, d):
    v = views.version_text(spark, d).select("grp", F.explode(tx.versions_in(F.col("text"))).alias("v"))
    return v.groupBy("grp").agg(F.max_by("v", tx.natural_key(F.col("v"))).alias("latest"))


@query("checksum_line_lookup", "SELECT doc_id % 10 AS bucket, sha256(text) AS hash, 'doc-' || doc_id || '.txt' AS file FROM documents")
def checksum_line_lookup(spark, d):
    line = views.checksum_text(spark, d).select("bucket", F.explode(F.split("text", "\n")).alias("line"))
    parsed = line.select("bucket", F.regexp_extract("line", r"^(\S+)\s+(.*)$", 1).alias("hash"), F.regexp_extract("line", r"^(\S+)\s+(.*)$", 2).alias("file"))
    wanted = views.read(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"))
    return parsed.join(wanted, "file", "left_semi").select("bucket", "hash", "file")


@query("hash_to_sri", "SELECT doc_id, 'sha256-' || to_base64(unhex(sha256(text))) AS sri FROM documents")
def hash_to_sri(spark, d):
    return views.read(spark, d, "documents").select("doc_id", tx.sri(F.sha2("text", 256)).alias("sri"))


@query("content_etag", """SELECT page_id, '"' || substr(sha256(html), 1, 32) || '"' AS etag FROM pages""")
def content_etag(spark, d):
    return views.read(spark, d, "pages").select("page_id", tx.content_etag(F.col("html")).alias("etag"))


PIN = "struct<osm:struct<url:string,hash:string>,shelters:struct<url:string,rev:string,hash:string>>"


@query("nested_pin_update", """SELECT page_id, 'https://dl.example.org/' || page_id AS osm_url, sha256(html) AS osm_hash, 'https://git.example.org/data.git' AS url, substr(sha256(html), 1, 9) AS rev, sha256(url || html) AS hash FROM pages""")
def nested_pin_update(spark, d):
    p = views.pins(spark, d).join(views.read(spark, d, "pages").select("page_id", "url", "html"), "page_id")
    digest = F.sha2("html", 256)
    updated = (
        F.from_json("doc", PIN)
        .withField("osm.url", F.concat(F.lit("https://dl.example.org/"), F.col("page_id").cast("string")))
        .withField("osm.hash", digest)
        .withField("shelters.url", F.lit("https://git.example.org/data.git"))
        .withField("shelters.rev", F.substring(digest, 1, 9))
        .withField("shelters.hash", F.sha2(F.concat("url", "html"), 256))
    )
    back = p.select("page_id", F.from_json(F.to_json(updated), PIN).alias("pin"))
    return back.select(
        "page_id", F.col("pin.osm.url").alias("osm_url"), F.col("pin.osm.hash").alias("osm_hash"), "pin.shelters.url", "pin.shelters.rev", "pin.shelters.hash"
    )


CLONED = f"^/[^/]+/([^/]+\\.git/({'|'.join(tx.CLONE_FILES)}|{tx.CLONE_FOLDER}.*))$"


@query("url_rewrite", f"""SELECT page_id, regexp_replace('/o' || (page_id % 3) || '/r' || page_id || '.git/' || CASE page_id % 4 WHEN 0 THEN 'HEAD' WHEN 1 THEN 'info/refs' WHEN 2 THEN 'objects/x' ELSE 'blob' END,
    '{CLONED}', '/\\1') AS path FROM pages""")  # fmt: skip
def url_rewrite(spark, d):
    return views.git_urls(spark, d).select("page_id", tx.clone_rewrite(F.col("url")).alias("path"))


@query("line_redaction", """SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(token|Licensed|@)')), chr(10)) AS text FROM documents""")
def line_redaction(spark, d):
    return views.read(spark, d, "documents").select("doc_id", tx.drop_lines(F.col("text"), "(token|Licensed|@)").alias("text"))


@query("cidr_filter", with_views("requests", """SELECT event_id, ip FROM requests WHERE CAST(split_part(ip, '.', 1) AS BIGINT) = 203 AND CAST(split_part(ip, '.', 2) AS BIGINT) = 0 AND CAST(split_part(ip, '.', 3) AS BIGINT) BETWEEN 112 AND 127"""))
def cidr_filter(spark, d):
    return views.requests(spark, d).filter(tx.in_subnets(F.col("ip"), SUBNETS)).select("event_id", "ip")


PATH = "regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"


@query("redirect_match", with_views("requests", f"""SELECT event_id, '{REDIRECT_HOST}' || {PATH} AS target FROM requests WHERE {PATH} IN (SELECT {PATH} FROM pages WHERE page_id % 5 = 0)"""))
def redirect_match(spark, d):
    path = lambda f: f.withColumn("path", F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1))
    redirects = path(views.read(spark, d, "pages").filter(F.col("page_id") % 5 == 0)).select("path").distinct()
    hits = path(views.requests(spark, d)).join(redirects, "path", "left_semi")
    return hits.select("event_id", F.concat(F.lit(REDIRECT_HOST), "path").alias("target"))


def _ray(flat: str) -> str:
    p = tx.points(flat)
    edges = [
        f"CAST((({y1}::DOUBLE > y) <> ({y2}::DOUBLE > y)) AND x < ({x2}::DOUBLE - {x1}::DOUBLE) * (y - {y1}::DOUBLE) / ({y2}::DOUBLE - {y1}::DOUBLE) + {x1}::DOUBLE AS INT)"
        for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1])
        if y1 != y2
    ]
    return "(" + " + ".join(edges) + ") % 2 = 1"


@query("zone_mask_filter", with_views("points", f"SELECT event_id, label, x, y FROM points WHERE label IN {TRACKED} AND {_ray(ZONE)} AND NOT " + " AND NOT ".join(_ray(m) for m in MASKS)))
def zone_mask_filter(spark, d):
    p = views.points(spark, d)
    x, y = F.col("x"), F.col("y")
    kept = p.filter(F.col("label").isin(*TRACKED) & tx.inside(x, y, tx.points(ZONE)))
    for mask in MASKS:
        kept = kept.filter(~tx.inside(x, y, tx.points(mask)))
    return kept.select("event_id", "label", "x", "y")


@query("first_match_rules", "SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{v}'" for v, p in RULES) + " ELSE 'include' END AS verdict FROM pages")
def first_match_rules(spark, d):
    return views.read(spark, d, "pages").select("page_id", tx.first_match(F.col("url"), RULES).alias("verdict"))


@query("requests_per_host", with_views("requests", "SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS requests FROM requests GROUP BY ALL"))
def requests_per_host(spark, d):
    return views.requests(spark, d).groupBy(F.expr("try_parse_url(url, 'HOST')").alias("host")).agg(F.count("*").alias("requests"))
