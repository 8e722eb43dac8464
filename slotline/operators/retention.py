"""What may be dropped, what is newest, what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.operators.ranks import among_newest, ranked


def keep_last_n(items: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """Every item with keep: whether it is among the newest n of its keys. ``order`` must tell a key's items apart."""
    return among_newest(items, n, keys, order, "keep")


def keep_within_or_last(items: DataFrame, as_of: str, within_days: int = 28, last: int = 3, pattern: str = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9:]{8}$") -> DataFrame:
    """Well-formed items with keep: no older than ``within_days``, or among the newest ``last`` of their subject."""
    named = items.filter(F.col("name").rlike(pattern))
    fresh = F.col("created") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {within_days} days")
    marked = among_newest(named, last, ["subject"], ["created", "event_id"], "among")
    return marked.withColumn("fresh", fresh).withColumn("keep", F.col("fresh") | F.col("among")).drop("among")


def class_retention(items: DataFrame, ages: dict[str, int], as_of: str) -> DataFrame:
    """Items with expired: older than their class allows and not the current one. Classes without an age never expire."""
    days = F.create_map(*[F.lit(x) for pair in ages.items() for x in pair])
    age = F.datediff(F.lit(as_of).cast("date"), F.col("created").cast("date"))
    return items.withColumn("expired", F.coalesce(age > F.get(F.array(F.element_at(days, F.col("label"))), F.lit(0)), F.lit(False)) & ~F.col("is_current"))


def refresh_due(items: DataFrame, as_of: int, age: int = 561_600) -> DataFrame:
    """Items last done ``age`` seconds ago or longer; never counts as due."""
    return items.filter(F.lit(as_of) - F.coalesce("last_ts", F.lit(0)) >= age)


def colliding_keys(items: DataFrame, key: str) -> DataFrame:
    """Normalised names that more than one key shares."""
    name = F.regexp_replace(key, r"[^A-Za-z0-9+._?=-]+", "-")
    return items.groupBy(name.alias("name")).agg(F.countDistinct(key).alias("keys")).filter(F.col("keys") > 1)


def newest_first(names: DataFrame, times: DataFrame, key: str) -> DataFrame:
    """Names ranked by last activity, newest first, then by name; without activity the time is 0."""
    last = times.groupBy(key).agg(F.max("at").alias("at"))
    rows = names.join(last, key, "left").select("name", F.coalesce("at", F.lit(0)).alias("last_ts"))
    return ranked(rows, [F.col("last_ts").desc(), F.col("name").asc()])


def latest_item(items: DataFrame, key: str, item: str, order: list[str]) -> DataFrame:
    """The newest item of each key."""
    return items.groupBy(key).agg(F.max_by(item, F.struct(*order)).alias("latest"))


def default_ref(refs: DataFrame) -> DataFrame:
    """The default ref if a repository has it, else the first by name."""
    return refs.groupBy("repo").agg(F.coalesce(F.max(F.when(F.col("is_default"), F.col("ref"))), F.min("ref")).alias("ref"))


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one side has, with multiplicity: nothing to publish if there are none."""
    return old.exceptAll(new).withColumn("side", F.lit("old")).union(new.exceptAll(old).withColumn("side", F.lit("new")))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Keys added, removed or changed; rows are compared by value, nulls equal."""
    rest = [c for c in old.columns if c != key]
    pack = lambda f, n: f.select(key, F.struct(*rest).alias(n))
    both = pack(old, "o").join(pack(new, "n"), key, "full_outer")
    kind = (
        F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    )
    return both.select(key, kind.alias("change")).filter(F.col("change").isNotNull())


def checksum_reuse(digests: DataFrame) -> DataFrame:
    """Well-formed declared digests that an earlier item with matching content already publishes, letter case aside."""
    ok = digests.filter(F.col("declared").rlike("^[0-9a-fA-F]{32}$")).withColumn("md5", F.lower("declared"))
    published = ok.filter(F.col("md5") == F.col("actual")).groupBy("md5").agg(F.min("doc_id").alias("published"))
    return ok.join(published, "md5").filter(F.col("published") < F.col("doc_id")).select("doc_id", "published", "md5")
