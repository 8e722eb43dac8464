"""Captures: scans, quarantines, backfill, coverage, completeness. Each function takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.functions import slots


def capture_scan(listing: DataFrame, prefix: str, min_bytes: int = slots.MIN_BYTES) -> DataFrame:
    """Valid captures whose name begins with a period; the period also bounds day_dir, so partitions are pruned."""
    first, last = prefix, prefix + "~"
    return listing.filter(
        F.col("day_dir").between(first[:10], last)
        & F.col("name").startswith(prefix)
        & (F.col("bytes") >= min_bytes)
        & slots.is_name(F.col("name"))
    )


def scan_landed(landed: DataFrame, prefix: str, min_bytes: int = slots.MIN_BYTES) -> DataFrame:
    """``capture_scan`` of captures landed by camera and day: the period is a range of the partition column between
    literals, so files of other days are neither listed nor read."""
    first = prefix[:10]
    near = landed.filter(F.col("day").between(F.lit(first), F.lit(first + "~")))  # no day goes on with a character after ~
    return near.filter(F.col("name").startswith(prefix) & (F.col("bytes") >= min_bytes) & slots.is_name(F.col("name")))


def scan_keys(landed: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Captures of the partitions that ``wanted`` lists. Where that list is small enough to be broadcast, Spark reads it
    first and then only the partitions in it."""
    return landed.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def quarantine(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows named as captures, and strays. A small capture is no stray."""
    named = slots.is_name(F.col("name"))
    return listing.filter(named), listing.filter(~named)


def stray_count(listing: DataFrame, *keys: str) -> DataFrame:
    return quarantine(listing)[1].groupBy(*keys).agg(F.count("*").alias("strays"))


def misplaced(frame: DataFrame, mode: str = "skip") -> DataFrame:
    """Rows under another day's partition: ``skip`` drops them, ``list`` returns them, ``fatal`` fails on the first."""
    wrong = F.col("day_dir") != slots.day_of_name(F.col("name"))
    if mode == "list":
        return frame.filter(wrong)
    if mode == "skip":
        return frame.filter(~wrong)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("misplaced: "), F.col("name")))).otherwise(F.col("name"))
    return frame.withColumn("name", checked.cast("string"))


def bad_clock(frame: DataFrame, mode: str = "list") -> DataFrame:
    """Rows whose slot is 288 or over: listed, dropped (``skip``) or refused (``fatal``)."""
    wrong = slots.slot_of_name(F.col("name")) >= slots.SLOTS_PER_DAY
    if mode == "fatal":
        checked = F.when(wrong, F.raise_error(F.concat(F.lit("bad clock: "), F.col("name")))).otherwise(F.col("name"))
        return frame.withColumn("name", checked.cast("string"))
    return frame.filter(wrong if mode == "list" else ~wrong)


def closed(frame: DataFrame, period_end: Column, as_of: str) -> DataFrame:
    """Periods that lie wholly before ``as_of``."""
    return frame.filter(period_end <= F.lit(as_of).cast("date"))


def backfill_select(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The earliest remote capture of each slot that has no local one. Misplaced remote rows are skipped; local rows
    count by their name alone."""
    keys = ["camera", "day", "slot"]
    slotted = lambda f: f.withColumn("day", slots.day_of_name(F.col("name"))).withColumn("slot", slots.slot_of_name(F.col("name")))
    have = slotted(local).select(*keys)
    picks = misplaced(slotted(remote)).groupBy(*keys).agg(F.min("name").alias("name"))
    return picks.join(have, keys, "left_anti")


def first_per_slot(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.groupBy(*keys).agg(F.min("name").alias("name"))


def slot_coverage(frame: DataFrame) -> DataFrame:
    return frame.select("camera", "g").distinct()


def active_months(frame: DataFrame) -> DataFrame:
    return frame.select("camera", slots.month_of_name(F.col("name")).alias("month")).distinct()


def merge_summary(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Per camera, and in all (null camera): local and remote captures, and how many are to be copied."""
    sides = [(local, "local"), (remote, "remote"), (backfill_select(local, remote), "to_copy")]
    rows = None
    for frame, side in sides:
        one = frame.select("camera", F.lit(side).alias("side"))
        rows = one if rows is None else rows.unionByName(one)
    count = lambda s: F.count(F.when(F.col("side") == s, 1)).alias(f"n_{s}")
    return rows.rollup("camera").agg(*[count(s) for _, s in sides])


def joined_months(done: DataFrame, cameras: DataFrame) -> DataFrame:
    """Months of ``done`` (camera, month) that every camera has: as many distinct ones as cameras there are."""
    wanted = cameras.select("camera").distinct().agg(F.count("*").alias("wanted"))
    have = done.join(cameras.select("camera").distinct(), "camera", "left_semi")
    per = have.groupBy("month").agg(F.countDistinct("camera").alias("n"))
    return per.join(F.broadcast(wanted)).filter(F.col("n") >= F.col("wanted")).select("month")  # one row broadcast


def pending_months(frame: DataFrame, joined: DataFrame, as_of: str) -> DataFrame:
    """Months from the first capture's to the current one that are not joined, with their rank, oldest first."""
    first = frame.agg(F.least(F.min("month"), F.date_format(F.lit(as_of).cast("date"), "yyyy-MM")).alias("first"))
    day = lambda c: F.concat(c, F.lit("-01")).cast("date")
    every = first.filter(F.col("first").isNotNull()).select(
        F.explode(F.sequence(day(F.col("first")), F.trunc(F.lit(as_of).cast("date"), "MM"), F.expr("interval 1 month"))).alias("d")
    )
    return every.select(F.date_format("d", "yyyy-MM").alias("month")).join(joined, "month", "left_anti")


def retention_due(months: DataFrame, joined: DataFrame, as_of: str, keep: int = 3) -> DataFrame:
    """Months with captures, older than the current one and ``keep`` whole ones before it, whose output is joined."""
    newest = F.date_format(F.add_months(F.trunc(F.lit(as_of).cast("date"), "MM"), -(keep + 1)), "yyyy-MM")
    return months.select("month").distinct().filter(F.col("month") <= newest).join(joined, "month", "left_semi")


def to_write(wanted: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Keys not yet written: finished outputs are never written again."""
    return wanted.join(existing.select(*keys), list(keys), "left_anti")


def superseded(days: DataFrame, months: DataFrame) -> DataFrame:
    """Day outputs whose month's output exists."""
    return days.withColumn("month", F.substring("day", 1, 7)).join(months, ["camera", "month"], "left_semi").select("camera", "day")
