"""The nightly run over an archive: each open month merged, its ended days made, the month joined, its days let go.

Months go in order, oldest first, and each step of a month is published before the next one begins (``publishing``), so a
run that fails or is stopped leaves whole steps, and the next run goes on after them. A merge that fails ends the run, since
nothing after it may be made from captures that are not all there. What is published is never made again, but for days
with captures that their output does not use: they are taken back, their month waits, and the next run makes them anew.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.functions import slots
from slotline.operators import capture, timeline
from slotline.sources.files import settled
from slotline.sources.publishing import Publication


@dataclass
class Archive:
    """What the runs publish: captures taken over from the other host, day outputs, month outputs."""

    merged: Publication
    days: Publication
    months: Publication

    @classmethod
    def at(cls, spark: SparkSession, root: str) -> Archive:
        return cls(
            Publication(spark, f"{root}/merged", ["camera", "day", "slot"]),
            Publication(spark, f"{root}/days", ["camera", "day"]),
            Publication(spark, f"{root}/months", ["camera", "month"]),
        )


def months_between(first: str, last: str) -> list[str]:
    """Months from first to last, as text."""
    at, out = date.fromisoformat(f"{first}-01"), []
    while f"{at:%Y-%m}" <= last:
        out.append(f"{at:%Y-%m}")
        at = (at + timedelta(days=31)).replace(day=1)
    return out


def nightly(local: DataFrame, remote: DataFrame, archive: Archive, as_of: str) -> list[tuple[str, str]]:
    """One run as of a day, which itself has not ended: (month, what was done) in order.

    ``local``, ``remote``: captures (camera, day_dir, name, bytes) of two hosts. Names of well-formed captures whose slot is
    no time of the day, and captures in another day's folder, fail the merge of their month.
    """
    spark = local.sparkSession
    ok = lambda f: f.filter((F.col("bytes") >= slots.MIN_BYTES) & slots.is_name(F.col("name")))
    local, remote = ok(local), ok(remote)
    first = local.agg(F.min(slots.month_of_name(F.col("name")))).first()[0]
    if first is None:
        return []
    origin, told = f"{first}-01", []
    cameras = settled(local.select("camera").distinct(), "cameras")
    now = as_of[:7]
    for month in months_between(min(first, now), now):
        begin = date.fromisoformat(f"{month}-01")
        end = (begin + timedelta(days=31)).replace(day=1)
        if month < now and _joined(cameras, archive.months, month):
            told.append((month, _let_go(archive, month)))
            continue
        _merge(local, remote, archive, month)
        photos = settled(_photos(local, archive, origin, f"{end}"), "photos")
        ended = min(end, date.fromisoformat(as_of))
        if ended > begin:
            _make_days(photos, cameras, archive, begin, ended, origin)
        if month == now:
            told.append((month, "days made"))
        else:
            told.append((month, _join(photos, archive, begin, end, origin)))
    return told


def _joined(cameras: DataFrame, months: Publication, month: str) -> bool:
    """Whether every camera's month is there."""
    done = months.read()
    return done is not None and cameras.join(done.filter(F.col("month") == month), "camera", "left_anti").isEmpty()


def _of_month(frame: DataFrame, month: str) -> DataFrame:
    return frame.filter(F.col("name").startswith(month))


def _merge(local: DataFrame, remote: DataFrame, archive: Archive, month: str) -> None:
    """The earliest remote capture of each slot that the local host lacks."""
    checked = [capture.bad_clock(capture.misplaced(_of_month(f, month), "fatal"), "fatal") for f in (local, remote)]
    archive.merged.publish(capture.backfill_select(*checked))


def _photos(local: DataFrame, archive: Archive, origin: str, before: str) -> DataFrame:
    """(camera, g, name) of local and merged captures before a day."""
    own = local.select("camera", F.col("day_dir").alias("day"), slots.slot_of_name(F.col("name")).alias("slot"), "name")
    merged = archive.merged.read()
    every = own if merged is None else own.unionByName(merged.select(*own.columns))
    return every.filter(F.col("day") < before).select("camera", slots.global_slot(F.col("day"), F.col("slot"), origin).alias("g"), "name")


def _numbered(frame: DataFrame, origin: str) -> DataFrame:
    """With the day and the frame of the day of each slot."""
    d = F.floor(F.col("g") / slots.SLOTS_PER_DAY).cast("int")
    day = F.date_format(F.date_add(F.lit(origin).cast("date"), d), "yyyy-MM-dd")
    return frame.withColumn("day", day).withColumn("frame", F.pmod("g", F.lit(slots.SLOTS_PER_DAY)).cast("int"))


def _make_days(photos: DataFrame, cameras: DataFrame, archive: Archive, begin: date, ended: date, origin: str) -> None:
    """Outputs of days that have ended and have none; a day without captures is one too."""
    start = (begin - date.fromisoformat(origin)).days
    # a camera without any capture so far has days as well
    known = photos.unionByName(cameras.select("camera", F.lit(None).cast("int").alias("g"), F.lit(None).cast("string").alias("name")))
    manifest = timeline.slot_manifest(known, (ended - begin).days, start=start)
    archive.days.publish(_numbered(manifest, origin).select("camera", "day", "frame", "state", "src"))


def _join(photos: DataFrame, archive: Archive, begin: date, end: date, origin: str) -> str:
    """The month's output of every camera whose days are all there and hold every capture; late days are taken back."""
    month = f"{begin:%Y-%m}"
    days = archive.days.read().filter(F.col("day").startswith(month))
    used = days.filter("state = 'P'").select("camera", "day", "frame")
    there = _numbered(photos, origin).filter(F.col("day").startswith(month))
    late = settled(there.join(used, ["camera", "day", "frame"], "left_anti").select("camera", "day").distinct(), "late")
    whole = days.groupBy("camera").agg(F.count("*").alias("n")).filter(F.col("n") == (end - begin).days * slots.SLOTS_PER_DAY)
    ready = whole.join(late, "camera", "left_anti").select("camera")
    index = F.datediff(F.col("day").cast("date"), F.lit(f"{begin}").cast("date"))
    union = timeline.month_union(days.join(ready, "camera", "left_semi").withColumn("day_index", index))
    archive.months.publish(union.select("camera", F.lit(month).alias("month"), F.col("frame").cast("int").alias("frame"), "state", "src"))
    if late.isEmpty():
        _let_go(archive, month)
        return "joined"
    archive.days.retract(late)
    return "waits for late days"


def _let_go(archive: Archive, month: str) -> str:
    """Takes back day outputs that a month's output covers."""
    days, months = archive.days.read(), archive.months.read()
    if days is not None and months is not None:
        done = months.filter(F.col("month") == month).select("camera").distinct()
        covered = days.filter(F.col("day").startswith(month)).join(done, "camera", "left_semi").select("camera", "day").distinct()
        if not covered.isEmpty():
            archive.days.retract(covered)
            return "days let go"
    return "done before"
