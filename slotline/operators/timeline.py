"""Timelines: every slot observed, held or missing; outages; captions; roll-ups; late arrivals; samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotline.functions import slots
from slotline.operators.ranks import ranked_within


def _calendar(valid: DataFrame, first: int, last: int) -> DataFrame:
    """(camera, d) of every camera and day from first to last."""
    return valid.select("camera").distinct().select("camera", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("d"))


def slot_spine(valid: DataFrame, days: int, keep_last: bool = False, start: int = 0) -> DataFrame:
    """Every camera's slots of ``days`` days from day ``start`` on, with the earliest capture where there is one (and the
    last, if asked)."""
    last = [F.max("name").alias("hi")] if keep_last else []
    within = valid if not start else valid.filter(F.col("g") >= start * slots.SLOTS_PER_DAY)
    filled = within.groupBy("camera", "g").agg(F.min("name").alias("name"), *last)
    every = _calendar(valid, start, start + days - 1).select(
        "camera", F.explode(F.sequence(F.col("d") * slots.SLOTS_PER_DAY, (F.col("d") + 1) * slots.SLOTS_PER_DAY - 1)).alias("g")
    )
    return every.join(filled, ["camera", "g"], "left")


def asof_seed(valid: DataFrame, days: int, start: int = 0) -> DataFrame:
    """For each camera and day of the period: the newest capture strictly before the day, and its slot.

    One row per camera and day reaches the window, so its size is that of the calendar, not of the captures.
    """
    per_day = valid.withColumn("d", F.floor(F.col("g") / slots.SLOTS_PER_DAY).cast("int")).groupBy("camera", "d").agg(
        F.max(F.struct("name", "g")).alias("last")
    )
    before = W.partitionBy("camera").orderBy("d").rowsBetween(W.unboundedPreceding, -1)
    every = _calendar(valid, 0, start + days - 1).join(per_day, ["camera", "d"], "left")
    seeded = every.withColumn("seed", F.last("last", ignorenulls=True).over(before)).filter(F.col("d") >= start)
    return seeded.select("camera", "d", F.col("seed.name").alias("seed"), F.col("seed.g").alias("seed_g"))


def slot_manifest(valid: DataFrame, days: int, hold: int = slots.HOLD, start: int = 0) -> DataFrame:
    """P (photo), H (held) or M (missing) for every slot of ``days`` days from day ``start`` on, with the name of the last
    photo; what is held when the first of them begins comes from the days before.

    Two levels, so that work spreads over camera and day: within a day the earliest capture of its slot is carried
    on, and what a day begins with is the last capture of the populated day before it.
    """
    spine = slot_spine(valid, days, start=start).withColumn("d", F.floor(F.col("g") / slots.SLOTS_PER_DAY).cast("int"))
    within = W.partitionBy("camera", "d").orderBy("g").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = F.last(F.when(F.col("name").isNotNull(), F.struct("name", "g")), ignorenulls=True).over(within)
    carried = spine.withColumn("own", own).join(asof_seed(valid, days, start), ["camera", "d"])
    src = F.coalesce("own.name", "seed")
    age = F.col("g") - F.coalesce("own.g", "seed_g")
    state = F.when(F.col("name").isNotNull(), "P").when(age <= hold, "H").otherwise("M")
    return carried.select("camera", "g", state.alias("state"), src.alias("src"))


def missing_runs(manifest: DataFrame) -> DataFrame:
    """Longest runs of missing slots: first, last and the source that they all name.

    Within a day by slot minus rank; runs that meet at midnight are then joined, one row per run and day.
    """
    d = F.floor(F.col("g") / slots.SLOTS_PER_DAY)
    missing = manifest.filter(F.col("state") == "M").withColumn("d", d)
    isle = F.col("g") - F.row_number().over(W.partitionBy("camera", "d").orderBy("g"))
    parts = missing.withColumn("isle", isle).groupBy("camera", "d", "isle").agg(
        F.min("g").alias("first"), F.max("g").alias("last"), F.min("src").alias("src")
    )
    order = W.partitionBy("camera").orderBy("first")
    begins = F.when(F.col("first") == F.lag("last").over(order) + 1, 0).otherwise(1)
    run = F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    joined = parts.withColumn("begins", begins).withColumn("run", run)
    return joined.groupBy("camera", "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("src").alias("src")
    ).drop("run")


def frame_outage(frames: DataFrame, runs: DataFrame) -> DataFrame:
    """Each frame with the run that holds it. The range join is turned into an equality on camera and day: a run is
    listed once for each day that it touches, then the range is checked."""
    day = lambda c: F.floor(c / slots.SLOTS_PER_DAY)
    spread = runs.select(
        F.col("camera").alias("c"),
        "first",
        "last",
        F.col("src").alias("held"),
        F.explode(F.sequence(day(F.col("first")), day(F.col("last")))).alias("d"),
    )
    found = frames.join(
        spread,
        (F.col("camera") == F.col("c")) & (day(F.col("g")) == F.col("d")) & F.col("g").between(F.col("first"), F.col("last")),
    )
    return found.drop("c", "d")


def outage_captions(manifest: DataFrame, origin: str) -> DataFrame:
    """Captions of missing frames: since when there is no data, on the local clock, and for how long."""
    found = frame_outage(manifest.select("camera", "g"), missing_runs(manifest))
    at = slots.slot_time(F.col("g"), origin)
    since = F.coalesce(F.timestamp_seconds(slots.epoch_of_name(F.col("held"))), slots.slot_time(F.col("first"), origin))
    found = found.withColumn("at", at).withColumn("since", since)
    badge, day = slots.local_day_badge(F.col("at")), slots.local_day_badge(F.col("since"))
    clock = F.concat(F.date_format(slots.local(F.col("since")), "HH:mm"), F.lit(" "), slots.zone_letters(F.col("since")))
    minutes = F.floor((F.unix_timestamp("at") - F.unix_timestamp("since") + 30) / 60)
    return found.select(
        "camera",
        "g",
        badge.alias("badge"),
        F.when(day == badge, clock).otherwise(F.concat(F.substring(day, 10, 5), F.lit(" "), clock)).alias("since"),
        slots.gap_text(minutes).alias("gap"),
    )


def state_rollup(manifest: DataFrame, photos: DataFrame, origin: str) -> DataFrame:
    """Photos, frames kept and dropped, and P/H/M counts, per camera, month and day with all totals above them."""
    date = F.date_add(F.lit(origin).cast("date"), F.floor(F.col("g") / slots.SLOTS_PER_DAY).cast("int"))
    keyed = lambda f: f.withColumn("month", F.date_format(date, "yyyy-MM")).withColumn("day", F.date_format(date, "yyyy-MM-dd"))
    states = keyed(manifest).select("camera", "month", "day", "state", F.lit(0).alias("photo"))
    taken = keyed(photos).select("camera", "month", "day", F.lit("").alias("state"), F.lit(1).alias("photo"))
    count = lambda s: F.sum(F.when(F.col("state") == s, 1).otherwise(0)).alias(f"n_{s.lower()}")
    # one row per camera and day goes on to the roll-up
    small = states.unionByName(taken).groupBy("camera", "month", "day").agg(
        F.sum("photo").alias("photos"), count("P"), count("H"), count("M")
    )
    total = lambda c: F.sum(c).alias(c)
    rolled = small.rollup("camera", "month", "day").agg(total("photos"), total("n_p"), total("n_h"), total("n_m"))
    return rolled.withColumn("dropped", F.col("photos") - F.col("n_p"))


def manifest_validate(manifest: DataFrame, days: int, origin: str) -> DataFrame:
    """Per camera: rows, whether they are as many as the period has slots, and photos named for another day."""
    expected = F.date_format(F.date_add(F.lit(origin).cast("date"), F.floor(F.col("g") / slots.SLOTS_PER_DAY).cast("int")), "yyyy-MM-dd")
    misnamed = (F.col("state") == "P") & (slots.day_of_name(F.col("src")) != expected)
    return manifest.groupBy("camera").agg(
        F.count("*").alias("n_rows"),
        (F.count("*") == days * slots.SLOTS_PER_DAY).alias("complete"),
        F.count(F.when(misnamed, 1)).alias("misnamed"),
    )


def late_arrivals(on_disk: DataFrame, used: DataFrame) -> DataFrame:
    """(camera, g) with captures that the finished output does not use."""
    return on_disk.select("camera", "g").distinct().join(used.select("camera", "g"), ["camera", "g"], "left_anti")


def month_union(days: DataFrame) -> DataFrame:
    """Day manifests (camera, day_index, frame, ...) as one: frames are numbered through the month."""
    return days.withColumn("frame", F.col("day_index") * slots.SLOTS_PER_DAY + F.col("frame")).drop("day_index")


def even_sample(rows: DataFrame, key: str, order: str, k: int = 6, block: Column | None = None) -> DataFrame:
    """k rows spread evenly from the first to the last of each key; duplicates among the ordinals collapse.

    Rows are ranked in blocks (by default, days of slots) and lifted by the blocks' counts, so that tasks grow with a
    key's days and not with all its rows.
    """
    block = F.floor(F.col(order) / slots.SLOTS_PER_DAY) if block is None else block
    n = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"))
    numbered = ranked_within(rows, key, block, [order], "ordinal")
    numbered = numbered.join(n, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    picked = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (1 + F.floor(i * (F.col("n") - 1) / (k - 1))).cast("int")
    )
    return numbered.filter(F.array_contains(picked, F.col("ordinal"))).drop("n")


def sample_reconcile(samples: DataFrame, sources: DataFrame, floor: float = 0.9) -> DataFrame:
    """Per camera: samples checked, skipped (source gone) and failing; none checked is a failure."""
    there = sources.select("camera", F.col("name").alias("src")).distinct().withColumn("there", F.lit(True))
    checked = samples.join(there, ["camera", "src"], "left")
    present = F.col("there").isNotNull()
    out = checked.groupBy("camera").agg(
        F.count(F.when(present, 1)).alias("checked"),
        F.count(F.when(~present, 1)).alias("skipped"),
        F.count(F.when(present & (F.col("score") < floor), 1)).alias("failing"),
    )
    return out.withColumn("passed", (F.col("checked") > 0) & (F.col("failing") == 0))
