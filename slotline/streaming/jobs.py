"""Structured Streaming jobs over captures and logs, each the twin of a batch operator.

Contract of the jobs with a watermark (slots, outages, sessions, samples, deduplication): rows may come in any order within
a micro-batch, and no later than ``late`` after the newest row of the batches before it; rows later than that are dropped
by the watermark. ``late_days`` is the path for those: it finds, over all batches, the days that late rows make stale.

Jobs with a ``root`` keep all that they know there: a checkpoint, and tables that a log of commits guards (one entry for
each micro-batch), so that a job that was stopped anywhere goes on from there, and a batch that is tried again adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from slotline.functions import slots
from slotline.operators import capture, metrics, ranks, timeline
from slotline.sources.files import scratch, settled_at
from slotline.sources.publishing import Publication


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", files: int | None = None) -> DataFrame:
    """A table as a stream of its files, its UTC times with a zone so that a watermark takes them.

    ``files``: at most so many in a micro-batch. Without it a run takes in one batch all that is there, so that its
    result does not depend on how the rows are dealt to files; with it, files must come in the order of their times, to
    within the jobs' lateness.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # as a pattern, so that a table may be one file or a folder of them
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    frame = reader.parquet(f"{sf_dir}/{name}.parque[t]")
    return frame.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into files in the shared folder, and read them."""
    spark, where = stream.sparkSession, scratch(stream.sparkSession, "stream")
    job = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{where}/checkpoint")
        .trigger(availableNow=True).start(f"{where}/rows")
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")


def by_batch(stream: DataFrame, root: str, work: Callable[[DataFrame, str], None]) -> None:
    """Run ``work`` on every micro-batch that is there now, with a name for the batch that stays the same when it is tried
    again. A run that goes on from ``root`` goes on with the batch after the last one that ended."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # several actions read it
        try:
            work(held, f"batch-{number}")
        finally:
            held.unpersist()

    job = (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()


def first_per_slot(captures: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The earliest capture of each camera and slot, once the slot is closed."""
    slot = F.window("ts", f"{slots.SLOT_MINUTES} minutes")
    return captures.withWatermark("ts", late).groupBy("camera", slot).agg(F.min("name").alias("name")).select(
        "camera", F.col("window.start").alias("start"), "name"
    )


#: Micro-batches after which the parts of a kept table are put together.
COMPACT = 16


def late_ledger(captures: DataFrame, used: DataFrame, final: DataFrame, root: str, compact: int = COMPACT) -> Publication:
    """The ledger of late slots, brought up to what is there now: (camera, g) with captures that the finished output does
    not use, of days that are not final.

    ``used`` (camera, g) and ``final`` (camera, day) are written to ``root`` when the job first begins and are what every
    batch is compared with. Each batch adds the slots that are not in the ledger yet, in one commit. When a day has been
    made again its slots are retracted, and later ones enter anew.
    """
    used = settled_at(used.select("camera", "g"), f"{root}/used")
    final = settled_at(final.select("camera", "day"), f"{root}/final")
    ledger = Publication(captures.sparkSession, f"{root}/ledger", ["camera", "g"])
    count = [0]

    def work(batch: DataFrame, name: str) -> None:
        open_ = capture.to_write(batch.withColumn("day", F.col("day_dir")), final, "camera", "day")
        ledger.publish(timeline.late_arrivals(open_, used).select("camera", F.col("g").cast("long").alias("g")), name)
        count[0] += 1
        if count[0] % compact == 0:
            ledger.compact()

    by_batch(captures, root, work)
    return ledger


def late_days(captures: DataFrame, used: DataFrame, final: DataFrame, root: str | None = None) -> DataFrame:
    """Days to be made again: late slots of days that are not final, each once however many batches it came in. With a
    ``root``, days that an earlier run has found are among them until they are retracted."""
    root = root or scratch(captures.sparkSession, "late")
    late = late_ledger(captures, used, final, root).read()
    day = F.floor(F.col("g") / slots.SLOTS_PER_DAY)
    return late.groupBy("camera", day.alias("day")).agg(F.count("*").alias("slots"))


class Outages(StatefulProcessor):
    """State of a camera: the last slot seen and whether its outage was told. A timer stands where the hold of that slot
    ends; once it has gone off another one forgets a camera that has sent nothing for ``forget`` slots."""

    def __init__(self, hold: int, forget: int):
        self.hold, self.forget = hold, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "g long, told boolean")

    def _timer(self, g: int, now: int) -> None:
        """The next timer, and no other."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max(g * slots.SLOT_MINUTES * 60_000, now) + 1)  # once the watermark is past it

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a camera's distinct slots of the batch: at most 288 for each day of it
        g = np.unique(np.concatenate([part["g"].to_numpy(dtype=np.int64) for part in rows]))
        last = self.state.get()[0] if self.state.exists() else None
        if last is not None:
            g = np.concatenate([[last], g[g > last]])
        gaps = np.flatnonzero(np.diff(g) > self.hold + 1)
        if len(g) and (last is None or g[-1] > last):
            self.state.update((int(g[-1]), False))
            self._timer(int(g[-1]) + self.hold + 1, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"camera": key[0], "first": g[gaps] + self.hold + 1, "last": pd.array(g[gaps + 1] - 1, dtype="Int64"), "kind": "closed"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, told = self.state.get()
        rows = []
        if told:
            self.state.clear()
        else:
            rows.append((key[0], last + self.hold + 1, None, "open"))
            self.state.update((last, True))
            self._timer(last + self.forget, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(rows, columns=["camera", "first", "last", "kind"]).astype({"last": "Int64"})


def outages(captures: DataFrame, hold: int = slots.HOLD, late: str = "10 minutes", forget_days: int = 366) -> DataFrame:
    """(camera, first, last, kind): ``closed`` when a capture ends a missing run, ``open`` (last null) when the watermark
    passes the first missing slot.

    Captures of one slot become one row before any Python sees them. A camera that is heard of again more than
    ``forget_days`` after its last slot begins anew, without a closed outage. The session needs a state store that keeps
    timers, RocksDB; ``timed_state`` sets it.
    """
    slots_ = captures.withWatermark("since", late).dropDuplicatesWithinWatermark(["camera", "g"]).select("camera", F.col("g").cast("long").alias("g"), "since")
    return slots_.groupBy("camera").transformWithStateInPandas(
        statefulProcessor=Outages(hold, max(forget_days * slots.SLOTS_PER_DAY, hold + 2)),
        outputStructType="camera string, first long, last long, kind string",
        outputMode="Append",
        timeMode="EventTime",
    )


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start within have a state store that keeps timers; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def sessions(captures: DataFrame, gap: str = "36 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of captures between outages, once closed: photo slots up to seven apart belong together."""
    session = F.session_window("slot_ts", gap)
    return captures.withWatermark("slot_ts", late).groupBy("camera", session).agg(
        F.min("g").alias("first"), F.max("g").alias("last"), F.count("*").alias("photos")
    ).select("camera", "first", "last", "photos")


def resampled(samples: DataFrame, step: str, late: str = "10 minutes") -> DataFrame:
    """The latest sample of each series in each closed step."""
    return samples.withWatermark("ts", late).groupBy("target", F.window("ts", step)).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value")
    ).select("target", F.col("window.start").alias("start"), "value")


def deduplicated(captures: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A capture delivered again changes nothing."""
    return captures.withWatermark("ts", late).dropDuplicatesWithinWatermark(["camera", "name"]).select("camera", "name")


def failure_alerts(log: DataFrame, n: int, root: str | None = None, compact: int = COMPACT) -> DataFrame:
    """For each failure the n records of its unit before it, as they were when its batch came: (unit, failure, record, back).

    The log is read once, as the stream brings it. The last n records of each unit are kept as a table: a batch adds its
    own last n of each unit, and now and then the parts are put together to the last n of all, so that the table stays in
    proportion to the units and not to the log. A batch reads of it the units that failed. Records must come in the order
    of their times from batch to batch; within a batch any order will do.
    """
    spark = log.sparkSession
    root = root or scratch(spark, "alerts")
    tails, told = Publication(spark, f"{root}/tails"), Publication(spark, f"{root}/alerts")
    order, count = ["ts", "event_id"], [0]

    def last(rows: DataFrame) -> DataFrame:
        return ranks.newest(rows, n, ["unit"], order).drop("_rank")

    def work(batch: DataFrame, name: str) -> None:
        batch = batch.select("unit", "ts", "failed", "event_id")
        failures = batch.filter("failed").select("unit", F.col("event_id").alias("failure"))
        tail = tails.read()
        both = batch if tail is None else batch.unionByName(tail)
        near = both.join(failures.select("unit").distinct(), "unit", "left_semi")
        found = metrics.failure_context(near, n).join(failures.select("failure"), "failure", "left_semi")
        told.publish(found.select("unit", "failure", "record", "back"), name)
        tails.publish(last(batch), name)  # after the alerts, which a second try would else make from this batch too
        count[0] += 1
        if count[0] % compact == 0:
            tails.compact(last)
            told.compact()

    by_batch(log, root, work)
    return told.read()
