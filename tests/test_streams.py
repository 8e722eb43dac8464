"""Streams give the same rows however a table is dealt to files, and in many micro-batches when files come in order."""

import pytest
from pyspark.sql import functions as F

from slotline.plans import registry, streams
from slotline.sources import files
from slotline.streaming import jobs

NAMES = sorted(n for n in registry.QUERIES if n.startswith("stream_"))


@pytest.fixture(scope="module")
def dealt(spark, sf, tmp_path_factory):
    """The events shuffled over twenty files, and in twenty files by time."""
    where = tmp_path_factory.mktemp("dealt")
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(20, F.xxhash64("event_id")).write.parquet(f"{where}/shuffled/events.parquet")
    ranges = events.withColumn("part", F.ntile(20).over(jobs_window()))
    for k in range(1, 21):  # one after the other, as the source takes files in the order of their making
        ranges.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{where}/ordered/events.parquet")
    return where


def jobs_window():
    from pyspark.sql import Window as W

    return W.orderBy("ts", "event_id")


def rows(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_from_twenty_shuffled_files(name, spark, sf, dealt):
    assert rows(registry.QUERIES[name](spark, f"{dealt}/shuffled")) == rows(registry.QUERIES[name](spark, sf))


def captures_of(spark, where, files_=None):
    return streams.shaped(jobs.event_stream(spark, where, files=files_))


def test_ordered_files_one_by_one(spark, sf, dealt):
    """Twenty micro-batches in order: nothing is late, so the closed windows are those of one batch."""
    many = jobs.drained(jobs.first_per_slot(captures_of(spark, f"{dealt}/ordered", 1)))
    one = jobs.drained(jobs.first_per_slot(captures_of(spark, sf)))
    assert rows(many) == rows(one) and many.count() > 100
    many = jobs.drained(jobs.sessions(captures_of(spark, f"{dealt}/ordered", 1).filter("host = 'a'")))
    one = jobs.drained(jobs.sessions(captures_of(spark, sf).filter("host = 'a'")))
    assert rows(many) == rows(one) and many.count() > 10


def test_late_days_over_many_batches(spark, sf, dealt):
    """Shuffled files, one in a batch: a day that several batches touch is one row, a slot in two of them counts once."""
    used = registry.QUERIES["slot_manifest"](spark, sf).filter("state = 'P'")
    final = streams.views.finalized(streams.views.captures(spark, sf))
    many = jobs.late_days(captures_of(spark, f"{dealt}/shuffled", 1), used, final)
    assert rows(many) == rows(registry.QUERIES["stream_late_handling"](spark, sf))
    assert many.groupBy("camera", "day").count().filter("count > 1").isEmpty()


def test_too_late_rows_are_dropped_and_found_by_the_late_path(spark, sf, dealt):
    """Files out of order, one in a batch: the watermark drops rows, as the contract says, and adds none."""
    many = set(rows(jobs.drained(jobs.first_per_slot(captures_of(spark, f"{dealt}/shuffled", 1))).select("camera", "start")))
    one = set(rows(jobs.drained(jobs.first_per_slot(captures_of(spark, sf))).select("camera", "start")))
    assert many < one


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        files.shared_folder(Session())
