"""Publishing: twice, after a crash anywhere, against another writer; snapshots that change nothing; late ledgers that go on."""

import os
import threading

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from slotline.operators import retention
from slotline.plans import registry, streams
from slotline.sources import publishing, views
from slotline.sources.files import settled_at
from slotline.sources.publishing import Publication, Snapshots
from slotline.streaming import jobs

KEYS = ["camera", "day"]


def days(spark, first, last, mark="x", cameras=("a", "b", None)):
    rows = [(c, f"2024-01-{d:02d}", f"{mark}{d}") for c in cameras for d in range(first, last + 1)]
    return spark.createDataFrame(rows, "camera string, day string, note string")


def rows(frame):
    return sorted(map(str, frame.collect()))


def folders(root):
    return sorted(f for f in os.listdir(f"{root}/rows") if not f.startswith("."))


def logged(root):
    return sorted(f for f in os.listdir(f"{root}/log") if not f.startswith("."))


def test_twice_is_once(spark, tmp_path):
    out = Publication(spark, str(tmp_path), KEYS)
    assert out.read() is None
    assert out.publish(days(spark, 1, 5)) == 0
    assert out.publish(days(spark, 1, 5)) is None and out.publish(days(spark, 2, 3, "other")) is None
    assert out.publish(days(spark, 4, 8, "y")) == 1
    assert rows(out.read()) == rows(days(spark, 1, 5).union(days(spark, 6, 8, "y")))
    assert len(folders(tmp_path)) == 2 and logged(tmp_path) == ["000000000000.json", "000000000001.json"]


def test_a_task_that_dies_half_way(spark, tmp_path):
    """Some of the rows are written, then a task fails: nothing is published, and the next run is as if it were the first."""

    def die(batches):
        for batch in batches:
            if "2024-01-05" in batch.column(1).to_pylist():
                raise RuntimeError("lost")
            yield batch

    frame = days(spark, 1, 8)
    out = Publication(spark, str(tmp_path), KEYS)
    out.publish(days(spark, 1, 2, "first"))
    with pytest.raises(PythonException):
        out.publish(frame.repartition(8, "day").mapInArrow(die, frame.schema))
    assert rows(out.read()) == rows(days(spark, 1, 2, "first")) and len(logged(tmp_path)) == 1
    assert out.publish(frame) == 1
    assert rows(out.read()) == rows(days(spark, 1, 2, "first").union(days(spark, 3, 8)))
    orphans = set(folders(tmp_path)) - {f"_commit={e.folder}" for e in out.log.entries()}
    assert out.vacuum() == [] and len(out.vacuum(older_than=0)) == len(orphans)
    assert len(folders(tmp_path)) == 2 and out.read().count() == 24


@pytest.mark.parametrize("after", [False, True])
def test_a_driver_that_dies_at_the_entry(spark, tmp_path, monkeypatch, after):
    """Rows are staged; the driver dies before, or just after, the entry is made."""
    add = publishing.Log.add

    def dies(self, number, **entry):
        if after:
            add(self, number, **entry)
        raise KeyboardInterrupt

    out = Publication(spark, str(tmp_path), KEYS)
    monkeypatch.setattr(publishing.Log, "add", dies)
    with pytest.raises(KeyboardInterrupt):
        out.publish(days(spark, 1, 5))
    monkeypatch.setattr(publishing.Log, "add", add)
    assert out.publish(days(spark, 1, 5)) == (None if after else 0)
    assert rows(out.read()) == rows(days(spark, 1, 5)) and len(logged(tmp_path)) == 1


def test_another_writer_in_between(spark, tmp_path, monkeypatch):
    """Both have staged when the other one's entry is made: keys that both have are the other's, each key once."""
    add, other = publishing.Log.add, Publication(spark, str(tmp_path), KEYS)
    out = Publication(spark, str(tmp_path), KEYS)
    turns = []

    def late(self, number, **entry):
        if self is out.log and len(turns) < 2:
            turns.append(number)
            other.publish([days(spark, 7, 9, "theirs"), days(spark, 3, 4, "theirs")][len(turns) - 1])
        return add(self, number, **entry)

    monkeypatch.setattr(publishing.Log, "add", late)
    out.publish(days(spark, 1, 5))
    assert len(turns) == 2
    assert rows(out.read()) == rows(days(spark, 7, 9, "theirs").union(days(spark, 3, 4, "theirs")).union(days(spark, 1, 2)).union(days(spark, 5, 5)))


def test_many_writers_at_once(spark, tmp_path):
    """Every key is published by one of them, and every log entry stays."""
    failed = []

    def run(mark):
        try:
            Publication(spark, str(tmp_path), KEYS).publish(days(spark, 1, 6, mark))
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=run, args=(m,)) for m in "pqrs"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = Publication(spark, str(tmp_path), KEYS).read()
    assert not failed and got.count() == 18 == got.select(*KEYS).distinct().count()


def test_tokens(spark, tmp_path):
    """A run that is named adds nothing when it is tried again, even where there are no keys, or nothing to add."""
    out = Publication(spark, str(tmp_path))
    assert out.publish(days(spark, 1, 2), "one") == 0 and out.publish(days(spark, 1, 2), "one") is None
    assert out.publish(days(spark, 1, 2), "two") == 1
    assert out.publish(days(spark, 1, 2).limit(0), "none") == 2 and out.publish(days(spark, 1, 9), "none") is None
    assert out.read().count() == 12


def test_retracted_keys_are_written_again(spark, tmp_path):
    out = Publication(spark, str(tmp_path), KEYS)
    out.publish(days(spark, 1, 6, "old"))
    out.retract(days(spark, 2, 3).select(*KEYS), "late")
    assert out.retract(days(spark, 2, 3).select(*KEYS), "late") is None
    assert rows(out.read()) == rows(days(spark, 1, 1, "old").union(days(spark, 4, 6, "old")))
    out.publish(days(spark, 1, 6, "new"))
    want = rows(days(spark, 1, 1, "old").union(days(spark, 2, 3, "new")).union(days(spark, 4, 6, "old")))
    assert rows(out.read()) == want
    assert out.compact() is not None and rows(out.read()) == want
    assert len(out.vacuum(older_than=0)) == 3 and len(folders(tmp_path)) == 1
    out.retract(days(spark, 4, 4).select(*KEYS))
    assert out.read().count() == 15 and out.publish(days(spark, 4, 7, "newest")) is not None
    assert out.read().count() == 21
    assert out.compact(lambda r: r.filter("day > '2024-01-05'")) is not None and out.read().count() == 6


# --- snapshots -------------------------------------------------------------------------------------------------------


def test_digest_is_of_the_rows_alone(spark):
    frame = spark.range(500).selectExpr("id AS key", "if(id % 7 = 0, null, id * 0.5) AS a", "if(id % 5 = 0, null, id * 0.5) AS b", "array(id) AS c")
    want = publishing.digest(frame)
    assert want.n == 500
    for same in (frame.repartition(7), frame.orderBy(F.desc("key")), frame.select("c", "b", "key", "a")):
        assert publishing.digest(same) == want
    swapped = frame.select("key", F.col("b").alias("a"), F.col("a").alias("b"), "c")
    twice = frame.union(frame.limit(1))
    pairs = frame.union(frame.limit(1)).union(frame.limit(1))
    others = [swapped, twice, pairs, frame.filter("key > 0"), frame.withColumn("a", F.when(F.col("key") != 3, F.col("a"))), frame.withColumn("key", F.col("key").cast("int"))]
    assert len({publishing.digest(f).digest for f in [frame, *others]}) == 7
    assert publishing.digest(frame.limit(0)).n == 0


def test_an_unchanged_snapshot_writes_nothing(spark, sf, tmp_path, monkeypatch):
    old, new = views.snapshots(spark, sf)
    out = Snapshots(spark, str(tmp_path))
    assert out.current() is None and out.publish(old) == 0
    before = folders(tmp_path), logged(tmp_path)
    monkeypatch.setattr(publishing.Log, "stage", lambda *a: pytest.fail("nothing is written"))
    monkeypatch.setattr(publishing.Log, "staged", lambda *a: pytest.fail("no rows are read"))
    assert out.publish(old.repartition(5)) is None and (folders(tmp_path), logged(tmp_path)) == before
    monkeypatch.undo()
    assert out.publish(new) == 1 and rows(out.current()) == rows(new) and rows(out.version(0)) == rows(old)
    assert retention.snapshot_diff(out.version(0), out.current()).count() > 0
    assert out.publish(old) == 2  # back again is a change too
    assert len(out.vacuum(keep=2, older_than=0)) == 1 and rows(out.current()) == rows(old)
    assert out.publish(old.limit(0)) == 3 and out.current().count() == 0


def test_a_snapshot_that_dies_before_its_entry(spark, tmp_path, monkeypatch):
    out = Snapshots(spark, str(tmp_path))
    out.publish(days(spark, 1, 2))
    with monkeypatch.context() as m:
        m.setattr(publishing.Log, "add", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            out.publish(days(spark, 1, 3))
    assert rows(out.current()) == rows(days(spark, 1, 2))
    assert out.publish(days(spark, 1, 3)) == 1 and rows(out.current()) == rows(days(spark, 1, 3))


# --- streams that keep tables ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ordered(spark, sf, tmp_path_factory):
    """The events in twelve files by time, and shuffled over twelve."""
    from pyspark.sql import Window as W

    where = tmp_path_factory.mktemp("files")
    events = spark.read.parquet(f"{sf}/events.parquet")
    parts = events.withColumn("part", F.ntile(12).over(W.orderBy("ts", "event_id"))).cache()
    for k in range(1, 13):
        parts.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{where}/ordered/events.parquet")
    events.repartition(12, F.xxhash64("event_id")).write.parquet(f"{where}/shuffled/events.parquet")
    return where


class Stopped(Exception):
    pass


def stopping(monkeypatch, owner, name, at):
    """The ``at``-th call of a method does its work and then fails."""
    real, calls = getattr(owner, name), [0]

    def call(self, *a, **k):
        out = real(self, *a, **k)
        calls[0] += 1
        if calls[0] == at:
            raise Stopped
        return out

    monkeypatch.setattr(owner, name, call)


def log_of(spark, where, files=1):
    e = jobs.event_stream(spark, where, files=files)
    return e.select(F.col("user_id").alias("unit"), (F.col("event_type") == "error").alias("failed"), "event_id", "ts")


def test_alerts_over_many_files(spark, sf, ordered):
    want = rows(registry.QUERIES["failure_context"](spark, sf))
    got = jobs.failure_alerts(log_of(spark, f"{ordered}/ordered"), 5, compact=3)
    assert rows(got) == want and len(want) > 100


@pytest.mark.parametrize("at", [3, 8])
def test_alerts_after_a_restart(spark, sf, ordered, tmp_path, monkeypatch, at):
    """Stopped after the alerts of a batch, or after its tails, and begun again from the same folder."""
    with monkeypatch.context() as m:
        stopping(m, Publication, "publish", at)
        with pytest.raises(Exception, match="Stopped"):
            jobs.failure_alerts(log_of(spark, f"{ordered}/ordered"), 5, str(tmp_path), compact=2)
    got = jobs.failure_alerts(log_of(spark, f"{ordered}/ordered"), 5, str(tmp_path), compact=2)
    assert rows(got) == rows(registry.QUERIES["failure_context"](spark, sf))


def test_tails_stay_small(spark, ordered, tmp_path):
    """What is kept is the last n records of each unit, not the log."""
    jobs.failure_alerts(log_of(spark, f"{ordered}/ordered"), 2, str(tmp_path), compact=1)
    tails = Publication(spark, f"{tmp_path}/tails").read()
    assert tails.groupBy("unit").count().agg(F.max("count")).first()[0] == 2


def captures_of(spark, where):
    return streams.shaped(jobs.event_stream(spark, where, files=1))


@pytest.mark.parametrize("at", [2, 5])
def test_late_ledger_after_a_restart(spark, sf, ordered, tmp_path, monkeypatch, at):
    used = registry.QUERIES["slot_manifest"](spark, sf).filter("state = 'P'")
    final = streams.views.finalized(streams.views.captures(spark, sf))
    with monkeypatch.context() as m:
        stopping(m, Publication, "publish", at)
        with pytest.raises(Exception, match="Stopped"):
            jobs.late_days(captures_of(spark, f"{ordered}/shuffled"), used, final, str(tmp_path))
    done = len(Publication(spark, f"{tmp_path}/ledger").log.entries())
    got = jobs.late_days(captures_of(spark, f"{ordered}/shuffled"), used.limit(0), final.limit(0), str(tmp_path))
    assert done == at and rows(got) == rows(registry.QUERIES["stream_late_handling"](spark, sf))
    ledger = Publication(spark, f"{tmp_path}/ledger", ["camera", "g"])
    assert len([e for e in ledger.log.entries() if e.kind == "rows"]) == 12
    again = ledger.read().limit(3)
    ledger.retract(again)
    assert ledger.read().count() == got.agg(F.sum("slots")).first()[0] - 3


def test_what_is_settled_stays(spark, tmp_path):
    first = settled_at(days(spark, 1, 2), f"{tmp_path}/used")
    assert rows(settled_at(days(spark, 5, 9), f"{tmp_path}/used")) == rows(first) == rows(days(spark, 1, 2))
