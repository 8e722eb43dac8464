"""The nightly run: order, what it publishes, late captures, failed merges, runs that are stopped."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from slotline.operators import nightly
from slotline.sources.publishing import Publication

SCHEMA = "camera string, day_dir string, name string, bytes long"


def photos(spark, *names, camera="gate"):
    return spark.createDataFrame([(camera, n[:10], f"{n}.jpg", 5000) for n in names], SCHEMA)


def states(frame):
    return {(r.camera, r.frame): (r.state, r.src) for r in frame.collect()}


@pytest.fixture()
def archive(spark, tmp_path):
    return nightly.Archive.at(spark, str(tmp_path))


def days_of(archive):
    return {(r.camera, r.day) for r in archive.days.read().select("camera", "day").distinct().collect()}


def test_months_in_order(spark, archive):
    local = photos(spark, "2026-01-30_10:00:00", "2026-01-30_10:01:00", "2026-02-02_00:01:00")
    remote = photos(spark, "2026-01-30_10:02:00", "2026-01-30_10:07:00", "2026-01-30_10:08:00")
    assert nightly.nightly(local, remote, archive, "2026-02-03") == [("2026-01", "joined"), ("2026-02", "days made")]
    assert [r.name for r in archive.merged.read().collect()] == ["2026-01-30_10:07:00.jpg"]
    got = states(archive.months.read())
    assert len(got) == 31 * 288
    at = 29 * 288 + 120
    assert got["gate", at] == ("P", "2026-01-30_10:00:00.jpg") and got["gate", at + 1] == ("P", "2026-01-30_10:07:00.jpg")
    assert got["gate", at + 7][0] == "H" and got["gate", at + 8] == ("M", "2026-01-30_10:07:00.jpg") and got["gate", 0] == ("M", None)
    assert days_of(archive) == {("gate", "2026-02-01"), ("gate", "2026-02-02")}  # those of a joined month are let go
    assert states(archive.days.read().filter("day = '2026-02-01'"))["gate", 0] == ("M", "2026-01-30_10:07:00.jpg")
    # the next night adds a day and touches nothing else
    before = archive.months.log.entries()
    assert nightly.nightly(local, remote, archive, "2026-02-04") == [("2026-01", "done before"), ("2026-02", "days made")]
    assert archive.months.log.entries() == before and ("gate", "2026-02-03") in days_of(archive)


def test_late_day_is_made_again(spark, archive):
    """A capture that comes after its day was made: the month waits, the next run makes the day anew and joins."""
    local = photos(spark, "2026-01-05_10:00:00", "2026-01-06_10:00:00")
    none = local.limit(0)
    nightly.nightly(local, none, archive, "2026-01-20")
    late = local.union(photos(spark, "2026-01-05_12:00:00"))
    assert nightly.nightly(late, none, archive, "2026-02-01") == [("2026-01", "waits for late days"), ("2026-02", "days made")]
    assert archive.months.read() is None and ("gate", "2026-01-05") not in days_of(archive) and ("gate", "2026-01-06") in days_of(archive)
    assert nightly.nightly(late, none, archive, "2026-02-01") == [("2026-01", "joined"), ("2026-02", "days made")]
    assert states(archive.months.read())["gate", 4 * 288 + 144] == ("P", "2026-01-05_12:00:00.jpg")


def test_one_late_camera_holds_up_no_other(spark, archive):
    a, b = photos(spark, "2026-01-05_10:00:00"), photos(spark, "2026-01-07_10:00:00", camera="yard")
    nightly.nightly(a.union(b), a.limit(0), archive, "2026-01-20")
    late = a.union(b).union(photos(spark, "2026-01-09_10:00:00", camera="yard"))
    nightly.nightly(late, a.limit(0), archive, "2026-02-01")
    assert {r.camera for r in archive.months.read().select("camera").distinct().collect()} == {"gate"}


@pytest.mark.parametrize("odd", [("2026-02-02", "2026-02-02_24:10:00.jpg"), ("2026-02-03", "2026-02-02_10:00:00.jpg")])
def test_a_merge_that_fails_ends_the_run(spark, archive, odd):
    """January is joined; February's merge fails, so nothing of February or later is made."""
    local = photos(spark, "2026-01-05_10:00:00", "2026-03-01_10:00:00")
    remote = spark.createDataFrame([("gate", *odd, 5000)], SCHEMA)
    with pytest.raises(PySparkException):
        nightly.nightly(local, remote, archive, "2026-03-05")
    assert {r.month for r in archive.months.read().select("month").distinct().collect()} == {"2026-01"}
    assert not days_of(archive)


@pytest.mark.parametrize("at", [2, 3, 5])
def test_stopped_anywhere(spark, archive, monkeypatch, at):
    """Stopped after any of a run's steps, and begun again: the outputs are those of one run."""
    local = photos(spark, "2026-01-30_10:00:00", "2026-02-02_00:01:00")
    remote = photos(spark, "2026-01-30_10:07:00", "2026-02-01_10:07:00")
    real, calls = Publication.publish, [0]

    def stop(self, *a, **k):
        out = real(self, *a, **k)
        calls[0] += 1
        if calls[0] == at:
            raise KeyboardInterrupt
        return out

    with monkeypatch.context() as m:
        m.setattr(Publication, "publish", stop)
        with pytest.raises(KeyboardInterrupt):
            nightly.nightly(local, remote, archive, "2026-02-03")
    nightly.nightly(local, remote, archive, "2026-02-03")
    got = states(archive.months.read())
    assert len(got) == 31 * 288 and {k: v for k, v in got.items() if v[0] == "P"} == {
        ("gate", 29 * 288 + 120): ("P", "2026-01-30_10:00:00.jpg"), ("gate", 29 * 288 + 121): ("P", "2026-01-30_10:07:00.jpg"),
    }
    assert days_of(archive) == {("gate", "2026-02-01"), ("gate", "2026-02-02")}
    assert archive.days.read().groupBy("camera", "day", "frame").count().filter(F.col("count") > 1).isEmpty()


def test_nothing_at_all(spark, archive):
    none = photos(spark, "2026-01-05_10:00:00").limit(0)
    assert nightly.nightly(none, none, archive, "2026-02-01") == []
