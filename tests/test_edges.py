"""Literal edge cases of names, slots, holds, captions, samples, gates and filters."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from slotline.functions import slots
from slotline.functions import text as tx
from slotline.operators import capture, metrics, retention, timeline
from slotline.sources import files, views


def values(spark, column, inputs):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {column[1]}")
    return [r.y for r in frame.select("i", column[0](F.col("x")).alias("y")).orderBy("i").collect()]


def listed(spark, names, day=None):
    rows = [("a", "c", day or n[:10], n, 2048) for n in names]
    return spark.createDataFrame(rows, "host string, camera string, day_dir string, name string, bytes long")


def test_size_boundary(spark):
    rows = [("a", "c", "2026-07-03", "2026-07-03_10:00:00.jpg", b) for b in (1023, 1024)]
    frame = spark.createDataFrame(rows, "host string, camera string, day_dir string, name string, bytes long")
    assert [r.bytes for r in capture.capture_scan(frame, "2026-07").collect()] == [1024]


def test_stray_names(spark):
    frame = listed(spark, ["local-2026-07-03_10:00:00.jpg", "2026-07-03_10:00:00.jpeg", "2026-07-03_10:00:00.jpg"])
    named, strays = capture.quarantine(frame)
    assert (named.count(), strays.count()) == (1, 2)


def test_slots_by_place(spark):
    names = ["2026-07-03_24:00:00.jpg", "2026-07-03_23:60:00.jpg", "2026-07-03_12:75:00.jpg", "2026-07-03_23:59:59.jpg"]
    assert values(spark, (slots.slot_of_name, "string"), names) == [288, 288, 159, 287]
    assert capture.bad_clock(listed(spark, names)).count() == 2
    assert values(spark, (slots.epoch_of_name, "string"), names[:3]) == [None, None, None]
    with pytest.raises(PySparkException):
        capture.bad_clock(listed(spark, names), "fatal").collect()


def test_misplaced(spark):
    frame = listed(spark, ["2026-07-03_10:00:00.jpg"], day="2026-07-04")
    assert capture.misplaced(frame).count() == 0
    assert capture.misplaced(frame, "list").count() == 1
    with pytest.raises(PySparkException):
        capture.misplaced(frame, "fatal").collect()


def manifest(spark, names, days=2, origin="2026-07-03"):
    got = timeline.slot_manifest(views.valid(listed(spark, names), origin), days)
    return {r.g: (r.state, r.src) for r in got.collect()}


def test_first_in_slot_wins(spark):
    m = manifest(spark, ["2026-07-03_10:04:59.jpg", "2026-07-03_10:01:00.jpg"])
    assert m[120] == ("P", "2026-07-03_10:01:00.jpg") and m[119] == ("M", None)


def test_hold_boundary(spark):
    m = manifest(spark, ["2026-07-03_00:50:00.jpg"])
    assert [m[g][0] for g in (10, 11, 16, 17)] == ["P", "H", "H", "M"]
    assert m[17][1] == "2026-07-03_00:50:00.jpg"


def test_hold_over_midnight(spark):
    m = manifest(spark, ["2026-07-03_23:56:00.jpg", "2026-07-03_23:58:00.jpg"])
    assert m[287] == ("P", "2026-07-03_23:56:00.jpg")
    assert {m[288 + s] for s in range(6)} == {("H", "2026-07-03_23:58:00.jpg")}
    assert m[294][0] == "M"


def test_runs_join_over_midnight(spark):
    frame = views.valid(listed(spark, ["2026-07-03_23:00:00.jpg", "2026-07-04_02:00:00.jpg"]), "2026-07-03")
    runs = timeline.missing_runs(timeline.slot_manifest(frame, 2)).orderBy("first").collect()
    assert [(r.first, r.last) for r in runs] == [(0, 275), (283, 311), (319, 575)]


def test_gap_text(spark):
    got = values(spark, (slots.gap_text, "long"), [59, 60, 1439, 1440, 7500])
    assert got == ["59m", "01h 00m", "23h 59m", "1d 00h", "5d 05h"]


def test_summer_time(spark):
    times = ["2026-03-29 00:30:00", "2026-03-29 01:30:00"]
    got = values(spark, (lambda x: F.date_format(slots.local(x.cast("timestamp")), "HH:mm"), "string"), times)
    assert got == ["02:30", "04:30"]
    assert values(spark, (lambda x: slots.zone_letters(x.cast("timestamp")), "string"), times) == ["EET", "EEST"]


def test_month_turn(spark):
    assert values(spark, (slots.next_month, "string"), ["2026-12", "2026-01"]) == ["2027-01", "2026-02"]


@pytest.mark.parametrize("n,want", [(1, {1}), (3, {1, 2, 3}), (6, set(range(1, 7))), (100, {1, 20, 40, 60, 80, 100})])
def test_even_sample(spark, n, want):
    rows = spark.range(1, n + 1).select(F.lit("c").alias("camera"), "id")
    assert {r.ordinal for r in timeline.even_sample(rows, "camera", "id").collect()} == want


def test_none_checked_fails(spark):
    samples = spark.createDataFrame([("c", "x", 0.99)], "camera string, src string, score double")
    sources = spark.createDataFrame([], "camera string, name string")
    row = timeline.sample_reconcile(samples, sources).first()
    assert (row.checked, row.skipped, row.passed) == (0, 1, False)


def test_refresh_gate(spark):
    now = 10_000_000
    rows = spark.createDataFrame([("a", now - 561_599), ("b", now - 561_600), ("c", None)], "key string, last_ts long")
    assert {r.key for r in retention.refresh_due(rows, now).collect()} == {"b", "c"}


def test_due_months(spark):
    months = spark.createDataFrame([("2026-03",), ("2026-04",), ("2026-05",)], "month string")
    assert {r.month for r in capture.retention_due(months, months, "2026-08-01").collect()} == {"2026-03", "2026-04"}


def test_zero_cover_is_a_value(spark):
    docs = [
        ("s", '{"observations":[{"observationTimeUtc":"2026-01-01 00:00:00","airTemperature":12,"cloudCover":0},'
         '{"observationTimeUtc":"2026-01-01 01:00:00","airTemperature":1.5}]}'),
    ]
    got = metrics.samples(metrics.observations(spark.createDataFrame(docs, "station string, doc string")))
    cover = got.filter(F.col("metric").contains("cloud")).collect()
    assert [(r.value, r.line) for r in cover] == [(0.0, 'weather_station_cloud_cover_percent{station="s"} 0 1767225600000')]


def test_natural_versions(spark):
    frame = spark.createDataFrame([("v3.9 v3.10 v3.23",)], "t string").select(F.explode(tx.versions_in(F.col("t"))).alias("v"))
    assert frame.agg(F.max_by("v", tx.natural_key(F.col("v"))).alias("m")).first().m == "3.23"


def test_subnet_edges(spark):
    ips = ["203.0.111.255", "203.0.112.0", "203.0.127.255", "203.0.128.0"]
    assert values(spark, (lambda x: tx.in_subnets(x, ["203.0.112.0/20"]), "string"), ips) == [False, True, True, False]


def test_manifest_width(spark):
    bad = spark.createDataFrame([("0001 P short",)], "value string")
    with pytest.raises(PySparkException):
        files.parse_manifest(bad).collect()


def test_newest_first_over_many_ranges(spark):
    names = spark.range(500).select(F.format_string("n%04d", "id").alias("name"), "id")
    times = spark.range(0, 500, 3).select("id", (F.col("id") % 7).alias("at"))
    got = retention.newest_first(names, times, "id").orderBy("rank").collect()
    at = {i: i % 7 for i in range(0, 500, 3)}
    want = sorted(((-at.get(i, 0), f"n{i:04d}") for i in range(500)))
    assert [(-r.last_ts, r.name) for r in got] == want and [r.rank for r in got] == list(range(1, 501))


def test_binary_tree_scan(spark, tmp_path):
    for day, name, size in (("2026-07-03", "2026-07-03_10:00:00.jpg", 2000), ("2026-07-03", "note.jpeg", 5)):
        folder = tmp_path / "gate" / day
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"x" * size)
    got = files.scan_captures(spark, str(tmp_path), "a")
    assert {(r.camera, r.day_dir, r.name, r.bytes) for r in got.collect()} == {
        ("gate", "2026-07-03", "2026-07-03_10:00:00.jpg", 2000),
        ("gate", "2026-07-03", "note.jpeg", 5),
    }


def test_invariants(spark, sf):
    valid = views.valid(views.captures(spark, sf).filter(F.col("host") == "a"))
    m = timeline.slot_manifest(valid, views.DAYS).cache()
    cameras = valid.select("camera").distinct().count()
    assert m.count() == cameras * views.DAYS * slots.SLOTS_PER_DAY
    assert m.filter("state = 'P'").count() == capture.slot_coverage(valid).count()
    runs = timeline.missing_runs(m)
    assert runs.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] == m.filter("state = 'M'").count()
    assert timeline.late_arrivals(valid, m.filter("state = 'P'")).count() == 0


def test_listings_do_not_grow_with_their_tables(spark, tmp_path):
    from slotline.sources import views

    n = 30_000
    ids = spark.range(n)
    ids.selectExpr("id AS doc_id", "'t' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    ids.selectExpr("id AS p_partkey", "1 AS p_size", "'b' AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    ids.selectExpr(
        "id AS event_id", "timestamp '2024-01-01 10:00:00' AS ts", "0L AS user_id", "'view' AS event_type", "1.0D AS value", "'{\"k\":1}' AS props"
    ).write.parquet(f"{tmp_path}/events.parquet")
    for view, column, mark in (
        (views.checksum_text, "text", "doc-"), (views.version_text, "text", "v"), (views.observation_docs, "doc", "observationTimeUtc")
    ):
        held = [r[0].count(mark) for r in view(spark, str(tmp_path)).select(column).collect()]
        assert sum(held) == n and max(held) <= 1_000


def test_queries_refuse_another_zone(spark, sf):
    from slotline.plans import registry

    spark.conf.set("spark.sql.session.timeZone", "Europe/Vilnius")
    try:
        with pytest.raises(ValueError):
            registry.QUERIES["slot_manifest"](spark, sf)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert registry.in_utc(spark)
