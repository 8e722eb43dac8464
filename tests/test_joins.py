"""As-of joins, networks, newest rows and carried values against brute force; hot keys are many tasks; scans are pruned."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from slotline.operators import asof, capture, metrics, networks, ranks, retention
from slotline.sources import files, views


def sides(seed, n=300):
    rng = random.Random(seed)
    key = lambda: rng.choice(["a", "a", "a", "b", None])
    at = lambda: rng.choice([None, *[x * 100 for x in range(60)]])
    return [(i, key(), at()) for i in range(n)], [(i, key(), at()) for i in range(n // 3)]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("keys", [["k"], []])
def test_asof_brute_force(spark, strict, keys):
    left, right = sides(1)
    a = spark.createDataFrame(left, "i int, k string, at long")
    b = spark.createDataFrame(right, "j int, k string, at long")
    got = asof.asof_join(a, b, keys, "at", "at", ["j"], strict, block=lambda at: F.floor(at / 700))
    for r in got.collect():
        fits = [(at, j) for j, k, at in right if at is not None and r.at is not None and (not keys or (k is not None and k == r.k)) and (at < r.at or (at == r.at and not strict))]
        want = max(fits, default=None)
        assert (None if r.match is None else (r.match.at, r.match.j)) == want
    assert got.count() == len(left)


def test_asof_empty_sides(spark):
    left, right = sides(2)
    a, b = spark.createDataFrame(left, "i int, k string, at long"), spark.createDataFrame(right, "i int, k string, at long")
    by = dict(keys=["k"], left_at="at", right_at="at", ties=["i"], block=lambda at: F.floor(at / 700))
    assert asof.asof_join(a, b.limit(0), **by).filter("match IS NOT NULL").count() == 0
    assert asof.asof_join(a.limit(0), b, **by).count() == 0


def tasks_with_rows(frame):
    return frame.select(F.spark_partition_id().alias("p")).distinct().count()


def test_hot_key_is_many_tasks(spark):
    """One key holds all rows: no window over it, so the rows of the result are in many partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        e = spark.range(20_000).selectExpr("0L AS unit", "timestamp_seconds(1704067200 + id * 130) AS ts", "id AS event_id", "(id % 97) * 1.0D AS value", "id % 50 = 0 AS failed")
        hot = [
            metrics.counter_increase(e, "unit", ["ts", "event_id"], "value"),
            ranks.ranked_within(e, "unit", F.to_date("ts"), ["ts", "event_id"]),
            asof.asof_join(e, e.filter("failed"), ["unit"], "ts", "ts", ["event_id"]),
            metrics.failure_context(e, 5),
        ]
        assert all(tasks_with_rows(f) >= 3 for f in hot)
        plan = retention.keep_last_n(e, 3, ["unit"], ["ts", "event_id"])._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan  # the threshold was made before; here is only a join
        kept = retention.keep_last_n(e, 3, ["unit"], ["ts", "event_id"]).filter("keep").collect()
        assert sorted(r.event_id for r in kept) == [19_997, 19_998, 19_999]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_newest_keeps_n_of_a_key_before_the_exchange(spark):
    e = spark.range(1000).selectExpr("id % 3 AS k", "id AS at")
    plan = ranks.newest(e, 2, ["k"], ["at"])._jdf.queryExecution().executedPlan().toString()
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line or "Exchange" in line]
    assert any("Final" in x for x in limits) and any("Partial" in x for x in limits)


def test_one_exchange_of_the_rows(spark):
    """Ranking moves the rows once: both sides of the join are dealt by the windows' keys."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = spark.range(1000).selectExpr("id % 3 AS unit", "timestamp_seconds(id * 5000) AS ts", "id AS event_id")
        plan = ranks.ranked_within(e, "unit", F.to_date("ts"), ["ts", "event_id"])._jdf.queryExecution().executedPlan().toString()
        # the rows, the counts of blocks, and those of keys
        assert plan.count("Exchange hashpartitioning") <= 4 and plan.count("event_id") > 0
        moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        assert len(moved) == 4 - ("ReusedExchange" in plan) or len(moved) == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("n", [1, 3])
def test_newest_and_carried_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.randrange(40) * 10_000, rng.choice([None, 1.0, 2.0, 5.0])) for i in range(400)]
    e = spark.createDataFrame(rows, "event_id long, k string, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    kept = {r.event_id for r in retention.keep_last_n(e, n, ["k"], ["ts", "event_id"]).filter("keep").collect()}
    rises = {r.event_id: r.rise for r in metrics.counter_increase(e, "k", ["ts", "event_id"], "value").collect()}
    want, risen = set(), {}
    for k in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        want |= {r[0] for r in own[-n:]}
        for x, y in zip(own, own[1:]):
            if x[3] is not None and y[3] is not None and y[3] > x[3]:
                risen[y[0]] = y[3] - x[3]
    assert kept == want and rises == risen and len(risen) > 20


# --- networks --------------------------------------------------------------------------------------------------------


def holder(trie, ip):
    for bits in range(32, -1, -1):
        found = trie.get((bits, ip >> (32 - bits)))
        if found is not None:
            return found
    return None


def test_hundred_thousand_networks(spark):
    rng = random.Random(5)
    nets = {}
    while len(nets) < 100_000:
        bits = rng.choice([8, 12, 16, 20, 22, 24, 24, 24, 26, 28, 30, 32])
        base = rng.randrange(1 << bits)
        nets[bits, base] = f"{ipaddress.ip_address(base << (32 - bits))}/{bits}"
    odd = ["10.0.0.0/33", "300.1.1.1/8", "x", None, "1.2.3/8", "1.2.3.4", "01.2.3.4/8"]
    frame = spark.createDataFrame([(x,) for x in [*nets.values(), *odd]], "net string")
    asked = [rng.randrange(1 << 32) for _ in range(3000)]
    asked += [(base << (32 - bits)) + rng.choice([0, (1 << (32 - bits)) - 1, -1, 1 << (32 - bits)]) for bits, base in rng.sample(sorted(nets), 3000)]
    asked = [x for x in asked if 0 <= x < 1 << 32]
    rows = [(i, str(ipaddress.ip_address(x))) for i, x in enumerate(asked)] + [(-1, None), (-2, "300.1.1.1"), (-3, "1.2.3"), (-4, "")]
    got = {r.i: r.net for r in networks.longest_prefix(spark.createDataFrame(rows, "i long, ip string"), frame).collect()}
    assert len(got) == len(rows) and all(got[i] is None for i in range(-4, 0))
    assert all(got[i] == holder(nets, x) for i, x in enumerate(asked))
    assert sum(v is not None for v in got.values()) > 3000


@pytest.mark.parametrize("nets", [["0.0.0.0/0"], ["0.0.0.0/0", "255.255.255.255/32", "0.0.0.0/32"], [], ["10.1.2.3/8", "10.0.0.0/8", "10.0.0.0/9"]])
def test_intervals_are_apart_and_cover(spark, nets):
    frame = spark.createDataFrame([(n,) for n in nets], "net string")
    got = sorted((r.lo, r.hi, r.net) for r in networks.intervals(frame).collect())
    assert all(x[1] < y[0] for x, y in zip(got, got[1:]))
    parsed = [(ipaddress.ip_network(n, strict=False), n) for n in nets]
    assert sum(hi - lo + 1 for lo, hi, _ in got) == sum(x.num_addresses for x in ipaddress.collapse_addresses([p for p, _ in parsed]))
    for lo, hi, net in got:
        for at in (lo, hi):
            inside = [(p.prefixlen, n) for p, n in parsed if ipaddress.ip_address(at) in p]
            assert ipaddress.ip_network(net, strict=False).prefixlen == max(b for b, _ in inside)
    assert networks.longest_prefix(spark.createDataFrame([("1.1.1.1",)], "ip string"), frame).first().net in [*nets, None]


# --- scans of a landed tree ------------------------------------------------------------------------------------------


def files_read(frame):
    """How many files the scan of a frame's last run has opened."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if "Scan parquet" in node.nodeName():
            total += node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        for inner in ("plan", "child"):
            if node.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage")):
                todo.append(node.plan())
                break
    return total


@pytest.fixture(scope="module")
def tree(spark, sf, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("landed"))
    frame = views.captures(spark, sf).select("host", "camera", "name", "bytes")
    files.land_captures(frame, where)
    return files.landed(spark, where, frame.schema), frame


def test_a_period_is_a_range_of_partitions(tree):
    landed, frame = tree
    every = files_read(landed)
    for prefix, most in (("2024-01-05", 6), ("2024-01-1", 51), ("2024-01", 150), ("2023", 0)):
        got = capture.scan_landed(landed, prefix)
        plan = got._jdf.queryExecution().executedPlan().toString()
        filters = next(x for x in plan.splitlines() if "PartitionFilters" in x)
        assert f"(day" in filters and f">= {prefix}" in filters and "PushedFilters" in filters
        assert files_read(got) <= min(most, every)
        want = frame.filter(F.col("name").startswith(prefix) & (F.col("bytes") >= 1024)).count()
        assert got.count() == want
    assert every >= 100


def test_listed_partitions_alone_are_read(spark, tree):
    landed, frame = tree
    wanted = spark.createDataFrame([("view", "2024-01-05"), ("click", "2024-01-06"), ("none", "2024-01-07")], "camera string, day string")
    got = capture.scan_keys(landed, wanted.filter("camera <> ''"), "camera", "day")
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()
    want = frame.filter("(camera = 'view' AND name LIKE '2024-01-05%') OR (camera = 'click' AND name LIKE '2024-01-06%')").count()
    assert got.count() == want > 0


def test_no_such_day_in_a_tree(spark, tmp_path):
    frame = spark.createDataFrame([("gate", "2026-07-03", "2026-07-03_10:00:00.jpg", 2000)] * 2, "camera string, day_dir string, name string, bytes long")
    root = f"file://{tmp_path}/tree"
    assert files.write_tree(frame.repartition(2), root) == 2
    assert [tuple(r) for r in files.scan_captures(spark, root, "a", "2026-07").collect()] == [("a", "gate", "2026-07-03", "2026-07-03_10:00:00.jpg", 2000)]
    assert files.scan_captures(spark, root, "a", "2027").count() == 0


def test_a_tree_lists_empty_files_by_tasks(spark, tmp_path):
    """Files without a byte are captures too; folders of other days, drafts and other files are not; the driver lists no folder."""
    cameras, days = ["gate", "a b", "é:1"], ["2026-07-03", "2026-07-04", "2026-08-01"]
    rows = [(c, d, f"{d}_10:00:0{i}.jpg", 0 if i == 1 else 100 * i) for c in cameras for d in days for i in range(4)]
    frame = spark.createDataFrame(rows, "camera string, day_dir string, name string, bytes long")
    root = f"file://{tmp_path}/tree"
    assert files.write_tree(frame, root) == len(rows)
    for other in (".2026-07-03_10:00:09.jpg", "_2026-07-03_10:00:09.jpg", "note.txt"):
        (tmp_path / "tree" / "gate" / "2026-07-03" / other).write_bytes(b"x")
    for prefix in ("2026-07", ""):
        got = files.scan_captures(spark, root, "a", prefix)
        assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(r for r in rows if r[1].startswith(prefix))
        assert {r.host for r in got.collect()} == {"a"} and not got.inputFiles()


def test_captures_of_no_bytes_are_in_the_tree(spark, tmp_path):
    """The registered query on events whose value is a multiple of the files' largest size, against its SQL."""
    import duckdb

    from slotline.plans import registry

    events = spark.range(300).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-09 00:00:00' + make_dt_interval(0, 0, 0, id * 701) AS ts", "id % 7 AS user_id",
        "if(id % 2 = 0, 'view', 'click') AS event_type", "if(id % 3 = 0, 40.96D * (id % 2), id / 8D) AS value", "'{}' AS props",
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = db.execute(registry.ORACLE["scan_captures"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["scan_captures"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and sum(r[-1] == 0 for r in want) > 20
