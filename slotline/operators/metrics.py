"""Observations as samples, probe and counter statistics, bursts, failure context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotline.operators.ranks import before_within, ranked, ranked_within
from slotline.sources.files import settled

OBSERVATION = T.StructType(
    [
        T.StructField(
            "observations",
            T.ArrayType(
                T.StructType(
                    [T.StructField("observationTimeUtc", T.StringType())]
                    + [
                        T.StructField(n, T.DoubleType())
                        for n in (
                            "airTemperature", "feelsLikeTemperature", "windSpeed", "windGust", "windDirection",
                            "cloudCover", "seaLevelPressure", "relativeHumidity", "precipitation",
                        )
                    ]
                    + [T.StructField("conditionCode", T.StringType())]
                )
            ),
        )
    ]
)
#: Fields and the metric that each becomes, fixed values in the order of the exposition.
METRICS = [
    ("airTemperature", "weather_station_air_temperature_celsius"),
    ("feelsLikeTemperature", "weather_station_air_feels_like_celsius"),
    ("windSpeed", "weather_station_wind_speed_ms"),
    ("windGust", "weather_station_wind_gust_ms"),
    ("windDirection", "weather_station_wind_direction_degrees"),
    ("cloudCover", "weather_station_cloud_cover_percent"),
    ("seaLevelPressure", "weather_station_sea_level_pressure_hpa"),
    ("relativeHumidity", "weather_station_relative_humidity_percent"),
    ("precipitation", "weather_station_precipitation_mm"),
]
CONDITION = "weather_station_condition"


def observations(docs: DataFrame) -> DataFrame:
    """One row per observation of a day document."""
    rows = docs.select("station", F.explode(F.from_json("doc", OBSERVATION)["observations"]).alias("o"))
    return rows.select("station", "o.*")


def epoch_ms(observed, strict: bool = False):
    """A UTC time's milliseconds; a bad one fails the batch if strict, else gives null."""
    read = F.to_timestamp if strict else F.try_to_timestamp
    return F.unix_millis(read(observed, F.lit("yyyy-MM-dd HH:mm:ss") if not strict else "yyyy-MM-dd HH:mm:ss"))


def samples(rows: DataFrame) -> DataFrame:
    """(metric, station, code, value, ts_ms, line): required numbers default to 0; a null cover or code gives none."""
    ts = epoch_ms(F.col("observationTimeUtc"))
    field = lambda n: F.col(n) if n == "cloudCover" else F.coalesce(n, F.lit(0.0))
    parts = [
        F.struct(F.lit(m).alias("metric"), F.lit(None).cast("string").alias("code"), field(n).alias("value")) for n, m in METRICS
    ]
    parts.append(
        F.struct(
            F.lit(CONDITION).alias("metric"),
            F.col("conditionCode").alias("code"),
            F.when(F.col("conditionCode").isNotNull(), 1.0).alias("value"),
        )
    )
    long = rows.select("station", ts.alias("ts_ms"), F.explode(F.array(*parts)).alias("s")).filter(F.col("s.value").isNotNull())
    labels = F.concat(
        F.lit('{station="'), "station", F.when(F.col("s.code").isNotNull(), F.concat(F.lit('",code="'), "s.code")).otherwise(F.lit("")), F.lit('"}')
    )
    # whole numbers print without a fraction
    whole = F.col("s.value") == F.floor("s.value")
    number = F.when(whole, F.col("s.value").cast("long").cast("string")).otherwise(F.col("s.value").cast("string"))
    line = F.concat("s.metric", labels, F.lit(" "), number, F.lit(" "), F.col("ts_ms").cast("string"))
    return long.select(F.col("s.metric").alias("metric"), "station", F.col("s.code").alias("code"), F.col("s.value").alias("value"), "ts_ms", line.alias("line"))


def any_failed(log: DataFrame, step: str = "5 minutes") -> DataFrame:
    """Per probe round, whether any input failed."""
    rounds = log.groupBy(F.window("ts", step)["start"].alias("start"))
    return rounds.agg(F.bool_or("failed").alias("failed"), F.count("*").alias("inputs"))


#: Ranks of one key that a task takes together, where a frame of rows goes back over few.
STRETCH = 4096


def _by_day(column: str):
    return F.to_date(F.col(column).cast("timestamp_ntz"))


def rolling_probe(probes: DataFrame, keep: int = 10, timeout: float = 5.0) -> DataFrame:
    """Mean, least and greatest of the answered among a target's last ``keep`` probes, and the share lost.

    A target's probes are dealt in stretches of ranks, each with the ``keep - 1`` probes before it, so that a target with
    very many of them is no single task.
    """
    probes = ranked_within(probes, "target", _by_day("ts"), ["ts", "event_id"], "_at")
    stretch = F.floor((F.col("_at") - 1) / STRETCH)
    carried = (F.col("_at") - 1) % STRETCH >= STRETCH - (keep - 1)
    both = F.when(carried, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))
    dealt = probes.withColumn("_stretch", F.explode(both)).withColumn("_own", F.col("_stretch") == stretch)
    w = W.partitionBy("target", "_stretch").orderBy("_at").rowsBetween(-(keep - 1), 0)
    lost = F.col("rtt") > timeout
    got = F.when(~lost, F.col("rtt"))
    seen = dealt.select(
        "event_id", "target", "_own",
        F.avg(got).over(w).alias("mean"), F.min(got).over(w).alias("least"), F.max(got).over(w).alias("most"),
        F.avg(lost.cast("double")).over(w).alias("loss"),
    )
    return seen.filter("_own").drop("_own")


def counter_increase(readings: DataFrame, key: str, order: list[str], value: str, block: Column | None = None) -> DataFrame:
    """Readings at which a counter rose, and by how much; a reset counts as no rise.

    A key's readings are dealt in blocks (by default, days of the first of ``order``), and the last reading of a block is
    handed on to the next one that has any.
    """
    seen = before_within(readings, [key], _by_day(order[0]) if block is None else block, order, value, "_was")
    return seen.withColumn("rise", F.greatest(F.col(value) - F.col("_was"), F.lit(0))).drop("_was").filter(F.col("rise") > 0)


def burst_classify(events: DataFrame, key: str, window_seconds: int, throttle: int, reject: int) -> DataFrame:
    """ok, throttle or reject by the events of a key in the trailing window, the present one counted.

    Time is cut into blocks as long as the window, and each event also stands in the block after its own: a window looks
    into no other, so tasks grow with a key's events in two blocks and not with all of them.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    length = window_seconds * 1_000_000
    block = F.floor(F.col("us") / length)
    dealt = events.withColumn("us", micros).withColumn("_block", F.explode(F.array(block, block + 1)))
    w = W.partitionBy(key, "_block").orderBy("us").rangeBetween(-length, 0)
    counted = dealt.withColumn("n", F.count("*").over(w)).filter(F.col("_block") == block).drop("us", "_block")
    return counted.withColumn("verdict", F.when(F.col("n") >= reject, "reject").when(F.col("n") >= throttle, "throttle").otherwise("ok"))


def failure_context(log: DataFrame, n: int = 1000) -> DataFrame:
    """For each failure, the n records of its unit before it: (unit, failure, record, back)."""
    numbered = ranked_within(log, "unit", _by_day("ts"), ["ts", "event_id"], "rn").select("unit", "event_id", "failed", "rn")
    numbered = settled(numbered, "numbered")  # read twice, as failures and as records
    # a record's block of n ranks, and the one after it, hold every failure that may want it: an equality on the block
    block = F.floor(F.col("rn") / n)
    failures = numbered.filter("failed").select(
        "unit", F.col("event_id").alias("failure"), F.col("rn").alias("at"), F.explode(F.array(block, block - 1)).alias("b")
    )
    records = numbered.select("unit", F.col("event_id").alias("record"), "rn", block.alias("b"))
    found = failures.join(records, ["unit", "b"]).filter(F.col("rn").between(F.col("at") - n, F.col("at") - 1))
    return found.select("unit", "failure", "record", (F.col("at") - F.col("rn")).cast("long").alias("back"))


def resample(samples_: DataFrame, series: list[str], step: str) -> DataFrame:
    """The latest sample of each series in each step."""
    return samples_.groupBy(*series, F.window("ts", step)["start"].alias("start")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value")
    )


def thread_order(messages: DataFrame) -> DataFrame:
    """Messages with their thread's rank (most recent first) and their own rank within it."""
    latest = messages.groupBy("thread").agg(F.max("ts").alias("latest"))
    threads = ranked(latest, [F.col("latest").desc(), F.col("thread").asc()], "thread_rank")
    own = ranked_within(messages, "thread", _by_day("ts"), ["ts", "event_id"], "message_rank")
    return own.join(threads.drop("latest"), "thread")
