"""As-of joins: for each row the newest row of another table at or before it, for any keys and any orderable times.

Both tables are put together and cut into blocks of time. Within a key's block a row sees the last other row before it;
what a block begins with is the last row of the key's populated blocks before, carried over one row for each block. So no
task holds a key, and the tables are moved once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def days(at: Column) -> Column:
    """Blocks of a day, for timestamps."""
    return F.to_date(at.cast("timestamp_ntz"))


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str,
    ties: list[str] | None = None, strict: bool = False, block=days,
) -> DataFrame:
    """Every left row with ``match``: the right row (a struct) with equal keys and the latest time that is not after the
    left row's, or before it if ``strict``; null if there is none.

    Of right rows with equal times the one with the greatest ``ties`` is taken, which must tell them apart. ``block`` maps
    a time to a value that rises with it; both times must have one type. Rows with a null key or time match nothing. No
    match is carried over a block that has one of its own.
    """
    ties = ties or []
    there = right.filter(F.col(right_at).isNotNull())
    for k in keys:
        there = there.filter(F.col(k).isNotNull())
    side = F.lit(0 if not strict else 1)  # at equal times: right rows come first, or after
    right_rows = there.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_at).alias("_at"), side.alias("_side"),
        F.struct(*ties).alias("_tie") if ties else F.lit(None).cast("struct<x:int>").alias("_tie"),
        F.struct(*right.columns).alias("_right"), F.lit(None).cast(_struct_of(left)).alias("_left"),
    )
    left_rows = left.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_at).alias("_at"), (1 - side).alias("_side"),
        F.lit(None).cast(right_rows.schema["_tie"].dataType).alias("_tie"),
        F.lit(None).cast(_struct_of(right)).alias("_right"), F.struct(*left.columns).alias("_left"),
    )
    key = F.struct(F.lit(0).alias("z"), *[f"_k{i}" for i in range(len(keys))])
    both = right_rows.unionByName(left_rows).withColumn("_key", key).withColumn("_block", F.struct(block(F.col("_at")).alias("b")))
    within = W.partitionBy("_key", "_block").orderBy("_at", "_side", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = both.withColumn("_own", F.last("_right", ignorenulls=True).over(within)).filter(F.col("_left").isNotNull())
    # the last right row of each block, carried on to the key's later blocks; blocks of left rows alone have none
    order = F.struct("_at", "_tie")
    lasts = both.groupBy("_key", "_block").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), order)).alias("_last"))
    before = W.partitionBy("_key").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.select("_key", "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    found = own.join(carried, ["_key", "_block"])
    match = F.coalesce("_own", "_carried")
    lacking = [F.col("_at").isNull(), *[F.col(f"_k{i}").isNull() for i in range(len(keys))]]
    for null in lacking:
        match = F.when(null, F.lit(None)).otherwise(match)
    return found.select("_left.*", match.alias("match"))


def _struct_of(frame: DataFrame):
    return frame.select(F.struct(*frame.columns).alias("s")).schema["s"].dataType
