"""Ranks, neighbours and newest rows without a global window and without one window for each key.

Rows of a key are dealt in blocks that rise with the order (stretches of time). What a block must know of those before it,
a count or a last row, is made from one row for each block, and comes back by an equality of key and block. The rows
themselves are moved once: the join asks for the partitioning that the windows had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotline.sources.files import settled


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their rank in ``order``, which must tell all rows apart.

    Rows are dealt by ranges of the order, ranked in each, and lifted by the sizes of the ranges before: no task holds
    all rows, and only one row for each range is broadcast.
    """
    dealt = settled(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranks")
    own = dealt.withColumn("own", F.row_number().over(W.partitionBy("part").orderBy(*order)))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select(
        F.col("part").alias("_part"),
        F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("lower"),
    )
    lifted = own.join(F.broadcast(before), F.col("part") == F.col("_part"))
    return lifted.withColumn(name, (F.col("own") + F.col("lower")).cast("long")).drop("part", "_part", "own", "lower")


def blocked(rows: DataFrame, keys: list[str], block: Column) -> DataFrame:
    """Rows with ``_block`` and with ``_key``, the keys as one value: it is never null, so that null keys are equal in a
    plain equality, whose partitioning is that of a window by it."""
    return rows.withColumn("_block", F.struct(block.alias("b"))).withColumn("_key", F.struct(*keys))


def ranked_within(rows: DataFrame, key: str, block: Column, order: list[str], name: str = "rank") -> DataFrame:
    """Rows with their rank from 1 within ``key`` in ``order``, which must tell a key's rows apart.

    Rows are ranked in each block of a key and lifted by the sizes of the key's blocks before, so that no task holds all
    rows of a frequent key, only its blocks' counts. A null key or block ranks like any other value.
    """
    dealt = blocked(rows, [key], block)
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy("_key", "_block").orderBy(*order)))
    before = W.partitionBy("_key").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("_key", "_block").agg(F.count("*").alias("_n"))
    lower = sizes.select("_key", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lower"))
    lifted = own.join(lower, ["_key", "_block"])
    return lifted.withColumn(name, F.col("_own") + F.col("_lower")).drop("_block", "_own", "_lower", "_key")


def before_within(rows: DataFrame, keys: list[str], block: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Rows with ``value`` of the row before them within the keys in ``order``, which must tell a key's rows apart.

    The last value of each block is handed on to the key's next populated block, whose first row has no other.
    """
    dealt = blocked(rows, keys, block)
    within = W.partitionBy("_key", "_block").orderBy(*order)
    own = dealt.withColumn("_first", F.row_number().over(within) == 1).withColumn("_before", F.lag(value).over(within))
    last = dealt.groupBy("_key", "_block").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    carried = last.select("_key", "_block", F.lag("_last").over(W.partitionBy("_key").orderBy("_block"))["v"].alias("_carried"))
    joined = own.join(carried, ["_key", "_block"])
    return joined.withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before"))).drop("_key", "_block", "_first", "_before", "_carried")


def newest(rows: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """The newest ``n`` rows of each key, with ``_rank``: every task keeps at most n of a key before anything is moved.

    Spark does that where a window's rank is compared with a limit, up to spark.sql.optimizer.windowGroupLimitThreshold
    (1,000 unless set); beyond it a key is one task.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n)


def among_newest(rows: DataFrame, n: int, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Rows with whether they are among the newest ``n`` of their keys; ``order`` must tell a key's rows apart.

    The n-th newest row of each key is a threshold, made from at most n rows of each task and key. It is written, so that
    the join with it has nothing but the two inputs and Spark can split a key that very many rows have.
    """
    at = F.struct(*order)
    least = newest(rows.select(*dict.fromkeys([*keys, *order])), n, keys, order).groupBy(*keys).agg(F.min(at).alias("_least"))
    least = settled(least.select(F.struct(*keys).alias("_key"), "_least"), "thresholds")
    marked = rows.withColumn("_key", F.struct(*keys)).join(least, "_key").withColumn(name, at >= F.col("_least"))
    return marked.drop("_key", "_least")
