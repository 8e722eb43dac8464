"""Connected components of a link table: smallest label by neighbours, with pointer jumping, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(v, component) of every vertex in ``links`` (a, b: longs); the component's name is its smallest vertex.

    Each round takes the least label among a vertex and its neighbours, then the label of that label, so rounds grow
    with the logarithm of a component's width. Only the count of changes reaches the driver. No links: no rows.
    """
    links = links.filter(F.col("a") != F.col("b")).select("a", "b")
    both = written(links.union(links.select("b", "a")).toDF("a", "b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("l"))
    labels = held = written(labels.select("v", F.least("v", "l").alias("l")), "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("l").alias("n"))
        least = labels.join(near, labels.v == near.a).select("v", F.col("l").alias("o"), F.least("l", "n").alias("l"))
        parent = labels.select(F.col("v").alias("p"), F.col("l").alias("q"))
        step = written(
            least.join(parent, least.l == parent.p, "left").select("v", "o", F.least("l", "q").alias("l")), "labels"
        )
        discard(held)
        labels, held = step.select("v", "l"), step
        if step.filter(F.col("o") != F.col("l")).isEmpty():
            discard(both)
            return labels.withColumnRenamed("l", "component")
