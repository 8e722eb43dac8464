"""What the text operators share: reading inputs, hash folds, shared scratch tables, Arrow row maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slotline.sources.files import shared_folder

#: A word is a run of anything but the six ASCII white-space characters.
WORD_BREAKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key's text, modulo ``modulus``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(modulus))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table_ = spark.read.schema(df.schema).parquet(path)
    table_.scratch = path
    return table_


def written_in_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """All rows of ``parts`` as one table of ``written``. Each is made by itself: within ``sweeping``, what one has moved goes
    before the next begins."""
    path = None
    for part in parts:
        spark, schema = part.sparkSession, part.schema
        path = path or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        part.write.mode("append").parquet(path)
    table_ = spark.read.schema(schema).parquet(path)
    table_.scratch = path
    return table_


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more. What a returned result still reads stays in the shared
    folder, which is the cluster's to clean."""
    for table_ in tables:
        jvm = table_.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table_.scratch)
        path.getFileSystem(table_.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def sweeping(spark: SparkSession):
    """Within, a step's shuffle files are deleted as soon as it has ended, and not when the driver's next large garbage
    collection finds that no plan needs them. For steps that end in ``written``, whose results read no shuffle again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


_MACHINE: dict = {}


def machine(key: object, make: Callable[[], object]):
    """What ``make`` builds for ``key`` (a broadcast value), kept in this worker from task to task. A worker keeps one
    machine at a time: opening another, or none (``release``), lets go of the tables of the one before."""
    if _MACHINE.get("of") is not key:
        _MACHINE.clear()
        _MACHINE["is"], _MACHINE["of"] = make(), key
    return _MACHINE["is"]


def release() -> None:
    """Lets go of the machine that an operator run before in this worker has left, and of what Arrow keeps of freed memory."""
    _MACHINE.clear()
    pa.default_memory_pool().release_unused()


def map_rows(
    df: DataFrame,
    schema: T.StructType | str,
    make: Callable[[], Callable[..., Sequence]],
    rows: int = 512,
) -> DataFrame:
    """Apply ``make()(*values) -> output tuple`` to each row in Arrow batches of at most ``rows`` rows.

    ``make`` runs once per task, so models are opened there and kept for the whole partition.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        arrow = to_arrow_schema(schema)
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = [each(*values) for values in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), type=f.type) for c, f in zip(zip(*out), arrow)], names=names
                )

    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, own: Sequence[str]) -> DataFrame:
    """``df`` with its columns other than ``own`` named by their places: names of any kind pass an Arrow map so, and
    ``toDF`` gives them back."""
    return df.toDF(*[c if c in own else f"_{i}" for i, c in enumerate(df.columns)])


def sampled_labels(spark: SparkSession, sf_dir: str, limit: int, keep: Column | None = None) -> DataFrame:
    """At most ``limit`` labelled rows, those with the smallest id hash: (doc_id, quality, toxic), one per doc_id."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if keep is not None:
        labels = labels.filter(keep)
    return (
        labels.groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )


def extended(df: DataFrame, **added: str) -> T.StructType:
    """The schema of ``df`` with further columns."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in added.items()))])
