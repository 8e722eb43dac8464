"""Files in and out: capture trees, listings, manifests, documents."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotline.functions import slots


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, spark.checkpoint.dir. Without one, files would go to a folder that executors
    on other machines do not share, so that is an error; a session whose master is local has one machine, and gets a
    folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in a folder of this application's in the shared one. That folder is deleted when the driver ends in
    good order; what a crash leaves is the cluster's to clean."""
    root = f"{shared_folder(spark)}/scratch-{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        files.mkdirs(place)
        files.deleteOnExit(place)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def settled(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once to the shared folder and read back: for plans that must not be run twice with
    different outcomes, as where ranges are cut from a sample, and for what several readers take."""
    spark = frame.sparkSession
    path = scratch(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def settled_at(frame: DataFrame, path: str) -> DataFrame:
    """``frame`` written to ``path`` unless a run before has done so, and read back: for what must stay as it was when a
    job began, however often the job begins again."""
    spark = frame.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        frame.write.mode("overwrite").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def scan_captures(spark: SparkSession, root: str, host: str, prefix: str = "") -> DataFrame:
    """A capture tree <root>/<camera>/<day>/<name> as a listing: only paths and sizes are read, never contents, and files
    without a byte are listed as well.

    ``prefix``: of the days to look at. Folders of other days are not listed. No such day is no error. Tasks list the cameras'
    folders, then the days', and the driver nothing; a task holds the names of one folder at a time. ``root`` must be in a
    store that Arrow's file systems know.
    """

    def folders(prefix: str, missing: bool):
        def run(batches):
            for batch in batches:
                for folder in batch.column(0).to_pylist():
                    below = [f.path for f in entries(folder, missing) if not f.is_file and f.base_name.startswith(prefix)]
                    yield pa.RecordBatch.from_arrays([pa.array(below, pa.string())], names=["folder"])

        return run

    def entries(folder: str, missing: bool = False):
        from pyarrow import fs

        store = fs.FileSystem.from_uri(root)[0]
        return store.get_file_info(fs.FileSelector(folder, allow_not_found=missing))

    def files(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                camera, day = folder.split("/")[-2:]
                found = [f for f in entries(folder) if f.is_file and PHOTO.fullmatch(f.base_name)]
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    columns = [[host] * len(part), [camera] * len(part), [day] * len(part), [f.base_name for f in part], [f.size for f in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["host", "camera", "day_dir", "name", "bytes"])

    from pyarrow import fs

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number, as few bytes become many names
    top = spark.createDataFrame([(fs.FileSystem.from_uri(root)[1],)], "folder string")
    cameras = top.mapInArrow(folders("", bool(prefix)), "folder string")
    return cameras.repartition(tasks).mapInArrow(folders(prefix, False), "folder string").repartition(tasks).mapInArrow(files, LISTING)


#: Names of captures, as the glob *.jp*g has them; those of drafts and hidden files are none.
PHOTO = re.compile(r"[^._].*\.jp.*g", re.DOTALL)
LISTING = "host string, camera string, day_dir string, name string, bytes long"


def write_tree(captures: DataFrame, root: str) -> int:
    """Files <root>/<camera>/<day_dir>/<name> of ``bytes`` bytes, written by tasks; how many.

    A file is written under another name and then renamed, so a task that runs again, or a second one with the same
    capture, leaves the same tree. ``root`` must be in a store that Arrow's file systems know.
    """

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for camera, day, name, size in zip(*(c.to_pylist() for c in batch.columns)):
                folder = f"{base}/{camera}/{day}"
                store.create_dir(folder, recursive=True)
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(bytes(size))
                store.move(draft, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    counted = captures.select("camera", "day_dir", "name", "bytes").mapInArrow(run, "n long")
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def land_captures(frame: DataFrame, path: str) -> DataFrame:
    """Captures as camera and day partitions; partitions that are written again are replaced, others stay.

    Rows are dealt by camera and day before the write, so that a partition gets few files.
    """
    named = frame.withColumn("day", slots.day_of_name(F.col("name")))
    spread = named.repartition("camera", "day")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("camera", "day").parquet(path)
    return frame.sparkSession.read.parquet(path)


def landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Captures that ``land_captures`` has written, ``day`` as text, so that a period is a range of it. ``schema``: that of
    the captures."""
    rest = [f for f in schema.fields if f.name not in ("camera", "day")]
    return spark.read.schema(T.StructType(rest).add("camera", "string").add("day", "string")).parquet(path)


def parse_listing(lines: DataFrame, min_bytes: int = slots.MIN_BYTES) -> DataFrame:
    """A long listing (perms size date time path) as entries; folders and small files go."""
    part = F.split("value", r"\s+")
    path = F.split(part[4], "/")
    rows = lines.filter(~F.col("value").startswith("d")).select(
        path[0].alias("day_dir"), path[1].alias("name"), F.regexp_replace(part[1], ",", "").cast("long").alias("bytes")
    )
    return rows.filter(F.col("bytes") >= min_bytes)


def parse_manifest(lines: DataFrame, column: str = "value", width: int = 30) -> DataFrame:
    """Fixed-width manifest lines; one of another width fails the read."""
    line = F.when(F.length(column) == width, F.col(column)).otherwise(
        F.raise_error(F.concat(F.lit("manifest line of the wrong width: "), column)).cast("string")
    )
    src = F.rtrim(F.substring(line, 8, 23))
    return lines.withColumn("frame", F.substring(line, 1, 4).cast("int")).withColumn("state", F.substring(line, 6, 1)).withColumn(
        "src", F.when(src != "", src)
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Manifest rows as text, one line each."""
    line = slots.manifest_line(F.col("frame"), F.col("state"), F.col("src"))
    manifest.select(line.alias("value")).write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Observation documents, one JSON file each, with the fixed schema."""
    from slotline.operators.metrics import OBSERVATION

    return spark.read.schema(OBSERVATION).option("multiLine", "true").json(path)
