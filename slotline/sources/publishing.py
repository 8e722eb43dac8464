"""Publishing that survives a second run and a crash: staged rows, and a log whose entries decide what readers see.

A publication is a folder with ``rows/_commit=<id>/`` for staged rows and ``log/<number>.json`` for what was decided. Rows
are staged first by an ordinary Spark write, whose tasks may fail and run again; then one entry is made in a temporary
file and renamed to the next number. The rename fails if that number is there, so of two writers one is first, and the
other looks at what was added, leaves out what it need no longer write, and tries again. Readers follow the log alone: rows
that no entry names, as after a crash, are never read, and ``vacuum`` deletes them.

Only the log's entries, one for each run that published, reach the driver; keys and rows stay in Spark. The folder must be
in a file system whose rename is atomic, as HDFS has it.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = "number long, kind string, folder string, upto long, token string, digest string, n long, schema string"
ROWS, RETRACTION, BASE, SNAPSHOT = "rows", "retraction", "base", "snapshot"


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Whether rows of two frames have equal keys; nulls are equal."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def digest(frame: DataFrame) -> Row:
    """(digest, n) of a frame's rows, whatever their order and dealing: a count, and sums and exclusive ors of two hashes
    of each row. Columns count by name. Maps have no order and are not taken."""
    names = sorted(frame.columns)
    flags = [F.col(f"`{c}`").isNull() for c in names]  # a null leaves a hash as it was
    hashes = [F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in names], *flags) for seed in ("first", "second")]
    hashed = frame.select(*[h.alias(f"h{i}") for i, h in enumerate(hashes)])
    sums = [x for i in range(2) for x in (F.sum(F.col(f"h{i}").cast("decimal(20,0)")), F.bit_xor(f"h{i}"))]
    text = F.concat_ws(":", F.lit(",".join(f"{c} {t}" for c, t in sorted(frame.dtypes))), *[F.coalesce(s.cast("string"), F.lit("0")) for s in sums])
    return hashed.agg(F.sha2(text, 256).alias("digest"), F.count("*").alias("n")).first()


class Log:
    """The numbered entries of a publication."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        for part in ("log", "rows"):
            self._fs.mkdirs(self._path(part))

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *[p for p in parts if p]]))

    def frame(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).json(f"{self.root}/log")

    def entries(self) -> list[Row]:
        """In order: one for each run that published something."""
        return self.frame().orderBy("number").collect()

    def add(self, number: int, **entry) -> bool:
        """The entry with that number, if there is none yet; whether it is ours."""
        files = self.spark._jvm.org.apache.hadoop.fs
        draft = self._path(f"draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"number": number, **entry}).encode()))
        out.close()
        context = files.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(files.Options.Rename, 0)  # nothing is overwritten
        try:
            context.rename(draft, self._path("log", f"{number:012d}.json"), none)
            return True
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False

    def stage(self, frame: DataFrame) -> str:
        """Rows written under an id that nobody reads before an entry names it."""
        folder = uuid.uuid4().hex
        frame.write.parquet(f"{self.root}/rows/_commit={folder}")
        return folder

    def staged(self, folders: list[str], schema: str) -> DataFrame:
        """The rows of some folders, with ``_commit``."""
        kind = T.StructType.fromJson(json.loads(schema)).add("_commit", T.StringType())
        paths = [f"{self.root}/rows/_commit={f}" for f in folders]
        return self.spark.read.schema(kind).option("basePath", f"{self.root}/rows").parquet(*paths)

    def drop(self, folder: str) -> None:
        self._fs.delete(self._path("rows", f"_commit={folder}"), True)

    def folders(self) -> dict[str, float]:
        """Folders of rows, and when each was last changed."""
        return {s.getPath().getName().removeprefix("_commit="): s.getModificationTime() / 1000 for s in self._fs.listStatus(self._path("rows"))}

    def vacuum(self, needed: set[str], older_than: float) -> list[str]:
        """Deletes folders that are not needed and that nobody has written to for so many seconds."""
        gone = [f for f, at in self.folders().items() if f not in needed and time.time() - at >= older_than]
        for folder in gone:
            self.drop(folder)
        return sorted(gone)


class Publication:
    """A table that is added to by whole keys: a key that is there is never written again, unless it was retracted.

    Without ``keys`` every row is added. A ``token`` names a run: what a run with that token has published is not
    published twice, so a micro-batch that is tried again adds nothing.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str] | None = None):
        self.log, self.keys = Log(spark, root), keys or []
        self.spark = spark

    def read(self, entries: list[Row] | None = None) -> DataFrame | None:
        """The rows that are published, or None if nothing was."""
        entries = self.log.entries() if entries is None else entries
        base = [e for e in entries if e.kind == BASE][-1:]
        upto = base[0].upto if base else -1
        parts = [(e.folder, e.upto if e.kind == BASE else e.number) for e in base + [e for e in entries if e.kind == ROWS and e.number > upto]]
        if not parts:
            return None
        schema = [e.schema for e in entries if e.kind in (ROWS, BASE)][-1]
        found = self.log.staged([f for f, _ in parts], schema)
        gone = [e for e in entries if e.kind == RETRACTION and e.number > upto]
        if not gone:
            return found.drop("_commit")
        numbers = lambda pairs: F.broadcast(self.spark.createDataFrame(pairs, "_commit string, number long"))  # noqa: E731  a row for each entry
        columns = found.drop("_commit").columns
        keys = T.StructType([f for f in found.schema.fields if f.name in self.keys]).json()
        dropped = self.log.staged([e.folder for e in gone], keys).join(numbers([(e.folder, e.number) for e in gone]), "_commit")
        last = dropped.groupBy(*self.keys).agg(F.max("number").alias("dropped"))
        own = found.join(numbers(parts), "_commit")
        kept = own.join(last, same(own, last, self.keys), "left").filter(F.col("dropped").isNull() | (F.col("number") > F.col("dropped")))
        return kept.select(*[own[c] for c in columns])

    def publish(self, frame: DataFrame, token: str | None = None) -> int | None:
        """Adds the rows of keys that are not there; the entry's number, or None if there was nothing to add."""
        while True:
            entries = self.log.entries()
            if token is not None and any(e.token == token for e in entries):
                return None
            there = self.read(entries) if self.keys else None
            new = frame if there is None else _without(frame, there, self.keys)
            folder = self.log.stage(new)
            schema = frame.schema.json()
            own = self.log.staged([folder], schema)
            n = own.count()
            if not n and token is None:
                self.log.drop(folder)
                return None
            number = self._enter(entries, own, token, kind=ROWS, folder=folder, token=token, n=n, schema=schema)
            if number is not None:
                return number
            self.log.drop(folder)  # another run has published some of these keys meanwhile

    def _enter(self, entries: list[Row], own: DataFrame | None, seen_token: str | None, **entry) -> int | None:
        """The next free number, unless what was entered since ``entries`` has some of the keys of ``own``."""
        known = entries[-1].number if entries else -1
        while not self.log.add(known + 1, **entry):
            since = [e for e in self.log.entries() if e.number > known]
            if seen_token is not None and any(e.token == seen_token for e in since):
                return None
            added = [e for e in since if e.kind == ROWS]
            if own is not None and self.keys and added:
                theirs = self.log.staged([e.folder for e in added], added[-1].schema)
                if not own.join(theirs, same(own, theirs, self.keys), "left_semi").isEmpty():
                    return None
            known = since[-1].number
        return known + 1

    def retract(self, keys: DataFrame, token: str | None = None) -> int | None:
        """Takes keys back, so that the next publish may write them again."""
        entries = self.log.entries()
        if token is not None and any(e.token == token for e in entries):
            return None
        folder = self.log.stage(keys.select(*self.keys).distinct())
        return self._enter(entries, None, token, kind=RETRACTION, folder=folder, token=token, n=0, schema=keys.select(*self.keys).schema.json())

    def compact(self, work=lambda rows: rows) -> int | None:
        """What is published, through ``work``, as one folder that stands for all entries so far. For one writer at a time:
        entries that others add meanwhile come after it and stay."""
        entries = self.log.entries()
        rows = self.read(entries)
        if rows is None:
            return None
        made = work(rows)
        folder, upto = self.log.stage(made), entries[-1].number
        return self._enter(entries, None, None, kind=BASE, folder=folder, upto=upto, n=0, schema=made.schema.json())

    def vacuum(self, older_than: float = 86_400.0) -> list[str]:
        """Deletes staged rows that no entry needs: those of crashed runs once they are old, and what was compacted."""
        entries = self.log.entries()
        upto = max([e.upto for e in entries if e.kind == BASE], default=-1)
        last = [e.folder for e in entries if e.kind == BASE][-1:]
        needed = {e.folder for e in entries if e.kind in (ROWS, RETRACTION) and e.number > upto} | set(last)
        return self.log.vacuum(needed, older_than)


def _without(frame: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not there."""
    have = there.select(*keys).distinct()
    return frame.join(have, same(frame, have, keys), "left_anti")


class Snapshots:
    """A table that is replaced as a whole, and only if it differs: the last entry is the pointer that readers follow."""

    def __init__(self, spark: SparkSession, root: str):
        self.log = Log(spark, root)

    def current(self) -> DataFrame | None:
        """The newest snapshot, or None if there is none."""
        return self.version(None)

    def version(self, number: int | None) -> DataFrame | None:
        entries = [e for e in self.log.entries() if number is None or e.number <= number]
        return self.log.staged([entries[-1].folder], entries[-1].schema).drop("_commit") if entries else None

    def publish(self, frame: DataFrame) -> int | None:
        """The new version's number, or None if the rows are those of the newest one: then nothing is written, and of
        what is published only the log is read."""
        made = digest(frame)
        while True:
            entries = self.log.entries()
            if entries and (entries[-1].digest, entries[-1].n) == (made.digest, made.n):
                return None
            folder = self.log.stage(frame)
            number = entries[-1].number + 1 if entries else 0
            if self.log.add(number, kind=SNAPSHOT, folder=folder, digest=made.digest, n=made.n, schema=frame.schema.json()):
                return number
            self.log.drop(folder)

    def vacuum(self, keep: int = 2, older_than: float = 86_400.0) -> list[str]:
        """Deletes all but the newest ``keep`` versions, and staged rows of crashed runs."""
        return self.log.vacuum({e.folder for e in self.log.entries()[-keep:]}, older_than)
