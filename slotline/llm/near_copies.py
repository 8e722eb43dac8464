"""SimHash near-duplicates by pigeonring filtering.

Method. A document's fingerprint has a bit for each of 64 that more than half of its shingles' hashes set. Two
fingerprints link at ``distance`` or fewer differing bits. The 64 bits form a ring of ``distance + 1`` segments. If two
fingerprints differ in at most ``distance`` bits, there is a segment from which on every run of l segments holds at
most l * distance / (distance + 1) differences. The first ``chain`` segments of such a run are looked up (the first
one equal, the others with every allowed error pattern); a candidate must then keep the budget on every longer run
before the whole distance is counted. No link is lost.

Groups. Equal fingerprints are one vertex. Vertices that share a chain are first linked to four pivots of that chain
where they are near enough, which joins dense groups with few links. The lookup then asks only for links between
different groups; in a chain that holds more than ``LARGE`` vertices, members of its largest group are not compared
with each other. So pairs within a group are never listed. Joins on a chain or a group have plain tables on both sides, so
that Spark splits those that are large. Spark sizes an exploded side as if each fingerprint were still one row, and would
broadcast tens of rows for each: such joins are asked to merge.

Null and empty texts have fingerprint zero, linked like any other. Texts shorter than a shingle are one shingle; those of
any length are read whole. Repeated rows share a component. A row without an id is in its group, whose name is the
smallest id there is in it (null where there is none). An empty table gives an empty result. Columns other than doc_id
and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.llm.common import extended, release, table, written
from slotline.llm.components import components

BITS, SEED = 64, 42
LARGE = 64


def fingerprint(text: str | None, k: int) -> int:
    """The 64-bit fingerprint of a text's k-word shingles (repeats included), as a signed number."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= k:
        shingles = [whole]
    else:
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends)]
        shingles = [whole[s:e] for s, e in zip(starts, ends[k - 1 :])]
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8", count=len(shingles))
    ones = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<i8")[0])


def fingerprinted(documents: DataFrame, k: int, text: str = "text") -> DataFrame:
    """Every input row with ``fp``."""
    documents = documents.drop("fp")
    place = documents.columns.index(text)

    def run(batches):
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fps = pa.array([fingerprint(t, k) for t in part.column(place).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, fps], names=[*part.schema.names, "fp"])

    return documents.mapInArrow(run, extended(documents, fp="long"))


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


class Ring:
    """The segments for a distance, the runs' masks and the error patterns of a chain."""

    def __init__(self, distance: int, chain: int):
        self.distance, self.chain, self.parts = distance, min(chain, distance + 1), distance + 1
        cuts = [BITS * i // self.parts for i in range(self.parts + 1)]
        self.segments = [list(range(a, b)) for a, b in zip(cuts, cuts[1:])]

    def budget(self, length: int) -> int:
        return length * self.distance // self.parts

    def run(self, start: int, length: int) -> int:
        return sum(1 << b for i in range(length) for b in self.segments[(start + i) % self.parts])

    def patterns(self, start: int) -> list[int]:
        """Flips that keep every budget of the chain."""
        found = [(0, 0)]
        for length in range(2, self.chain + 1):
            grown = list(found)
            level = found
            for _ in range(self.budget(length)):
                level = list({
                    (flips | 1 << b, n + 1)
                    for flips, n in level
                    for b in self.segments[(start + length - 1) % self.parts]
                    if not flips >> b & 1 and n < self.budget(length)
                })
                grown += level
            found = list(set(grown))
        return [flips for flips, _ in found]

    def keys(self, probe: bool) -> Column:
        """(start, bits) of a fingerprint's chains; with every allowed error pattern for a probe."""
        rows = [
            (i, signed(self.run(i, self.chain)), signed(f)) for i in range(self.parts) for f in (self.patterns(i) if probe else [0])
        ]
        made = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).cast("long").alias("m"), F.lit(f).cast("long").alias("f")) for i, m, f in rows])
        return F.transform(
            made,
            lambda r: F.struct(
                r["i"].alias("start"), F.col("fp").bitwiseXOR(r["f"]).bitwiseAND(r["m"]).alias("bits")
            ),
        )

    def holds(self, x: Column, y: Column, start: Column) -> Column:
        """Whether every run from ``start`` that is longer than the chain keeps its budget; the last is the whole."""
        differ = x.bitwiseXOR(y)
        whole = F.bit_count(differ) <= self.distance
        for length in range(self.chain + 1, self.parts):
            masks = F.array(*[F.lit(signed(self.run(i, length))).cast("long") for i in range(self.parts)])
            whole = (F.bit_count(differ.bitwiseAND(F.get(masks, start))) <= self.budget(length)) & whole
        return whole


def pairs_with_pivots(fps: DataFrame, ring: Ring) -> DataFrame:
    """Links (a, b) of each fingerprint with the pivots of its chains that are near enough."""
    rows = fps.select("fp", F.explode(ring.keys(False)).alias("k")).select("fp", "k.start", "k.bits")
    pivots = rows.groupBy("start", "bits").agg(
        F.count("*").alias("n"),
        F.min("fp").alias("p1"),
        F.max("fp").alias("p2"),
        F.min_by("fp", F.xxhash64("fp")).alias("p3"),
        F.max_by("fp", F.xxhash64("fp")).alias("p4"),
    )
    # written, so that the join below has no aggregation in it and Spark can split a chain that very many share
    pivots = written(pivots.filter(F.col("n") > 1), "pivots")
    shared = rows.join(pivots.hint("merge"), ["start", "bits"])
    linked = shared.select(F.col("fp").alias("a"), F.explode(F.array("p1", "p2", "p3", "p4")).alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= ring.distance
    return linked.filter((F.col("a") != F.col("b")) & near).distinct()


def pairs_between(fps: DataFrame, ring: Ring) -> DataFrame:
    """Links (a, b) between fingerprints of different groups. ``fps``: fp, grp."""
    # few bytes become many rows: deal them before they are exploded
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    index = fps.select("fp", "grp", F.explode(ring.keys(False)).alias("k")).select("fp", "grp", "k.start", "k.bits")
    by_group = index.groupBy("start", "bits", "grp").agg(F.count("*").alias("n"))
    large = (
        by_group.groupBy("start", "bits")
        .agg(F.sum("n").alias("n"), F.max_by("grp", "n").alias("top"))
        .filter(F.col("n") > LARGE)
        .select("start", "bits", "top")
    )
    large = written(large, "large")
    index = index.join(large, ["start", "bits"], "left")
    # list 0 of a chain has all its members, list 1 of a large chain those outside its largest group
    lists = F.when(F.col("top").isNotNull() & (F.col("grp") != F.col("top")), F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    index = index.select(
        F.col("fp").alias("y"), F.col("grp").alias("gy"), "start", "bits", F.explode(lists).alias("list")
    )
    probe = fps.select("fp", "grp", F.explode(ring.keys(True)).alias("k")).select("fp", "grp", "k.start", "k.bits")
    probe = probe.join(large, ["start", "bits"], "left").select(
        F.col("fp").alias("x"),
        F.col("grp").alias("gx"),
        "start",
        "bits",
        F.when(F.col("grp") == F.col("top"), 1).otherwise(0).alias("list"),
    )
    found = probe.join(index.hint("merge"), ["start", "bits", "list"]).filter(
        (F.col("gx") != F.col("gy")) & ring.holds(F.col("x"), F.col("y"), F.col("start"))
    )
    return found.select(F.least("gx", "gy").alias("a"), F.greatest("gx", "gy").alias("b")).distinct()


def chain_for(n: int) -> int:
    """Segments looked up together: longer keys, with more error patterns, for more fingerprints, so that a key is shared
    by chance by few. No link is lost with any."""
    return 2 if n <= 1 << 26 else 3


def grouped(fps: DataFrame, distance: int, chain: int | None) -> DataFrame:
    """(fp, grp) for distinct fingerprints: the same group exactly if links lead from one to the other."""
    fps = written(fps.select("fp").distinct(), "fps")
    ring = Ring(distance, chain or chain_for(fps.count()))
    first = components(pairs_with_pivots(fps, ring))
    one = fps.join(first, fps.fp == first.v, "left").select("fp", F.coalesce("component", "fp").alias("grp"))
    one = written(one, "groups")
    more = components(pairs_between(one, ring))
    return one.join(more, one.grp == more.v, "left").select("fp", F.coalesce("component", "grp").alias("grp"))


def classes(small: DataFrame, distance: int, chain: int | None) -> DataFrame:
    """(fp, component_id) of rows (doc_id, fp); copies have met in one row before groups are joined."""
    least = small.groupBy("fp").agg(F.min("doc_id").alias("least")).join(grouped(small, distance, chain), "fp")
    # written, so that Spark can split the join where one group has very many fingerprints
    named = written(least.groupBy("grp").agg(F.min("least").alias("component_id")), "named")
    return least.join(named, "grp").select("fp", "component_id")


def linked(documents: DataFrame, k: int = 5, distance: int = 7, chain: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every input row: its group's smallest doc_id."""
    small = written(fingerprinted(documents.select("doc_id", "text"), k).select("doc_id", "fp"), "fingerprints")
    return small.join(classes(small, distance, chain), "fp")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linked(table(spark, sf_dir, "documents"), k=4, distance=4)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
