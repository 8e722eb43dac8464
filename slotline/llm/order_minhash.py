"""Document fingerprints with DataFrame functions alone: order MinHash.

Method. A text is cut into units, words of at most ``UNIT`` characters (longer ones into pieces). Its k-mers are every
``K`` units in a row, told apart by how many equal ones came before (occurrence number). Each k-mer hashes to 64 bits;
the top bits deal the k-mers into ``BUCKETS`` and each bucket selects its ``ORDER`` minimal ones, puts them back into
text order and hashes that tuple. Equal entries of two fingerprints so mean the same k-mers in the same order, which
falls with edit distance, not merely with shared content. Likeness is the share of equal entries among those that
either fingerprint has.

Null and empty texts have no k-mers: an empty fingerprint, like another empty one (likeness 1) and unlike any other.
Texts of fewer than ``K`` units have one k-mer, padded. Equal texts have equal fingerprints. A place in the text takes 30
bits, more than the units of the longest string that Spark holds, so order is kept in texts of any length. Equal hashes
of one text are told apart by occurrence and place, so ties are settled alike everywhere. An empty table gives an empty
result. Columns other than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotline.llm.common import table, written

UNIT, K, ORDER = 24, 2, 2
BUCKET_BITS = 6
BUCKETS = 1 << BUCKET_BITS
PLACE_BITS = 30  #: the longest string has fewer units than places
PLACE = (1 << PLACE_BITS) - 1


def _hash_of(v: Column) -> Column:
    return F.shiftright(v, PLACE_BITS)


def selected(text: Column) -> Column:
    """The k-mers that the buckets select, as (hash, place) packed in longs, in the order of their hashes."""
    units = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{UNIT}}}"), F.lit(0))
    last = lambda a: F.greatest(F.size(a) - K, F.lit(0))
    kmers = lambda a: F.transform(
        F.sequence(F.lit(0), last(a)),
        lambda i: F.xxhash64(*[F.get(a, i + j) for j in range(K)]).bitwiseAND(F.lit(~PLACE)).bitwiseOR(
            F.least(i, F.lit(PLACE)).cast("long")
        ),
    )
    ranked = _let(_let(units, lambda a: F.when(F.size(a) > 0, F.sort_array(kmers(a)))), lambda v: F.sort_array(_occurrences(v)))
    return _let(
        ranked,
        lambda v: F.filter(
            v,
            lambda x, i: (i < ORDER)
            | (F.shiftright(x, 64 - BUCKET_BITS) != F.shiftright(F.get(v, i - ORDER), 64 - BUCKET_BITS)),
        ),
    )


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: within one lambda it is a variable."""
    return F.transform(F.array(value), use)[0]


def _occurrences(v: Column) -> Column:
    """Sorted (hash, place) values with each repeated hash mixed with its occurrence number.

    Equal hashes stand together in text order, so the number is the distance to the first of its run. It is found by
    halving steps, and only where the one before is equal.
    """

    def number(x: Column, i: Column) -> Column:
        back = F.lit(0)
        steps = F.array(*[F.lit(1 << s) for s in range(PLACE_BITS - 1, -1, -1)])
        return F.aggregate(
            steps,
            back,
            lambda seen, s: F.when(
                (i - seen - s >= 0) & (_hash_of(F.get(v, F.greatest(i - seen - s, F.lit(0)))) == _hash_of(x)), seen + s
            ).otherwise(seen),
        )

    def mixed(x: Column, i: Column) -> Column:
        repeated = (i > 0) & (_hash_of(F.get(v, F.greatest(i - 1, F.lit(0)))) == _hash_of(x))
        other = F.xxhash64(_hash_of(x), number(x, i)).bitwiseAND(F.lit(~PLACE)).bitwiseOR(x.bitwiseAND(F.lit(PLACE)))
        return F.when(repeated, other).otherwise(x)

    return F.transform(v, mixed)


def signature(text: Column) -> Column:
    """One entry for each bucket with k-mers: its number and the hash of its selected k-mers in text order."""

    def entries(chosen: Column) -> Column:
        bucket = lambda x: F.shiftright(x, 64 - BUCKET_BITS)
        place = lambda x: x.bitwiseAND(F.lit(PLACE))
        first = lambda x, i: (i == 0) | (bucket(x) != bucket(F.get(chosen, F.greatest(i - 1, F.lit(0)))))

        def entry(x: Column, i: Column) -> Column:
            y = F.get(chosen, i + 1)
            pair = y.isNotNull() & (bucket(y) == bucket(x))
            low, high = F.when(place(x) <= place(y), x).otherwise(y), F.when(place(x) <= place(y), y).otherwise(x)
            hashed = F.when(pair, F.xxhash64(_hash_of(low), _hash_of(high))).otherwise(F.xxhash64(_hash_of(x)))
            low32 = hashed.bitwiseAND(F.lit(0xFFFFFFFF))
            return F.when(first(x, i), F.shiftleft(bucket(x) + BUCKETS // 2, 32).bitwiseOR(low32))

        return F.filter(F.transform(chosen, entry), lambda e: e.isNotNull())

    empty = F.array().cast("array<bigint>")
    return F.coalesce(_let(selected(text), lambda c: F.when(c.isNotNull(), entries(c))), empty)


def as_text(signature_: Column) -> Column:
    """The entries in hexadecimal, ten digits each: the bucket and its tuple's hash."""
    return F.array_join(F.transform(signature_, lambda e: F.lpad(F.hex(e), 10, "0")), "")


def fingerprints(documents: DataFrame, text: str = "text") -> DataFrame:
    """Every input row with ``signature``, an array of entries (bucket times 2**32 plus tuple hash)."""
    return documents.withColumn("signature", signature(F.coalesce(F.col(text), F.lit(""))))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries among the buckets that either signature has; 1 for two empty ones."""
    bucket = lambda e: F.shiftright(e, 32)
    either = F.size(F.array_union(F.transform(a, bucket), F.transform(b, bucket)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def successors(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, next): the next lower key, and for the lowest the highest. Keys are dealt by ranges; a window runs in
    each range, and one over the ranges' ends joins them up, so that no task holds all keys."""
    ids = documents.select(key).filter(F.col(key).isNotNull()).distinct()
    # written once: the ranges' bounds come from a sample, so two runs of this plan could deal keys differently
    parts = written(ids.repartitionByRange(F.col(key).desc()).withColumn("part", F.spark_partition_id()), "ranges")
    inner = parts.withColumn("next", F.lead(key).over(W.partitionBy("part").orderBy(F.col(key).desc())))
    ends = parts.groupBy("part").agg(F.max(key).alias("top"))
    order = W.orderBy("part")
    ends = ends.select(
        F.col("part").alias("_part"),
        F.coalesce(F.lead("top").over(order), F.max("top").over(W.partitionBy(F.lit(0)))).alias("_after"),
    )
    joined = inner.join(F.broadcast(ends), F.col("part") == F.col("_part"))  # one row for each range
    return joined.select(key, F.coalesce("next", "_after").alias("next"))


def against_next(documents: DataFrame) -> DataFrame:
    """(doc_id, text, edited, own, other, near_next): each text, its edit, both signatures, and its likeness to the next.

    Texts are shuffled once, by doc_id: the exchange serves both the join that hands each document's beginning and
    signature to the one before it, and the join that takes them up. Of rows that share an id, the least beginning is
    handed on. A row without an id has no next: its edit only loses its last third, and near_next is 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    documents = documents.select("doc_id", text.alias("text"))
    known = documents.filter(F.col("doc_id").isNotNull())
    sized = known.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    wants = successors(known).join(sized, "doc_id").select(
        F.col("doc_id").alias("for_id"), "next", F.floor(F.col("n") / 3).cast("int").alias("take")
    )
    given = known.join(wants, F.col("doc_id") == F.col("next")).select(
        "for_id", F.struct(F.substr("text", F.lit(1), F.col("take")).alias("head"), signature(F.col("text")).alias("after")).alias("given")
    )
    given = given.groupBy("for_id").agg(F.min("given").alias("given"))
    third = F.floor(F.length("text") / 3).cast("int")
    kept = F.substr("text", F.lit(1), F.length("text") - third)
    paired = known.join(given, F.col("doc_id") == F.col("for_id")).select(
        "doc_id", "text", F.concat(kept, F.substr("given.head", F.lit(1), third)).alias("edited"), F.col("given.after").alias("after")
    )
    alone = documents.filter(F.col("doc_id").isNull()).select(
        "doc_id", "text", kept.alias("edited"), F.lit(None).cast("array<bigint>").alias("after")
    )
    both = paired.unionByName(alone).withColumn("own", signature(F.col("text"))).withColumn("other", signature(F.col("edited")))
    return both.withColumn("near_next", F.coalesce(likeness(F.col("own"), F.col("after")), F.lit(0.0))).drop("after")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_next(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        "near_next",
    )
