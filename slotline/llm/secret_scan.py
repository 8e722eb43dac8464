"""Secret scans with DataFrame functions alone: fixed patterns, and a likelihood ratio of two character models.

Method. Two first-order Markov models over the characters of ``ALPHABET`` (anything else is one further character)
are trained from labelled samples. The fixed patterns label: the values that they match are random strings, the runs of
such characters in documents where they match nothing are ordinary identifiers (words, numbers). Both samples hold
distinct values, the random ones at most ``SAMPLE`` and the ordinary ones from at most ``SAMPLE`` documents, and each value
in further spellings: secrets are written in other alphabets than those that patterns know, so the bytes of a hexadecimal
one also stand in base 64; names are written as compounds, so in one of ``COMPOUND`` documents three words in a row also stand joined, in camel case or by
underscores, hyphens or slashes, or one with a date or a number. All also stand in capitals. Every count has one added. A quarter of each, told by a hash, is not trained on: the threshold of the mean log-likelihood ratio of a
value's steps lies a quarter of the way from the high end of the held-out ordinary runs (one in a thousand is above) to
the low end of the held-out secrets (all but 5 % are above), or at the former if they overlap: other kinds of random
string than the patterns know are less unlike words than those are. Then every run of ``LEAST`` or
more such characters in every text is judged by the models alone, letters and digits alike, also within what a pattern
matched: span kind ``random``.

Null and empty texts have no spans. A text of any length is read whole; repeated rows are kept and get the same spans; a
ratio equal to the threshold is not a secret. An empty table gives an empty result. Without a random sample its model is
uniform and the threshold ``MARGIN``. Rows without an id are scanned, but no ordinary runs are sampled from them. Columns
other than doc_id and text are not read, so their names cannot clash. Nothing is written to scratch.
"""

from __future__ import annotations

from math import log

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.llm import spans as S
from slotline.llm.common import table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "[0-9a-f]{24,}+"
CHARACTERS = "A-Za-z0-9+/_=-"
LEAST = 16  #: characters of a run that is judged
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SAMPLE = 4_000  #: distinct secrets, and documents for ordinary runs, that the models are trained from, at most
COMPOUND = 8  #: one in so many of those documents gives compounds
HELD_OUT = 4  #: one in so many sampled values calibrates the threshold
MARGIN = 0.4  #: nats per step, where no secret is known


def fixed(text: Column) -> Column:
    """Spans of the three patterns."""
    every = lambda v: F.lit(True)
    return F.concat(
        S.matches(text, ASSIGN, 0, lambda v: F.length(v) >= 6, group=1),
        S.matches(text, ACCESS, 1, every),
        S.matches(text, HEX, 2, every),
    )


def pairs(value: Column) -> Column:
    """The value's characters with their successors, as places in the alphabet (0: other)."""
    chars = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    last = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.arrays_zip(F.slice(chars, 1, last).alias("a"), F.slice(chars, 2, last).alias("b"))


def spelled(value: Column, random: Column) -> Column:
    """A labelled value in the ways in which such values are written."""
    raw = F.base64(F.unhex(value))
    is_hex = random & value.rlike("^(?:[0-9a-f]{2}){8,}$")
    both = F.array(value, F.upper(value))
    return F.array_distinct(F.when(is_hex, F.concat(both, F.array(raw, F.upper(raw)))).otherwise(both))


def compounds(text: Column) -> Column:
    """Each three words in a row as one name, joined in one of four ways, or the first with a date or a number."""
    words = F.filter(F.split(text, "[^A-Za-z]+"), lambda w: F.length(w).between(2, 14))
    last = F.floor(F.size(words) / 3).cast("int") - 1
    threes = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(words, i * 3 + 1, 3))

    def joined(t: Column) -> Column:
        camel = F.concat(F.lower(t[0]), F.initcap(t[1]), F.initcap(t[2]))
        way, number = F.pmod(F.xxhash64(t), F.lit(6)), F.pmod(F.xxhash64(t, F.lit("number")), F.lit(10**16))
        dated = F.concat(F.lower(t[0]), F.lit("-"), F.date_format(F.timestamp_seconds(number % (1 << 31)), "yyyy-MM-dd_HH-mm-ss"))
        joins = [camel, F.array_join(t, "_"), F.array_join(t, "-"), F.array_join(t, "/"), dated]
        return F.coalesce(*[F.when(way == i, x) for i, x in enumerate(joins)], F.concat(t[0], F.lit("_"), number.cast("string")))

    return F.transform(F.filter(threes, lambda t: F.size(t) == 3), joined)


def samples(documents: DataFrame, sample: int) -> DataFrame:
    """(random, w, held): distinct labelled values, spelled; ``held`` ones are for the threshold."""
    text = F.col("text")
    found = documents.filter(text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX)).select(fixed(text).alias("found"))
    secrets = found.select(F.explode("found.value").alias("w")).distinct().orderBy(F.xxhash64("w"), "w").limit(sample)
    plain = documents.filter(~(text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX)) & F.col("doc_id").isNotNull())
    chosen = F.broadcast(plain.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct())
    runs = F.filter(F.split("text", f"[^{CHARACTERS}]+"), lambda w: F.length(w) >= 6)
    some = F.when(F.pmod(F.xxhash64(F.lit("compound"), "doc_id"), F.lit(COMPOUND)) == 0, compounds(text)).otherwise(F.array().cast("array<string>"))
    ordinary = plain.join(chosen, "doc_id", "left_semi").select(F.explode(F.concat(runs, some)).alias("w")).distinct()
    both = secrets.withColumn("random", F.lit(True)).unionByName(ordinary.withColumn("random", F.lit(False)))
    both = both.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "w"), F.lit(HELD_OUT)) == 0)
    return both.withColumn("w", F.explode(spelled(F.col("w"), F.col("random"))))


def ratios(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio of each step, row by row: a table of fixed size, whatever the input's."""
    size = len(ALPHABET) + 1
    counts = {kind: [[1.0] * size for _ in range(size)] for kind in (True, False)}
    each = labelled.filter(~F.col("held")).select("random", F.explode(pairs(F.col("w"))).alias("p"))
    for kind, a, b, n in each.groupBy("random", "p.a", "p.b").count().collect():  # at most 2 * size * size rows
        counts[kind][a][b] += n
    share = {kind: [[c / sum(row) for c in row] for row in rows] for kind, rows in counts.items()}
    return [log(r / p) for random, usual in zip(share[True], share[False]) for r, p in zip(random, usual)]


def likely(value: Column, ratio: list[float]) -> Column:
    """The mean log-likelihood ratio of the value's steps."""
    size = len(ALPHABET) + 1
    held = F.split(F.lit(",".join(f"{x:.6f}" for x in ratio)), ",").cast("array<double>")
    total = F.aggregate(
        pairs(value), F.lit(0.0), lambda t, p: t + F.element_at(held, (p["a"] * size + p["b"] + 1).cast("int"))
    )
    return total / (F.length(value) - 1)


def threshold(labelled: DataFrame, ratio: list[float]) -> float:
    """The ratio above which a run is a secret, from the held-out values."""
    scores = labelled.filter(F.col("held")).withColumn("score", likely(F.col("w"), ratio))
    low = F.expr("percentile(if(random, score, null), 0.05)")
    high = F.expr(f"percentile(if(not random and length(w) >= {LEAST}, score, null), 0.999)")
    low, high = scores.agg(low, high).first()
    if low is None:
        return MARGIN
    return low - 0.1 if high is None else high + max(low - high, 0.0) / 4


def fit(documents: DataFrame, sample: int = SAMPLE) -> tuple[list[float], float]:
    """The models' ratios and the threshold. ``documents``: doc_id, text."""
    labelled = samples(documents, sample).persist(StorageLevel.MEMORY_ONLY)  # bounded; never on disk, lost parts are made again
    ratio = ratios(labelled)
    margin = threshold(labelled, ratio)
    labelled.unpersist()
    return ratio, margin


def secrets(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, found, added): fixed spans, and those that the models find; one row for each input row."""
    documents = documents.select("doc_id", "text")
    ratio, margin = fit(documents, sample)
    text = F.coalesce(F.col("text"), F.lit(""))
    added = S.matches(text, f"[{CHARACTERS}]{{{LEAST},}}+", 3, lambda v: likely(v, ratio) > margin)
    return documents.select("doc_id", fixed(text).alias("found"), added.alias("added"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ("start", "kind")
    got = secrets(table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id",
        *[S.count_of(F.col("found"), k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(S.joined(F.col("found"), KINDS, by), 256).alias("base_sha256"),
        S.joined(F.concat("found", "added"), KINDS, by).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
    )
