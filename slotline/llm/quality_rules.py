"""Quality rules: exact rule counts, then an isolation forest over rule statistics.

Method. A forest of random trees (random feature, random split between the node's extremes) is grown on the rule ratios of
the labelled rows. As the method has it, each tree takes a subsample of its own of ``SUBSAMPLE`` rows; any labelled row may
be drawn for any tree, a bad one with less weight, so that anomalies are rare where trees grow. A document's anomaly
score is 2 ** (-mean path length / c(SUBSAMPLE)), in steps of 1 / ``STEPS``. Each length band has a threshold calibrated on
every labelled row: the one with the best gain of rejected bad rows over lost good ones, while no more than ``MAX_LOSS`` of
the good rows go.

How it runs. One pass makes the statistics of every text, which are written; labels are joined to these, so that no text is
shuffled. Draws are grouped by tree and each tree is grown in a task; the labelled rows are scored in tasks too, and are
counted by score. The driver has the trees and these counts, at most one for each band, step and label.

Null and empty texts have no words, so the base rule rejects them; texts of any length are read whole. Ties and repeated rows score alike. With no
labelled rows of either kind, as with empty tables, nothing but the base rule rejects. Further input columns pass through ``judge``
untouched; its own columns replace inputs of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.llm import text_stats
from slotline.llm.common import discard, extended, map_rows, release, table, written

TREES, SUBSAMPLE, DEPTH = 128, 512, 12
STEPS = 1 << 14  #: a score's resolution
MAX_LOSS = 0.005
RARE, FEW = 0.015, 3  #: bad rows that a tree draws on average: a share of its good rows, but on small tables these few
BANDS = (40, 200)  #: word counts at which the length bands part
#: The rule statistics that the forest splits on: those that clean texts keep near zero whatever their length.
RULES = ("symbol", "pipe", "upper", "exclaim", "repeat8", "adjacent", "symbol_words")
_PICK = [text_stats.RATIOS.index(r) for r in RULES]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def mean_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2.0 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2.0 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays over heap positions: feature (-1: leaf), split value and the leaf's path length."""

    feature: np.ndarray
    split: np.ndarray
    length: np.ndarray
    size: int

    @staticmethod
    def tree(rows: np.ndarray, rng: np.random.Generator) -> tuple[list[int], list[int], list[float], list[float]]:
        """One tree: heap positions, with the feature (-1: leaf), split value and path length of each."""
        todo, nodes = [(1, rows, 0)], []
        while todo:
            at, part, depth = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth == DEPTH or len(part) < 2 or not len(open_):
                nodes.append((at, -1, 0.0, float(depth + mean_depth(len(part)))))
                continue
            f = rng.choice(open_)
            v = rng.uniform(low[f], high[f])
            nodes.append((at, int(f), float(v), 0.0))
            left = part[:, f] <= v
            todo += [(2 * at, part[left], depth + 1), (2 * at + 1, part[~left], depth + 1)]
        return tuple(map(list, zip(*nodes)))

    @classmethod
    def of(cls, trees: list, size: int) -> Forest:
        """The forest of trees as ``tree`` gives them, each grown on ``size`` rows."""
        shape = (len(trees), 2 ** (DEPTH + 1))
        forest = cls(np.full(shape, -1, dtype=np.int16), np.zeros(shape), np.zeros(shape), size)
        for t, (at, feature, split, length) in enumerate(trees):
            forest.feature[t, at], forest.split[t, at], forest.length[t, at] = feature, split, length
        return forest

    @classmethod
    def grow(cls, rows: np.ndarray, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        size = min(SUBSAMPLE, len(rows))
        return cls.of([cls.tree(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(TREES)], size)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores between 0 and 1; higher is rarer."""
        rows = np.asarray(rows, dtype=float)
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, length in zip(self.feature, self.split, self.length):
            at = np.ones(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[every, np.maximum(f, 0)] > split[at]
                at = np.where(inner, 2 * at + right, at)
            total += length[at]
        score = 2.0 ** (-total / len(self.feature) / max(float(mean_depth(self.size)), 1.0))
        return np.round(score * STEPS) / STEPS


@dataclass
class RuleModel:
    """A fitted forest with a threshold for each length band; no forest: nothing is anomalous."""

    forest: Forest | None
    thresholds: tuple[float, ...]

    @staticmethod
    def band(n_words: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(BANDS), n_words, side="right")

    def anomalous(self, n_words: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.forest is None or not len(ratios):
            return np.zeros(len(ratios)), np.zeros(len(ratios), dtype=bool)
        score = self.forest.score(ratios)
        return score, score > np.array(self.thresholds)[self.band(n_words)]


def calibrated(cuts: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The score above which rows are rejected: best gain, with at most MAX_LOSS of the good rows above. ``cuts``: the scores
    that occur, rising, with how many good and bad rows have each."""
    if not good.sum() or not bad.sum():
        return np.inf
    lost, caught = (1.0 - np.cumsum(n) / n.sum() for n in (good, bad))
    allowed = lost <= MAX_LOSS
    return float(cuts[allowed][np.argmax((caught - lost)[allowed])])


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, the rule counts and the ratios of every whole text."""

    def make():
        def each(doc_id, text):
            c, words, raw = text_stats.counts(text)
            return (doc_id, *(c[k] for k in COUNTS), rules_of(c, words, raw))

        return each

    fields = ", ".join(f"{c} long" for c in COUNTS)
    return map_rows(documents.select("doc_id", "text"), f"doc_id long, {fields}, ratios array<double>", make)


def rules_of(c: dict[str, int], words: list[bytes], raw: bytes) -> list[float]:
    every = text_stats.ratios(c, words, raw)
    return [every[i] for i in _PICK]


def base_failed(c: dict[str, int]) -> bool:
    return c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]


def labelled(spark: SparkSession, rows: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, ratios, good) of every labelled row of ``statistics`` that the base rule does not reject."""
    labels = table(spark, sf_dir, "labels").filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    labels = labels.groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    passed = rows.filter((F.col("n_words") >= 20) & (100 * F.col("n_repeat_words") <= 30 * F.col("n_words")))
    return passed.join(labels, "doc_id").select("doc_id", "n_words", "ratios", "good")


def grown(rows: DataFrame, good: int, bad: int, seed: int = 7) -> Forest:
    """The forest of ``labelled`` rows, each tree from its own draw of all of them and in its own group."""
    import pyarrow as pa

    weight = min(1.0, max(FEW, RARE * good) / bad) if good and bad else 1.0  # of a bad row
    mass = good + weight * bad
    size = min(SUBSAMPLE, max(1, round(mass)))
    least = min(1.0, 1.5 * SUBSAMPLE / mass)  # draws below it are more than a tree takes
    own = F.xxhash64("doc_id", "ratios")
    draw = lambda t: F.pmod(F.xxhash64(F.col("own"), t), F.lit(1 << 40)) / F.lit(float(1 << 40)) / F.col("weight")
    each = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), draw(t).alias("draw")))
    drawn = rows.select("ratios", own.alias("own"), F.when(F.col("good"), 1.0).otherwise(weight).alias("weight"))
    drawn = drawn.select("ratios", F.explode(F.filter(each, lambda x: x.draw < least)).alias("d")).select("d.tree", "d.draw", "ratios")

    def run(part: pa.Table) -> pa.Table:
        tree = part.column("tree")[0].as_py()
        # one order, however the rows were dealt
        taken = sorted(zip(part.column("draw").to_pylist(), part.column("ratios").to_pylist()))[:size]
        nodes = Forest.tree(np.array([r for _, r in taken]), np.random.default_rng((seed, tree)))
        return pa.Table.from_pylist([dict(zip(("tree", "at", "feature", "split", "length"), (tree, *nodes)))], schema)

    schema = pa.schema([
        ("tree", pa.int32()), ("at", pa.list_(pa.int32())), ("feature", pa.list_(pa.int32())),
        ("split", pa.list_(pa.float64())), ("length", pa.list_(pa.float64())),
    ])
    trees = drawn.groupBy("tree").applyInArrow(run, "tree int, at array<int>, feature array<int>, split array<double>, length array<double>")
    return Forest.of([r[1:] for r in sorted(trees.collect())], size)  # TREES trees of fewer than 2 * SUBSAMPLE nodes


def thresholds(rows: DataFrame, forest: Forest) -> tuple[float, ...]:
    """Each band's threshold, from the scores of all ``labelled`` rows."""
    import pyarrow as pa

    held = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                score = held.value.score(np.array(part.column(1).to_pylist()))
                bands = RuleModel.band(part.column(0).to_numpy(zero_copy_only=False))
                columns = [pa.array(bands, pa.int32()), pa.array(np.round(score * STEPS).astype(np.int32)), part.column(2)]
                yield pa.RecordBatch.from_arrays(columns, names=["band", "step", "good"])

    steps = rows.select("n_words", "ratios", "good").mapInArrow(run, "band int, step int, good boolean")
    counts = steps.groupBy("band", "step").agg(F.sum(F.col("good").cast("long")).alias("good"), F.count("*").alias("n"))
    got = counts.orderBy("band", "step").collect()  # at most (STEPS + 1) rows a band, whatever the corpus
    found = []
    for band in range(len(BANDS) + 1):
        step, good, n = np.array([r[1:] for r in got if r.band == band], dtype=np.int64).reshape(-1, 3).T
        found.append(calibrated(step / STEPS, good, n - good))
    return tuple(found)


def fitted(spark: SparkSession, rows: DataFrame, sf_dir: str) -> RuleModel:
    """A model from every labelled row. ``rows``: ``statistics``, written."""
    own = written(labelled(spark, rows, sf_dir), "labelled")
    n = own.agg(F.count("*").alias("all"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("good")).first()
    if n["all"] < 2:
        model = RuleModel(None, (np.inf,) * (len(BANDS) + 1))
    else:
        forest = grown(own, n.good, n["all"] - n.good)
        model = RuleModel(forest, thresholds(own, forest))
    discard(own)
    return model


def fit(spark: SparkSession, documents: DataFrame, sf_dir: str) -> RuleModel:
    """A model from every labelled document."""
    rows = written(statistics(documents), "statistics")
    model = fitted(spark, rows, sf_dir)
    discard(rows)
    return model


def judge(documents: DataFrame, model: RuleModel) -> DataFrame:
    """Every input row with its counts, base_failed, anomaly (score) and kept. Needs a ``text`` column."""
    import pyarrow as pa

    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(model)
    own = [*COUNTS, "base_failed", "anomaly", "kept"]
    documents = documents.drop(*own)
    schema = extended(documents, **dict.fromkeys(COUNTS, "long"), base_failed="boolean", anomaly="double", kept="boolean")
    place = documents.columns.index("text")

    def run(batches):
        release()
        model = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                seen = [text_stats.counts(t) for t in part.column(place).to_pylist()]
                found = [c for c, _, _ in seen]
                ratios = np.array([rules_of(*x) for x in seen])
                n_words = np.array([c["n_words"] for c in found])
                failed = np.array([base_failed(c) for c in found], dtype=bool)
                score, odd = model.anomalous(n_words, ratios)
                columns = [pa.array([c[k] for c in found], pa.int64()) for k in COUNTS]
                columns += [pa.array(failed), pa.array(score, pa.float64()), pa.array(~failed & ~odd)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *own])

    return documents.mapInArrow(run, schema)


def verdicts(rows: DataFrame, model: RuleModel) -> DataFrame:
    """``statistics`` with base_failed, kept and anomaly, as ``judge`` has them, without its ratios."""
    import pyarrow as pa

    held = rows.sparkSession.sparkContext.broadcast(model)
    own = ["base_failed", "kept", "anomaly"]
    rows = rows.select("doc_id", *COUNTS, "ratios")
    schema = extended(rows.drop("ratios"), base_failed="boolean", kept="boolean", anomaly="double")

    def run(batches):
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns = dict(zip(part.schema.names, part.columns))
                seen = part.select(list(COUNTS)).to_pylist()
                failed = np.array([base_failed(c) for c in seen], dtype=bool)
                ratios = np.array(columns.pop("ratios").to_pylist())
                score, odd = held.value.anomalous(np.array([c["n_words"] for c in seen]), ratios)
                added = [pa.array(failed), pa.array(~failed & ~odd), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([*columns.values(), *added], names=[*columns, *own])

    return rows.mapInArrow(run, schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = written(statistics(documents), "statistics")
    return verdicts(rows, fitted(spark, rows, sf_dir))
