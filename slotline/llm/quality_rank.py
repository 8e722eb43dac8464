"""Quality classifier: Bradley-Terry pairwise ranking with a score quantile as threshold.

Method. Each document has a vector of text statistics. A bounded sample of labelled rows gives preference pairs
(a good row, a bad row); the weights w maximise the likelihood of every preference, P(a over b) =
sigmoid(w . (x_a - x_b)), by logistic loss on the feature differences with an L2 penalty. The strength w . x is
then put on a scale from 0 to 1 by a logistic curve through the quantile of the strengths that parts the good
from the bad rows best: a document at that quantile scores ``CUT``.

The sampled rows are put in one order before the pairs are drawn, so a fit does not depend on how rows are dealt. Null and
empty texts have all statistics zero and get the score of such a vector; texts of any length are read whole. Without labelled rows of both
kinds, as with empty tables, every score is 0.5. Repeated rows score alike; extra columns of the input pass through ``score``, whose own
columns replace inputs of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.llm import text_stats
from slotline.llm.common import extended, fold, map_rows, sampled_labels, table

SAMPLE_LIMIT = 16_000  #: labelled rows, at most
PAIRS = 120_000  #: preference pairs drawn from them, at most
CUT = 0.3


def vector(text: str | None) -> list[float]:
    """The document's features: ratios, their square roots (for small shares), and length."""
    c, words, raw = text_stats.counts(text)
    r = text_stats.ratios(c, words, raw)
    n = c["n_words"]
    return [*r, *np.sqrt(r).tolist(), float(np.log1p(n)) / 8.0, 1.0 if n < 20 else 0.0, 1.0 if n == 0 else 0.0]


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    steep: float

    @classmethod
    def fit(cls, rows: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 11) -> Ranker | None:
        if not good.any() or good.all():
            return None
        rng = np.random.default_rng(seed)
        mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
        x = np.clip((rows - mean) / scale, -8, 8)
        a = rng.choice(np.flatnonzero(good), pairs)
        b = rng.choice(np.flatnonzero(~good), pairs)
        step, w, first, second = 0.05, np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
        t = 0
        for _ in range(6):
            order = rng.permutation(pairs)
            for at in range(0, pairs, 1024):
                part = order[at : at + 1024]
                diff = x[a[part]] - x[b[part]]
                lose = 1.0 / (1.0 + np.exp(np.clip(diff @ w, -30, 30)))
                grad = -(diff * lose[:, None]).mean(axis=0) + 1e-3 * w
                t += 1
                first = 0.9 * first + 0.1 * grad
                second = 0.999 * second + 0.001 * grad**2
                w = w - step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        strength = x @ w
        cuts = np.quantile(strength, np.linspace(0, 1, 1001))
        lost = np.searchsorted(np.sort(strength[good]), cuts) / good.sum()
        caught = np.searchsorted(np.sort(strength[~good]), cuts) / (~good).sum()
        cut = float(cuts[np.argmax(caught - 2.0 * lost)])
        return cls(mean, scale, w, cut, 1.0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        strength = np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weight
        z = self.steep * (strength - self.cut) + np.log(CUT / (1 - CUT))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit(spark: SparkSession, documents: DataFrame, sf_dir: str, limit: int = SAMPLE_LIMIT) -> Ranker | None:
    """A ranker from at most ``limit`` labelled rows whose fold of 5 is not 0; only their vectors reach the driver."""
    labels = F.broadcast(sampled_labels(spark, sf_dir, limit, fold(F.col("doc_id"), 5) != 0).select("doc_id", "quality"))
    chosen = documents.select("doc_id", "text").join(labels, "doc_id", "left_semi")

    def make():
        return lambda doc_id, text: (doc_id, vector(text))

    got = map_rows(chosen, "doc_id long, x array<double>", make).join(labels, "doc_id")
    got = got.select(F.xxhash64("doc_id").alias("h"), "doc_id", "x", "quality").collect()
    if not got:
        return None
    got = sorted(got, key=lambda r: (r.h, r.doc_id, r.quality, r.x))  # whatever order the tasks came in
    return Ranker.fit(np.array([r.x for r in got]), np.array([r.quality == 1 for r in got]))


def score(documents: DataFrame, ranker: Ranker | None) -> DataFrame:
    """Every input row with score and predicted. Needs a ``text`` column."""
    import pyarrow as pa

    held = documents.sparkSession.sparkContext.broadcast(ranker)
    documents = documents.drop("score", "predicted")
    place = documents.columns.index("text")

    def run(batches):
        ranker = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = np.array([vector(t) for t in part.column(place).to_pylist()])
                got = ranker.score(rows) if ranker else np.full(len(rows), 0.5)
                columns = [pa.array(got), pa.array((got >= CUT).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "score", "predicted"])

    return documents.mapInArrow(run, extended(documents, score="double", predicted="int"))


def op3_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(documents, fit(spark, documents, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
