"""Language identification of words by a linear-chain conditional random field.

Method. A document's words are a chain with a hidden language each. A word's score for a language is the sum of the
weights of its features: affixes, character n-grams (hashed), and a lexicon of whole words; neighbours add a learned
transition weight. Weights maximise the labels' conditional likelihood (forward-backward gradients, Adam, L2) on
sequences spliced from pieces of documents of several languages, as code-switched text is, so that the transitions
learn how long a language lasts. At prediction, forward-backward gives each word its probabilities; a document's
language has the largest sum of them over its words with letters, and its score is the mean. Words of any length have
all their features.

The documents learned from are a bounded sample (``SAMPLE``); all whole texts are labelled, very long ones in a batch of
their own. A null text or one without a letter (a character of category L) is ``und`` with score 0. Without labelled documents every text is ``und``. Ties go to the first language by
name. Repeated rows are labelled alike; extra columns pass through ``label``, whose own columns replace inputs of the
same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.llm.common import extended, fold, machine, table

SAMPLE = 3_000  #: documents learned from, at most
LENGTH, PIECE = 48, (4, 16)  #: words in a training sequence, and in each of its pieces
SEQUENCES = 4_000
BUCKETS = 1 << 15
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.08, 1e-4
MAX_WORDS = 400_000  #: words whose scores a worker keeps
CELLS = 200_000  #: words padded into one batch of chains
TEXTS = 2048  #: texts sorted by length before they are put into batches
MARKS = ".,;:!?\"'()[]|*#$%&"
WIDE = 24  #: letters that words are padded to; longer ones to twice as many, and so on
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def feature_ids(words: list[str], wide: int) -> np.ndarray:
    """Buckets of the features of words of at most ``wide`` letters, one row per word, 0 where there is none: all 1- to
    3-grams with the word's ends marked, its first three and last three and four letters, and the word itself."""
    codes = np.array(words, dtype=f"<U{wide}").view("<u4").reshape(len(words), wide).astype(np.uint64)
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    marked = np.zeros((len(words), wide + 2), dtype=np.uint64)
    marked[:, 0] = 2
    marked[:, 1:-1] = codes
    rows = np.arange(len(words))
    marked[rows, n + 1] = 3
    out = []
    with np.errstate(over="ignore"):

        def bucket(h: np.ndarray, there: np.ndarray) -> np.ndarray:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(32))
            return np.where(there, (h % np.uint64(BUCKETS - 1)).astype(np.int64) + 1, 0)

        rolled = np.zeros((len(words), wide + 2), dtype=np.uint64)
        for k in (1, 2, 3):
            width = wide + 3 - k
            rolled = rolled[:, :width] * np.uint64(0x9E3779B97F4A7C15) + marked[:, k - 1 : k - 1 + width] + np.uint64(k)
            out.append(bucket(rolled, np.arange(width) + k <= n[:, None] + 2))
        for tag, at, k in ((11, np.zeros_like(n), 4), (12, n - 2, 4), (13, n - 3, 5), (14, None, wide)):
            h = np.full(len(words), tag, dtype=np.uint64)
            for j in range(k):  # a word's length tells its group, so its own feature is the same wherever it stands
                letter = codes[:, j] if at is None else marked[rows, np.clip(at + j, 0, wide + 1)]
                h = h * np.uint64(0x9E3779B97F4A7C15) + letter
            out.append(bucket(h, n >= (1 if at is None else k - 1))[:, None])
    ids = np.concatenate(out, axis=1)
    ids[n == 0] = 0
    return ids


def width_groups(words: list[str]) -> Iterator[tuple[np.ndarray, list[str], int]]:
    """Words without the marks around them, in groups that are padded to one width: places, words and the width, which
    doubles from WIDE on, so that long words have all their features and short ones pay nothing for them."""
    bare = [w.strip(MARKS) for w in words]
    size = np.fromiter(map(len, bare), dtype=np.int64, count=len(bare))
    level = np.ceil(np.log2(np.maximum(size, WIDE) / WIDE)).astype(np.int64)
    for step in np.unique(level).tolist():
        at = np.flatnonzero(level == step)
        wide = WIDE << step
        rows = max(1, 4096 * WIDE // wide)
        for k in range(0, len(at), rows):
            part = at[k : k + rows]
            yield part, [bare[i] for i in part.tolist()], wide


def feature_lists(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' features end to end, and how many each word has; a word without any has the void feature 0."""
    size, parts = np.ones(len(words), dtype=np.int64), []
    for at, bare, wide in width_groups(words):
        ids = feature_ids(bare, wide)
        n = (ids > 0).sum(axis=1)
        size[at] = np.maximum(n, 1)
        ids[n == 0, 0] = -1
        kept = ids[ids != 0]
        parts.append((at, np.maximum(kept, 0)))
    start = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), dtype=np.int64)
    for at, kept in parts:
        own = size[at]
        flat[np.repeat(start[at] - (np.cumsum(own) - own), own) + np.arange(len(kept))] = kept
    return flat, size


def forward_backward(scores: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals [n, t, y], expected transitions [y, y] and log partitions [n]. scores: [n, t, y], padded at the end."""
    n, t, y = scores.shape
    top = scores.max(axis=2, keepdims=True)
    local = np.exp(scores - top)
    step = np.exp(move).astype(scores.dtype)
    forth, scale = np.empty_like(local), np.ones((n, t))
    now = local[:, 0]
    for k in range(t):
        if k:
            now = np.where(mask[:, k, None], (now @ step) * local[:, k], now)
        total = now.sum(axis=1)
        scale[:, k] = np.where(mask[:, k], total, 1.0)
        now = forth[:, k] = now / total[:, None]
    back = np.ones_like(local)
    after = np.ones((n, y))
    expected = np.zeros((y, y))
    for k in range(t - 2, -1, -1):
        inner = local[:, k + 1] * after / scale[:, k + 1, None]
        inner = np.where(mask[:, k + 1, None], inner, 0.0)
        expected += step * (forth[:, k].T @ inner)
        after = np.where(mask[:, k + 1, None], inner @ step.T, after)
        back[:, k] = after
    marginal = forth * back
    marginal /= marginal.sum(axis=2, keepdims=True)
    return marginal, expected, (np.log(scale) * mask).sum(axis=1) + (top[:, :, 0] * mask).sum(axis=1)


def mean_marginals(chains: list[np.ndarray], scores: np.ndarray, move: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Forward-backward for prediction: mean marginals [n, y] over the words of each chain that ``told`` marks. Chains are
    places of words in ``scores`` [word, y] and ``told``; shorter chains come first, so that those that reach a step are the
    last ones and no step computes padding. What all languages of a step share cancels out."""
    sizes = np.fromiter(map(len, chains), dtype=np.int64, count=len(chains))
    n, t = len(chains), int(sizes[-1])
    start = np.searchsorted(sizes, np.arange(t), side="right").tolist()  # the first chain that has a word at each step
    ids = np.zeros((t, n), dtype=np.int64)
    for k, own in enumerate(chains):
        ids[: len(own), k] = own
    local, marked = scores.T[:, ids], told[ids].astype(scores.dtype)
    local -= local.max(axis=0)
    np.exp(local, out=local)
    step = np.exp(move).astype(scores.dtype)
    back = step.T.copy()
    forth = local.copy()
    now = forth[:, 0]
    now /= now.sum(axis=0)
    for k in range(1, t):
        own = forth[:, k, start[k] :]
        own *= back @ now[:, now.shape[1] - own.shape[1] :]
        own /= own.sum(axis=0)
        now = own
    shares = np.zeros((len(local), n))
    after = np.ones((len(local), n), dtype=scores.dtype)
    for k in range(t - 1, -1, -1):
        a = start[k]
        both = forth[:, k, a:] * after[:, a:]
        both *= marked[k, a:] / both.sum(axis=0)
        shares[:, a:] += both
        if k:
            own = step @ (local[:, k, a:] * after[:, a:])
            own /= own.sum(axis=0)
            after[:, a:] = own
    reached = np.arange(t)[:, None] < sizes
    return (shares / (marked * reached).sum(axis=0)).T


@dataclass
class Model:
    languages: list[str]
    weight: np.ndarray  #: [bucket, language]
    move: np.ndarray  #: [from, to]

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], seed: int = 5) -> Model | None:
        languages = sorted({lang for _, lang in rows})
        by = [[w for t, lang in rows if lang == x for w in [words_of(t)] if w] for x in languages]
        languages, by = [x for x, d in zip(languages, by) if d], [d for d in by if d]
        if not languages:
            return None
        rng = np.random.default_rng(seed)
        y = len(languages)
        chains, labels = [], []
        for _ in range(SEQUENCES):
            spliced, label = [], []
            while len(spliced) < LENGTH:
                lang = int(rng.integers(y))
                words = by[lang][rng.integers(len(by[lang]))]
                size = int(rng.integers(*PIECE))
                at = int(rng.integers(max(1, len(words) - size + 1)))
                part = words[at : at + size]
                spliced += part
                label += [lang] * len(part)
            chains.append(spliced[:LENGTH])
            labels.append(label[:LENGTH])
        place: dict[str, int] = {}
        at_word = np.array([[place.setdefault(w, len(place)) for w in words] for words in chains])
        flat_of, size_of = feature_lists(list(place))
        first_of = np.cumsum(size_of) - size_of
        gold = np.array(labels)
        weight, move = np.zeros((BUCKETS, y)), np.zeros((y, y))
        moments = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(move), np.zeros_like(move)]
        t = 0
        mask = np.ones((BATCH, LENGTH), dtype=bool)
        for _ in range(EPOCHS):
            order = rng.permutation(len(chains))
            for at in range(0, len(order) - BATCH + 1, BATCH):
                picked = order[at : at + BATCH]
                words = at_word[picked].ravel()
                size = size_of[words]
                start = np.cumsum(size) - size
                flat = flat_of[np.arange(int(size.sum())) + np.repeat(first_of[words] - start, size)]
                scores = np.add.reduceat(weight[flat], start)
                word = np.repeat(np.arange(len(words)), size)
                marginal, expected, _ = forward_backward(scores.reshape(BATCH, LENGTH, y), move, mask)
                truth = np.eye(y)[gold[picked]]
                error = (marginal - truth).reshape(-1, y) / BATCH
                touched, place = np.unique(flat, return_inverse=True)
                grad = np.zeros((len(touched), y))
                np.add.at(grad, place, error[word])
                grad += DECAY * weight[touched]
                seen = np.zeros((y, y))
                np.add.at(seen, (gold[picked][:, :-1].ravel(), gold[picked][:, 1:].ravel()), 1.0)
                moved = (expected - seen) / BATCH + DECAY * move
                t += 1
                rate = RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                m, v, mm, mv = moments
                m[touched] = 0.9 * m[touched] + 0.1 * grad
                v[touched] = 0.999 * v[touched] + 0.001 * grad**2
                weight[touched] -= rate * m[touched] / (np.sqrt(v[touched]) + 1e-8)
                weight[0] = 0  # the void feature
                mm[:] = 0.9 * mm + 0.1 * moved
                mv[:] = 0.999 * mv + 0.001 * moved**2
                move -= rate * mm / (np.sqrt(mv) + 1e-8)
        return cls(languages, weight.astype(np.float32), move)


class Labeller:
    """A worker's own scorer: chains are padded into batches of bounded size; words' scores are kept in a table."""

    def __init__(self, model: Model | None):
        self.model = model
        self.begin()

    def begin(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages) if self.model else 1), dtype=np.float32)
        self.lettered = np.zeros(0, dtype=bool)

    def learn(self, words: Iterable[str]) -> None:
        """Takes words that are new into the tables."""
        new = list(set(words).difference(self.place))
        if new:
            base = len(self.place)
            self.place.update(zip(new, range(base, base + len(new))))
            if len(self.scores) < base + len(new):
                size = max(4096, base + len(new), len(self.scores) * 3 // 2)
                self.scores = np.concatenate([self.scores, np.zeros((size - len(self.scores), self.scores.shape[1]), dtype=np.float32)])
                self.lettered = np.concatenate([self.lettered, np.zeros(size - len(self.lettered), dtype=bool)])
            for at, bare, wide in width_groups(new):
                self.scores[base + at] = self.model.weight[feature_ids(bare, wide)].sum(axis=1)
            self.lettered[base : base + len(new)] = list(map(has_letter, new))

    def places(self, words: list[str]) -> np.ndarray:
        self.learn(words)
        return self._places(words)

    def _places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if self.model is None:
            return out
        if len(self.place) > MAX_WORDS:
            self.begin()
        chains = [(i, words_of(t)) for i, t in enumerate(texts) if t and has_letter(t)]
        self.learn(chain.from_iterable(w for _, w in chains))  # of all texts at once, as calls for few words cost most
        chains = sorted(((i, self._places(w)) for i, w in chains if w), key=lambda x: len(x[1]))
        at = 0
        while at < len(chains):
            upto = at + 1
            while upto < len(chains) and len(chains[upto][1]) * (upto + 1 - at) <= CELLS:
                upto += 1
            part = chains[at:upto]
            share = mean_marginals([x for _, x in part], self.scores, self.model.move, self.lettered)
            for (i, _), s in zip(part, share):
                best = int(s.argmax())
                out[i] = (self.model.languages[best], float(min(1.0, s[best])))
            at = upto
        return out


def fit(documents: DataFrame, limit: int = SAMPLE) -> Model | None:
    """A model from at most ``limit`` documents with a lang whose fold of 3 is not 1, those with the smallest id hash."""
    known = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    chosen = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).distinct()
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id", "left_semi")
    got = rows.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "text").limit(limit)
    return Model.fit([(r.text, r.lang) for r in got.select("text", "lang").toLocalIterator()])


def label(documents: DataFrame, model: Model | None) -> DataFrame:
    """Every input row with lang_pred and lang_score. Needs a ``text`` column."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    documents = documents.drop("lang_pred", "lang_score")
    place = documents.columns.index("text")

    def run(batches):
        labeller = machine(held.value, lambda: Labeller(held.value))
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                got = labeller.predict(part.column(place).to_pylist())
                columns = [pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *columns], names=[*part.schema.names, "lang_pred", "lang_score"]
                )

    return documents.mapInArrow(run, extended(documents, lang_pred="string", lang_score="double"))


def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = label(documents.select("doc_id", "text"), fit(documents))
    return got.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
