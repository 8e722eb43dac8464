"""Language-model scores of whole texts, beside unigram base scores.

Method. Words (ASCII lower case) become subword ids of a public vocabulary; a causal self-attention model
(``attention_lm``) scores every id once in overlapping windows, and a text's score is the sum over its ids. All counts
(words, ids, tails of classes) cover every training text, and the attention weights learn from every window of every
training text once: texts are dealt to ``ROUNDS`` by a hash, small ones first; in a round every task trains from the same
weights on the windows of its texts of that round, and the weights are averaged, by their windows, with an aggregation. A
task reads as many of the table's parts as it needs to have LEAST_WINDOWS; beyond that, scores still differ a little with
how the table is dealt, as other tasks' weights are averaged.

How it runs. One pass turns texts into blocks of about ``BLOCK`` bytes, each with its own word list and its texts as
places in that list. Word rows (one per block and distinct word) are summed by word with partial sums; each distinct word
is made subwords once, beside its sum. Word rows are joined with those, a join that Spark splits where a word stands in very
many blocks; then they return by block, as subwords. No row per occurrence is ever shuffled. A training task keeps the
subwords of the last ``KEPT`` words that it met.

A null or empty text has the end token alone. Very long texts are read whole and may make a block of their own.
Without training texts N and V are 0 and the weights stay as they began; an empty table gives an empty result. Repeated
rows and rows without an id are scored like others (a null id is the empty text to the fold), and equal texts score
alike. Columns other than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.llm import attention_lm as lm
from slotline.llm.byte_bpe import read_ranks
from slotline.llm.common import fold, machine, release, sweeping, table, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK = 12_000_000
#: Of each round: sixteenths of the training texts, the rate of learning, and windows in a step.
ROUNDS = ((1, 3e-2, 32), (3, 1.5e-2, 64), (12, 6e-3, 64))
#: Windows that a task of a round learns from, on average, at least: fewer would leave tasks within the trainer's first
#: steps, and the mean of such weights is worse than any of them.
LEAST_WINDOWS = 65_536
ROWS = 65_536  #: word rows in one Arrow batch
SOME = 8_192  #: words made subwords at once
KEPT = 150_000  #: words that a training task keeps with their subwords, before it begins anew


class Blocks(dict):
    """The word list of a block under way: a new word takes the next place."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def blocked(documents: DataFrame) -> DataFrame:
    """Text rows (block, doc_id, held_out, n, places) and word rows (block, place, word, n) of one pass, as one table.

    ``documents``: doc_id, text, held_out. ``places`` are packed and compressed; a word row's n counts training texts.
    """
    schema = "block long, doc_id long, held_out boolean, n long, places binary, place int, word binary"
    names = ["block", "doc_id", "held_out", "n", "places", "place", "word"]

    def run(batches):
        release()
        task, number = TaskContext.get().partitionId(), 0
        words, training, texts, size = Blocks(), [], [], 0

        def close():
            nonlocal words, training, texts, size, number
            counts = np.bincount(np.concatenate([np.zeros(0, dtype="<u4"), *training]), minlength=len(words))
            block = (task << 32) + number
            of = lambda n, x, t: pa.array([x] * n, t)
            for at in range(0, len(texts), 512):
                part = list(zip(*texts[at : at + 512]))
                n = len(part[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        of(n, block, pa.int64()), pa.array(part[0], pa.int64()), pa.array(part[1], pa.bool_()),
                        pa.array(part[2], pa.int64()), pa.array(part[3], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                    ],
                    names=names,
                )
            listed = list(words)
            for at in range(0, len(listed), ROWS):
                part = listed[at : at + ROWS]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        of(n, block, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(counts[at : at + n]),
                        pa.nulls(n, pa.binary()), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(part, pa.binary()),
                    ],
                    names=names,
                )
            words, training, texts, size = Blocks(), [], [], 0
            number += 1

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for doc_id, text, held_out in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    raw = (text or "").encode("utf-8").lower().split()
                    places = np.fromiter(map(words.__getitem__, raw), dtype="<u4", count=len(raw))
                    if not held_out:
                        training.append(places)
                    packed = pa.compress(places.tobytes(), codec="zstd", asbytes=True)
                    texts.append((doc_id, held_out, len(raw), packed))
                    size += len(text or "")
                    if size >= BLOCK:
                        yield from close()
        if texts:
            yield from close()

    return documents.select("doc_id", "text", "held_out").mapInArrow(run, schema)


class Subwords:
    """Ids of words, each with a space before it."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.coding = tiktoken.Encoding(
            "subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each word has."""
        flats, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(words), SOME):  # lists of some words only are held at once
            found = [self.coding.encode_ordinary(" " + w.decode("utf-8")) for w in words[at : at + SOME]]
            sizes.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            flats.append(np.fromiter((i for x in found for i in x), dtype=np.int64, count=int(sizes[-1].sum())))
        return np.concatenate(flats), np.concatenate(sizes)


def _subwords(held) -> Subwords:
    return machine(held.value, lambda: Subwords(held.value))


def as_subwords(vocabulary: DataFrame, held) -> DataFrame:
    """(word, c, ids): the ids of each word, packed. ``vocabulary``: word, c."""

    def run(batches):
        release()
        subwords = _subwords(held)
        for batch in batches:
            for at in range(0, batch.num_rows, SOME):
                part = batch.slice(at, SOME)
                flat, sizes = subwords.of(part.column(0).to_pylist())
                ends = np.concatenate([[0], np.cumsum(sizes) * 4]).astype("<i4")
                packed = pa.Array.from_buffers(
                    pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(flat.astype("<u4"))]
                )
                yield pa.RecordBatch.from_arrays([*part.columns, packed], names=["word", "c", "ids"])

    return vocabulary.select("word", "c").mapInArrow(run, "word binary, c long, ids binary")


def unpacked(ids: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids end to end, and how many each word has."""
    flat = np.frombuffer(b"".join(ids.to_pylist()), dtype="<u4")
    return flat.astype(np.int64), pc.binary_length(ids).to_numpy().astype(np.int64) // 4


def id_counts(vocabulary: DataFrame, size: int) -> DataFrame:
    """(id, n) over all training words. ``vocabulary``: ids, c; ``size``: of the subwords' vocabulary."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            flat, sizes = unpacked(batch.column(0))
            weight = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), sizes)
            total += np.bincount(flat, weights=weight, minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    got = vocabulary.select("ids", "c").mapInArrow(run, "id long, n double")
    return got.groupBy("id").agg(F.sum("n").alias("n"))  # at most one row for each id of the vocabulary


class Met:
    """The words that a task has met, with their ids. ``of``: the subwords of new ones."""

    def __init__(self, of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.of, self.words = of, Blocks()
        self.flat, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def places(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Each text's words as places among those met."""
        if len(self.words) > KEPT:
            self.__init__(self.of)
        known = len(self.words)
        found = [np.fromiter(map(self.words.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts]
        flat, sizes = self.of(list(islice(self.words, known, None)))
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        return found


def laid_out(places: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, end: int):
    """Texts as ids end to end, each closed by ``end``: ids, ids per text, and ids per word (the end is a word)."""
    words = np.concatenate([x for p in places for x in (p, [len(sizes)])]).astype(np.int64)
    size = np.append(sizes, 1)[words]
    first = np.append(starts, len(flat))[words]
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    ids = np.append(flat, end)[np.repeat(first, size) + within]
    ends = np.cumsum([len(p) + 1 for p in places])
    upto = np.cumsum(size)[ends - 1]
    return ids, np.diff(np.concatenate([[0], upto])), size


@dataclass
class Windows:
    """Windows of training texts. They are made in the worker that learns from them, so a task has one worker and no window
    is handed from one to another. ``held``, ``coding``: broadcasts of the ranks and the coding."""

    documents: DataFrame
    held: Broadcast
    coding: Broadcast

    def made(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]:
        """From batches of texts to inputs [n, SPAN] (-1: none) and target classes [n, STRIDE] (-1: not scored)."""
        held, coding = self.held, self.coding

        def run(batches):
            met, code = Met(_subwords(held).of), coding.value
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    texts = [(t or "").encode("utf-8").lower().split() for t in batch.slice(at, 64).column(0).to_pylist()]
                    places, sizes = met.places(texts), met.sizes
                    ids, lengths, _ = laid_out(places, np.cumsum(sizes) - sizes, sizes, met.flat, code.end)
                    before = code.inputs[np.concatenate([[code.end], ids[:-1]])]
                    before[np.cumsum(lengths) - lengths] = code.inputs[code.end]
                    x, valid, scored, live = lm.gather(before, lm.windows(lengths))
                    yield np.where(valid, x, -1).astype("<i2"), np.where(live, code.classes[ids][scored], -1).astype("<i2")

        return run

    def count(self) -> int:
        made = self.made()

        def run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(x) for x, _ in made(batches))], pa.int64())], names=["n"])

        return self.documents.select("text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same rows, in order, ``size`` at a time and what is left at last."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= size:
            x, y = (np.concatenate(z) for z in zip(*held))
            upto = n - n % size
            for at in range(0, upto, size):
                yield x[at : at + size], y[at : at + size]
            held, n = [(x[upto:].copy(), y[upto:].copy())], n - upto
    if n:
        x, y = (np.concatenate(z) for z in zip(*held))
        yield x, y


def averaged(windows: Windows, model: lm.Model, rate: float, step: int, seed: int) -> lm.Model:
    """One round: every task trains on its windows from the same weights; the mean of their weights by windows."""
    held = windows.documents.sparkSession.sparkContext.broadcast(model.flat)
    made = windows.made()

    def run(batches):
        own, n = lm.Model(held.value.copy()), 0
        trainer = lm.Trainer(own, rate, step, seed)
        for x, y in gathered(made(batches), 4096):
            x, y = x.astype(np.int32), y.astype(np.int32)
            trainer.learn(np.maximum(x, 0), x >= 0, np.maximum(y, 0), y >= 0)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([own.flat.tolist()], pa.list_(pa.float32())), pa.array([n], pa.int64())], names=["w", "n"]
            )

    each = windows.documents.select("text").mapInArrow(run, "w array<float>, n long")
    mean = each.select("n", F.posexplode("w").alias("i", "w")).groupBy("i").agg(
        (F.sum(F.col("w").cast("double") * F.col("n")) / F.sum("n")).alias("w")
    )
    rows = mean.collect()  # one for each weight of the model, whatever the corpus
    held.unpersist()
    if not rows:
        return model
    flat = np.zeros(len(model.flat), dtype=np.float32)
    for i, w in rows:
        flat[i] = w
    return lm.Model(flat)


def fit(documents: DataFrame, counts: np.ndarray, ranks: dict[bytes, int], held) -> tuple[lm.Coding, lm.Model]:
    """The coding and the model. ``documents``: training texts (doc_id, text); ``counts``: of each id in them, the end's last."""
    texts = [b""] * len(ranks)
    for token, i in ranks.items():
        texts[i] = token
    coding = lm.Coding.from_counts(counts, texts)
    share = np.bincount(coding.classes, weights=counts + 0.5, minlength=lm.GROUPS * lm.MEMBERS) + 1e-9
    model = lm.Model.start(share / share.sum())
    shared = documents.sparkSession.sparkContext.broadcast(coding)
    part, low = F.pmod(F.xxhash64("doc_id", "text"), F.lit(16)), 0
    windows = counts.sum() / lm.STRIDE
    for k, (share, rate, step) in enumerate(ROUNDS):
        # read by few enough tasks, however the table is dealt; nothing is moved
        tasks = max(1, int(windows * share / 16 / LEAST_WINDOWS))
        own = documents.filter((part >= low) & (part < low + share)).coalesce(tasks)
        model = averaged(Windows(own, held, shared), model, rate, step, seed=k)
        low += share
    return coding, model


def scored(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). ``documents``: doc_id, text, held_out."""
    spark = documents.sparkSession
    sc = spark.sparkContext
    ranks = read_ranks(path)
    held = sc.broadcast(ranks)
    both = written(blocked(documents), "blocks")
    texts = both.filter(F.col("places").isNotNull()).select("block", "doc_id", "held_out", "n", "places")
    rows = both.filter(F.col("word").isNotNull()).select("block", "place", "word", "n")
    with sweeping(spark):  # word rows that were summed are not to lie beside those that are joined
        vocabulary = written(as_subwords(rows.groupBy("word").agg(F.sum("n").alias("c")), held), "vocabulary")
    rows = rows.select("block", "place", "word").join(vocabulary, "word")
    known = vocabulary.filter(F.col("c") > 0)
    n_texts = texts.filter(~F.col("held_out")).count()
    total = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, distinct = total.n + n_texts, total.v + (n_texts > 0)
    counts = np.zeros(len(ranks) + 1)
    for i, n in id_counts(known, len(ranks)).collect():
        counts[i] = n
    counts[-1] = n_texts
    coding, model = fit(documents.filter(~F.col("held_out")), counts, ranks, held)
    fitted = sc.broadcast((coding, model.flat))
    floor = 0.5 * (distinct + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        code, flat_weights = fitted.value
        words = right.sort_by("place")
        c = np.append(words.column("c").to_numpy(), n_texts).astype(np.float64)
        base = np.log10((c + 0.5) / (n_train + floor))
        flat, sizes = unpacked(words.column("ids"))
        starts = np.cumsum(sizes) - sizes
        model = lm.Model(flat_weights)
        out = []
        raw, size = left.column("places").to_pylist(), left.column("n").to_pylist()
        at = 0
        while at < len(raw):
            upto, many = at, 0
            while upto < len(raw) and (upto == at or many + size[upto] < 200_000):
                many += size[upto]
                upto += 1
            places = [
                np.frombuffer(pa.decompress(r, decompressed_size=4 * n, codec="zstd", asbytes=True), dtype="<u4") if n else np.zeros(0, "<u4")
                for r, n in zip(raw[at:upto], size[at:upto])
            ]
            ids, lengths, _ = laid_out(places, starts, sizes, flat, code.end)
            each = lm.token_scores(model, code, ids, lengths)
            which = np.concatenate([x for p in places for x in (p, [len(sizes)])]).astype(np.int64)
            first = np.cumsum([0, *(len(p) + 1 for p in places[:-1])])
            n_known = np.add.reduceat((c[which] > 0).astype(np.int64), first)
            out.append((np.array([len(p) + 1 for p in places]), n_known, np.add.reduceat(base[which], first), np.add.reduceat(each, np.cumsum(lengths) - lengths)))
            at = upto
        n, k, b, s = (np.concatenate(x) for x in zip(*out))
        return pa.Table.from_arrays(
            [left.column("doc_id"), left.column("held_out"), pa.array(n), pa.array(k), pa.array(np.full(len(n), n_train)), pa.array(b), pa.array(s)],
            names=names,
        )

    listed = rows.select(F.col("block").alias("of"), "place", "ids", "c")
    return (
        texts.groupBy("block")
        .cogroup(listed.groupBy("of"))
        .applyInArrow(
            run,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )


def op2_lm_score(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", "text", (fold(F.col("doc_id"), 5) == 1).alias("held_out")
    )
    return scored(documents, vocabulary or public_tokenizers.path(VOCABULARY))
