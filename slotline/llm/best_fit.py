"""Best-fit packing by exact-complement hashing.

Method. Documents become ids and are cut into pieces of at most ``CAPACITY`` tokens; only how many pieces there are of
each length matters for packing, and that histogram has at most ``CAPACITY`` rows whatever the input's size. On it,
for each length from the longest down, the gap it leaves is looked up in an index of single lengths, sums of two and sums
of three that are still available, and combinations that fill the gap exactly are consumed as often as their scarcest
length allows. What remains is packed best-fit decreasing. The plan, a list of combinations with multiplicities, is
broadcast (its size depends on ``CAPACITY`` alone), and every piece finds its place from its rank among the pieces of
its length. Ranks come from per-task counts and their running sums, so no task holds all pieces of a length.

Null and empty texts have the end token alone. Texts of any length are read whole. Repeated rows and rows without an id
are packed each. An empty table gives an empty result. Columns other than doc_id and text are not read, so their names
cannot clash. Pieces of equal length may change places from run to run; how many sequences there are does not.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotline.llm.byte_bpe import LATIN1_LETTERS
from slotline.llm.byte_bpe import pieces as split_text
from slotline.llm.common import extended, machine, table, written

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
END = 2  #: the id that closes each document
MAX_WORDS = 600_000  #: encoded words kept by a worker (about 0.2 kB each)
TOGETHER = 512  #: new words given to the tokenizer as one text


#: A word that starts with its only space and goes on in letters of Latin-1: many of them, end to end, are split where
#: each starts.
PLAIN = re.compile(rf" [{LATIN1_LETTERS}]+").fullmatch


class WordTable(dict):
    """Ids of texts through the tokenizer. A bounded table, this dict, gives words seen before their places; their ids lie
    end to end in ``flat``. The tokenizer's added tokens are cut out of a text before it is split into words, so a text
    with one goes to the tokenizer whole."""

    def __init__(self, description: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        self.added = [x["content"] for x in json.loads(description)["added_tokens"]]
        self.starts_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.starts_word[i] = token[0] == "\u0120"  # how byte-level vocabularies write the space
        self.fresh: list[str] = []
        self.begin()

    def begin(self) -> None:
        self.clear()
        self.flat, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.first, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = place = len(self)
        return place

    def learn(self) -> None:
        """Ids of the words met since the last call."""
        words, base = self.fresh, len(self) - len(self.fresh)
        self.fresh = []
        size = np.zeros(len(words), dtype=np.int64)
        ids: list[np.ndarray] = []
        odd: list[int] = []
        order: list[int] = []
        plain = [i for i, w in enumerate(words) if PLAIN(w)]
        for at in range(0, len(plain), TOGETHER):
            part = plain[at : at + TOGETHER]
            found = self.tokenizer.encode_batch_fast(["".join([words[i] for i in part])], add_special_tokens=False)[0].ids
            found = np.array(found, dtype="<u4")
            starts = np.flatnonzero(self.starts_word[found])
            if len(starts) == len(part):
                size[part] = np.diff(np.append(starts, len(found)))
                ids.append(found)
                order += part
            else:
                odd += part
        odd += sorted(set(range(len(words))).difference(plain))
        for i, found in zip(odd, self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)):
            ids.append(np.array(found.ids, dtype="<u4"))
            size[i] = len(ids[-1])
        order += odd
        new = np.concatenate([np.zeros(0, dtype="<u4"), *ids])
        self.flat = room(self.flat, self.used + len(new))
        self.first, self.size = room(self.first, len(self)), room(self.size, len(self))
        self.flat[self.used : self.used + len(new)] = new
        self.size[base : len(self)] = size
        self.first[base + np.array(order, dtype=np.int64)] = self.used + np.cumsum(size[order]) - size[order]
        self.used += len(new)

    def encode(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """The ids of each text, closed by ``end``."""
        if len(self) > MAX_WORDS:
            self.begin()
        places, whole = [], {}
        for k, text in enumerate(texts):
            if text and any(x in text for x in self.added):
                whole[k] = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, end], dtype="<u4")
                text = None
            words = split_text(text) if text else []
            places.append(np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)))
        if self.fresh:
            self.learn()
        out = []
        for k, place in enumerate(places):
            if k in whole:
                out.append(whole[k])
                continue
            size = self.size[place]
            upto = np.cumsum(size)
            total = int(upto[-1]) if len(upto) else 0
            ids = np.empty(total + 1, dtype="<u4")
            ids[:total] = self.flat[np.arange(total) + np.repeat(self.first[place] - (upto - size), size)]
            ids[total] = end
            out.append(ids)
        return out


def room(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with place for n at least."""
    if n <= len(a):
        return a
    grown = np.zeros(max(n, len(a) * 3 // 2), dtype=a.dtype)
    grown[: len(a)] = a
    return grown


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what whole pieces leave over."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized(documents: DataFrame, path: str, capacity: int, with_ids: bool) -> DataFrame:
    """One row per piece, with the task that made it and its rank among that task's pieces of its length."""
    with open(path, encoding="utf-8") as f:
        held = documents.sparkSession.sparkContext.broadcast(f.read())
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    schema = T._parse_datatype_string(kinds + (", ids binary" if with_ids else ""))

    def run(batches):
        words = machine(held.value, lambda: WordTable(held.value))
        task, made = TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                every = words.encode(part.column(1).to_pylist(), END)
                for doc_id, ids in zip(part.column(0).to_pylist(), every):
                    ids, n = ids.tobytes(), len(ids)
                    for k, (start, length) in enumerate(cut(n, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        rank = made[length] = made.get(length, -1) + 1
                        row = (doc_id, k, start, length, zlib.crc32(own), task, rank)
                        out.append((*row, own) if with_ids else row)
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*out), to_arrow(schema))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class Sums:
    """Which one, two or three available lengths add up to a sum. For each sum the index keeps the place of its first
    combination still available, longest first. Lengths are only ever used up, and none over the one in hand is asked
    for again, so places move one way and each combination is passed once."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.pairs: dict[tuple[int, int], int] = {}  #: (sum, least bound that counts) to the longer length
        self.triples: dict[int, int] = {}  #: sum to the longest length

    def single(self, total: int, longest: int) -> tuple[int, ...] | None:
        return (total,) if 0 < total <= longest and self.left[total] > 0 else None

    def pair(self, total: int, longest: int, within: int = 0) -> tuple[int, ...] | None:
        """``within``: the length of a triple that the pair is to complete, one of which is taken; 0: none."""
        left, key = self.left, (total, within)
        a = min(self.pairs.get(key, total - 1), total - 1, within or longest)
        while 2 * a >= total:
            b = total - a
            need = (a == within) + (b == within)
            if left[a] > (a == b) + (a == within) and left[b] > (b == within) + (a == b) and left[within or a] >= need:
                self.pairs[key] = a
                return (a, b)
            a -= 1
        self.pairs[key] = 0
        return None

    def triple(self, total: int, longest: int) -> tuple[int, ...] | None:
        a = min(self.triples.get(total, total - 2), total - 2, longest)
        while 3 * a >= total:
            rest = self.pair(total - a, longest, within=a) if self.left[a] > 0 else None
            if rest:
                self.triples[total] = a
                return (a, *rest)
            a -= 1
        self.triples[total] = 0
        return None


def complement(left: np.ndarray, gap: int, longest: int, sums: Sums | None = None) -> tuple[int, ...] | None:
    """Up to three available lengths, none over ``longest``, that add up to ``gap``; the fewest and longest first."""
    sums = sums or Sums(left)
    return sums.single(gap, longest) or sums.pair(gap, longest) or sums.triple(gap, longest)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths, none over the capacity, with how many sequences get each."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    found: list[tuple[tuple[int, ...], int]] = []
    sums = Sums(left)
    for length in range(capacity, 0, -1):
        while left[length]:
            left[length] -= 1  # the one whose gap is to be filled
            rest = () if length == capacity else complement(left, capacity - length, length, sums)
            left[length] += 1
            if rest is None:
                break
            whole = (length, *rest)
            times = min(left[x] // whole.count(x) for x in set(whole))
            for x in whole:
                left[x] -= times
            found.append((whole, int(times)))
    # best fit: groups of equal sequences by the gap that they have left
    gaps: list[int] = []
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(whole: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(whole)
        if times:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((whole, times))

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):  # new sequences
                fits = capacity // length
                whole, times = (), n // fits or 1
            else:
                gap = gaps[at]
                fits = gap // length
                whole, times = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap], gaps[at]
            if n < fits:
                put(whole, times - 1)
                put(whole + (length,) * n, 1)
                n = 0
            else:
                full = min(times, n // fits)
                put(whole, times - full if whole else 0)
                put(whole + (length,) * fits, full)
                n -= full * fits
    return found + [x for group in groups.values() for x in group]


def places(found: list[tuple[tuple[int, ...], int]], capacity: int) -> np.ndarray:
    """Rows (length and first rank as one key, first sequence, copies in each, first offset), in the key's order."""
    rank = [0] * (capacity + 1)
    rows, sequence = [], 0
    for whole, times in found:
        offset = 0
        for length in sorted(set(whole), reverse=True):
            copies = whole.count(length)
            rows.append(((length << 44) + rank[length], sequence, copies, offset))
            rank[length] += copies * times
            offset += copies * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and its offset there; ``with_ids`` adds the piece's packed ids."""
    cuts = written(tokenized(documents, path, capacity, with_ids), "pieces")
    made = cuts.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = made.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lower"), "n")
    totals = made.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    held = documents.sparkSession.sparkContext.broadcast(places(plan({r.length: r.n for r in totals}, capacity), capacity))
    ranked = cuts.join(offsets.drop("n"), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("lower"))
    ranked = ranked.drop("task", "lower")

    def run(batches):
        rows = held.value
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            at = np.searchsorted(rows[:, 0], (length << 44) + rank, side="right") - 1
            mine = rows[at]
            since = (length << 44) + rank - mine[:, 0]
            sequence = mine[:, 1] + since // mine[:, 2]
            offset = mine[:, 3] + since % mine[:, 2] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(run, extended(ranked, sequence_id="long", offset="long")).drop("rank")


def op4_best_fit(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    got = pack(table(spark, sf_dir, "documents"), path)
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
