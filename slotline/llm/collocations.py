"""Phrase collocation mining: how much more often words stand together than apart, per language, with exact counts.

Method. Phrases of up to ``LONGEST`` words are counted within pieces of text that punctuation and line ends part. A phrase
of two or more words that occurs ``least`` times or more is a candidate; cut after its first k words it scores
floor(1000 a n / (l r)), with a its count, l and r its parts', n all words of the language; its lowest cut counts. A
candidate that stands in a longer one as often as anywhere goes. The best ``top`` of each language are returned.

Counting. A beginning, or any part, of a frequent phrase is frequent. So words are counted first, then pairs of frequent
words, then paths: from each place on, the words up to the longest phrase as far as neighbours are frequent pairs. Pairs
and paths are counted in burstable tries (``hat_trie``), which leave whole subtrees as sorted runs. The runs of one first
word meet in one prefix partition, where they are merged; a very frequent word's subtrees are split by the words after
it, into as many parts as its count asks for. There are as many prefix partitions as give each about ``HOT``
occurrences. A path's beginnings give the counts of all shorter phrases from its place. Nothing is estimated and nothing is dropped that could be frequent.

How it runs. Texts become blocks of places in a word list of their own. The lists' rows meet by word, where they are summed,
and frequent words return to their blocks as numbers, packed; the blocks are written anew in their frequent words. So do
frequent pairs. A block has one row for each prefix partition, however many runs it holds. A task's memory is one block,
one trie of a fixed number of entries, the runs of one prefix partition, or a place for each block that has a word. Products are decimals of 38 digits.

Null texts are empty, a null language is ``und``. Texts of any length are read whole. Repeated rows count each. Ties: of
equal cuts the one with fewest words first, of equal scores the phrase with the larger count, then the first in byte
order. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotline.llm.common import discard, release, table, written
from slotline.llm.hat_trie import HatTrie, beginnings, summed

LONGEST, LEAST, TOP = 5, 100, 2_000
UNKNOWN = "und"
BLOCK_BYTES, BLOCK_WORDS = 12_000_000, 400_000  #: a block is closed at the first of these, between texts
IN_TASK = 33  #: bits of an id that count within a task
CHUNK = 1 << 22  #: places in one row: most blocks are one, very long texts are cut where no phrase goes on
STRETCH = 1 << 19  #: places whose pairs or paths a trie takes at once
HOT = 500_000  #: occurrences that a prefix partition has on average, and the most that a first word brings it undivided
PACKED = 500_000  #: words or pairs that a merging task gathers before it deals them to their blocks
_APART = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\xff" * 10)  # a byte that no UTF-8 text has
BLOCK_ROW = "block long, place long, n long, lang string, word binary, places binary"
WORD_ROW = "block long, packed binary, id long, lang string, word binary, f long, n long"
CODED_ROW = "block long, place long, n long, places binary, numbers binary, parts binary, pairs binary"
RUN_ROW = "bucket long, block long, paths binary, n binary"


class WordList:
    """Places of a block's words, by language; place 0 parts the pieces."""

    def __init__(self):
        self.words: list[tuple[str, bytes]] = [("", b"")]
        self.of: dict[str, Places] = {}

    def places(self, lang: str, text: str) -> np.ndarray:
        """Of all words of a text, with a 0 at its end and wherever it is parted."""
        own = self.of.get(lang)
        if own is None:
            own = self.of[lang] = Places(self, lang)
        raw = text.encode("utf-8").lower().translate(_APART).replace(b"\xff", b" \xff ").split()
        raw.append(b"\xff")
        return np.fromiter(map(own.__getitem__, raw), dtype="<u4", count=len(raw))


class Places(dict):
    def __init__(self, words: WordList, lang: str):
        super().__init__({b"\xff": 0})
        self.all, self.lang = words.words, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self.all)
        self.all.append((self.lang, word))
        return place


def _rows(schema: str, **columns) -> pa.RecordBatch:
    """A batch of rows; what is not given is null."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[k], kinds[t]) if k in columns else pa.nulls(size, kinds[t]) for k, t in named], names=[k for k, _ in named]
    )


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=4 * n, codec="zstd", asbytes=True), dtype="<u4")


def blocked(documents: DataFrame) -> DataFrame:
    """Blocks of texts: their places (packed), and a row for each word with its place ``a`` and count ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        task, number = TaskContext.get().partitionId(), 0
        words, texts, size = WordList(), [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal words, texts, size, number
            block = (task << 40) + (number << 12)  # the last bits are for its rows
            every = np.concatenate(texts)
            counts = np.bincount(every, minlength=len(words.words))
            for at in range(0, len(every), CHUNK):
                part = every[at : at + CHUNK]
                yield _rows(BLOCK_ROW, block=[block], place=[at], n=[len(part)], places=[_packed(part)])
            for at in range(1, len(words.words), 65_536):
                langs, own = zip(*words.words[at : at + 65_536])
                n = len(own)
                yield _rows(BLOCK_ROW, block=[block] * n, place=np.arange(at, at + n), n=counts[at : at + n], lang=langs, word=own)
            words, texts, size = WordList(), [], 0
            number += 1

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for lang, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    texts.append(words.places(UNKNOWN if lang is None else lang, text or ""))
                    size += len(text or "")
                    if size >= BLOCK_BYTES or len(words.words) >= BLOCK_WORDS:
                        yield from close()
        if texts:
            yield from close()

    return documents.select("lang", "text").mapInArrow(run, BLOCK_ROW)


def _by_block(block: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Rows of values packed for each block."""
    order = np.argsort(block, kind="stable")
    own, begins = np.unique(block[order], return_index=True)
    dealt = values[order].astype("<i8")
    return own, [dealt[a:b].tobytes() for a, b in zip(begins, [*begins[1:], len(dealt)])]


class WordMerge:
    """Rows (block, place, n, lang, word) in the order of lang and word: frequent words with an id and their sum, the places
    of each block with the ids that they have, and the sums of languages."""

    def __init__(self, task: int, least: int):
        self.next, self.least = task << IN_TASK, least
        self.open: tuple[tuple, list, list, int] | None = None  # a word whose rows may go on: key, blocks, places, sum
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.totals = 0, Counter()

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block, place, n = (batch.column(i).to_numpy() for i in range(3))
        lang, word = batch.column(3), batch.column(4)
        coded = lang.dictionary_encode()
        for k, total in enumerate(np.bincount(coded.indices.to_numpy(), weights=n)):
            self.totals[coded.dictionary[k].as_py()] += int(total)
        changes = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(word[1:], word[:-1])).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        if self.open and self.open[0] == (lang[0].as_py(), word[0].as_py()):
            self._more(block, place, n, edges[1])
            edges = edges[1:]
        if len(edges) < 2:
            return
        yield from self._shut()
        whole = np.array(edges[:-1])  # the last word may go on
        if len(whole) > 1:
            upto = whole[-1]
            sums = np.add.reduceat(n[whole[0] : upto], whole[:-1] - whole[0])
            yield from self._keep(sums, np.diff(whole), block[whole[0] : upto], place[whole[0] : upto], lang.take(pa.array(whole[:-1])), word.take(pa.array(whole[:-1])))
        last = edges[-2]
        self.open = ((lang[last].as_py(), word[last].as_py()), [], [], 0)
        self._more(block[last:], place[last:], n[last:], batch.num_rows - last)

    def _more(self, block, place, n, upto: int) -> None:
        key, blocks, places, total = self.open
        self.open = (key, [*blocks, block[:upto]], [*places, place[:upto]], total + int(n[:upto].sum()))

    def _shut(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            (lang, word), blocks, places, total = self.open
            block, self.open = np.concatenate(blocks), None
            yield from self._keep(np.array([total]), np.array([len(block)]), block, np.concatenate(places), pa.array([lang]), pa.array([word], pa.binary()))

    def _keep(self, sums, sizes, block, place, lang, word) -> Iterator[pa.RecordBatch]:
        often = sums >= self.least
        if often.any():
            ids = self.next + np.arange(often.sum())
            self.next += len(ids)
            yield _rows(WORD_ROW, id=ids, lang=lang.filter(pa.array(often)), word=word.filter(pa.array(often)), f=sums[often])
            rows = np.repeat(often, sizes)
            parts = -(-sums[often] // HOT)
            values = np.stack([place[rows], np.repeat(ids, sizes[often]), np.repeat(parts, sizes[often])], axis=1)
            self.held.append((block[rows], values))
            self.size += len(values)
            if self.size >= PACKED:
                yield from self._deal()

    def _deal(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            own, packed = _by_block(*(np.concatenate(x) for x in zip(*self.held)))
            yield _rows(WORD_ROW, block=own, packed=packed)
            self.held, self.size = [], 0

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self._shut()
        yield from self._deal()
        if self.totals:
            yield _rows(WORD_ROW, lang=list(self.totals), n=list(self.totals.values()))


def merged_words(listed: DataFrame, least: int) -> DataFrame:
    """What WordMerge makes of the rows of all blocks, which meet by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        work = WordMerge(TaskContext.get().partitionId(), least)
        for batch in batches:
            if batch.num_rows:
                yield from work.take(batch)
        yield from work.close()

    dealt = listed.select("block", "place", "n", "lang", "word").repartition("lang", "word").sortWithinPartitions("lang", "word")
    return dealt.mapInArrow(run, WORD_ROW)


def by_block(rows: DataFrame, make, schema: str) -> DataFrame:
    """``make(block, columns by name)`` of the rows of each block, which are brought together and come one block after the
    other; columns are lists of arrays."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        now, held = None, []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            edges = [*np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])).tolist(), len(ids)] if len(ids) else []
            for a, b in zip(edges, edges[1:]):
                if now is not None and ids[a] != now:
                    yield from make(now, pa.Table.from_batches(held))
                    held = []
                now = int(ids[a])
                held.append(batch.slice(a, b - a))
        if now is not None:
            yield from make(now, pa.Table.from_batches(held))

    return rows.repartition(names[0]).sortWithinPartitions(*names[:1]).mapInArrow(run, schema)


def _parts_of(rows: pa.Table) -> np.ndarray:
    """The places of a block's rows that have some, in order."""
    found = sorted(zip(rows.column("place").to_pylist(), rows.column("n").to_pylist(), rows.column("places").to_pylist()), key=lambda x: x[0])
    return np.concatenate([_unpacked(raw, n) for _, n, raw in found])


def coded(known: DataFrame, lower: list[int]) -> DataFrame:
    """Blocks in their frequent words: places are 0 (parted, or not frequent) or stand for a number of the block's list.
    A row is a block of its own from here on: it ends at a 0.

    ``known``: block, place, n, places, and packed places of frequent words with ids and parts. ``lower``: of each task that
    has given ids, the numbers before its own, so that numbers have no gaps.
    """
    before = np.array(lower, dtype=np.int64)

    def make(block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        words = [np.frombuffer(r, dtype="<i8") for r in rows.column("packed").to_pylist() if r]
        at, ids, parts = np.concatenate([np.zeros(0, dtype="<i8"), *words]).reshape(-1, 3).T
        number = before[ids >> IN_TASK] + (ids & ((1 << IN_TASK) - 1)) + 1
        order = np.argsort(number)
        places = _parts_of(rows.filter(rows.column("places").is_valid()))
        small = np.zeros(int(max(places.max(initial=0), at.max(initial=0))) + 1, dtype="<u4")
        small[at[order]] = np.arange(1, len(order) + 1)
        codes = small[places]
        apart = np.flatnonzero(codes == 0)  # the last place is one, and phrases cross none
        ends = sorted({int(apart[np.searchsorted(apart, k)]) + 1 for k in range(min(CHUNK, len(codes)) - 1, len(codes), CHUNK)} | {len(codes)})
        lists = {"numbers": [number[order].astype("<i8").tobytes()], "parts": [parts[order].astype("<i8").tobytes()]}
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            yield _rows(CODED_ROW, block=[block + k], place=[0], n=[b - a], places=[_packed(codes[a:b])], **lists)

    return by_block(known, make, CODED_ROW)


class Block:
    """One block in its frequent words: codes in order, the number and the parts of each code (0 for code 0)."""

    def __init__(self, rows: pa.Table):
        texts = rows.filter(rows.column("places").is_valid())
        self.x = _parts_of(texts)
        lists = [np.concatenate([[0], *(np.frombuffer(r, dtype="<i8") for r in texts.column(c).to_pylist() if r)]) for c in ("numbers", "parts")]
        self.number, self.parts = lists[0].astype(np.int64), lists[1].astype(np.int64)
        packed = [np.frombuffer(r, dtype="<i8") for r in rows.column("pairs").to_pylist() if r]
        self.pairs = np.concatenate([np.zeros(0, dtype="<i8"), *packed]).reshape(-1, 2)

    def distinct_pairs(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours that are both frequent, with counts, as codes, of which the first stands in the stretch from ``at`` on."""
        x, n = self.x[at : at + STRETCH + 1].astype(np.int64), len(self.number)
        both = (x[:-1] > 0) & (x[1:] > 0)
        key, counts = np.unique(x[:-1][both] * n + x[1:][both], return_counts=True)
        return np.stack([key // n, key % n], axis=1), counts

    @cached_property
    def frequent_pairs(self) -> np.ndarray:
        """Codes of both words in one number, in order."""
        pairs = np.searchsorted(self.number, self.pairs)
        return np.sort(pairs[:, 0] * len(self.number) + pairs[:, 1])

    def distinct_paths(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """From each place of the stretch from ``at`` on, the words as far as neighbours are frequent pairs, with counts, as
        codes; paths of three words or more."""
        x, n, width, frequent = self.x[at : at + STRETCH + LONGEST].astype(np.int64), len(self.number), LONGEST, self.frequent_pairs
        linked = np.zeros(len(x) + width, dtype=bool)
        if len(frequent):
            key = x[:-1] * n + x[1:]
            place = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
            linked[: len(key)] = (frequent[place] == key) & (x[:-1] > 0) & (x[1:] > 0)
        starts = np.flatnonzero((linked[:-1] & linked[1:])[:STRETCH])
        paths = np.zeros((len(starts), width), dtype="<u4")
        on = np.ones(len(starts), dtype=bool)
        rank = np.zeros(len(starts), dtype=np.int64)
        for k in range(width):
            if k:
                on &= linked[starts + k - 1]
            paths[on, k] = x[starts[on] + k]
            # equal beginnings have equal ranks, in the order of the words, and ranks stay small enough to go on
            _, rank = np.unique(rank * n + paths[:, k], return_inverse=True)
        _, first, counts = np.unique(rank, return_index=True, return_counts=True)
        return paths[first], counts


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A number from some columns of ids."""
    mixed = np.zeros(len(columns[0]), dtype=np.uint64)
    for column in columns:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def runs_of(block: int, of: Block, width: int, kind: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's pairs (width 2) or paths, counted in a trie, stretch by stretch: the runs that it leaves, dealt to the
    prefix partitions."""
    trie, left, number = HatTrie(width, kind), [], of.number.astype(f"<{kind}")
    for at in range(0, len(of.x), STRETCH):
        codes, counts = of.distinct_pairs(at) if width == 2 else of.distinct_paths(at)
        left += trie.add(number[codes], counts)
    left += trie.spill()
    if not left:
        return
    first = np.repeat([f for f, _, _ in left], [len(n) for _, _, n in left])
    rests, n = np.concatenate([r for _, r, _ in left]), np.concatenate([n for _, _, n in left])
    # a first word that is split has as many parts as it has HOT occurrences in all texts
    parts = of.parts[np.searchsorted(of.number, first)]
    own = np.where(parts > 1, _mixed([rests[:, k] for k in range(min(2, width - 1))]) % parts.astype(np.uint64), 0)
    bucket = (_mixed([first, own + 1]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    paths = np.empty((len(first), width), dtype=f"<{kind}")  # no wider copy of all paths is made
    paths[:, 0], paths[:, 1:] = first[order], rests[order]
    del left, rests
    n, bucket = n[order].astype("<u4"), bucket[order]
    edges = [*np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist(), len(bucket)]
    rows = [(int(bucket[a]), block, paths[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
    for at in range(0, len(rows), 256):
        yield _rows(RUN_ROW, **dict(zip(("bucket", "block", "paths", "n"), map(list, zip(*rows[at : at + 256])))))


def pair_runs(blocks: DataFrame, kind: str, buckets: int) -> DataFrame:
    """Runs of the pairs of coded blocks, each row for itself: nothing is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i in range(batch.num_rows):
                rows = pa.Table.from_batches([batch.slice(i, 1)])
                yield from runs_of(rows.column("block")[0].as_py(), Block(rows), 2, kind, buckets)

    return blocks.mapInArrow(run, RUN_ROW)


def path_runs(blocks: DataFrame, kind: str, buckets: int) -> DataFrame:
    """Runs of the paths of coded blocks, with rows for their frequent pairs."""
    return by_block(blocks, lambda block, rows: runs_of(block, Block(rows), LONGEST, kind, buckets), RUN_ROW)


MERGED_ROW = "block long, pairs binary, ids array<long>, f long"


def _phrases(paths: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    size = len(n)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()), pa.array(paths.tolist(), pa.list_(pa.int64())), pa.array(n, pa.int64())],
        names=["block", "pairs", "ids", "f"],
    )


class PairMerge:
    """Frequent pairs of a prefix partition, and the pairs of each block, packed."""

    def __init__(self, least: int):
        self.least, self.held, self.size = least, [], 0

    def take(self, blocks: list[int], paths: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.concatenate(paths).astype(np.int64), np.concatenate(counts)
        order = np.lexsort(pairs.T[::-1])
        edges = np.flatnonzero(np.concatenate([[True], (pairs[order][1:] != pairs[order][:-1]).any(axis=1)]))
        sums = np.add.reduceat(n[order], edges)
        often = sums >= self.least
        if often.any():
            yield _phrases(pairs[order[edges[often]]], sums[often])
            own = order[np.repeat(often, np.diff(np.append(edges, len(order))))]
            self.held.append((np.repeat(blocks, [len(c) for c in counts])[own], pairs[own]))
            self.size += len(own)
            if self.size >= PACKED:
                yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            own, packed = _by_block(*(np.concatenate(x) for x in zip(*self.held)))
            size = len(own)
            kinds = [pa.array(own, pa.int64()), pa.array(packed, pa.binary()), pa.nulls(size, pa.list_(pa.int64())), pa.nulls(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(kinds, names=["block", "pairs", "ids", "f"])
            self.held, self.size = [], 0


class PathMerge:
    """Frequent phrases of three words or more of a prefix partition."""

    def __init__(self, least: int):
        self.least = least

    def take(self, blocks: list[int], paths: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own, n = summed(np.concatenate(paths).astype(np.int64), np.concatenate(counts))
        for part, f in beginnings(own, n, range(3, LONGEST + 1), self.least):
            if len(f):
                yield _phrases(part, f)

    def close(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def merged(runs: DataFrame, width: int, kind: str, merge) -> DataFrame:
    """What ``merge()`` makes of the runs of each prefix partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        work, now, blocks, paths, counts, size = merge(), None, [], [], [], 0
        for batch in batches:
            for bucket, block, path, n in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    if now is not None:
                        yield from work.take(blocks, paths, counts)
                    now, blocks, paths, counts, size = bucket, [], [], [], 0
                blocks.append(block)
                paths.append(np.frombuffer(path, dtype=f"<{kind}").reshape(-1, width))
                counts.append(np.frombuffer(n, dtype="<u4").astype(np.int64))
                size += len(counts[-1])
                if width > 2 and size > 4 * HOT:  # equal paths of many blocks become one
                    path, n = summed(np.concatenate(paths), np.concatenate(counts))
                    blocks, paths, counts, size = [block], [path], [n], len(n)
        if now is not None:
            yield from work.take(blocks, paths, counts)
        yield from work.close()

    return runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, MERGED_ROW)


def frequent(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (number, lang, word, f), phrases of two words or more (ids, f), and (lang, n) of all words.

    ``documents``: lang, text.
    """
    spark = documents.sparkSession
    blocks = written(blocked(documents), "blocks")
    words = written(merged_words(blocks.filter(F.col("word").isNotNull()), least), "words")
    totals = words.filter(F.col("n").isNotNull()).groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.filter(F.col("id").isNotNull())
    task = F.shiftright("id", IN_TASK)
    given = {r.task: r.n for r in often.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect()}  # a row for each task
    lower = np.cumsum([0, *(given.get(t, 0) for t in range(max(given, default=-1) + 1))]).tolist()
    kind = "u4" if lower[-1] < (1 << 32) - 1 else "u8"
    offsets = F.broadcast(spark.createDataFrame(list(enumerate(lower)), "task long, lower long"))
    own = F.col("id").bitwiseAND(F.lit((1 << IN_TASK) - 1)) + F.col("lower") + 1
    often = often.withColumn("task", task).join(offsets, "task").select(own.alias("number"), "lang", "word", "f")
    texts = blocks.filter(F.col("places").isNotNull()).select("block", "place", "n", "places")
    back = words.filter(F.col("block").isNotNull()).select("block", "packed")
    texts = written(coded(texts.unionByName(back, allowMissingColumns=True), lower), "coded")
    discard(blocks)
    buckets = max(1, -(-(totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // HOT))
    pairs = written(merged(pair_runs(texts, kind, buckets), 2, kind, lambda: PairMerge(least)), "pairs")
    back = pairs.filter(F.col("block").isNotNull()).select("block", "pairs")
    both = texts.drop("pairs").unionByName(back, allowMissingColumns=True)
    longer = written(merged(path_runs(both, kind, buckets), LONGEST, kind, lambda: PathMerge(least)), "phrases")
    discard(texts)
    phrases = pairs.filter(F.col("f").isNotNull()).select("ids", "f").unionByName(longer.select("ids", "f"))
    return often, phrases, totals


def score() -> Column:
    """floor(1000 a n / (l r)): products in decimals, divided to whole numbers."""
    wide = [f"cast({c} as decimal(19,0))" for c in ("a", "n", "l", "r")]
    return F.expr("(1000 * ({} * {})) div ({} * {})".format(*wide))


def mined(documents: DataFrame, least: int = LEAST, share: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate that no longer one holds. ``documents``: lang, text.

    ``share``: in hundredths of its occurrences, how many within a longer candidate make a phrase go.
    """
    words, phrases, totals = frequent(documents, least)
    size = F.size("ids")
    # every part of a frequent phrase is frequent, so it is among the words or the phrases
    parts = phrases.unionByName(words.select(F.array("number").alias("ids"), "f"))
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, size).alias("right"))
    cuts = cuts.join(parts.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(parts.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    langs = words.select("number", "lang").join(totals, "lang")  # a row for each frequent word
    cuts = cuts.join(langs.withColumnRenamed("number", "first"), F.col("ids")[0] == F.col("first"))
    lowest = cuts.withColumn("score", score()).groupBy("ids").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "lang")).alias("cut")).select("ids", "cut.*")
    # a phrase in a longer one is in one that is longer by a word, which occurs at least as often
    inner = phrases.filter(size > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "f")
    around = inner.groupBy("ids").agg(F.max("f").alias("around"))
    kept = lowest.join(around, "ids", "left").filter(F.col("around").isNull() | (100 * F.col("around") < share * F.col("a")))
    kept = written(kept.drop("around"), "candidates")
    spelled = kept.select("ids", F.posexplode("ids").alias("at", "number")).join(words.select("number", "word"), "number")
    spelled = spelled.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("w")))).alias("ws"))
    phrase = F.array_join(F.transform("ws", lambda x: x["w"]), " ")
    return kept.join(spelled.select("ids", phrase.alias("phrase")), "ids").select("lang", "phrase", "a", "l", "r", "n", "score")


def best(candidates: DataFrame, top: int = TOP, deal: int = 64) -> DataFrame:
    """The first ``top`` of each language with their rank: the first of each of ``deal`` parts, then of those."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    dealt = candidates.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(deal)))
    some = dealt.withColumn("rank", rank("lang", "part")).filter(F.col("rank") <= top)
    return some.withColumn("rank", rank("lang").cast("long")).filter(F.col("rank") <= top).drop("part")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("lang", "text")
    return best(mined(documents)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_GRAMS = " UNION ALL ".join(f"SELECT lang, {m} AS m, array_to_string(w[i:i + {m - 1}], ' ') AS phrase FROM places WHERE i + {m - 1} <= len(w)" for m in range(1, LONGEST + 1))
SQL = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
    lists AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
    grams AS (SELECT lang, m, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL), often AS (SELECT * FROM grams WHERE f >= {LEAST}),
    totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE m = 1 GROUP BY lang),
    words AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE m > 1),
    cuts AS (SELECT *, unnest(range(1, m)) AS k FROM words),
    scored AS (SELECT c.lang, c.phrase, c.m, c.a, x.f AS l, y.f AS r, t.n, c.k, CAST(1000::HUGEINT * c.a * t.n // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM cuts c
    JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    kept AS (SELECT * FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM often o WHERE o.lang = s.lang AND o.m > s.m AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * o.f >= 100 * s.a))
    SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= {TOP}"""
