"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Method. A sequence of tokens is what the merges make of its bytes exactly when every token is made from its own
bytes and every two neighbours stay two when merged alone; so the segmentations form a nondeterministic transducer
whose states are (token before, place in the vocabulary's prefix tree). ``Transducer`` determinises it as texts need
it: a state is the set of live hypotheses with the tokens that they have not agreed upon; a step reads one byte,
drops hypotheses that leave the tree, and emits the tokens that all live ones share, at most the longest token's
length behind. States are kept in a bounded table that is emptied when full. ``Utf8Stream`` decodes: its state is the
bytes of an unfinished character, and its steps are lifted from bytes to whole tokens. ``digests`` does both in one pass.

Nulls and empty texts encode to no ids. Texts of any length, repeated rows and extra columns are fine; the added
columns (``n_tokens``, ``ids``, ``decoded``) replace inputs of the same name. ``ids`` are packed little-endian
unsigned 32-bit integers. The vocabulary has a fixed size, so it is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from slotline.llm.common import extended, machine, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MAX_STATES = 150_000  #: determinised states kept by a worker (about 1 kB each)
MAX_PIECES = 400_000  #: encoded pieces kept by a worker in each of two tables (about 0.2 kB each)
FEW = 32  #: up to so many tokens below a place are kept by name in a state
NEVER = 1 << 60

# The split pattern's classes within Latin-1, fixed values: letters, numbers, white space.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
LATIN1_LETTERS = _L
#: The public split pattern for texts of Latin-1 characters only, for the faster built-in matcher.
LATIN1 = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
PATTERN = regex.compile(public_tokenizers.PATTERN)


def pieces(text: str) -> list[str]:
    """The split pattern's matches."""
    if text.isascii():
        return LATIN1.findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return PATTERN.findall(text)
    return LATIN1.findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """The vocabulary with each token's last merge, found by merging the token's own bytes by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: list[int] = []  #: tokens that the merges make from their own bytes
        for token, rank in ranks.items():
            parts, last = self.merged(token)
            if len(parts) == 1:
                self.made.append(rank)
                if last:
                    self.left[rank], self.right[rank] = ranks[last[0]], ranks[last[1]]
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        #: whether a token's parts always have lower ranks, so that ranks tell the order of merges
        self.ordered = all(self.left[t] < t and self.right[t] < t for t in self.left)

    def merged(self, word: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        parts, last = [word[i : i + 1] for i in range(len(word))], None
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last


class Transducer:
    """The determinised encoder; ``encode`` gives the ids of one piece."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.whole = merges.ranks
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for t in merges.made:
            node = 0
            for b in merges.bytes_of[t]:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = t
        #: tokens below each place of the tree, where they are few
        self.below: list[frozenset[int] | None] = [None] * len(self.ends)
        for node in range(len(self.ends) - 1, -1, -1):
            under: set[int] = set()
            for x in self.children[node].values():
                if self.below[x] is None:
                    break
                under |= self.below[x]
                if self.ends[x] >= 0:
                    under.add(self.ends[x])
            else:
                self.below[node] = frozenset(under) if len(under) <= FEW else None
        self.empty()

    def empty(self) -> None:
        start = (((), -1, 0, None),)
        self.viable: dict[tuple[int, int], tuple[int, ...]] = {}
        self.number = {start: 0}
        self.states = [start]
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.rest: list[tuple[int, ...]] = [()]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, stay as they are: undo their merges, latest first, and see that the two
        parts at the seam never merge before a part is taken up by its own side (left of two equal merges first)."""
        m, ranks, name = self.m, self.m.ranks, self.m.bytes_of
        if not m.ordered:
            return m.merged(name[a] + name[b])[0] == [name[a], name[b]]
        until_a = until_b = NEVER
        while True:
            rank = ranks.get(name[a] + name[b], NEVER)
            if rank < until_a and rank <= until_b:
                return False
            made_a, made_b = (a if a in m.right else -1), (b if b in m.left else -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                until_a, a = a, m.right[a]
            else:
                until_b, b = b, m.left[b]

    def followers(self, before: int, node: int) -> tuple[int, ...]:
        """The few tokens below a place that can follow ``before``, in order."""
        known = self.viable.get((before, node))
        if known is None:
            tokens = sorted(self.below[node])
            known = tuple(tokens) if before < 0 else tuple(t for t in tokens if self.neighbours(before, t))
            self.viable[before, node] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """A hypothesis is (pending, before, node, few): tokens not yet sent, the last token, the place in the tree, and
        the tokens below that may still come, where they are few. Those then stand for the last token, so that states
        which differ in nothing that can matter are one."""
        live, seam = [], None
        for pending, before, node, few in self.states[state]:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            token = self.ends[nxt]
            if seam is None and token >= 0:
                if few is not None:
                    fits = token in few
                else:
                    fits = before < 0 or self.neighbours(before, token)
                if fits:
                    seam = ((*pending, token), token, 0, None)
            if self.children[nxt]:
                below = self.below[nxt]
                if below is None:
                    live.append((pending, before, nxt, None))
                    continue
                left = self.followers(before, nxt) if few is None else tuple(t for t in few if t in below)
                if left:
                    live.append((pending, -1, nxt, left))
        if seam is None:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        live.append(seam)
        first = seam[0]
        sent = min(len(x[0]) for x in live)
        for other in live:
            k = 0
            while k < sent and other[0][k] == first[k]:
                k += 1
            sent = k
        key = tuple((pending[sent:], before, node, few) for pending, before, node, few in live)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.rest.append(key[-1][0])
        found = self.steps[state][byte] = (to, first[:sent])
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.whole.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self.empty()
        at, out, steps = 0, [], self.steps
        for byte in piece:
            found = steps[at].get(byte) or self.step(at, byte)
            at = found[0]
            if found[1]:
                out += found[1]
        out += self.rest[at]
        return out


class Encoder(dict):
    """Whole texts to packed ids. This dict holds the ids of pieces seen before, and ``older`` those of the table before
    it, so that frequent pieces outlive a full table."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.transducer = Transducer(merges)
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.transducer.encode(piece.encode("utf-8"))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        self[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self) > MAX_PIECES:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, pieces(text)))


class Utf8Stream:
    """An incremental UTF-8 machine over tokens. State: the bytes of a character not yet complete."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.lifted: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        size = max(bytes_of) + 1
        self.alone: list[bytes | None] = [None] * size  #: decoded bytes of tokens that begin and end between characters
        for token in bytes_of:
            text, held = self.step(b"", token)
            if not held:
                self.alone[token] = text.encode("utf-8")

    @staticmethod
    def needs(held: bytes) -> int:
        """How many bytes the character begun by ``held`` has; 0 if ``held`` cannot begin one."""
        first = held[0]
        n = 1 if first < 0x80 else 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0
        if n and len(held) > 1:
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(first, 0x80)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(first, 0xBF)
            if not low <= held[1] <= high or any(not 0x80 <= b <= 0xBF for b in held[2:]):
                return 0
        return n

    def step(self, held: bytes, token: int) -> tuple[str, bytes]:
        """The characters completed by the token's bytes, and the bytes then held; U+FFFD for what is not UTF-8."""
        known = self.lifted.get((held, token))
        if known is None:
            out, at = [], held
            for byte in self.bytes_of[token]:
                more = at + bytes([byte])
                n = self.needs(more)
                if not n and at:
                    out.append("�")
                    more = bytes([byte])
                    n = self.needs(more)
                if not n:
                    out.append("�")
                    at = b""
                elif n == len(more):
                    out.append(more.decode("utf-8"))
                    at = b""
                else:
                    at = more
            known = self.lifted[held, token] = ("".join(out), at)
        return known

    def chunks(self, ids: list[int]) -> Iterator[str]:
        held = b""
        for token in ids:
            text, held = self.step(held, token)
            if text:
                yield text
        if held:
            yield "�"

    def decoded(self, ids: bytes) -> bytes:
        """The text of packed ids, in UTF-8."""
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        try:
            return b"".join(map(self.alone.__getitem__, numbers))
        except TypeError:  # a token ends within a character
            return "".join(self.chunks(numbers)).encode("utf-8")

    def decode(self, ids: bytes) -> str:
        return self.decoded(ids).decode("utf-8")


def encode(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row with n_tokens and packed ids of its whole text, by the rank file at ``path``."""
    held = documents.sparkSession.sparkContext.broadcast(Merges(read_ranks(path)))
    documents = documents.drop("n_tokens", "ids")
    place = documents.columns.index(text)

    def run(batches):
        coder = machine(held.value, lambda: Encoder(held.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [coder.encode(t) for t in part.column(place).to_pylist()]
                columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "n_tokens", "ids"])

    return documents.mapInArrow(run, extended(documents, n_tokens="long", ids="binary"))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Every row with the text that its packed ids decode to (null ids: empty)."""
    held = encoded.sparkSession.sparkContext.broadcast({b: a for a, b in read_ranks(path).items()})
    encoded = encoded.drop("decoded")
    place = encoded.columns.index(ids)

    def run(batches):
        stream = machine(held.value, lambda: Utf8Stream(held.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [stream.decode(x or b"") for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"]
                )

    return encoded.mapInArrow(run, extended(encoded, decoded="string"))


def digests(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row with n_tokens, ids_sha256 and decoded_sha256: encoded and decoded again in one pass, so that neither
    ids nor texts leave the worker."""
    held = documents.sparkSession.sparkContext.broadcast(Merges(read_ranks(path)))
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    documents = documents.drop(*names)
    place = documents.columns.index(text)

    def run(batches):
        encoder, decoder = machine(held.value, lambda: (Encoder(held.value), Utf8Stream(held.value.bytes_of)))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encoder.encode(t) for t in part.column(place).to_pylist()]
                columns = [
                    pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()),
                    pa.array([sha(decoder.decoded(x)) for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *names])

    return documents.mapInArrow(run, extended(documents, n_tokens="long", ids_sha256="string", decoded_sha256="string"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = digests(documents, vocabulary or public_tokenizers.path(VOCABULARY))
    return got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
