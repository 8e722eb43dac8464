"""A compressed set of places with select: containers of three kinds under cumulative cardinalities, with numpy.

The places of one text are dealt by their high bits to containers of ``SPAN`` places. A container is kept as whichever
takes fewest bytes: a sorted array of low parts, a bitmap of 64-bit words, or runs (first place and length). The k-th
place is found by a binary search in the cumulative cardinalities for the container and a select within it.
"""

from __future__ import annotations

import numpy as np

SPAN = 1 << 16
WORDS = SPAN // 64


class Sorted:
    """Low parts in order: two bytes each."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class Bitmap:
    """A bit for each place, and how many are set before each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, dtype=np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1  # the lowest set bit goes
        return at * 64 + (word & -word).bit_length() - 1


class Runs:
    """First place and length of each run of neighbours, and how many places stand before each run."""

    def __init__(self, low: np.ndarray, starts: np.ndarray):
        self.first = low[starts].astype(np.uint16)
        self.before = np.append(starts, len(low))

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.first[at]) + k - int(self.before[at])


def container(low: np.ndarray) -> Sorted | Bitmap | Runs:
    """The smallest container of some low parts in order."""
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1] + 1]))
    sizes = {"sorted": 2 * len(low), "bitmap": 8 * WORDS, "runs": 4 * len(starts)}
    kind = min(sizes, key=sizes.get)
    return Runs(low, starts) if kind == "runs" else Sorted(low) if kind == "sorted" else Bitmap(low)


class BoundarySet:
    """Distinct places in rising order."""

    def __init__(self, places: np.ndarray):
        places = np.asarray(places, dtype=np.int64)
        high = places // SPAN
        self.keys, begins = np.unique(high, return_index=True)
        edges = np.append(begins, len(places))
        self.upto = edges[1:]  # cumulative cardinalities
        self.containers = [container(places[a:b] - key * SPAN) for a, b, key in zip(edges, edges[1:], self.keys)]

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The k-th place, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.upto, k, side="right"))
        inner = k - (int(self.upto[at - 1]) if at else 0)
        return int(self.keys[at]) * SPAN + self.containers[at].select(inner)
