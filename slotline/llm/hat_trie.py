"""Counts of word-id paths: hash containers that burst under a shallow trie, spilled as sorted runs, and runs merged.

A path is a row of ``width`` ids above 0, shorter ones filled up with 0. Upper nodes lead by an id; below them a
container maps the packed rest of a path to its count. A container that grows beyond ``BURST`` entries becomes a node over
smaller ones. With more than ``budget`` entries in all, the subtrees of the first ids that hold most leave whole, each
as a run in the order of its paths, until half the budget is free; a path may so stand in many runs. ``beginnings`` gives
the counts of the beginnings of paths, once the runs of a first id have met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BURST = 4_096
BUDGET = 400_000  #: entries of one trie: some 80 MB, as no key is longer than 32 bytes


class HatTrie:
    """``kind``: of the packed ids, u4 or u8."""

    def __init__(self, width: int, kind: str = "u4", budget: int = BUDGET, burst: int = BURST):
        self.width, self.budget, self.burst = width, budget, burst
        self.kind = np.dtype(f">{kind}")  # high bytes first, so bytes sort as numbers do
        self.root: dict[int, Node | dict[bytes, int]] = {}
        self.held: dict[int, int] = {}  # entries under each first id
        self.entries = 0

    def add(self, paths: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Take distinct paths, in order, with their counts; gives the runs that had to leave."""
        packed = np.ascontiguousarray(paths, dtype=self.kind)
        edges = _edges(paths[:, 0])
        for a, b in zip(edges, edges[1:]):
            first = int(paths[a, 0])
            child, new = self._put(self.root.get(first), packed[a:b], counts[a:b], 1)
            self.root[first] = child
            self.held[first] = self.held.get(first, 0) + new
            self.entries += new
            if self.entries > self.budget:
                yield from self.spill(self.budget // 2)

    def _put(self, child, packed: np.ndarray, counts: np.ndarray, depth: int):
        """The child with further paths, packed from their first id on, and how many entries are new."""
        if isinstance(child, Node):
            edges = _edges(packed[:, depth])
            new = 0
            for a, b in zip(edges, edges[1:]):
                own = int(packed[a, depth])
                child[own], more = self._put(child.get(own), packed[a:b], counts[a:b], depth + 1)
                new += more
            return child, new
        rests = np.ascontiguousarray(packed[:, depth:]).view(f"V{self.kind.itemsize * (self.width - depth)}").ravel().tolist()
        if child is None:
            child, before = dict(zip(rests, counts.tolist())), 0
        else:
            before = len(child)
            for rest, n in zip(rests, counts.tolist()):
                child[rest] = child.get(rest, 0) + n
        new = len(child) - before
        if len(child) > self.burst and depth < self.width - 1:
            child = self._burst(child, depth)
        return child, new

    def _burst(self, container: dict[bytes, int], depth: int) -> Node:
        node, size = Node(), self.kind.itemsize
        for rest, n in container.items():
            node.setdefault(int.from_bytes(rest[:size], "big"), {})[rest[size:]] = n
        for own, child in node.items():  # one id may lead most of them
            if len(child) > self.burst and depth + 1 < self.width - 1:
                node[own] = self._burst(child, depth + 1)
        return node

    def spill(self, upto: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first id, rests of its paths in order, counts): whole subtrees, the fullest first, until no more than ``upto``
        entries are left."""
        for first in sorted(self.held, key=self.held.get, reverse=True):
            if self.entries <= upto:
                return
            self.entries -= self.held.pop(first)
            keys, counts = [], []
            self._list(self.root.pop(first), b"", keys, counts)
            yield first, np.frombuffer(b"".join(keys), dtype=self.kind).reshape(-1, self.width - 1), np.array(counts, dtype=np.int64)

    def _list(self, child, begin: bytes, keys: list[bytes], counts: list[int]) -> None:
        """The paths below, in order."""
        if isinstance(child, Node):
            for own in sorted(child):
                self._list(child[own], begin + own.to_bytes(self.kind.itemsize, "big"), keys, counts)
        else:
            rests = sorted(child)
            keys.extend([begin + rest for rest in rests] if begin else rests)
            counts.extend([child[rest] for rest in rests])


class Node(dict):
    """Children by id: nodes or containers."""


def _edges(ids: np.ndarray) -> list[int]:
    """Where runs of equal ids begin, and their end."""
    return [*np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])).tolist(), len(ids)] if len(ids) else []


def summed(paths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paths in order with the sums of their counts."""
    order = np.lexsort(paths.T[::-1])
    paths, counts = paths[order], counts[order]
    edges = np.flatnonzero(np.concatenate([[True], (paths[1:] != paths[:-1]).any(axis=1)]))
    return paths[edges], np.add.reduceat(counts, edges)


def beginnings(paths: np.ndarray, counts: np.ndarray, lengths: range, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(beginnings, counts) of each length that stand in ``least`` or more. ``paths`` in order."""
    for k in lengths:
        has = paths[:, k - 1] > 0
        if has.any():
            own, n = paths[has, :k], counts[has]
            edges = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)]))
            sums = np.add.reduceat(n, edges)
            yield own[edges][sums >= least], sums[sums >= least]
