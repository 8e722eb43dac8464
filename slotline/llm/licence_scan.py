"""Licence scans: matching statistics against an automaton of licence texts, and chains of long matches.

Method. Fixed phrases and templates are token sequences in one generalised suffix automaton (``suffix_automaton``). A
text is streamed through it. Where a whole phrase ends, that place is an exact find. Stretches of ``LEAST`` or more
tokens that a template continues no further are its long matches; those of one template are chained, in the order of
both text and template, across at most ``GAP`` other words. A chain's coverage is the share of the template's tokens that
its matches hold, each once; with ``COVER`` or more the chain is a span of the template's label. So an edited or
re-wrapped licence is found as well as an exact one. Words are ASCII lower-case runs of letters, digits and anything
beyond ASCII.

How it runs. One pass, no shuffle: the automaton depends on the templates alone and is broadcast. Words that no template
has, and neighbours that stand next to each other in no template, cut a text into stretches, and only stretches are
streamed.

Null and empty texts have no words and no spans. Texts of any length are read whole. Chains that cover equally: the one
that ends first is taken first; a text that holds a template twice has two spans. Repeated rows are scanned alike. An
empty table gives an empty result. Extra columns pass through ``scan``; its own columns replace inputs of the same name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.llm.common import extended, machine, numbered, table
from slotline.llm.suffix_automaton import SuffixAutomaton

LEAST, GAP, COVER = 3, 12, 0.75
#: The phrases that count wherever their words stand consecutively, and their labels.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
#: Notices in common use, a parameter: any (label, text) pairs do.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License. See the LICENSE file in the project root for full license information."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
]
_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_SPACED = bytes(i if i in _KEPT else 32 for i in range(256))
FIND = "array<struct<label:string,first:int,last:int,coverage:double,exact:boolean>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().translate(_SPACED).split()


@dataclass
class Find:
    """Words ``first`` up to (not including) ``last`` of a text are a label's, a share of whose template they cover."""

    label: str
    first: int
    last: int
    coverage: float
    exact: bool


class Scanner:
    def __init__(self, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]):
        every = [*phrases, *templates]
        self.labels = [label for label, _ in every]
        tokens = [words_of(text) for _, text in every]
        self.exact = len(phrases)
        self.ids = {w: i for i, w in enumerate(sorted({w for t in tokens for w in t}))}
        coded = [[self.ids[w] for w in t] for t in tokens]
        self.automaton = SuffixAutomaton(coded)
        n = len(self.ids) + 1
        #: which words stand next to each other in a template; the last word is any other
        self.beside = np.zeros((n, n), dtype=bool)
        for t in coded:
            self.beside[t[:-1], t[1:]] = True
        self.single = {t[0] for t in coded[: self.exact] if len(t) == 1}
        self.single |= {t[0] for t in coded if len(t) == 1 and LEAST <= 1}

    def stretches(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(first word, token ids) of the stretches that can hold a match."""
        get, other = self.ids.get, len(self.ids)
        ids = np.fromiter((get(w, other) for w in words), dtype=np.int64, count=len(words))
        joined = self.beside[ids[:-1], ids[1:]]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        for a, b in edges.reshape(-1, 2).tolist():
            yield a, ids[a : b + 1].tolist()
        if self.single:
            alone = np.isin(ids, list(self.single))
            alone[:-1] &= ~joined
            alone[1:] &= ~joined
            for a in np.flatnonzero(alone).tolist():
                yield a, [int(ids[a])]

    def finds(self, words: list[bytes]) -> list[Find]:
        """Exact places of the phrases and covered spans of the templates, by first word."""
        out: list[Find] = []
        of: dict[int, list[tuple[int, int, list[int]]]] = {}
        if words:
            for base, ids in sorted(self.stretches(words)):
                out.extend(self._phrases(base, ids))
                for number, start, end, ends in self.automaton.matches(ids, LEAST):
                    if number >= self.exact:
                        of.setdefault(number, []).append((base + start, base + end, ends))
        for number, found in of.items():
            size = self.automaton.size[number]
            for first, last, held in chains(found, size):
                if held >= COVER * size:
                    out.append(Find(self.labels[number], first, last, held / size, False))
        return sorted(out, key=lambda f: (f.first, f.last, f.label, f.coverage))

    def _phrases(self, base: int, ids: list[int]) -> Iterator[Find]:
        a = self.automaton
        for at, (length, state) in enumerate(a.statistics(ids), 1):
            for number, holder in a.holder[state].items():
                # the whole phrase ends here if the longest suffix that it holds is as long as it
                if number < self.exact and (length if holder == state else a.length[holder]) == a.size[number]:
                    yield Find(self.labels[number], base + at - a.size[number], base + at, 1.0, True)


def chains(found: list[tuple[int, int, list[int]]], size: int) -> list[tuple[int, int, int]]:
    """(first, last, tokens held) of disjoint chains of one template's matches (start, end, ends in the template).

    A match goes on a chain whose text and template end before its own do, at most GAP words earlier; what overlaps in
    either counts once. Chains that hold most are taken first.
    """
    found = sorted(found, key=lambda m: (m[1], m[0]))
    ends = [m[1] for m in found]
    links: list[tuple[int, int, int, tuple[int, int] | None]] = []  # held, match, end in the template, link before
    begins: list[int] = []  # the first link of each match
    for k, (start, end, places) in enumerate(found):
        begins.append(len(links))
        low = bisect_left(ends, start - GAP)
        earlier = range(begins[low], begins[k]) if low < k else range(0)
        for place in places:
            best, before = end - start, None
            for j in earlier:
                held, match, upto, _ = links[j]
                more = min(end - max(start, ends[match]), place - max(place - (end - start), upto))
                if upto >= place or ends[match] >= end or more <= 0:
                    continue
                if held + more > best or (held + more == best and before is not None):  # of equals, the nearest
                    best, before = held + more, j
            links.append((best, k, place, before))
    used, out = set(), []
    for j in sorted(range(len(links)), key=lambda j: (-links[j][0], found[links[j][1]][1], j)):
        chain, at = [], j
        while at is not None and links[at][1] not in used:
            chain.append(at)
            at = links[at][3]
        if chain and at is None:
            used.update(links[i][1] for i in chain)
            out.append((found[links[chain[-1]][1]][0], found[links[j][1]][1], min(links[j][0], size)))
    return out


def scan(documents: DataFrame, phrases=None, templates=None, rows: int = 256) -> DataFrame:
    """Every input row with ``n_words`` and ``found`` (label, first, last, coverage, exact). ``rows``: texts at once."""
    documents = documents.drop("n_words", "found")
    named = documents.columns
    documents = numbered(documents, ("text",))
    held = documents.sparkSession.sparkContext.broadcast((PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates))
    schema = extended(documents, n_words="long", found=FIND)
    names = [*documents.columns, "n_words", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = machine(held.value, lambda: Scanner(*held.value))
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("coverage", pa.float64()), ("exact", pa.bool_())]))
        for batch in batches:
            place = batch.schema.get_field_index("text")
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                sizes, found = [], []
                for text in part.column(place).to_pylist():
                    words = words_of(text)
                    sizes.append(len(words))
                    found.append([vars(f) for f in scanner.finds(words)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.int64()), pa.array(found, kind)], names=names)

    return documents.mapInArrow(run, schema).toDF(*named, "n_words", "found")


def op13_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    exact = F.filter("found", lambda f: f["exact"])
    labels = lambda finds: F.array_join(F.array_sort(F.array_distinct(F.transform(finds, lambda f: f["label"]))), ",")
    firsts = F.transform(exact, lambda f: f["first"].cast("long"))
    return got.select(
        "doc_id",
        "n_words",
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["coverage"])), F.lit(0.0)).alias("score"),
        F.size(F.filter("found", lambda f: ~f["exact"])).cast("long").alias("n_spans"),
    )
