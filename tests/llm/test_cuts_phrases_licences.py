"""Fill-in-middle cuts, phrase collocations and licence scans: SQL, brute force from their definitions, awkward rows."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotline.llm import boundary_set, collocations, fill_middle, hat_trie, licence_scan
from slotline.llm.queries import ORACLE, QUERIES
from slotline.llm.suffix_automaton import SuffixAutomaton
from tests.llm.test_text_operators import AWKWARD, SCHEMA
from tests.test_queries import rows

LANGS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(name, spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# --- fill in the middle ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "places",
    [
        [0], [5, 70_000], list(range(200_000)), list(range(0, 200_000, 7)), list(range(10)) + list(range(65_530, 65_600)) + [1 << 20],
        list(range(0, 131_072, 2)) + list(range(140_000, 150_000)),
    ],
)
def test_select_is_the_sorted_list(places):
    held = boundary_set.BoundarySet(np.array(places))
    assert len(held) == len(places)
    picks = {0, len(places) - 1} | set(random.Random(3).choices(range(len(places)), k=300))
    assert all(held.select(k) == places[k] for k in picks)
    with pytest.raises(IndexError):
        held.select(len(places))


def test_each_kind_of_container():
    kinds = {
        boundary_set.Sorted: np.arange(0, 60_000, 61), boundary_set.Bitmap: np.arange(0, 60_000, 2), boundary_set.Runs: np.arange(100, 60_000),
    }
    for kind, low in kinds.items():
        made = boundary_set.container(low)
        assert type(made) is kind and [made.select(k) for k in range(0, len(low), 97)] == low[::97].tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300_000), min_size=1, max_size=400, unique=True))
def test_select_on_any_set(places):
    places = sorted(places)
    held = boundary_set.BoundarySet(np.array(places))
    assert [held.select(k) for k in range(len(places))] == places


def plain_cut(doc_id, text):
    """From the definition, by slicing the list of tokens."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.integers(-5, 10_000), st.text(alphabet=st.sampled_from("ab Z<PSM>\n<<é😀"), max_size=40))
def test_cut_on_odd_texts(doc_id, text):
    assert fill_middle.transformed(doc_id, text) == plain_cut(doc_id, text)


def test_cuts_awkward(spark):
    marked = [(30 + i, t) for i, t in enumerate(["a<P>b", "<S>", "x <M", "<P<S", "é" * 70_000 + " b" * 40_000, "one two " * 20_000])]
    frame = spark.createDataFrame(AWKWARD + marked, SCHEMA).withColumn("form", F.lit(1)).withColumn("output", F.array(F.lit("x"))).withColumn("kept.`s", F.lit(7))
    got = fill_middle.cut(frame).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(AWKWARD) + len(marked)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_cut(r.doc_id, r.text)
        assert r.back == (r.text or "") and r["kept.`s"] == 7
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.cut(frame.limit(0)).count() == 0


# --- collocations ----------------------------------------------------------------------------------------------------


def plain_phrases(rows_, least, share=100):
    """(lang, phrase): (a, l, r, n, score) of every candidate that stays, by counting all phrases in one dictionary."""
    f, n = collections.Counter(), collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows_:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f.update((lang, *w[i : i + m]) for i in range(len(w) - m + 1))
    out = {}
    often = {k: a for k, a in f.items() if a >= least and len(k) > 2}
    for (lang, *w), a in often.items():
        cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(
            key[0] == lang and len(key) - 1 > len(w) and 100 * b >= share * a and any(list(key[i : i + len(w)]) == w for i in range(1, len(key) - len(w) + 1))
            for key, b in often.items()
        )
        if not inside:
            out[lang, " ".join(w)] = (a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score)
    return out


def prose(seed, size):
    rng = random.Random(seed)
    vocabulary = [*"abcdefg", "The", "the", "ß", "日本", "x y", "\x00z"]
    apart = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \x0b", "\r\n", "! ?"]
    return "".join(rng.choice(vocabulary[: rng.choice([3, 7, 13])]) + rng.choice(apart) for _ in range(size))


def as_rows(frame):
    return {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in frame.collect()}


@pytest.mark.parametrize("least,share", [(5, 100), (3, 60), (1, 100)])
def test_phrases_brute_force(spark, least, share):
    some = [(i, prose(i, 60), [None, "en", "de"][i % 3]) for i in range(20)]
    frame = spark.createDataFrame(some + [(None, "a b c d e f g", ""), (99, None, "en"), (99, "", None)], LANGS).repartition(5)
    want = plain_phrases([(r.lang, r.text) for r in frame.collect()], least, share)
    assert as_rows(collocations.mined(frame, least, share)) == want and len(want) > 20


def test_small_blocks_and_tries_give_the_same(spark, monkeypatch):
    """Blocks of a text each, containers that burst and tries that spill all the time."""
    frame = spark.createDataFrame([(i, prose(i, 300), "en") for i in range(12)], LANGS).repartition(3)
    want = as_rows(collocations.mined(frame, 4))
    made = hat_trie.HatTrie
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 50)
    monkeypatch.setattr(collocations, "CHUNK", 37)
    monkeypatch.setattr(collocations, "HOT", 10)
    monkeypatch.setattr(collocations, "PACKED", 5)
    monkeypatch.setattr(collocations, "HatTrie", lambda width, kind: made(width, "u8", budget=20, burst=3))
    assert as_rows(collocations.mined(frame, 4)) == want and len(want) > 20


def test_stretches_of_a_block_give_the_same(spark, monkeypatch):
    frame = spark.createDataFrame([(i, prose(i, 300), "en") for i in range(12)], LANGS).repartition(3)
    want = as_rows(collocations.mined(frame, 4))
    for size in (1, 6, 64):
        monkeypatch.setattr(collocations, "STRETCH", size)
        assert as_rows(collocations.mined(frame, 4)) == want


def test_a_block_is_counted_in_bounded_memory():
    """Beside the block itself, what counting its paths takes grows little with its length."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = np.minimum(rng.zipf(1.3, 900_000), 3_000).astype("<u4")
    x[rng.random(len(x)) < 0.05] = 0
    n = 3_000
    both = np.unique(np.stack([x[:-1], x[1:]], axis=1)[(x[:-1] > 0) & (x[1:] > 0)], axis=0).astype("<i8")
    row = collocations._rows(
        collocations.CODED_ROW, block=[1], place=[0], n=[len(x)], places=[collocations._packed(x)],
        numbers=[np.arange(1, n + 1, dtype="<i8").tobytes()], parts=[np.ones(n, dtype="<i8").tobytes()], pairs=[both.tobytes()],
    )
    tracemalloc.start()
    got = sum(np.frombuffer(c, dtype="<u4").sum() for b in collocations.runs_of(1, collocations.Block(pa.Table.from_batches([row])), 5, "u4", 64) for c in b.column(3).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got > 600_000 and peak < 122e6


@pytest.mark.parametrize("kind", ["u4", "u8"])
def test_trie_counts_paths(kind):
    rng = np.random.default_rng(1)
    want, got, runs = collections.Counter(), collections.Counter(), 0
    trie = hat_trie.HatTrie(4, kind, budget=300, burst=5)
    for _ in range(60):
        paths = rng.integers(1, 5, (40, 4)) * (np.arange(4) < rng.integers(1, 5, (40, 1)))
        paths, counts = np.unique(paths, axis=0, return_counts=True)
        want.update(dict(zip(map(tuple, paths.tolist()), counts.tolist())))
        for first, rests, n in [*trie.add(paths, counts)]:
            runs += 1
            assert rests.tolist() == sorted(rests.tolist())
            for path, c in zip(rests.tolist(), n.tolist()):
                got[first, *path] += c
    for first, rests, n in trie.spill():
        for path, c in zip(rests.tolist(), n.tolist()):
            got[first, *path] += c
    assert got == want and not trie.entries and not trie.root and runs


def test_trie_within_its_budget():
    trie = hat_trie.HatTrie(3, budget=100, burst=8)
    for k in range(50):
        paths = np.array(sorted({(1 + k % 3, 1 + i, 1 + (i * k) % 7) for i in range(30)}))
        for _ in trie.add(paths, np.ones(len(paths), dtype=np.int64)):
            pass
        assert trie.entries <= 100


def test_beginnings_of_summed_runs():
    rng = np.random.default_rng(2)
    paths = rng.integers(1, 3, (400, 5)) * (np.arange(5) < rng.integers(3, 6, (400, 1)))
    counts = rng.integers(1, 4, 400)
    want = collections.Counter()
    for p, c in zip(paths.tolist(), counts.tolist()):
        for k in range(3, 6):
            if p[k - 1]:
                want[tuple(p[:k])] += c
    got = [x for own, n in hat_trie.beginnings(*hat_trie.summed(paths, counts), range(3, 6), 10) for x in zip(map(tuple, own.tolist()), n.tolist())]
    assert dict(got) == {k: c for k, c in want.items() if c >= 10} and len(got) == len(dict(got))


def test_products_beyond_64_bits(spark):
    """The score of counts as a very large corpus has them."""
    n, a, x, y = 9 * 10**15, 10**12 + 7, 3 * 10**12, 2 * 10**12 + 1
    frame = spark.createDataFrame([(a, n, x, y)], "a long, n long, l long, r long")
    assert frame.select(collocations.score()).first()[0] == 1000 * a * n // (x * y)


def test_ranks_of_ties(spark):
    frame = spark.createDataFrame([("en", p, a, 1, 1, 1, s) for p, a, s in [("b c", 5, 9), ("a c", 5, 9), ("ä c", 5, 9), ("z z", 6, 9), ("q q", 1, 10)]], "lang string, phrase string, a long, l long, r long, n long, score long")
    got = {r["rank"]: r.phrase for r in collocations.best(frame, 4, deal=2).collect()}
    assert got == {1: "q q", 2: "z z", 3: "a c", 4: "b c"}


def test_phrases_awkward(spark):
    frame = spark.createDataFrame([(i, t, None) for i, t in AWKWARD], LANGS).withColumn("ids", F.lit(1)).withColumn("number", F.lit("x")).withColumn("block", F.lit(1))
    assert as_rows(collocations.mined(frame)) == plain_phrases([(None, t) for _, t in AWKWARD], 100)
    assert collocations.best(collocations.mined(frame.limit(0))).count() == 0
    assert collocations.mined(frame.filter("doc_id < 4"), 1).count() == 0


# --- licences --------------------------------------------------------------------------------------------------------

CLASS = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def plain_words(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(CLASS, (text or "").translate(lower))


def plain_places(text):
    words = plain_words(text)
    out = []
    for label, phrase in licence_scan.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


def occurrences(part, whole):
    return [i + len(part) for i in range(len(whole) - len(part) + 1) if whole[i : i + len(part)] == part]


def plain_matches(templates, stream, least):
    out = []
    for number, t in enumerate(templates):
        longest = [max((k for k in range(j + 1) if occurrences(stream[j - k : j], t) or not k), default=0) for j in range(len(stream) + 1)]
        for j in range(1, len(stream) + 1):
            k = longest[j]
            if k >= least and (j == len(stream) or longest[j + 1] != k + 1):
                out.append((number, j - k, j, occurrences(stream[j - k : j], t)))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=10), min_size=1, max_size=4),
    st.lists(st.integers(0, 4), max_size=25),
    st.integers(1, 3),
)
def test_matches_brute_force(templates, stream, least):
    assert sorted(SuffixAutomaton(templates).matches(stream, least)) == plain_matches(templates, stream, least)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "the", "Licensed under", "-", "é"]), max_size=30))
def test_phrases_are_found_everywhere(parts):
    text = " ".join(parts)
    scanner = licence_scan.Scanner(licence_scan.PHRASES, licence_scan.TEMPLATES)
    assert sorted((f.first, f.label) for f in scanner.finds(licence_scan.words_of(text)) if f.exact) == plain_places(text)[1]


def test_base_columns_brute_force(spark, sf, texts):
    got = {r.doc_id: r for r in licence_scan.op13_licence_scan(spark, sf).collect()}
    assert set(got) == set(texts)
    for doc_id, text in texts.items():
        n, places = plain_places(text)
        r = got[doc_id]
        firsts = [i for i, _ in places] or [None]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), firsts[0], firsts[-1])
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (r.score == 1 if places else True)
    assert sum(r.n_base > 0 for r in got.values()) > 2


def edited(text, rng, share):
    """A template with some words replaced, wrapped at odd places."""
    words = [("something" if rng.random() < share else w) for w in text.split()]
    return "".join(w + rng.choice([" ", " ", "\n * ", "  "]) for w in words)


def test_edited_licences_and_clean_prose(texts):
    rng = random.Random(4)
    scanner = licence_scan.Scanner(licence_scan.PHRASES, licence_scan.TEMPLATES)
    clean = [t for t in texts.values() if t and not plain_places(t)[1]]
    assert not any(scanner.finds(licence_scan.words_of(t)) for t in clean)
    long = [(label, t) for label, t in licence_scan.TEMPLATES if len(t.split()) > 30]
    for label, t in long:
        for _ in range(10):
            a, b = rng.choice(clean), rng.choice(clean)
            spans = [f for f in scanner.finds(licence_scan.words_of(f"{a}\n{edited(t, rng, 0.05)}\n{b}")) if not f.exact]
            start, size = len(plain_words(a)), len(plain_words(t))
            assert any(f.label == label and abs(f.first - start) <= 4 and abs(f.last - start - size) <= 8 for f in spans)
    halves = [" ".join(t.split()[: len(t.split()) // 2]) for _, t in long]
    assert not any(not f.exact and f.last - f.first > 30 for t in halves for f in scanner.finds(licence_scan.words_of(t)))


def test_two_copies_are_two_spans():
    t = licence_scan.TEMPLATES[-1][1]
    scanner = licence_scan.Scanner([], [("bsd", t)])
    words = licence_scan.words_of(t)
    cut = [*words[:20], b"zzz", *words[20:]]
    for copies in (words * 3, cut * 3, [*words, b"and", *cut, *words]):
        found = scanner.finds(copies)
        assert len(found) == 3 and all(f.coverage > 0.95 for f in found)
        assert all(x.last <= y.first for x, y in zip(found, found[1:]))


def test_chain_follows_the_template():
    """Stretches in another order than the template's are not one span."""
    t = licence_scan.TEMPLATES[-1][1]
    words = licence_scan.words_of(t)
    scanner = licence_scan.Scanner([], [("bsd", t)])
    assert [f.first for f in scanner.finds(words)] == [0]
    assert not scanner.finds([*words[len(words) // 2 :], *words[: len(words) // 2]])
    apart = [*words[:40], *[b"zzz"] * (licence_scan.GAP + 1), *words[40:]]
    assert not [f for f in scanner.finds(apart) if f.coverage > 0.95]


def test_very_long_text_of_licences():
    scanner = licence_scan.Scanner(licence_scan.PHRASES, licence_scan.TEMPLATES)
    line = "This work is licensed under the GNU General Public License, version 3. Released under the MIT License.\n"
    found = scanner.finds(licence_scan.words_of(line * 3000))
    assert sum(f.exact for f in found) == 6000 and sum(not f.exact and f.label == "mit" for f in found) >= 3000


def test_licences_awkward(spark):
    more = [(40, "Apache License"), (41, "apache-license (MIT) LICENSE"), (42, "CC BY"), (43, "mit licenses"), (44, "GNU General Public\nLicense")]
    frame = spark.createDataFrame(AWKWARD + more, SCHEMA).withColumn("found", F.lit(1)).withColumn("label", F.lit("x"))
    got = licence_scan.scan(frame).collect()
    assert len(got) == len(AWKWARD) + len(more)
    for r in got:
        n, places = plain_places(r.text)
        assert r.n_words == n and sorted((f.first, f.label) for f in r.found if f.exact) == places and r.label == "x"
    assert licence_scan.scan(frame.limit(0)).count() == 0
    own = licence_scan.scan(frame, [("one", "cat")], []).filter("size(found) > 0").collect()
    assert [r.doc_id for r in own] == [10] and len(own[0].found) == 2
