"""The dealt methods against naive versions of them, written from their definitions, and fits that order cannot change."""

import collections
import hashlib
import math
import re
import types

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from slotline.llm import (
    attention_lm, best_fit, byte_bpe, language_crf, lm_score, order_minhash, private_data, quality_rank, quality_rules, secret_scan,
)

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*values, seed=42):
    """Spark's xxhash64 of strings and longs; a null leaves the hash as it is."""
    h = seed
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), h)
    return h


# --- byte-level BPE --------------------------------------------------------------------------------------------------
def test_digests_of_whole_texts(spark, sf, documents, texts):
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    known = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [None, "", "x" * 5000, "日本語 😀 é ½² x́", "<|endoftext|> a", " \n\t ", "a\u0000b", "same", "same"]
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)] + [(None, "no id")], SCHEMA)
    docs = documents.select("doc_id", "text").unionByName(extra).withColumn("n_tokens", F.lit("clash"))
    rows = byte_bpe.digests(docs, public_tokenizers.path(byte_bpe.VOCABULARY)).collect()
    assert len(rows) == len(texts) + len(odd) + 1
    for r in rows:
        ids = known.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_states_that_merge_change_nothing():
    """Small tree regions make other states; the ids stay."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    merges = byte_bpe.Merges(ranks)
    words = [w.encode() for w in ("erlichschchscher", "internationalisation", "aaaaaaaaaaaaaaaaaaaaaa", "ñandúçé", "0x3fE9", "\t\t  \n")]
    found = []
    for few in (0, 4, 64):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(byte_bpe, "FEW", few)
            machine = byte_bpe.Transducer(merges)
            found.append([machine.encode(w) for w in words for _ in range(2)])
    assert found[0] == found[1] == found[2]


# --- language model --------------------------------------------------------------------------------------------------
def naive_scores(model, coding, ids):
    """log10 probability of each id of one text, one token at a time, in float64."""
    lm, p = attention_lm, {k: v.astype(np.float64) for k, v in model.p.items()}
    inputs = np.concatenate([[coding.inputs[coding.end]], coding.inputs[ids[:-1]]])
    out = []
    for t, target in enumerate(ids):
        begin = t // lm.STRIDE * lm.STRIDE - (lm.SPAN - lm.STRIDE)  # of the window that scores t
        seen = [s for s in range(max(begin, 0), t + 1)]
        e = p["embed"][inputs[seen]]
        q = e[-1] @ p["query"]
        logits = np.array([q @ (x @ p["key"]) / math.sqrt(lm.WIDTH) + p["near"][t - s] for s, x in zip(seen, e)])
        weight = np.exp(logits - logits.max())
        weight /= weight.sum()
        context = sum(w * (x @ p["value"]) for w, x in zip(weight, e))
        h = np.maximum(np.concatenate([e[-1], context]) @ p["mix"] + p["mix0"], 0)
        group, member = divmod(int(coding.classes[target]), lm.MEMBERS)
        first = h @ p["group"] + p["group0"]
        second = h @ p["member"][group] + p["member0"][group]
        share = first[group] - np.log(np.exp(first).sum()) + second[member] - np.log(np.exp(second).sum())
        out.append(share / math.log(10) + coding.within[target])
    return np.array(out)


def test_token_scores_equal_a_naive_forward_pass():
    rng = np.random.default_rng(6)
    coding = attention_lm.Coding.from_counts(np.arange(1200, dtype=float), [bytes([97 + i % 26, 97 + i // 26 % 26]) for i in range(1199)])
    model = attention_lm.Model.start(rng.dirichlet(np.ones(1024)))
    model.flat += rng.normal(size=len(model.flat)).astype(np.float32) * 0.2
    lengths = np.array([1, 5, 16, 17, 33, 90])
    parts = [np.append(rng.integers(0, 1199, n - 1), 1199) for n in lengths]
    got = attention_lm.token_scores(model, coding, np.concatenate(parts), lengths)
    assert got == pytest.approx(np.concatenate([naive_scores(model, coding, x) for x in parts]), abs=2e-4)


def test_windows_are_gathered_in_order():
    parts = [(np.arange(a, b), -np.arange(a, b)) for a, b in ((0, 3), (3, 3), (3, 20), (20, 21), (21, 29))]
    got = list(lm_score.gathered(iter(parts), 5))
    assert [len(x) for x, _ in got] == [5, 5, 5, 5, 5, 4] and np.concatenate([x for x, _ in got]).tolist() == list(range(29))
    assert all((x == -y).all() for x, y in got) and not list(lm_score.gathered(iter([]), 5))


def test_subwords_of_a_word_are_made_once(spark, monkeypatch):
    """In training once a task, however many batches of texts hold the word, unless more than KEPT were met; in scoring once
    in all, however many blocks hold it."""
    held = types.SimpleNamespace(value=lm_score.read_ranks(public_tokenizers.path(lm_score.VOCABULARY)))
    coding = attention_lm.Coding.from_counts(np.ones(len(held.value) + 1), [b"x"] * len(held.value))
    batch = pa.RecordBatch.from_arrays([pa.array([f"these words are {i % 9}\n here {i}" if i % 7 else None for i in range(300)])], names=["text"])
    asked, of = [], lm_score.Subwords.of
    monkeypatch.setattr(lm_score.Subwords, "of", lambda self, words: asked.extend(words) or of(self, words))
    made = lambda: [np.concatenate(z) for z in zip(*lm_score.Windows(None, held, types.SimpleNamespace(value=coding)).made()([batch]))]
    x, y = made()
    assert len(asked) == len(set(asked)) > 250 and len(x) == 300
    monkeypatch.setattr(lm_score, "KEPT", 90)
    asked.clear()
    again = made()
    assert len(asked) > len(set(asked)) and (x == again[0]).all() and (y == again[1]).all()

    monkeypatch.setattr(lm_score, "BLOCK", 100)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"), F.lit(False).alias("held_out"))
    plan = lm_score.scored(docs, public_tokenizers.path(lm_score.VOCABULARY))._jdf.queryExecution().analyzed().toString()
    grouped = next(line for line in plan.split("\n") if "FlatMapCoGroupsInArrow" in line)
    assert "ids#" in grouped and "word#" not in grouped


def test_training_steps_are_adams():
    """Against the formula in float64, with a group of classes that no target is in and places that are not scored."""
    rng = np.random.default_rng(4)
    model = attention_lm.Model.start(rng.dirichlet(np.ones(1024)))
    x, target = rng.integers(0, 2_000, (80, attention_lm.SPAN)), rng.integers(0, 500, (80, attention_lm.STRIDE))
    valid, live = np.ones(x.shape, dtype=bool), rng.random(target.shape) > 0.2
    plain, first, second = model.flat.astype(np.float64), 0, 0
    order = np.random.default_rng(0).permutation(80)
    for k in range(5):
        i = order[k * 16 : k * 16 + 16]
        grad = attention_lm.Model(plain).gradient(x[i], valid[i], target[i], live[i])[0].astype(np.float64)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        rate = 1e-2 * (k + 1) / 20 / math.sqrt(1 + (k + 1) / 1000)
        plain = plain - rate * (first / (1 - 0.9 ** (k + 1))) / (np.sqrt(second / (1 - 0.99 ** (k + 1))) + 1e-7)
    attention_lm.Trainer(model, 1e-2, 16).learn(x, valid, target, live)
    assert np.abs(model.flat - plain).max() < 2e-5


def test_tiles_hold_rows_of_one_group():
    group = np.random.default_rng(2).choice([0, 3, 3, 3, 9, 31], 500)
    place, of = attention_lm.tiles(group)
    assert (of[place // attention_lm.TILE] == group).all() and len(set(place.tolist())) == 500
    assert len(of) == sum(-(-int((group == g).sum()) // attention_lm.TILE) for g in range(attention_lm.GROUPS))


def test_a_task_learns_in_one_worker(spark, monkeypatch):
    """Windows are not handed from one Python worker to another: a round is one Arrow map over the texts."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans, real = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or real(self))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"), F.lit(False).alias("held_out"))
    lm_score.scored(docs, public_tokenizers.path(lm_score.VOCABULARY))
    rounds = [p for p in plans if "posexplode" in p]
    assert len(rounds) == len(lm_score.ROUNDS) and all(p.count("MapInArrow") == 1 for p in rounds)


def test_text_score_is_the_models_alone(spark):
    """A text's score is the sum over its ids under the fitted model; repeated rows, nulls and clashing names."""
    rows = [(1, "a b c a b c"), (2, "a b d"), (3, None), (4, ""), (5, "a b d"), (None, "zzz"), (None, "zzz"), (6, "ab " * 3000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("block", F.lit(1)).withColumn("held_out", F.col("doc_id") == 2)
    docs = docs.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    kept = {}
    with pytest.MonkeyPatch.context() as patch:
        fit = lm_score.fit

        def noted(*args):
            kept["fit"] = fit(*args)
            return kept["fit"]

        patch.setattr(lm_score, "fit", noted)
        got = lm_score.scored(docs, public_tokenizers.path(lm_score.VOCABULARY)).collect()
    coding, model = kept["fit"]
    subwords = lm_score.Subwords(lm_score.read_ranks(public_tokenizers.path(lm_score.VOCABULARY)))
    want = collections.defaultdict(set)
    for i, text in rows:
        ids = np.append(subwords.of([w.encode() for w in (text or "").split()])[0], coding.end)
        if len(ids) < 100:
            want[i].add(round(float(naive_scores(model, coding, ids).sum()), 3))
    assert len(got) == len(rows)
    for r in got:
        assert r.doc_id == 6 or any(r.score == pytest.approx(x, abs=5e-3) for x in want[r.doc_id])


# --- quality ---------------------------------------------------------------------------------------------------------
def test_fits_do_not_depend_on_the_rows_order(spark, sf, documents):
    other = documents.repartition(7, F.xxhash64("text"))
    a, b = (quality_rank.fit(spark, d, sf) for d in (documents, other))
    assert a.cut == b.cut and (a.weight == b.weight).all() and (a.mean == b.mean).all()
    a, b = (quality_rules.fit(spark, d, sf) for d in (documents, other))
    assert a.thresholds == b.thresholds and (a.forest.split == b.forest.split).all()


def test_ranker_raises_the_pairs_likelihood():
    """Against plain gradient descent on all pairs: nearly as likely."""
    rng = np.random.default_rng(8)
    good = rng.random(120) < 0.5
    rows = rng.normal(size=(120, 4)) + good[:, None] * np.array([1.0, -0.5, 0.0, 0.2])
    got = quality_rank.Ranker.fit(rows, good, pairs=6000)
    x = np.clip((rows - rows.mean(axis=0)) / (rows.std(axis=0) + 1e-6), -8, 8)
    pairs = [(i, j) for i in np.flatnonzero(good) for j in np.flatnonzero(~good)]
    diff = np.array([x[i] - x[j] for i, j in pairs])

    def likelihood(w):
        return -np.mean(np.log1p(np.exp(-(diff @ w))))

    w = np.zeros(4)
    for _ in range(3000):
        w += 0.5 * (diff / (1 + np.exp(diff @ w))[:, None]).mean(axis=0) - 0.5e-3 * w
    assert likelihood(got.weight) == pytest.approx(likelihood(w), abs=0.01) and likelihood(got.weight) > likelihood(np.zeros(4))
    # a document at the quantile scores the cut, and scores rise with strength
    assert got.score(rows)[np.argsort(x @ got.weight)].tolist() == sorted(got.score(rows).tolist())


def test_path_lengths_one_row_at_a_time():
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(700, 3))
    forest = quality_rules.Forest.grow(rows)
    size = min(quality_rules.SUBSAMPLE, len(rows))
    harmonic = lambda n: sum(1 / i for i in range(1, n))
    unit = 2 * harmonic(size) - 2 * (size - 1) / size
    for k in (0, 5, 99):
        total = 0.0
        for feature, split, length in zip(forest.feature, forest.split, forest.length):
            at = 1
            while feature[at] >= 0:
                at = 2 * at + (rows[k, feature[at]] > split[at])
            total += length[at]
        assert forest.score(rows[k : k + 1])[0] == pytest.approx(2 ** (-total / len(forest.feature) / unit), rel=1e-3)


def test_rules_learn_from_every_labelled_row(spark, tmp_path):
    """More labelled rows than the 12,000 that were once sampled: thresholds as a plain calibration over all of them has them."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(15_000):
        bad = i % 50 == 0
        words = ["w%d" % j for j in rng.integers(0, 5000, rng.integers(20, 60))]
        for j in range(rng.integers(1, 9) if bad else rng.integers(0, 2)):
            words[j] = words[j].upper() + "!" * bad
        rows.append((i, " ".join(words), 0 if bad else 1))
    spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    counted = quality_rules.written(quality_rules.statistics(docs), "counted")
    own = quality_rules.labelled(spark, counted, str(tmp_path)).collect()
    assert len(own) == len(rows)
    model = quality_rules.fit(spark, docs, str(tmp_path))
    assert len(model.forest.feature) == quality_rules.TREES and (model.forest.feature[:, 1] >= 0).all()
    n_words, good = np.array([r.n_words for r in own]), np.array([r.good for r in own])
    score, odd = model.anomalous(n_words, np.array([r.ratios for r in own]))
    for b, got in enumerate(model.thresholds):
        s, g = score[model.band(n_words) == b], good[model.band(n_words) == b]
        if not len(s):
            assert got == np.inf
            continue
        gain = {c: (s[~g] > c).mean() - (s[g] > c).mean() for c in np.unique(s) if (s[g] > c).mean() <= quality_rules.MAX_LOSS}
        assert gain[got] == pytest.approx(max(gain.values()))
    assert odd[~good].mean() > 0.5
    # what judge and verdicts say of a text is one and the same
    want = {r.doc_id: (r.n_words, r.base_failed, r.kept, r.anomaly) for r in quality_rules.judge(docs.limit(900), model).collect()}
    got = {r.doc_id: (r.n_words, r.base_failed, r.kept, r.anomaly) for r in quality_rules.verdicts(counted, model).collect()}
    assert len(got) == len(rows) and all(got[i] == v for i, v in want.items())


# --- language --------------------------------------------------------------------------------------------------------
def test_letters_and_long_words():
    worker = language_crf.Labeller(None)
    assert [language_crf.has_letter(t) for t in ("²", "½ ①", "12 _", "x", "é", "日", "١٢")] == [False, False, False, True, True, True, False]
    assert worker.predict(["²", "x"]) == [("und", 0.0), ("und", 0.0)]
    # words that share both ends differ in what lies between, however long they are
    ends = "a" * 12, "b" * 12
    for n in (5, 40, 500):
        x, y = (ends[0] + c * n + ends[1] for c in "cd")
        flat, size = language_crf.feature_lists([x, "short", y, "...", x])
        lists = np.split(flat, np.cumsum(size)[:-1])
        assert set(lists[0]) == set(lists[4]) != set(lists[2])
        assert lists[3].tolist() == [0]
        assert len(lists[0]) == 3 * len(x) + 3 + 4  # 1- to 3-grams with the ends marked, three affixes, the word


def test_chains_of_one_batch_by_themselves(monkeypatch):
    """Chains of all lengths at once have the means that forward-backward gives each alone; new words of many texts are
    scored together."""
    rng, letters = np.random.default_rng(4), "abcdefgh"
    words = ["".join(rng.choice(list(letters), rng.integers(1, 9))) for _ in range(900)] + ["12", "--", "x" * 60]
    weight = rng.normal(size=(language_crf.BUCKETS, 3)).astype(np.float32)
    weight[0] = 0
    model = language_crf.Model(["a", "b", "c"], weight, rng.normal(size=(3, 3)))
    texts = ["a", *(" ".join(rng.choice(words, n)) + " z" for n in [*rng.integers(1, 90, 200).tolist(), 2000])]
    worker, calls, real = language_crf.Labeller(model), [], language_crf.feature_ids
    monkeypatch.setattr(language_crf, "feature_ids", lambda w, n: calls.append(len(w)) or real(w, n))
    got = worker.predict(texts)
    assert len(calls) <= 4 and sum(calls) == len(worker.place)
    for text, (lang, score) in zip(texts, got):
        places = worker.places(text.split())
        marginal, _, _ = language_crf.forward_backward(worker.scores[places][None].astype(float), model.move, np.ones((1, len(places)), bool))
        mean = marginal[0][worker.lettered[places]].mean(axis=0)
        assert model.languages[int(mean.argmax())] == lang and abs(mean.max() - score) < 1e-4


def test_und_needs_a_letter(spark, documents):
    model = language_crf.fit(documents)
    rows = [(1, "² ½"), (2, None), (3, ""), (4, "x ² ²"), (None, "and the"), (5, "and " * 30_000), (5, "and " * 30_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("lang_pred", F.lit(1)).withColumn("lang", F.lit("zz"))
    got = language_crf.label(docs, model).collect()
    assert len(got) == len(rows)
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3)) and 0 <= r.lang_score <= 1 for r in got)
    assert len({(r.lang_pred, r.lang_score) for r in got if r.doc_id == 5}) == 1


# --- secrets ---------------------------------------------------------------------------------------------------------
def test_runs_are_judged_by_the_likelihood_ratio(spark, documents):
    """Every run of every text, by models counted again from the same samples."""
    planted = [
        (10**6, "key Zx9Qm2Lr8Tv4Wk1Bn7Hd3Yp6 end"), (10**6 + 1, 'token = "6f1c2b9a0d4e8f73b5a1c2d3e4f50617"'), (10**6 + 2, "internationalisation department-of-something"),
        (10**6 + 3, "qxzvbkjwpfgqzxvkjb 4111111111111111 2024-01-02_03-04-05"), (10**6 + 4, None), (None, "9f8e7d6c5b4a39281706f5e4"), (10**6 + 5, "ABAB" * 10 + " é" + "0f" * 20),
    ]
    rng = np.random.default_rng(10)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    planted += [(2 * 10**6 + i, f'password = "{"".join(rng.choice(letters, 24))}" and {"".join(rng.choice(letters[26:], 24))}') for i in range(80)]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(planted, SCHEMA))
    labelled = secret_scan.samples(docs, secret_scan.SAMPLE).collect()
    size = len(secret_scan.ALPHABET) + 1
    place = {c: i + 1 for i, c in enumerate(secret_scan.ALPHABET)}
    counts = {kind: np.ones((size, size)) for kind in (True, False)}
    for r in labelled:
        if not r.held:
            for a, b in zip(r.w, r.w[1:]):
                counts[r.random][place.get(a, 0), place.get(b, 0)] += 1
    log = {kind: np.log(c / c.sum(axis=1, keepdims=True)) for kind, c in counts.items()}

    def mean(run):
        return sum(log[True][place[a], place[b]] - log[False][place[a], place[b]] for a, b in zip(run, run[1:])) / (len(run) - 1)

    ratio, margin = secret_scan.fit(docs)
    assert ratio == pytest.approx((log[True] - log[False]).ravel(), abs=1e-9)
    got = {r.doc_id: sorted((s.start, s.end) for s in r.added) for r in secret_scan.secrets(docs).collect()}
    for r in docs.collect():
        runs = [m for m in re.finditer(r"[A-Za-z0-9+/_=-]+", r.text or "") if len(m[0]) >= secret_scan.LEAST]
        clear = [m for m in runs if abs(mean(m[0]) - margin) > 1e-5]
        assert set(got[r.doc_id]) >= {m.span() for m in clear if mean(m[0]) > margin}
        assert not set(got[r.doc_id]) & {m.span() for m in clear if mean(m[0]) < margin}
    # planted random strings are found, identifiers, numbers and dates are not
    assert len(got[10**6]) == 1 and len(got[10**6 + 1]) == 1 and not got[10**6 + 2] and len(got[None]) == 1 and (42, 82) in got[10**6 + 5]
    # those that patterns find too, nearly all; of capitals and digits that no pattern finds, most
    assert np.mean([any(s < 30 for s, _ in got[2 * 10**6 + i]) for i in range(80)]) > 0.95
    assert np.mean([any(s > 30 for s, _ in got[2 * 10**6 + i]) for i in range(80)]) > 0.7
    assert (19, 35) not in got[10**6 + 3] and (36, 55) not in got[10**6 + 3]


def test_kinds_of_secrets_and_of_names(spark, documents):
    """Trained on hexadecimal tokens as the tables have them: recall on other kinds of random strings, and how few written
    names of unseen words are taken for secrets."""
    import base64

    rng = np.random.default_rng(12)
    alnum = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    tokens = [(10**6 + i, f'a token = "{rng.bytes(20).hex()}" here') for i in range(150)]
    rows = documents.select("doc_id", "text").collect()
    unseen = [w.lower() for r in rows[::2] for w in re.findall("[A-Za-z]{3,12}", r.text or "")]
    seen = documents.filter(F.col("doc_id").isin([r.doc_id for r in rows[1::2]])).select("doc_id", "text")
    secrets = {
        "base64": lambda: base64.b64encode(rng.bytes(24)).decode(),
        "mixed": lambda: "".join(rng.choice(alnum, 24)),
        "capitals": lambda: "".join(rng.choice(alnum[26:], 24)),
        "hex": lambda: rng.bytes(16).hex(),
    }
    some = lambda n: [str(w) for w in rng.choice(unseen, n)]
    names = {
        "camel": lambda: (lambda w: w[0] + "".join(x.capitalize() for x in w[1:]))(some(4)),
        "path": lambda: "/" + "/".join(some(4)),
        "hyphens": lambda: "-".join(some(4)),
        "dots": lambda: ".".join(some(4)),
        "underscores": lambda: "_".join(some(4)).upper(),
    }
    made = [(kind, make()) for kinds in (secrets, names) for kind, make in kinds.items() for _ in range(100)]
    ratio, margin = secret_scan.fit(seen.unionByName(spark.createDataFrame(tokens, SCHEMA)))
    text = F.col("text")
    places = secret_scan.S.matches(text, f"[{secret_scan.CHARACTERS}]{{{secret_scan.LEAST},}}+", 3, lambda v: secret_scan.likely(v, ratio) > margin)
    frame = spark.createDataFrame([(i, f"the {v} of it") for i, (_, v) in enumerate(made)], SCHEMA)
    got = {r.doc_id: r.n for r in frame.select("doc_id", F.size(places).alias("n")).collect()}
    share = {kind: np.mean([got[i] > 0 for i, (k, _) in enumerate(made) if k == kind]) for kind in [*secrets, *names]}
    assert all(share[k] > 0.9 for k in secrets) and all(share[k] < 0.1 for k in names), share


# --- personal data ---------------------------------------------------------------------------------------------------
def naive_terms(rows):
    """Terms of each text, from the definition: counts over documents, shrunk shares, disclosure, terms near entities."""
    kinds = [
        (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda v: True),
        (1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", lambda v: all(int(x) <= 255 for x in v.split("."))),
        (2, r"[0-9](?:[\x20-]?[0-9])+", lambda v: 13 <= len(d := re.sub("[ -]", "", v)) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0),
        (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
    ]

    def words(t):
        """(word, whether it has a capital inside a sentence); a gap's start follows an entity, a text's start does not matter."""
        out = []
        for m in re.finditer(r"[^\W\d_]+", t):
            if len(m[0]) >= 3:
                before = t[: m.start()]
                inside = before == " " or (len(before) > 1 and before[-1] == " " and (before[-2].isalnum() or before[-2] in ",;"))
                out.append((m[0].lower(), inside and m[0][0].isupper() and m[0][1].islower()))
        return out

    near, n_t, n_e, n_et, seen, names = [], *(collections.Counter() for _ in range(3)), collections.defaultdict(set), set()
    for text in rows:
        own = collections.defaultdict(set)
        for kind, pattern, keep in kinds:
            gaps, at = [], 0
            found = list(re.finditer(pattern, text))
            for m in found:
                gaps.append(words(text[at : m.start()]))
                at = m.end()
            gaps.append(words(text[at:]))
            for i, m in enumerate(found):
                if keep(m[0]):
                    left = [w for g in gaps[: i + 1] for w in g][-4:]
                    right = [w for g in gaps[i + 1 :] for w in g][:4]
                    e = kind, m[0].lower()
                    own[e] |= {w for w, _ in [*left, *right]}
                    names |= {(e, w) for w, name in [*left, *right] if name}
        near.append(own)
        n_t.update({w for w, _ in words(text)})
        n_e.update(own.keys())
        n_et.update((e, t) for e, ts in own.items() for t in ts)
        for e, ts in own.items():
            for t in ts:
                seen[e, t].add(text)
    n = len(rows)

    def discloses(e, t):
        s = len(seen[e, t])
        p = (s * n_et[e, t] / n_t[t] + 2 * (0.9 if (e, t) in names else 0.02)) / (s + 2)
        return n > n_e[e] and p >= 0.5 - 1e-12 and math.log(p * n / n_e[e]) >= 0.8 * math.log(n / n_e[e]) - 1e-12

    return [{t for e, ts in own.items() for t in ts if discloses(e, t)} for own in near]


def test_terms_by_counting_again(spark, documents):
    planted = ["Ask Zorblax the head, jane@x.org, a@b.cd and Quux of the"] * 3 + ["the +1 (234) 567-8901 desk of Wendlebury", "the head of the desk 10.0.0.1"]
    planted += [f"the {w} grumbletonk desk x{i}@y.org is {w}y" for i, w in enumerate(["red", "blue", "green", "white", "black"])]  # as many addresses
    planted += [f"{w} fizzelwick at fizz@y.org is {w}y" for w in ["red", "blue", "green", "white", "black"]]  # one address, five texts
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(planted)], SCHEMA))
    got = {r.doc_id: {t.value.lower() for t in r.terms} for r in private_data.mark(docs).select("doc_id", "terms").collect()}
    rows = docs.filter("text is not null").collect()
    want = dict(zip([r.doc_id for r in rows], naive_terms([r.text for r in rows])))
    assert got == {r.doc_id: want.get(r.doc_id, set()) for r in docs.collect()}
    assert sum(map(bool, want.values())) > 5 and {"zorblax", "quux"} <= got[10**6]
    assert not any("grumbletonk" in got[10**6 + i] for i in range(5, 10)) and all("fizzelwick" in got[10**6 + i] for i in range(10, 15))


def test_names_go_and_rare_words_stay(spark, sf):
    """Planted in whole texts: names next to addresses of their own, and rare ordinary words, as lines or in running text."""
    rng = np.random.default_rng(8)
    syllables = ["bran", "dol", "fen", "gar", "hul", "jor", "kel", "mun", "pol", "rus", "tam", "wex"]
    word = lambda: "".join(rng.choice(syllables, 4))
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) > 400").orderBy("doc_id").limit(120).collect()]
    names, rare, rows = {}, {}, []
    for i, t in enumerate(texts):
        name, plain, mail = word(), word(), f"m{i}@post{i % 7}.org"
        names[i], rare[i] = name, plain
        rows.append((i, f"{t}\nWe asked {name.capitalize()}, {mail}, about the {plain} and the rest."))
    got = {r.doc_id: {t.value.lower() for t in r.terms} for r in private_data.mark(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "terms").collect()}
    recall = sum(names[i] in got[i] for i in names) / len(names)
    lost = sum(rare[i] in got[i] for i in rare) / len(rare)
    marked = sum(len(got[i]) for i in got)
    assert recall >= 0.95 and lost <= 0.05 and sum(names[i] in got[i] for i in names) >= 0.9 * marked


# --- fingerprints ----------------------------------------------------------------------------------------------------
def naive_signature(text):
    """Entries from the definition: k-mers with occurrence numbers, the least of each bucket, in text order."""
    m = order_minhash
    units = [w[i : i + m.UNIT] for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") for i in range(0, len(w), m.UNIT)]
    seen, buckets = collections.Counter(), collections.defaultdict(list)
    mask = (1 << 64) - 1 - m.PLACE
    if units:
        for i in range(max(len(units) - m.K, 0) + 1):
            h = hashed(*[units[i + j] if i + j < len(units) else None for j in range(m.K)]) & mask
            number = seen[h]
            seen[h] += 1
            if number:
                h = xxhash.xxh64_intdigest(number.to_bytes(4, "little"), hashed(signed(h) >> m.PLACE_BITS)) & mask
            buckets[signed(h) >> (64 - m.BUCKET_BITS)].append((signed(h) >> m.PLACE_BITS, i))
    out = []
    for b, kmers in buckets.items():
        chosen = sorted(kmers)[: m.ORDER]
        in_order = [h for h, _ in sorted(chosen, key=lambda x: x[1])]
        out.append(((b + m.BUCKETS // 2) << 32) | (hashed(*in_order) & 0xFFFFFFFF))
    return sorted(out)


def test_signatures_from_the_definition(spark, documents, texts):
    odd = [None, "", "one", "a b " * 60, "x" * 200, "é 日本 😀 " * 5, "same words here", "same words here"]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], SCHEMA)).withColumn("signature", F.lit("clash"))
    rows = order_minhash.fingerprints(docs).collect()
    assert len(rows) == len(texts) + len(odd)
    for r in rows:
        assert sorted(r.signature) == naive_signature(r.text)


def test_likeness_is_the_share_of_equal_entries(spark, documents):
    rows = order_minhash.against_next(documents).withColumn("near", order_minhash.likeness(F.col("own"), F.col("other"))).collect()
    for r in rows:
        own, other = set(r.own), set(r.other)
        buckets = {e >> 32 for e in own | other}
        assert r.near == pytest.approx(len(own & other) / len(buckets) if buckets else 1.0)


# --- packing ---------------------------------------------------------------------------------------------------------
def test_word_table_learns_in_any_order():
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(best_fit.VOCABULARY), encoding="utf-8") as f:
        description = f.read()
    known = Tokenizer.from_str(description)
    texts = ["plain words here", None, " plain  words\n\nhere 12 é½", "<|endoftext|>", "x<|endoftext|>y plain", "日本語 words ªº", "'s 're ll", ""]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(best_fit, "TOGETHER", 2)
        patch.setattr(best_fit, "MAX_WORDS", 6)
        table = best_fit.WordTable(description)
        for _ in range(3):
            for got, text in zip(table.encode(texts, 2), texts):
                assert got.tolist() == [*known.encode(text or "", add_special_tokens=False).ids, 2]


# --- near copies -----------------------------------------------------------------------------------------------------
def test_no_near_pair_is_left_without_a_key(spark, monkeypatch):
    """Pairs at exactly 0.8, found among 240,000 as those that share none of 56 keys of 8 min-hashes; in any order of the hashes."""
    from slotline.llm import near_shingles as near

    rows = []
    for i in (20172, 24923, 128096, 135249, 186641, 192053, 205215, 208778):
        words = [f"w{i}x{j}" for j in range(40)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:36], *(f"v{i}x{j}" for j in range(4))]))]
        rows.append((len(rows), " ".join([*words[:35], *(f"u{i}x{j}" for j in range(5))])))  # 31 of 41: not alike
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for often in (1, 2, 3):
        monkeypatch.setattr(near, "OFTEN", often)
        got = {r.doc_id: r.component_id for r in near.linked(docs).collect()}
        assert all(got[i + 1] == got[i] == i and got[i + 2] == i + 2 for i in range(0, len(rows), 3))


def test_keys_of_random_sets_meet():
    """Each pair of sets at the similarity shares a key that leaves enough of both, whichever hashes come last."""
    from slotline.llm import near_shingles as near

    rng, met = np.random.default_rng(3), 0
    for _ in range(3000):
        base = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 60)).astype("<u8"))
        x, y = (np.unique(np.append(base[rng.random(len(base)) > 0.1], rng.integers(0, 1 << 63, rng.integers(0, 4)).astype("<u8"))) for _ in "xy")
        both, (m, n) = len(np.intersect1d(x, y)), (len(x), len(y))
        if not both or 10 * both < 8 * (m + n - both):
            continue
        last = np.sort(rng.choice(base, int(len(base) * rng.random()), replace=False))
        a, b = (near.first_keys(s, last, np.argsort(last[::-1]), 0.8).tolist() for s in (x, y))
        places = [(a.index(h), b.index(h)) for h in set(a) & set(b)]
        assert any(9 * min(m - i, n - j) >= 4 * (m + n) for i, j in places)
        met += 1
    assert met > 300


def test_sketches_allow_every_alike_pair(spark):
    """The bound never refuses a pair of the similarity, and refuses many that are not alike."""
    from slotline.llm import near_shingles as near

    rng = np.random.default_rng(11)
    rows, alike = [], []
    for n in (1, 5, 60, 400, 3000):
        base = rng.integers(0, 1 << 63, n).astype("<u8")
        for share in (1.0, 0.97, 0.9, 0.88, 0.7, 0.4, 0.0):
            other = np.unique(np.concatenate([base[: int(n * share)], rng.integers(0, 1 << 63, n - int(n * share)).astype("<u8")]))
            x, y = np.unique(base), other
            both = len(np.intersect1d(x, y))
            rows.append((len(rows), len(x), len(y), near.sketch(x).tolist(), near.sketch(y).tolist()))
            alike.append(both >= 0.8 * (len(x) + len(y) - both))
    frame = spark.createDataFrame(rows, "i long, m long, n long, sx array<long>, sy array<long>")
    kept = {r.i for r in frame.filter(near.possible(0.8)).collect()}
    assert {i for i, a in enumerate(alike) if a} <= kept and len(kept) < len(rows) - 8


def test_pairs_are_not_listed_at_each_key_they_share(spark):
    """Edited copies share dozens of keys: each pair of them is listed, and few more than once in either order."""
    from pyspark.sql import functions as F

    from slotline.llm import near_shingles as near

    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 400).astype("<u8")
    sets = [np.unique(np.append(base[rng.random(400) > 0.1], rng.integers(0, 1 << 63, 20).astype("<u8"))) for _ in range(30)]
    none = np.zeros(0, dtype="<u8")
    rows = [(i, len(s), near.sketch(s).tolist(), near.first_keys(s, none, none, 0.8).tolist()) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "id long, size long, sketch array<long>, keys array<long>")
    shared = frame.select("id", "size", F.col("id").alias("grp"), F.posexplode("keys").alias("place", "key"))
    got = [(r.a, r.b) for r in near.pairs_between(shared, frame.select("id", "sketch", "keys"), 0.8).collect()]
    possible = {
        (r.a, r.b)
        for r in frame.select(F.col("id").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("sx"))
        .join(frame.select(F.col("id").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("sy")), F.col("a") < F.col("b"))
        .filter(near.possible(0.8))
        .collect()
    }
    alike = {(i, j) for i in range(30) for j in range(i + 1, 30) for n in [len(np.intersect1d(sets[i], sets[j]))] if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)}
    assert alike <= set(got) <= possible and len(set(got)) > 100
    assert len(got) < 3 * len(set(got))  # in either order once, and few again


def test_near_copies_leave_neither_shuffles_nor_dead_tables(spark):
    """What a step has moved and what no later step reads is off the disks when the groups are told."""
    import glob
    import os
    import time

    from slotline.llm import near_shingles as near

    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    moved = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}
    tables = lambda: set(os.listdir(re.sub("^file:/*", "/", spark.conf.get("spark.checkpoint.dir"))))
    rows = [(i, " ".join(f"w{i // 3}x{j}" for j in range(60)) + " edited" * (i % 3)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before, at_first, setting = moved(), tables(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    got = near.linked(docs)
    for _ in range(50):
        if moved() <= before:
            break
        time.sleep(0.2)
    assert moved() <= before and spark.conf.get(setting, None) == was
    assert {t.rsplit("-", 1)[0] for t in tables() - at_first} <= {"rows", "names", "named", "labels", "pivoted", "lists", "alike"}
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i - i % 3 for i, _ in rows}


def test_near_copies_in_parts(spark, monkeypatch):
    """Done in many parts, groups are the same; what later steps do not read is gone before texts are moved a second time."""
    import os

    from slotline.llm import near_shingles as near

    rng, folder = np.random.default_rng(5), re.sub("^file:/*", "/", spark.conf.get("spark.checkpoint.dir"))
    rows = []
    for i in range(300):
        words = [f"w{i // 3}x{j}" for j in range(60)]
        if i % 3:
            for at in rng.choice(60, i % 4, replace=False):
                words[at] = f"edit{i}"
        rows.append((i, " ".join(words)))
    sets = [near.shingle_set(t, 5) for _, t in rows]
    want = list(range(300))
    for i in range(0, 300, 3):
        for a, b in ((i, i + 1), (i, i + 2), (i + 1, i + 2), (i, i + 1), (i, i + 2)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                want[a] = want[b] = min(want[a], want[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at_first, seen, moves = set(os.listdir(folder)), [], near.sets_of
    there = lambda: {t.rsplit("-", 1)[0] for t in set(os.listdir(folder)) - at_first}

    def watched(*given):
        seen.append((there(), *given[3:]))
        return moves(*given)

    monkeypatch.setattr(near, "sets_of", watched)
    for name, value in (("FEW", 0), ("PARTS", 3), ("SIDE", 2), ("KEYS", 4)):
        monkeypatch.setattr(near, name, value, raising=False)
    assert {r.doc_id: r.component_id for r in near.linked(docs).collect()} == dict(enumerate(want)) and len(set(want)) > 100
    assert len(seen) == 2 and not seen[1][0] & {"sets", "sketches", "shared", "grouped", "lists", "pivoted", "hashes", "listed"}
    assert there() <= {"rows", "names", "named", "labels", "alike"} and [x[1:] for x in seen] == [(3,), (3,)]
