"""BPE, top-k, language, toxicity, language model, chat and licences: exact round trips, brute force and held-out quality."""

import hashlib
import os
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridcast.llm import bpe, chat, knn, language, license, lm, toxicity

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
reference = Tokenizer.from_file(bpe._path(None))
codec = bpe.Codec(bpe._path(None))
ODD = [None, "", " ", "\n\n", "a" * 3000, "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "naïve 漢字 🙂 ́", "I'll we've 12 3.5\t\x1c x", "   lead"]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab '\n<|endoftext>lsé1 ", max_size=60))
def test_bpe_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = np.frombuffer(codec.encode(text), "<u4").tolist()
    assert ids == reference.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == reference.decode(ids, skip_special_tokens=False) == text


def test_a_changed_pattern_is_refused():
    with pytest.raises(ValueError, match="changed"):
        bpe.pieces(r"\S+|\s+")


def test_bpe_operator(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate([*ODD, ODD[4]])], "doc_id long, text string, ids int")
    out = bpe.decode(bpe.encode(docs)).orderBy("doc_id").collect()
    for r in out:
        assert r["decoded"] == (r["text"] or "")
        assert r["ids"] == reference.encode(r["text"] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    d = {r["doc_id"]: r for r in bpe.digests(docs, with_ids=True).collect()}
    for r in out:
        raw = np.array(r["ids"], "<u4").tobytes()
        assert (d[r["doc_id"]]["ids_sha256"], d[r["doc_id"]]["ids"]) == (hashlib.sha256(raw).hexdigest(), r["ids"])
        assert d[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.digests(docs.where("false")).count() == 0


def brute_top(rows, queries, k):
    ints = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in ints if i in queries}.items():
        best = sorted((-sum(x * y for x, y in zip(a, v, strict=False)), i) for i, v in ints if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("pivots", [1, 7, 48])
def test_top_k_equals_brute_force(spark, pivots, monkeypatch):
    monkeypatch.setattr(knn, "DATA_BLOCK", 16)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 4)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [0.5, 0.5]), (305, [])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, cell int")
    queries = {i for i, _ in rows if i % 10 == 0}
    got = knn.top_k(df, df.where("vec_id % 10 = 0"), 5, pivots=pivots)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, queries, 5)


def test_top_k_of_few_and_huge_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [3.0e6, 1.0]), (50, [2.0e6, -1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, knn.top_k(df, df).collect())) == brute_top([(0, [3.0e6, 1.0]), (50, [2.0e6, -1.0])], {0, 50}, 5)
    assert knn.top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
    assert knn.top_k(df.where("false"), df).count() == 0


def test_top_k_replicates_only_what_clusters_need(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.02, 16)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0")
    pairs, copies = knn.shares(knn.plan(df, asked, 5, "vec_id", "embedding", 24))
    assert pairs < 0.1 and copies < 0.6
    assert sorted(map(tuple, knn.top_k(df, asked, 5, pivots=24).collect())) == brute_top(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    loose = spark.createDataFrame([(i, rng.normal(0, 1, 16).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    assert 0.0 <= knn.shares(knn.plan(loose, loose.where("vec_id % 50 = 0"), 5, "vec_id", "embedding", 24))[0] <= 1.0


def test_groups_of_queries_hold_near_cells():
    centres = knn.Centres(np.array([[0.0, 1], [9, 9], [0, 2], [9, 8]]), np.arange(4))
    groups = knn.gathered({0: 5, 1: 4, 2: 4, 3: 3}, centres, 9)
    assert groups[0] == groups[2] != groups[1] == groups[3]
    assert set(knn.gathered({0: 50, 1: 1}, centres, 9).values()) == {0, 1}


def test_codewords_are_apart():
    for n in (2, 4, 6, 12):
        code = language.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n and (np.abs(code.sum(0)) < n).all()
    near = min((a != b).sum() for i, a in enumerate(language.codewords(12)) for b in language.codewords(12)[:i])
    assert near >= 5


def test_language_of_odd_texts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog " * 9, "en"), ("le chat et la maison " * 9, "fr"), ("und der hund ist das " * 9, "de")] * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 !? ...", 1), (4, "le chat et la maison", 1), (5, "é", 1), (5, "é", 1), (6, "漢", 1), (7, "the dog " * 40000, 1)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in language.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] == "fr" and got[7]["lang_pred"] == "en"
    assert got[5]["lang_pred"] != "und" and got[6]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in got.values())
    kept = language.accept(odd.withColumn("lang", F.lit(None).cast("string")), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 5, 6, 7] and kept.where("lang is null").count() == 0
    told = odd.withColumn("lang", F.lit("xx"))
    assert {r["lang"] for r in language.accept(told, model).collect()} == {"xx"} and language.accept(told, model).count() == 5
    none = language.fit(docs.where("false"))
    assert sorted(r["doc_id"] for r in language.accept(odd, none).collect()) == [4, 5, 5, 6, 7]
    assert {r["lang_pred"] for r in language.predict(odd, none).collect()} == {"und"}
    one = language.fit(docs.where("lang = 'en'"))
    assert {r["lang_pred"] for r in language.predict(odd, one).collect()} == {"und", "en"}
    assert language.predict(odd.where("false"), model).count() == 0


def brute_trigrams(text):
    raw = [b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
    return [((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32) >> 17 for a, b, c in zip(raw, raw[1:], raw[2:], strict=False)]


def brute_languages(rows):
    """(doc_id, lang_pred, score) of (doc_id, text, lang), one text and one trigram after another; for up to six languages and no sampling."""
    learn = [(t, k) for i, t, k in rows if k is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    names = sorted({k for _, k in learn})
    counts = {k: {} for k in names}
    for t, k in learn:
        for g in brute_trigrams(t):
            counts[k][g] = counts[k].get(g, 0) + 1
    total = {k: sum(c.values()) + 0.05 * language.BUCKETS for k, c in counts.items()}
    share = lambda k, g: (counts[k].get(g, 0) + 0.05) / total[k]
    code = language.codewords(len(names)).tolist()
    bits = range(len(code[0]))
    known = {}

    def weights(g):
        if g not in known:
            side = lambda b, s: [share(k, g) for k, c in zip(names, code, strict=True) if c[b] == s]
            known[g] = [np.log(sum(side(b, 1)) / len(side(b, 1))) - np.log(sum(side(b, -1)) / len(side(b, -1))) for b in bits]
        return known[g]

    def mean(t):
        all_ = [weights(g) for g in brute_trigrams(t)]
        return [sum(w[b] for w in all_) / len(all_) if all_ else 0.0 for b in bits]

    x = np.array([mean(t) for t, _ in learn])
    fits = [language._logistic(x[:, b], np.array([code[names.index(k)][b] > 0 for _, k in learn])) for b in bits]
    out = []
    for i, t, _ in rows:
        if not any(map(str.isalpha, t or "")):
            out.append((i, "und", 0.0))
            continue
        margin = [a * m + c for m, (a, c) in zip(mean(t), fits, strict=True)]
        loss = [sum(np.log1p(np.exp(-np.clip(m * s, -40, 40))) for m, s in zip(margin, word, strict=True)) / len(bits) for word in code]
        likely = [np.exp(-(v - min(loss)) * len(bits)) for v in loss]
        out.append((i, names[loss.index(min(loss))], max(likely) / sum(likely)))
    return out


@tables
def test_language_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in language.query(spark, DATA).collect()}
    want = brute_languages(rows)
    assert len(got) == len(want)
    for i, lang, score in want:
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-4)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


@tables
def test_language_held_out(spark):
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    out = language.query(spark, DATA).join(truth, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)


def edits(a, b):
    """Edits with neighbouring letters swapped, by the full table."""
    d = np.add.outer(np.arange(len(a) + 1), np.arange(len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[-1, -1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=7), st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=6, unique=True), st.integers(0, 2))
def test_automaton_finds_the_nearest_term(word, terms, most):
    found = toxicity.Trie(dict.fromkeys(terms, 1.0), lambda t: most).near(word)
    near = min(edits(word, t) for t in terms)
    assert (found is None) == (near > most) and (found is None or found[2] == near)


def test_quotation_weighs_less_than_abuse():
    m = toxicity.Model({"idiot": 5.0}, {"foul": 4.0}, frozenset({"idiot"}), frozenset({"idiom"}), np.array([0.0, 0, 1, 1, 0, 0, 0]), -1.0)
    score = lambda t: m.scores(m.features(t)[None])[0]
    assert score("you idiot") > score('he said "you idiot" to us') > score("a kind word")
    assert score("you idoit") > score("a kind word") and score("") == score("a kind word") == score("an idiom")
    assert score("fouling") > score("a kind word")


@tables
def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxicity.query(spark, DATA).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.8 * len(held)


def slow_features(model, text, known):
    """The features word by word, every term compared with every word by the full table of edits. known: what has been found of a word."""
    low = (text or "").lower()
    found = list(toxicity.WORD.finditer(low))
    looked = [(t, w) for t, w in model.terms.items() if len(t) >= toxicity.LEAST_FUZZY] + [(t + "*", w) for t, w in model.stems.items()]
    hits = []
    for i, m in enumerate(found):
        word = m[0]
        stems = [word[:n] for n in toxicity.STEMS if word[:n] in model.stems]
        if word in model.terms:
            hits.append((i, model.terms[word], True, model.trust.get(word, 1.0)))
        elif stems:
            hits.append((i, model.stems[stems[0]], True, model.trust.get(stems[0] + "*", 1.0)))
        elif word not in model.ordinary and len(word) >= toxicity.LEAST_FUZZY - 1:
            near = known.setdefault(word, [])
            for t, w in looked if not near else ():
                most = 2 if len(t) >= 10 else 1
                body = t.removesuffix("*")
                if t.endswith("*"):
                    e = min(edits(body, word[:k]) for k in range(len(word) + 1))
                else:
                    e = edits(body, word) if abs(len(body) - len(word)) <= most else 9
                if e <= most:
                    near.append((e, -w, t))
            near = near or [(9, 0.0, "")]
            known[word] = near
            e, w, t = min(near)
            if e < 9:
                hits.append((i, -w / (1 + e), False, model.trust.get(t, 1.0)))
    out = np.zeros(toxicity.FEATURES)
    for i, weight, exact, trust in hits:
        words = [m[0] for m in found[max(0, i - toxicity.CONTEXT) : i + toxicity.CONTEXT + 1]]
        reported = any(w in toxicity.REPORTING for w in words)
        left = low[found[max(0, i - toxicity.CONTEXT)].start() : found[i].start()]
        right = low[found[i].end() : found[min(len(found) - 1, i + toxicity.CONTEXT)].end() + 1]
        quoted = any(q in left for q in toxicity.QUOTES) and any(q in right for q in toxicity.QUOTES)
        near = sum(abs(j - i) <= toxicity.CONTEXT for j, *_ in hits) - 1
        told = 0.3 if quoted or reported else 1.0
        out += np.array([0, 1, 0, weight * told, quoted, reported, min(near, 3)]) if exact else trust * np.array([0, 0, told, 0, quoted, reported, min(near, 3)])
    out[0] = out[1] > 0
    out[1:] = np.log1p(out[1:])
    return out


@tables
def test_toxicity_scores_equal_a_slow_version(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(toxicity.fold(4) != 2))
    assert model.terms
    some = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"] is None or len(r["text"]) < 500}
    known: dict = {}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, text in some.items():
        p = 1 / (1 + np.exp(-np.clip(slow_features(model, text, known) @ model.weights + model.bias, -35, 35)))
        assert got[i] == pytest.approx(p, abs=1e-9)


def test_toxicity_without_labels_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 50000), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == 4 and all(r["score"] < 1e-9 for r in out)
    some = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, some)).count() == 4


def test_automaton_reads_stems_as_beginnings():
    trie = toxicity.Trie({"stupid*": 2.0, "scum": 1.0}, lambda t: 1)
    assert trie.near("stuipdities")[::2] == ("stupid*", 1) and trie.near("stupidities")[::2] == ("stupid*", 0)
    assert trie.near("scumm")[0] == "scum" and trie.near("scumbag") is None and trie.near("stapeds") is None


def test_misspelled_terms_of_a_spread_lexicon_are_found(spark):
    """Forty terms, each in under 5% of the toxic texts, one of four letters; an ordinary word one edit away stays ordinary."""
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(n))
    terms, plain = ["scum", *(make(4) for _ in range(39))], [make(3) for _ in range(300)]
    texts = [" ".join([*rng.sample(plain, 12), *([terms[i // 2 % 40]] if i % 2 else ["slum"] if i % 10 == 0 else [])]) for i in range(1600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1600)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(terms) <= set(model.terms)
    score = lambda t: model.scores(model.features(t)[None])[0]
    assert all(model.hit(t[:-2] + t[-1] + t[-2]) for t in terms) and score("you scmu") > score("you there")
    assert score("a slum") == score("a town") and not any(map(model.hit, plain))


def lm_corpus():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a b", "c d", "Rare%d" % rng.randrange(300)]) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    return [(i, t) for i, t in enumerate([*texts, None, "", "unseen words here", "b a " * 3000, texts[0]])] + [(3, texts[3])]


@pytest.mark.parametrize("frequent", [20, 100_000])
def test_lm_counts_and_base_equal_brute_force(spark, frequent):
    rows = lm_corpus()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, word int, tf int")
    net, counts = lm.fit(docs.where(lm.fold(10) != 0), frequent)
    tokens = lambda t: [*(t or "").lower().split(), None]
    c = {}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            for w in tokens(t):
                c[w] = c.get(w, 0) + 1
    total = sum(c.values())
    got = lm.score(docs, net, counts).collect()
    assert net.total == total and net.distinct == len(c) and len(got) == len(rows)
    for r in got:
        t = next(t for i, t in rows if i == r["doc_id"])
        base = sum(np.log10((c.get(w, 0) + 0.1) / (total + 0.1 * (len(c) + 1))) for w in tokens(t))
        assert (r["n_tokens"], r["n_known"]) == (len(tokens(t)), sum(w in c for w in tokens(t)))
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
    text = [r for r in got if r["n_tokens"] > 20]
    assert sum(r["score"] for r in text) > sum(r["base_score"] for r in text)


def test_lm_is_a_distribution_and_carries_its_state(spark):
    rows = lm_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net, _ = lm.fit(docs)
    n = len(net.p["e"]) - 1
    first = np.arange(0, 3 * n + 1, 3)
    out = np.array([[5, 2, k] for k in range(n)]).ravel()
    both = lm.likelihood(net, out, first) - lm.likelihood(net, np.array([5, 2]), np.array([0, 2]))
    assert (10**both).sum() == pytest.approx(1.0, abs=1e-4)
    # a text longer than a window scores as by single steps
    long = np.random.default_rng(0).integers(0, n, 100)
    table, h, want, before = net.p["e"] @ net.p["wx"] + net.p["b"], np.zeros((1, lm.HIDDEN), np.float32), 0.0, n
    for x in long:
        h = lm._step(table[[before]], h, net.p["wh"])[0]
        want += lm._outputs(net, h, np.array([x]))[0]
        before = x
    assert lm.likelihood(net, long, np.array([0, 100]))[0] * lm.LOG10 == pytest.approx(want, rel=1e-4)


def test_lm_gradient_is_right():
    """Losses fall on a text with a strict pattern, far below the unigram entropy."""
    flat = np.tile(np.array([0, 1, 2, 3]), 400).reshape(4, -1)
    classes, p = lm.train(flat, 5, np.array([1.0, 1, 1, 1, 0.1]), 4, epochs=20)
    net = lm.Network(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, int), classes, p, 0, 0, 1.0)
    per_token = -lm.likelihood(net, np.tile([0, 1, 2, 3], 25), np.array([0, 100]))[0] / 100
    assert per_token < 0.1


def random_net(n=900, scale=0.3):
    rng = np.random.default_rng(3)
    classes, p = lm.start(n, rng.random(n) + 0.01, rng)
    p = {k: v + rng.normal(0, scale, v.shape).astype(np.float32) for k, v in p.items()}
    return lm.Network(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, int), classes, p, 0, 0, 1.0)


def plain_likelihood(net, out, first):
    """Lock-step with a row for each document, 32 tokens at a time."""
    p, length, total, n_h = net.p, np.diff(first), np.zeros(len(first) - 1), lm.HIDDEN
    table, order = p["e"] @ p["wx"] + p["b"], np.argsort(-length, kind="stable")

    def logs(x, at):
        np.subtract(x, x.max(1, keepdims=True), out=x)
        return x[np.arange(len(at)), at] - np.log(np.exp(x, out=x).sum(1))

    base, n = first[order], length[order]
    h, alive = np.zeros((len(n), n_h), np.float32), len(n)
    for t0 in range(0, int(n[0]), 32):
        hs, at, who = [], [], []
        for t in range(t0, min(t0 + 32, int(n[0]))):
            while n[alive - 1] <= t:
                alive -= 1
            px, h = table[out[base[:alive] + t - 1] if t else np.full(alive, len(p["e"]) - 1)], h[:alive]
            ph = h @ p["wh"]
            gates = 0.5 * np.tanh(0.5 * (px[:, : 2 * n_h] + ph[:, : 2 * n_h])) + 0.5
            new = np.tanh(px[:, 2 * n_h :] + gates[:, n_h:] * ph[:, 2 * n_h :])
            h = new + gates[:, :n_h] * (h - new)
            hs.append(h)
            at.append(base[:alive] + t)
            who.append(order[:alive])
        hs, target = np.concatenate(hs), out[np.concatenate(at)]
        cls, unit = target // lm.CLASS_SIZE, target % lm.CLASS_SIZE
        got = logs(hs @ p["c"] + p["cb"], cls)
        by = np.argsort(cls, kind="stable")
        for of in np.split(by, np.flatnonzero(np.diff(cls[by])) + 1):
            k = cls[of[0]]
            got[of] += logs(hs[of] @ p["o"][k] + p["ob"][k], unit[of])
        total += np.bincount(np.concatenate(who), got, len(total))
    return total / lm.LOG10


@pytest.mark.parametrize("window", [1, 50, 8000])
def test_lm_windows_carry_the_state_of_all_documents(monkeypatch, window):
    """Empty, short and long documents, more of them than run together; windows down to one step."""
    monkeypatch.setattr(lm, "WINDOW", window)
    monkeypatch.setattr(lm, "TOGETHER", 7)
    rng, net = np.random.default_rng(0), random_net()
    length = np.array([1, 200, 1, 33, 32, 31, *rng.integers(1, 60, 20)])
    first = np.concatenate(([0], np.cumsum(length)))
    out = rng.integers(0, 900, first[-1])
    assert lm.likelihood(net, out, first) == pytest.approx(plain_likelihood(net, out, first), rel=1e-5)
    assert lm.likelihood(net, out[:0], np.zeros(1, int)).tolist() == []


def test_lm_gates_saturate_without_a_fault():
    """Sums far beyond the range of an exponential leave or replace the state."""
    h, px = np.full((2, lm.HIDDEN), 0.25, np.float32), np.zeros((2, 3 * lm.HIDDEN), np.float32)
    px[0, : lm.HIDDEN], px[1, : 2 * lm.HIDDEN] = 200, -200
    with np.errstate(over="ignore"):
        got = lm._step(px, h, np.zeros((lm.HIDDEN, 3 * lm.HIDDEN), np.float32))[0]
    assert got[0].tolist() == [0.25] * lm.HIDDEN and got[1].tolist() == [0.0] * lm.HIDDEN


def test_lm_gradients_equal_differences(monkeypatch):
    """Those of all weights, in a window with ends of documents and padding; moments stay in single precision."""
    net, rng, grads = random_net(70), np.random.default_rng(5), []
    y = rng.integers(0, 70, (3, 12))
    y[0, 4] = y[2, 7] = 69
    live = np.ones(y.shape, bool)
    live[2, 9:] = False
    own = lm.Learner(net.p, 70, 69)
    descend = own._descend
    monkeypatch.setattr(own, "_descend", lambda grad, m, rate: (grads.append({k: g.copy() for k, g in grad.items()}), descend(grad, m, rate)))
    own._window(np.zeros((3, lm.HIDDEN), np.float32), np.full(3, 70), y, live, 0.01)
    assert all(v.dtype == np.float32 for d in (own.p, own.first, own.second) for v in d.values())

    def loss(p):
        flat, first = [], [0]
        for row, n in zip(y, live.sum(1), strict=True):
            for part in np.split(row[:n], np.flatnonzero(row[:n] == 69) + 1):
                flat.append(part)
                first += [first[-1] + len(part)] * bool(len(part))
        return -plain_likelihood(lm.Network(net.known, net.counts, net.output, net.classes, p, 0, 0, 1.0), np.concatenate(flat), np.array(first)).sum() * lm.LOG10

    p = {k: v.astype(float) for k, v in net.p.items()}
    for k, v in p.items():
        for at in rng.integers(0, v.size, 8).tolist() + [int(np.abs(grads[0][k]).argmax())]:
            ends = []
            for by in (1e-5, -1e-5):
                moved = v.copy()
                moved.ravel()[at] += by
                ends.append(loss(p | {k: moved}))
            assert grads[0][k].ravel()[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-2, abs=2e-3), (k, at)


def test_lm_scoring_takes_less_time_than_by_rows():
    rng, net = np.random.default_rng(0), random_net()
    first = np.concatenate(([0], np.cumsum(rng.integers(100, 140, 1000))))
    out, spent = rng.integers(0, 900, first[-1]), {lm.likelihood: [], plain_likelihood: []}
    for _ in range(5):
        for run, took in spent.items():
            began = time.process_time()
            run(net, out, first)
            took.append(time.process_time() - began)
    assert min(spent[lm.likelihood]) < 0.9 * min(spent[plain_likelihood])


def test_lm_lookup_finds_places():
    rng, last = np.random.default_rng(0), 2**64 - 1
    spread = np.unique(rng.integers(0, last, 3000, dtype=np.uint64))
    for known in (spread, np.arange(500, dtype=np.uint64), np.array([0, last], np.uint64), np.zeros(0, np.uint64)):
        ids = np.concatenate((known[::-1], known + np.uint64(1), np.array([0, 5, last], np.uint64)))
        at = {int(x): i for i, x in enumerate(known)}
        assert lm.Lookup(known)(ids).tolist() == [at.get(int(x), len(known)) for x in ids]


def test_lm_learns_from_all_training_documents(spark, monkeypatch):
    """What stands only in texts past the driver's sample is learnt too, and a huge first text doesn't end the sample."""
    monkeypatch.setattr(lm, "SAMPLE_TOKENS", 400)
    rows = [(0, "z " * 5000), *((i, "a b c d e " * 40) for i in range(1, 400)), (400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net, counts = lm.fit(docs)
    assert net.learnt == net.total == sum(len((t or "").split()) + 1 for _, t in rows)
    got = lm.score(spark.createDataFrame([(1, "a b c d e " * 40)], "doc_id long, text string"), net, counts).first()
    assert got["score"] > 0.85 * got["base_score"]


def test_lm_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    """Weights are equal to the last bit however rows are partitioned and batched; scores to single precision."""
    monkeypatch.setattr(lm, "SHARE", 3000)
    monkeypatch.setattr(lm, "PORTION", 700)
    rows = [(i, t) for i, (_, t) in enumerate(lm_corpus() * 3)] + [(7, "same id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    made = []
    for parts, batch in ((1, "10000"), (8, "3"), (32, "50")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        net, counts = lm.fit(docs.repartition(parts))
        made.append((net, sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"]) for r in lm.score(docs.repartition(parts), net, counts).collect())))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for net, got in made[1:]:
        assert all((net.p[k] == made[0][0].p[k]).all() for k in net.p)
        assert [r[:3] for r in got] == [r[:3] for r in made[0][1]] and np.allclose([r[3] for r in got], [r[3] for r in made[0][1]], rtol=1e-6, atol=1e-6)


def test_lm_portions_are_a_matter_of_each_learner():
    table = pa.table({"learner": [0, 0, 0, 1], "place": [0, 1, 2, 3], "text": ["a b", None, "c", "d e f"]})
    for size in (1, 2, 9):
        got = [(k, len(ids)) for k, ids, _ in lm._learnt(iter(table.to_batches(max_chunksize=size)))]
        assert got == [(0, 6), (1, 4)]


def test_kinds_of_words_are_told_by_their_endings():
    words = ["running", "singing", "singing,", "x", "x.", ".", "12", "37", "37.", "año", "niño", "", "running gag"]
    got = [lm.tokens(pa.array([w]))[1].tolist() for w in words]
    kind = lambda w: got[words.index(w)][0]
    assert kind("running") == kind("singing") == kind("singing,") != kind("x") == kind("x.") and kind("12") == kind("37") == kind("37.")
    assert kind("año") == kind("niño") and got[words.index("running gag")][0] == kind("running") and all(0 <= k < lm.KINDS for g in got for k in g)


def test_lm_words_of_a_kind_share_its_probability(spark):
    """Over all words counted and one unseen word of each kind the probabilities of a first token are one."""
    rows = lm_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net, counts = lm.fit(docs, 20)
    n = len(net.p["e"]) - 1
    first = 10 ** lm.likelihood(net, np.arange(n), np.arange(n + 1))
    inside = {r["word"]: r for r in counts.collect()}
    out = {w: u for w, u in zip(net.known.view(np.int64).tolist(), net.output.tolist(), strict=True)}
    total = sum(0.1 / net.rare * first[n - lm.KINDS :])
    for w, r in inside.items():
        u = out.get(w, n - lm.KINDS + r["kind"])
        total += first[u] * ((r["c"] + 0.1) / net.rare[r["kind"]] if u >= n - lm.KINDS else 1.0)
    assert total == pytest.approx(1.0, abs=1e-4)


def test_lm_without_training_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    net, counts = lm.fit(docs.where("false"))
    got = lm.score(docs, net, counts).collect()
    assert [(r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got] == [(0, 0.0, 0.0)] * 2
    assert lm.score(docs.where("false"), net, counts).count() == 0


TEXTS = st.text(alphabet=st.sampled_from("a\\#: </turn>\nhtcé漢"), max_size=25)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b\\", "###"]), TEXTS), min_size=1, max_size=6))
def test_chat_round_trip(turns):
    rows = pa.table({"conv_id": [1] * len(turns), "turn": list(range(len(turns))), "role": [r for r, _ in turns], "text": [t for _, t in turns]}, schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    out = chat.conversations(rows).to_pylist()[0]
    assert chat.parse(out["formatted"]) == turns
    loss = [chat.unescape(out["formatted"][b : b + n]) for b, n in zip(out["loss_begin"], out["loss_length"], strict=True)]
    assert loss == [t for r, t in turns if r == "assistant"]


def test_chat_order_nulls_and_batches(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (2, None, None, None), (None, 0, "user", "x"), (1, 1, "assistant", "again"), *((3, i, "assistant", "long text") for i in range(50)), *((c, 0, "user", "u") for c in range(10, 30))]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert chat.parse(got[1]["formatted"]) == [("user", "one"), ("assistant", "again"), ("assistant", "two")]
    assert chat.parse(got[2]["formatted"]) == [("", "")] and got[None]["n_turns"] == 1
    assert got[3]["n_turns"] == 50 and len(got) == 24 and len(got[3]["loss_begin"]) == 50
    assert chat.format_conversations(df.where("false")).count() == 0


def test_assembly_copies_long_and_short_segments(monkeypatch):
    monkeypatch.setattr(chat, "GATHER_BYTES", 5)
    source = np.arange(100, dtype=np.uint8)
    begin, length = np.array([3, 50, 7, 0, 90]), np.array([2, 20, 0, 1, 10])
    out, at = chat.assemble(source, begin, length)
    assert out.tolist() == [x for b, n in zip(begin, length, strict=True) for x in range(b, b + n)] and at[-1] == 33


def test_license_scan(spark):
    mit = next(t for n, t in license.TEMPLATES if n == "MIT" and len(t) > 200)
    rows = [(1, None), (2, ""), (3, "Some text.\nReleased under the  MIT license\nmore"), (4, mit.replace("hereby ", "")), (5, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (6, "word " * 20000), (6, "one"), (7, "under the MIT")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = {r["doc_id"]: r for r in license.scan(df).collect()}
    assert (got[1]["n_units"], got[2]["n_units"], got[2]["n_matches"]) == (0, 1, 0)
    assert got[3]["license"] == "MIT" and got[4]["license"] == "MIT" and got[4]["dice"] > 0.9
    assert got[5]["licenses"] == "Apache-2.0,CC-BY-NC-4.0" and got[5]["n_matches"] == 2 and got[5]["license"] == "Apache-2.0"
    assert got[6]["n_matches"] == 0 and got[7]["n_matches"] == 0
    assert license.scan(df.where("false")).count() == 0


def test_full_licence_texts_are_told_apart():
    matcher = license.Matcher()
    for name, body in license.TEMPLATES:
        if len(body) > 600:
            words = body.split()
            text = "my project\nCopyright 2020 Someone\n" + "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11)) + "\ndef f(): pass\n" * 3
            assert [matcher.names[i] for i, _ in matcher.scan(text)[1]] == [name]


def test_wrapped_and_embedded_notices_are_found():
    m = license.Matcher()
    names = lambda t: sorted(m.names[i] for i, _ in m.scan(t)[1])
    prose = "Some words of prose that say nothing at all. " * 30
    for name, text in ((n, t) for n, t in license.TEMPLATES if len(t) > 120):
        words = text.split()
        wrapped = "\n".join(" * " + " ".join(words[i : i + 7]) for i in range(0, len(words), 7))
        assert names(f"{prose}\n{wrapped}\n{prose}") == [name] and names(prose + text + " " + prose) == [name]
    assert names("Copyright 2020 Foo. Licensed under the MIT License.") == ["MIT"]
    assert names(prose + "licensed under CC BY 4.0. " + prose + "Released under the MIT License. " + prose) == ["CC-BY-4.0", "MIT"]
    assert names(prose + "\nReleased under the MIT License.\n" + prose) == ["MIT"] and names(prose) == [] and m.scan(None) == (0, [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("licensed under the apache license version 2 0 mit released cc by nc 4".split()), max_size=12))
def test_size_bounds_never_drop_a_match(found):
    unit, m = " ".join(found).encode(), license.Matcher()
    own = license.bigrams(unit)
    dice = [2 * len(own & s) / (len(own) + len(s)) for s in m.sets]
    want = max(dice) if own and max(dice) >= m.threshold else None
    got = m.match(unit)
    assert (got and got[1]) == want and (want is None or got[0] == dice.index(want))


def test_license_windows_equal_a_plain_slide():
    """All runs of words that begin and end with a bigram of a template: best value, count and overlaps, on random texts."""
    templates = (("a", "one two three four five"), ("b", "two three six"), ("a", "six one two"), ("c", "x y"))
    m, rng = license.Matcher(templates, 0.8), random.Random(1)
    hits = 0
    for _ in range(400):
        words = [w.encode() for w in rng.choices("one two three four five six x y z".split(), k=rng.randrange(30))]
        pairs = list(zip(words, words[1:], strict=False))
        found = []
        for i, own in enumerate(m.sets):
            most = int(len(own) * 1.2 / 0.8 + 1e-9)
            for a in range(len(pairs)):
                best = None
                for j in range(a, min(a + most, len(pairs))):
                    if pairs[a] in own and pairs[j] in own:
                        seen = set(pairs[a : j + 1])
                        dice = 2 * len(seen & own) / (len(own) + len(seen))
                        if dice >= 0.8 and (best is None or dice > best[1]):
                            best = (len(seen & own), dice, j)
                if best:
                    found.append((-best[0], -best[1], i, a, best[2] + 1))
        want, taken = [], []
        for _, dice, i, a, b in sorted(found, key=lambda f: f[:4]):
            if all(b < c or a > d for c, d in taken):
                taken.append((a, b))
                want.append((i, -dice))
        assert m.windows([(words, False)]) == want
        hits += len(want)
    assert hits > 50
