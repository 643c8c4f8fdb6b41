"""Quality, whitening and phrases: slow versions, brute force, odd rows and columns, and layouts of the input."""

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridcast.llm import phrases, quality, whitening

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


# ---- quality ----


def slow_features(text):
    """Buckets and values of a text, with the hashes of the operator and everything else by hand."""
    raw = (text or "").encode()
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\x09-\x0d\x200-9A-Za-z\x80-\xff]+", raw)
    hashed = quality.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes() if raw else []
    assert len(hashed) == len(tokens)
    of = dict(zip(tokens, hashed, strict=True))
    found = Counter()
    for t in tokens:
        found[int(quality.tx.mix(np.array([of[t]]), 11)[0] >> np.uint64(64 - quality.BITS))] += 1
    for a, b in zip(tokens, tokens[1:], strict=False):
        found[int(quality.tx.Rolling(np.array([of[a], of[b]])).of(np.zeros(1, np.int64), 2, 12)[0] >> np.uint64(64 - quality.BITS))] += 1
    value = {k: 1 + np.log(c) for k, c in found.items()}
    norm = np.sqrt(sum(v * v for v in value.values()))
    return {k: v / norm for k, v in value.items()}


TEXTS = ["Good text, good text!", None, "", " \n", "a | b | c |", "naïve 漢字... 12x", "w " * 2000 + "end", "THE!! the"]


def test_features_equal_a_slow_version():
    got = {}
    for i, j, first, bucket, value in quality.features(pa.array(TEXTS)):
        for d in range(j - i):
            got[i + d] = dict(zip(bucket[first[d] : first[d + 1]].tolist(), value[first[d] : first[d + 1]].tolist(), strict=True))
    for i, t in enumerate(TEXTS):
        want = slow_features(t)
        assert got[i].keys() == want.keys() and all(abs(got[i][k] - v) < 1e-6 for k, v in want.items())


def test_updates_equal_a_coordinate_by_coordinate_version():
    rng = np.random.default_rng(3)
    size = 30
    leader = quality.Leader(np.zeros(size), np.zeros(size))
    z, n = [0.0] * size, [0.0] * size

    def weight(i):
        l1 = 0.0 if i == size - 1 else quality.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((quality.BETA + np.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(60):
        at = np.sort(rng.choice(size - 1, 5, replace=False))
        x, label, cost = rng.normal(size=5), int(rng.integers(2)), float(rng.uniform(0.5, 2))
        leader.learn(at, x, label, cost)
        row = [*zip(at.tolist(), x.tolist(), strict=True), (size - 1, 1.0)]
        w = {i: weight(i) for i, _ in row}
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in row)))
        for i, v in row:
            g = (p - label) * cost * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / quality.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert np.allclose(leader.weights(), [weight(i) for i in range(size)], atol=1e-12)
    again = quality.Leader(leader.weights(), leader.n)
    assert np.allclose(again.weights(), leader.weights(), atol=1e-12)


def learned_corpus(n=240):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, " ".join(word() + ("$$$" if bad and rng.random() < 0.5 else "") for _ in range(rng.randrange(5, 60))), i))
        marks.append((i, 0 if bad else 1))
    return rows, marks


def test_quality_learns_and_does_not_depend_on_the_layout(spark):
    rows, marks = learned_corpus()
    docs = spark.createDataFrame([*rows, (None, None, 0), (999, "", 0), (5, rows[5][1], 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([*marks, (None, 1), (7, 5), (8, None), (12, 1)], "doc_id long, quality int")
    scores = []
    for parts in (1, 7):
        model = quality.fit(docs.repartition(parts).select("doc_id", "text"), labels.repartition(parts))
        scores.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in quality.score(docs, model).collect()))
    assert [x[:2] for x in scores[0]] == [x[:2] for x in scores[1]] and np.allclose([x[2] for x in scores[0]], [x[2] for x in scores[1]], atol=1e-12)
    got = {i: s for null, i, s in scores[0] if not null}
    right = [(got[i] >= 0.5) == (y == 1) for i, y in marks if i not in (8, 12)]
    assert sum(right) >= 0.95 * len(right) and len(scores[0]) == len(rows) + 3
    slow = {i: quality.logistic(sum(float(model.weights[k]) * v for k, v in slow_features(t).items()) + model.bias) for i, t, _ in rows}
    assert all(abs(slow[i] - got[i]) < 1e-5 for i in slow)


def test_quality_without_labels_or_with_one(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for marks, want in (([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (2, 0)], 0.0), ([(7, 1), (8, 0)], 0.5)):
        model = quality.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int"))
        assert [round(r["score"], 6) for r in quality.score(docs, model).collect()] == [want, want]
    assert quality.score(docs.where("false"), model).count() == 0


@tables
def test_quality_query(spark):
    rows = quality.query(spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


# ---- whitening ----


def brute_whitening(rows):
    good = [(i, [int(np.floor(64 * float(x))) + 1_000_000 for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    lengths = Counter(len(x) for _, x in good)
    d = max(lengths, key=lambda k: (lengths[k], k))
    good = [(i, x) for i, x in good if len(x) == d]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    whole = lambda x: [n * a - s for a, s in zip(x, sums, strict=True)]
    a = np.array([whole(x) for x in fit], float) / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    order = np.argsort(-values)
    return n, [(i, sum(e * e for e in whole(x)), np.array(whole(x), float) / n) for i, x in good], values[order], vectors[:, order]


def check_whitening(spark, rows, tolerance=1e-8):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, component int, x int")
    x = whitening.integers(df)
    model = whitening.fit(x)
    out = whitening.whiten(x, model).collect()
    n, want, values, vectors = brute_whitening(rows)
    rank = min(16, int((values > 1e-9 * values[0]).sum()))
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in out) == sorted((i, k, n, dev) for i, dev, _ in want for k in range(1, rank + 1))
    assert max(r["identity_error"] for r in out) < 1e-9
    for k in range(1, rank + 1):
        assert all(abs(r["explained"] / (values[k - 1] / values.sum()) - 1) < 1e-9 for r in out if r["component"] == k)
        got = {(r["vec_id"], r["deviation"]): r["whitened"] for r in out if r["component"] == k}
        a, b = np.array([got[i, dev] for i, dev, _ in want]), np.array([c @ vectors[:, k - 1] for _, _, c in want]) / np.sqrt(values[k - 1])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < tolerance
    return model


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(90, 20)) * np.linspace(1, 9, 20)).tolist())]
    odd = [(200, None), (201, []), (202, [None] * 20), (203, [float("nan")] * 20), (204, [float("inf")] * 20), (205, [1.0, 2.0]), (206, rows[0][1]), (206, rows[3][1]), (3, rows[3][1])]
    check_whitening(spark, rows + odd)


def test_whitening_of_low_rank_and_few_rows(spark):
    rng = np.random.default_rng(6)
    check_whitening(spark, [(i, v) for i, v in enumerate(rng.normal(size=(4, 12)).tolist())])
    low = np.round(rng.normal(size=(60, 3)) * 5) @ np.round(rng.normal(size=(3, 10)) * 3)
    check_whitening(spark, [(i, v) for i, v in enumerate(low.tolist())])


def test_whitening_of_equal_eigenvalues(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack((np.eye(6), -np.eye(6))))]
    model = whitening.fit(whitening.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert len(model.values) == 6 and np.allclose(model.values, model.values[0]) and model.identity_error < 1e-12
    assert np.allclose(model.vectors.T @ model.vectors, np.eye(6), atol=1e-12)


def test_whitening_of_one_and_no_rows_and_wide_numbers(spark):
    make = lambda rows: whitening.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for rows in ([], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        x = make(rows)
        assert whitening.whiten(x, whitening.fit(x)).count() == 0
    x = make([(1, [0.0, 1e9]), (2, [5.0, -1e9]), (3, [1.0, 1e300]), (4, [2.0, 3.0])])
    out = {r["vec_id"]: r for r in whitening.whiten(x, whitening.fit(x)).where("component = 1").collect()}
    assert set(out) == {1, 2, 4} and out[1]["deviation"] is None and abs(out[1]["whitened"]) < 2
    assert out[4]["deviation"] == (3 * (2 * 64 + 10**6) - (7 * 64 + 3 * 10**6)) ** 2 + (3 * (3 * 64 + 10**6) - (3 * 64 + 3 * 10**6)) ** 2


def test_partial_sums_meet_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "DIRECT", 2)
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rng = np.random.default_rng(9)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(50, 4)).tolist())]
    check_whitening(spark, rows)


# ---- phrases ----


def brute_phrases(rows, least, percent, top):
    text, f, n = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""), Counter(), Counter()
    for lang, t in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for s in range(len(w) - k + 1):
                    f[lang, tuple(w[s : s + k])] += 1
    longer = {}
    for (lang, p), c in f.items():
        if c >= least:
            for k in range(2, len(p)):
                for s in range(len(p) - k + 1):
                    q = (lang, p[s : s + k])
                    longer[q] = max(longer.get(q, 0), c)
    out = []
    for lang in n:
        best = []
        for (g, p), a in f.items():
            if g == lang and len(p) > 1 and a >= least and not 100 * longer.get((lang, p), -1) >= percent * a:
                score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]  # noqa: E741
    return sorted(out)


def spoken(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "é", "cc", "D1", "ü-x", "漢"]
    rows = [(rng.choice(["en", "en", "de", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", "\n"]) for _ in range(rng.randrange(40)))) for _ in range(n)]
    return rows + [("en", None), (None, None), ("fr", " \n,. "), ("en", "one two three four five six. " * 9), ("en", "the\x1cend the\x00end"), ("de", "a " * 400), rows[0], rows[0]]


@pytest.mark.parametrize(("burst", "most", "chunk"), [(1 << 15, 1 << 20, 2 << 20), (8, 40, 60)])
def test_phrases_equal_brute_force(spark, monkeypatch, burst, most, chunk):
    """Also with containers that burst, tries that spill and chunks of a document or two."""
    for name, value in (("LEAST", 4), ("BURST", burst), ("MOST_ENTRIES", most), ("CHUNK", chunk)):
        monkeypatch.setattr(phrases, name, value)
    rows = spoken(3)
    docs = spark.createDataFrame([(i, t, lang, "x", 5) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, word string, c int").repartition(5)
    for top in (2000, 7):
        assert sorted(map(tuple, phrases.collocations(docs, top).collect())) == brute_phrases(rows, 4, 100, top)
    assert phrases.collocations(docs.where("false")).count() == 0


def test_a_trie_counts_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 16)
    rng = np.random.default_rng(2)
    trie, want, runs = phrases.HatTrie(2, most=300), Counter(), []
    for _ in range(40):
        one, two = (np.minimum(rng.zipf(1.4, 200), 5000).astype(np.uint64) for _ in range(2))
        want.update(zip(one.tolist(), two.tolist(), strict=True))
        key, first, c = np.unique(one * np.uint64(10_000) + two, return_index=True, return_counts=True)
        runs += trie.add((key, c, one[first], two[first]))
        assert trie.root.entries <= 300
    assert any(isinstance(c, phrases.Node) for c in trie.root.children)
    spilled = len(runs)
    runs += trie.rest()
    got = Counter()
    for _, c, one, two in runs:
        pairs = list(zip(one.tolist(), two.tolist(), strict=True))
        assert pairs == sorted(set(pairs))
        for p, k in zip(pairs, c.tolist(), strict=True):
            got[p] += k
    assert got == want and spilled > 3


def test_runs_of_pairs_are_read_as_written():
    rng = np.random.default_rng(8)
    one = np.sort(rng.integers(0, 1 << 63, 40, np.uint64)[rng.integers(0, 40, 300)])
    two, c = rng.integers(0, 1 << 63, 300, np.uint64), rng.choice([1, 2, 254, 255, 256, 10**12], 300)
    for kind in (np.uint32, np.uint64):
        rest = [two.astype(kind), two[::-1].astype(kind)]
        got = phrases.decoded(phrases.encoded(c, one, rest), 2, kind)
        assert all((a == b).all() for a, b in zip(got, (c, one, *rest), strict=True))
        none = np.zeros(0, np.int64)
        assert [len(x) for x in phrases.decoded(phrases.encoded(none, none.astype(np.uint64), [none.astype(kind)] * 2), 2, kind)] == [0] * 4


def test_pairs_taken_for_frequent_change_nothing(spark, monkeypatch):
    """The pass over pairs may take too many (short ids that meet); counts come from whole ids."""
    monkeypatch.setattr(phrases, "LEAST", 3)
    monkeypatch.setattr(phrases, "PART_WORDS", 5)
    monkeypatch.setattr(phrases, "SHARES", 4)
    merge = phrases._merged

    def taken(runs, columns, kind):
        with monkeypatch.context() as m:
            if columns == 1:
                m.setattr(phrases, "LEAST", 1)  # takes all pairs for frequent
            return merge(runs, columns, kind)

    monkeypatch.setattr(phrases, "_merged", taken)
    rows = [("en", "a b a c a d b c d e " * 2), ("en", "a b. a c! b d e a"), ("de", "a b a b a b")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == brute_phrases(rows, 3, 100, 2000)


def test_a_filter_lets_all_of_its_keys_through(spark):
    ids = spark.range(3000).select(F.xxhash64("id").alias("w1"))
    bits = phrases.bloom(ids, 3000)
    own = np.array([r["w1"] for r in ids.collect()]).view(np.uint64)
    other = np.random.default_rng(1).integers(0, 1 << 63, 20_000, np.uint64)
    assert phrases.holds(bits, own).all() and phrases.holds(bits, other).mean() < 0.02


def test_scores_beyond_64_bits_are_exact(spark, monkeypatch):
    n, a, l, r = 9 * 10**15, 4 * 10**14, 7 * 10**14, 5 * 10**14 + 1  # noqa: E741
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    told = spark.createDataFrame([("en", ["x"], l), ("en", ["y"], r), ("en", ["x", "y"], a)], "lang string, words array<string>, a long")
    monkeypatch.setattr(phrases, "count", lambda docs: (totals, told))
    assert [tuple(x) for x in phrases.collocations(None).collect()] == [("en", 1, "x y", a, l, r, n, 1000 * a * n // (l * r))]
