"""Near duplicates, substring removal and decontamination against brute force, with nulls, ties, long texts and odd columns."""

import hashlib
import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from gridcast.llm import components, decontaminate, neardup, scratch, substring
from gridcast.llm import text as tx

SPACE, ALNUM = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, class string, places int, row string, gram int, component_id long, n_chars long"


def lower(text):
    return re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode())


def words(text, pattern=SPACE, low=True):
    return pattern.findall(lower(text) if low else (text or "").encode())


def make(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3, len(t or "")) for i, t in rows], SCHEMA)


def corpus(seed=1, n=60):
    """Random texts with exact copies, near copies, shared passages, repeats inside a text, and odd ones."""
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("la", "ti", "Ko", "é", "ü") for b in ("ra", "no", "S", "x1", ",")]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    base, passage = [text(rng.randrange(1, 150)) for _ in range(n // 2)], text(35)
    out = list(base)
    for t in base[: n // 4]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out += [t, " ".join(w), f"{text(5)} {passage} {text(7)}"]
    out += [None, "", "  \n", "one", "One two", "\x1cone\x0btwo", passage + " " + passage, "word " * 3000, base[0].upper()]
    rng.shuffle(out)
    return [(i * 3 - 20, t) for i, t in enumerate(out)] + [(10_000, out[0]), (10_000, out[0])]


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    ids = sorted({i for i, _ in rows})
    sets = {i: shingle_set(t, k) for i, t in rows}
    low = {i: i for i in ids}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            low[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    rows = corpus()
    got = neardup.groups(make(spark, rows), k, percent).collect()
    want = brute_components(rows, k, percent)
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chain_of_near_copies_is_one_component(spark):
    """Neighbours are alike, ends are not: the stars alone would leave it in pieces."""
    rng = random.Random(3)
    w = [f"w{rng.randrange(10**6)}" for _ in range(220)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(w)))
        for _ in range(3):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(make(spark, rows), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 3, 85).items()}


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    """Near copies of unlike distance, more than a block of them: half of them are strays."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "BRIDGES", 2)
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(make(spark, rows), 3, 85).collect()}
    want = {i: c for i, (_, c) in brute_components(rows, 3, 85).items()}
    assert got == want and 1 < len(set(want.values())) < 60


def test_deduplicate_keeps_one_row_of_each_group_and_all_columns(spark):
    rows = corpus(5)
    out = neardup.deduplicate(make(spark, rows))
    want = brute_components(rows, 5, 80)
    assert out.columns == make(spark, rows[:1]).columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_a_doc_id_with_several_texts_is_several_documents(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one), (1, two), (1, two), (2, one), (3, two + " end"), (None, one), (None, one), (4, None), (4, None), (5, "")]
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.deduplicate(make(spark, rows)).collect())
    assert got == sorted([(1, one), (1, two), (0, one), (0, one), (4, ""), (5, "")])


def test_copies_of_common_sets_are_dealt_by_document(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARES", 3)
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(i, text) for i in range(50, 90)] + [(i, text + f" tail{i}") for i in range(5)] + [(100, "x y z"), (101, "")]
    got = {r["doc_id"]: (r["component_id"], r["class_id"]) for r in neardup.groups(make(spark, rows), 3, 85).collect()}
    assert all(got[i] == (0, 50) for i in range(50, 90)) and all(got[i] == (0, i) for i in range(5)) and got[100] == (100, 100) and got[101] == (101, 101)


def test_the_filter_lets_all_members_through(spark):
    words = neardup.bloom(spark.range(5000), 5000, "id")
    shipped = spark.sparkContext.broadcast(words)
    docs = spark.range(9000).selectExpr("xxhash64(id) as h", "id as doc_id", "concat('w', id) as text")
    got = {r["doc_id"] for r in docs.mapInArrow(neardup._digests(3, shipped), "doc_id long, class long, shingles binary").collect()}
    assert set(range(5000)) <= got and len(got) < 5200


@pytest.mark.parametrize("contracts", [True, False])
def test_components_equal_a_walk(spark, monkeypatch, contracts):
    """With and without the contraction inside tasks, which does it all on a small table."""
    if not contracts:
        monkeypatch.setattr(components, "_contract", lambda batches: batches)
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(35)] + [(500, k) for k in range(300, 340)] + [(7, 7)]
    near: dict = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert got == {i: reach(i) for i in near if near[i] != {i}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_documents(spark):
    empty = make(spark, [(1, "x")]).where("false")
    assert neardup.groups(empty).count() == 0
    assert substring.digests(empty).count() == 0
    assert substring.clean(empty).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(empty, bench).count() == 0
    assert decontaminate.clean(make(spark, [(1, "x")]), bench).count() == 1


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 1500, np.uint64) * tx.U(2)
    one, two = h[:1000], h[200:1200]
    doc = lambda x: np.zeros(len(x), np.int64)
    a, b, both = (neardup.sketch(doc(x), x, 1, 384) for x in (one, two, np.unique(h[:1200])))
    assert (np.maximum(a, b) == both).all()
    j = neardup.estimate(a, b, np.array([1000.0]), np.array([1000.0]))[0]
    assert abs(j - 800 / 1200) < 0.15
    assert neardup.estimate(a, a, np.array([1000.0]), np.array([1000.0]))[0] > 0.99


def brute_removal(rows, n=20):
    seen, out = {}, {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None}, key=lambda r: r[0]):
        w = words(t, low=False)
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            if seen.setdefault(key, (i, s)) != (i, s):
                gone[s : s + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("n_batches", [1, 2, 7])
def test_removal_equals_brute_force(spark, n_batches):
    rows = corpus(2)
    got = substring.digests(make(spark, rows).repartition(5), n_batches).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_removal(rows)


def test_partial_overlaps_and_periodic_texts(spark):
    rng = random.Random(9)
    w = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(w))]
    rows += [(i, " ".join(rng.choice("abcdef") for _ in range(9)) + " " + " ".join(w[s : s + k]) + " z " + " ".join(w[t : t + k])) for i, (s, t, k) in enumerate([(5, 100, 19), (5, 100, 20), (40, 41, 60), (280, 0, 20), (17, 18, 33)], 1)]
    rows += [(10, "a b " * 30), (11, "b a " * 15), (12, "a " * 41), (13, "c " * 19), (14, "c " * 20), (15, "c " * 21)]
    for n_batches in (1, 3):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digests(make(spark, rows), n_batches).collect()}
        assert got == brute_removal(rows)


def test_texts_of_one_doc_id_lose_only_what_repeats(spark):
    """Brute force over (doc_id, text), with overlaps that hit one text of a doc_id only, through digests, clean and the pipeline's stage."""
    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(100000)}"
    passage, own = [" ".join(word() for _ in range(30)) for _ in range(4)], [" ".join(word() for _ in range(40)) for _ in range(9)]
    rows = [(0, passage[0]), (1, passage[0]), (1, own[0]), (1, own[0]), (2, own[1] + " " + passage[1]), (2, passage[1] + " " + own[2]), (2, own[3])]
    rows += [(3, passage[2] + " " + own[4]), (4, own[5] + " " + passage[2]), (4, own[6]), (-5, passage[3]), (-5, own[7]), (6, own[7] + " " + passage[3]), (6, None), (6, own[8]), (None, passage[0])]
    df = make(spark, rows)
    order = {(r["doc_id"], r["text"]): r["h"] for r in df.selectExpr("doc_id", "text", "xxhash64(text) as h").collect()}
    seen, want = {}, {}
    for i, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], order[r])):
        w = words(t, low=False)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if seen.setdefault(tuple(w[s : s + 20]), (i, t, s)) != (i, t, s):
                gone[s : s + 20] = [True] * 20
        want[i, t] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert want[1, own[0]][1] == 0 and want[1, passage[0]][1] == 30 and want[4, own[6]][1] == 0
    for n_batches in (1, 2, 4, None):
        got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digests(df, n_batches).where("doc_id is not null").collect())
        expect = sorted((i, want[i, t][0], want[i, t][1], hashlib.sha256(want[i, t][2]).hexdigest()) for i, t in rows if i is not None)
        assert got == expect
    kept = sorted((r["doc_id"], r["text"] or "") for r in corpus_pipeline.cut_repeats(spark, df, "").where("doc_id is not null").collect())
    assert kept == sorted((i, want[i, t][2].decode() if t and want[i, t][1] else t or "") for i, t in rows if i is not None)


def test_tables_of_a_scope_go_with_it(spark):
    before = {t.name for t in spark.catalog.listTables()}
    with scratch.scope(spark, "work"):
        assert substring.clean(make(spark, corpus(2))).count() == len(corpus(2))
        assert {t.name for t in spark.catalog.listTables()} > before
    assert {t.name for t in spark.catalog.listTables()} == before


def removed_words(part, repeats):
    places = {}
    for r in repeats.collect():
        places.setdefault(r["doc_id"], []).append({"start": r["start"], "n": r["n"]})
    return {r["doc_id"]: substring.keep(r["text"] or "", places.get(r["doc_id"]))[1] for r in part.distinct().collect()}


def batches(docs, n):
    number, parts = substring.numbered(docs, n)
    docs = docs.where("doc_id is not null").withColumn("b", number)
    return [docs.where(f"b = {i}").select("doc_id", "text") for i in range(parts)]


def test_index_compacts_drops_and_goes_on(spark):
    docs = make(spark, corpus(4)).select("doc_id", "text")
    index = substring.FingerprintIndex(spark, buckets=3)
    parts, got = batches(docs, 8), {}
    for p in parts:
        got |= removed_words(p, index.add(p))
    want = brute_removal(corpus(4))
    assert got == {i: r[1] for i, r in want.items()}
    spans = [r for r in index.runs if r.kind == "spans"]
    assert all(sum(r.level == k for r in spans) <= substring.FANOUT for k in range(4)) and max(r.level for r in spans) > 0
    alive = {t.name for t in spark.catalog.listTables() if t.name.startswith("spans_")}
    assert {r.table for r in spans} <= alive and len(os.listdir(index.path.removeprefix("file://"))) == 1 + len(index.runs)
    index.forget()
    assert not {r.table for r in spans} & {t.name for t in spark.catalog.listTables()}


def test_another_session_opens_the_index(spark):
    docs = make(spark, corpus(6)).select("doc_id", "text")
    parts = batches(docs, 4)
    index = substring.FingerprintIndex(spark, buckets=3)
    got = {}
    for p in parts[:3]:
        got |= removed_words(p, index.add(p))
    for run in index.runs:
        spark.sql(f"drop table {run.table}")  # a new session's catalog knows nothing
    again = substring.FingerprintIndex(spark, path=index.path)
    assert (again.runs, again.buckets, again.version) == (index.runs, 3, index.version)
    got |= removed_words(parts[3], again.add(parts[3]))
    assert got == {i: r[1] for i, r in brute_removal(corpus(6)).items()}
    assert substring.FingerprintIndex(spark, path=scratch.folder(spark, "none")).runs == []


def test_history_is_merged_without_an_exchange(spark, monkeypatch):
    docs = make(spark, corpus(4)).select("doc_id", "text")
    index = substring.FingerprintIndex(spark, buckets=3)
    parts = batches(docs, 3)
    for p in parts[:2]:
        index.add(p)
    plans = []

    def seen(self, rows, kind, level=0, write=substring.FingerprintIndex._write):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(self, rows, kind, level)

    monkeypatch.setattr(substring.FingerprintIndex, "_write", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index.add(parts[2])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    merged = plans[2]  # after the texts and the batch's own spans
    assert merged.count("SortMergeJoin") >= 4 and "Exchange" not in merged
    assert plans[1].count("Exchange") == 1


def test_clean_leaves_other_texts_and_columns_alone(spark):
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(1, shared), (2, "A  b\n" + shared), (3, "keep   this\ttext"), (None, shared), (4, None)]
    got = {r["doc_id"]: r for r in substring.clean(make(spark, rows)).collect()}
    assert {i: r["text"] for i, r in got.items()} == {1: shared, 2: "A b", 3: "keep   this\ttext", None: shared, 4: None}
    assert got[2]["n_chars"] == 3 and got[2]["class"] == "x"


def brute_hits(docs, bench, n=10):
    items = {}
    for i, t in bench:
        w = words(t, ALNUM)
        items.setdefault(i, set()).update(tuple(w[s : s + min(n, len(w))]) for s in range(max(1, len(w) - n + 1)) if w)
    out = {}
    for d, t in docs:
        w = words(t, ALNUM)
        hit, found = set(), set()
        for i, windows in items.items():
            for size in {len(x) for x in windows}:
                for s in range(len(w) - size + 1):
                    if tuple(w[s : s + size]) in windows:
                        hit.update(range(s, s + size))
                        found.add(str(i))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_null_items_and_null_documents(spark):
    bench = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (4, None)], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.scan(make(spark, [(None, "x a b c"), (None, "x a b c"), (1, None)]), bench).collect()), key=str)
    digest = hashlib.sha256(b"3").hexdigest()
    assert got == sorted([(None, 4, 3, 2, digest, True)] * 2 + [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest(), False)], key=str)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 60, 5])
def test_decontamination_equals_brute_force(spark, block):
    rng = random.Random(7)
    vocabulary = ["a", "B", "c1", "dé", "e-f", "G.", "h"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    bench = [(i, text(k)) for i, k in enumerate([3, 9, 10, 11, 25, 40, 1])] + [(7, None), (8, ""), (10, "... !"), (2, text(12))]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(30)]
    docs += [(100 + i, f"{text(4)} {(t or '').upper()} {text(3)}") for i, t in bench] + [(200, None), (201, ""), (202, "...")]
    out = decontaminate.scan(make(spark, docs), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=block).collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in out}
    assert len(out) == len(docs) and got == brute_hits(docs, bench)
    kept = decontaminate.clean(make(spark, docs), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=block)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if not r[4])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB1 \n\t\x0b\x1cé漢-. "), max_size=30), max_size=8))
def test_words_follow_the_patterns(texts):
    for table, pattern in ((tx.SPACED, SPACE), (tx.ALNUM, ALNUM)):
        found = [w.strings(d) for i, j, w in tx.words(pa.array(texts, pa.string()), table, limit=16) for d in range(j - i)]
        assert found == [words(t, pattern) for t in texts]
        h = {}
        for _, _, w in tx.words(pa.array(texts, pa.string()), table, limit=16):
            for d in range(len(w.first) - 1):
                for s, x in zip(w.strings(d), w.hashes()[w.first[d] : w.first[d + 1]].tolist(), strict=True):
                    assert h.setdefault(s, x) == x
        assert len(set(h.values())) == len(h)


def test_scratch_tables_lie_in_the_checkpoint_folder(spark):
    df = scratch.keep(spark.range(3), "t")
    assert df.count() == 3 and spark.conf.get("spark.checkpoint.dir").split(":")[-1] in df.inputFiles()[0]
