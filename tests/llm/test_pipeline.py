"""The pipeline against a brute-force version of its stages."""

import os

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridcast.llm import bpe
from tests.llm.test_models import brute_languages
from tests.llm.test_texts import brute_components, brute_hits, words

DATA = "/root/testdata/sf0.001"


def cut(rows, n=20):
    seen, out = set(), []
    for i, t in sorted(rows):
        w = words(t, low=False)
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            if key in seen:
                gone[s : s + n] = [True] * n
            seen.add(key)
        out.append((i, b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode() if any(gone) else t))
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pipeline_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    told = {i: lang for i, lang, _ in brute_languages(docs)}
    rows = [(i, t) for i, t, _ in docs if told[i] != "und"]
    groups = brute_components(rows, 5, 80)
    rows = cut([(i, t) for i, t in rows if groups[i][1] == i])
    hit = brute_hits(rows, bench)
    rows = [(i, t) for i, t in rows if not hit[i][4]]
    ids = Tokenizer.from_file(bpe._path(None))
    want = {i: ids.encode(t, add_special_tokens=False).ids for i, t in rows}
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and len(got) < len(docs)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "en", "s", 11), (2, "...", None, "s", 3), (3, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, DATA)
        assert out.columns == docs.columns
    assert [r["doc_id"] for r in out.collect()] == [1]
    assert len(corpus_pipeline.STAGES) in (4, 5)


ODD = "doc_id long, text string, lang string, source string, n_chars int, ids int, n_tokens string, kept string, mark int, __row int, __gone int, __places string, label string, component double"


def odd_tables(spark, tmp_path, rows, bench):
    docs = [(i, t, lang, "s", len(t or ""), 1, "n", "k", 2, 3, 4, "p", "l", 0.5) for i, t, lang in rows]
    spark.createDataFrame(docs, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))


def test_pipeline_of_odd_rows_and_columns(spark, tmp_path):
    """Nulls, repeated rows, one doc_id with two texts, an empty text, a long one, rows without a doc_id, and columns with the stages' own names."""
    en, de = "the cat and the dog sat on the mat and then the bird came to see them ", "der hund und die katze sind im haus und das kind ist auch noch da "
    passage, rest = (" ".join(f"{x}{i}" for i in range(40)) for x in "pz")
    rows = [(1, en * 3, "en"), (1, en * 3, "en"), (2, de * 3, "de"), (2, "another text under the same id, quite unlike the first of them", None), (3, None, None), (4, "", "en"), (5, "12 34", "de")]
    rows += [(None, en + " without an id", None), (None, en + " without an id", "en"), (6, en * 20_000, "en"), (7, "before " + passage, "en"), (8, f"after that {passage} {rest}", None), (9, "it says q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 here", "en"), (10, en * 3, "en")]
    odd_tables(spark, tmp_path, rows, [(1, " ".join(f"q{i}" for i in range(1, 11))), (None, None), (3, "")])
    out, docs = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = out
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in out.collect())
    # 6 is as 1 in shingles, 10 equals 1; 5, 4 and 3 have no letter; 9 holds the benchmark item; 8 loses the passage of 7
    want = [(0, en + " without an id")] * 2 + [(1, en * 3), (2, de * 3), (2, rows[3][1]), (7, "before " + passage), (8, "after that " + rest)]
    short = {i: t for i, t in got if i == 1}
    assert [i for i, _ in got] == [i for i, _ in want] and got[-1] == want[-1] and short[1].startswith("the cat")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(want)


def test_pipeline_of_no_documents(spark, tmp_path):
    odd_tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
