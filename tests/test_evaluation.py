"""Exact quantiles, long windows, policy searches, calibration, tagged rows, dense offers, vintages and sinks against plain versions."""

import datetime as dt
import random
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.operators import models, policy, quality, quantiles, rolling, select, windows
from gridcast.operators.asof import carried_vintage, vintage_columns
from gridcast.plans import evaluation, registry  # noqa: F401 (evaluation adds its queries to the registry)
from gridcast.sources import ingest, sinks

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_are_exact_in_groups_of_any_size(spark, accuracy):
    rng = random.Random(1)
    rows = [(g, rng.choice([None, float(rng.randrange(9)), rng.gauss(0, 5)])) for g, n in ((1, 1), (2, 7), (3, 900), (4, 33)) for _ in range(n)] + [(5, None), (6, 2.0)] + [(7, 1.0)] * 500
    df = spark.createDataFrame(rows, "g int, x double")
    for q in (0.0, 0.25, 0.5, 0.97, 1.0):
        got = {r["g"]: r["q"] for r in quantiles.quantile(df, "x", q, "q", ["g"], accuracy).collect()}
        for g in got:
            values = [x for k, x in rows if k == g and x is not None]
            assert got[g] == (pytest.approx(np.quantile(values, q)) if values else None)
        assert set(got) == {g for g, _ in rows}
    assert quantiles.quantile(df, "x", 0.5, "q").first()["q"] == pytest.approx(np.quantile([x for _, x in rows if x is not None], 0.5))
    assert quantiles.quantile(df.where("false"), "x", 0.5, "q").first()["q"] is None


def test_sorted_windows_equal_pandas():
    rng = random.Random(2)
    x = pd.Series([rng.choice([float("nan"), float(rng.randrange(5)), rng.random()]) for _ in range(300)])
    for w, least in ((1, 1), (7, 3), (50, 50), (400, 1)):
        want = x.rolling(w, min_periods=least).quantile(0.3)
        got = pd.Series(list(windows.walk(x.tolist(), w, least, 0.3)), dtype=float)
        pd.testing.assert_series_equal(got, want, check_names=False)
        rank = x.rolling(w, min_periods=least).rank(pct=True)
        got = pd.Series(list(windows.walk(x.tolist(), w, least, None)), dtype=float)
        pd.testing.assert_series_equal(got, rank, check_names=False)


def test_windows_and_fills_cross_blocks(spark):
    rng = random.Random(3)
    x = [rng.choice([None, None, float(rng.randrange(50))]) for _ in range(97)]
    df = spark.createDataFrame([("a", T0 + dt.timedelta(hours=i), v) for i, v in enumerate(x)], "region string, ts timestamp, x double")
    out = windows.rolled(df, [windows.Rolled("q", "x", 20, 2, 0.5)], 3600, rows=10).orderBy("ts").toPandas()
    pd.testing.assert_series_equal(out["q"], pd.Series(x, dtype=float).rolling(20, min_periods=2).quantile(0.5), check_names=False)
    for backward in (False, True):
        got = rolling.filled(df, "x", "y", 3600, ["region"], rows=5, backward=backward).orderBy("ts").toPandas()["y"]
        series = pd.Series(x, dtype=float)
        pd.testing.assert_series_equal(got, series.bfill() if backward else series.ffill(), check_names=False)
    wide = rolling.wide_mean(df, "x", 30, 4, "s", agg="std").orderBy("ts").toPandas()["s"]
    pd.testing.assert_series_equal(wide, pd.Series(x, dtype=float).rolling(30, min_periods=4).std(), check_names=False)


def test_policy_searches_equal_plain_loops(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([-20.0, 50.0, 90.0, 200.0]) + rng.random(), rng.uniform(0, 150), rng.random(), rng.uniform(50, 300), rng.uniform(0, 200), rng.uniform(-60, 60)) for _ in range(300)] + [("c", 10.0, 12.0, 0.5, 90.0, 80.0, 1.0)]
    df = spark.createDataFrame([*rows, ("a", None, 1.0, 0.1, 1.0, 1.0, 1.0)], "g string, y double, base double, p double, p90 double, l1 double, dip double")
    spikes, dips = policy.spike_settings((0.1, 0.5), (0.5, 2.0), (0.4, 1.0)), policy.dip_settings((0.1, 0.5), (0.5, 2.0), (0.4, 1.0), (0.3,))

    def errors(own, made):
        part = lambda keep: (lambda e: sum(e) / len(e) if e else 0.0)([abs(r[1] - made(r)) for r in own if keep(r[1])])
        every, mid = part(lambda y: True), [r for r in own if 0 <= r[1] <= 150]
        score = 2.2 * part(lambda y: y > 150) + 1.3 * part(lambda y: y < 0) + part(lambda y: y <= 150) + 0.25 * every
        return round(score, 9), part(lambda y: y <= 150), sum(abs(r[1] - made(r)) for r in mid) / len(mid) if mid else every

    def one(make, s):
        return lambda r: float(make({"base": np.array(r[2]), "p": np.array(r[3]), "p90": np.array(r[4]), "l1": np.array(r[5]), "dip": np.array(r[6])}, s))

    got = {r["g"]: r for r in policy.spike_search(df, ["g"], spikes, slack=8.0).collect()}
    low = {r["g"]: r for r in policy.dip_search(df, ["g"], dips, slack=0.15).collect()}
    for g in "abc":
        own = [r for r in rows if r[0] == g]
        limit = errors(own, one(policy.spike_made, spikes[0]))[1] + 8.0
        best = min((errors(own, one(policy.spike_made, s))[0], s[0]) for s in spikes if errors(own, one(policy.spike_made, s))[1] <= limit)
        assert (got[g]["source"], got[g]["mode"], got[g]["threshold"], got[g]["power"], got[g]["weight"]) == spikes[best[1]][1:] and got[g]["score"] == pytest.approx(best[0])
        base = errors(own, lambda r: r[2])
        tried = [(errors(own, one(policy.dip_made, s)), s[0]) for s in dips]
        good = [(e[0], i) for e, i in tried if e[2] <= base[2] + 0.15 and e[0] < base[0]]
        score, i = min(good, default=(base[0], 0))
        assert (low[g]["mode"], low[g]["threshold"], low[g]["power"], low[g]["weight"]) == dips[i][2:] and low[g]["score"] == pytest.approx(score)


def test_calibration_by_horizon_and_interpolation(spark):
    rng = random.Random(5)
    rows = [(h, rng.random() * 100, rng.random() * 50) for h, n in ((1, 600), (2, 40)) for _ in range(n)]
    knots = models.calibrators(spark.createDataFrame(rows, "h int, p double, y double"), [1, 2, 3], "p", "y")
    assert [r["h"] for r in knots.collect()] == [1]
    found = [(k["x"], k["y"]) for k in knots.first()["knots"]]
    assert found == sorted(found) and all(a[1] <= b[1] for a, b in zip(found, found[1:], strict=False))
    x = [-5.0, 0.0, 33.3, 99.9, 500.0, None]
    df = spark.createDataFrame([(v,) for v in x], "x double").crossJoin(knots)
    got = [r[0] for r in df.select(policy.interpolated(F.col("x"), F.col("knots"))).collect()]
    assert got[:-1] == pytest.approx(np.interp(x[:-1], *zip(*found, strict=True)).tolist()) and got[-1] is None


def test_tagged_rows_rules(spark):
    lines = ["I,RUNS,T,1,VALUE,INTERVENTION,REGION", 'D,RUNS,T,1,5,0,"a,b"', "D,RUNS,T,1,6,1,c", "D,RUNS,T,1,7", "D,RUNS,T", "i,Runs,T,2,region,value", "D,RUNS,T,2,d,8", "D,OTHER,T,2,e,9", ""]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)] + [("g", 0, lines[1])], "file string, n int, line string")
    got = ingest.tagged_rows(df, "runs", ["Value", "Region"]).orderBy("n").collect()
    assert [(r["n"], r["value"], r["region"]) for r in got] == [(1, "5", "a,b"), (6, "8", "d")]
    at = spark.createDataFrame([("2024-01-01 03:59:59",)], "t string").select(ingest.run_time(F.col("t"))).first()[0]
    assert at == dt.datetime(2024, 1, 1, 3, 30)


def test_offers_are_dense_with_zeros(spark):
    found = spark.createDataFrame([(T0, 1, 5.0, [1, 2]), (T0 + dt.timedelta(hours=2), 2, 7.0, [3, 4])], "ts timestamp, duid int, max_avail double, bands array<int>")
    got = {(r["ts"].hour, r["duid"]): (r["max_avail"], r["packed"]) for r in ingest.dense_offers(found, 3600, 2).collect()}
    assert len(got) == 6 and got[0, 1] == (5.0, "1,2") and got[1, 1] == got[2, 1] == (0.0, "0,0") and got[2, 2] == (7.0, "3,4")


def test_dense_offers_join_and_shuffle_no_grid(spark):
    at = lambda h: None if h is None else T0 + dt.timedelta(hours=h)
    rows = [(at(1), 1, 5.0, [1]), (at(3), 1, None, [2]), (None, 2, 9.0, [9]), (at(0), 2, 7.0, None), (None, 3, 1.0, [1]), (at(2), None, 8.0, [8]), (at(4), 4, 6.0, [6])]
    out = ingest.dense_offers(spark.createDataFrame(rows, "ts timestamp, duid int, max_avail double, bands array<int>"), 3600, 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.index("Generate") < plan.index("Exchange") and "SortMergeJoin" not in plan
    want = {(h, u): (0.0, "0") for h in range(5) for u in (1, 2, 3, 4, None)} | {(1, 1): (5.0, "1"), (3, 1): (0.0, "2"), (0, 2): (7.0, "0"), (4, 4): (6.0, "6")}
    got = [((r["ts"].hour, r["duid"]), (r["max_avail"], r["packed"])) for r in out.collect()]
    assert dict(got) == want and len(got) == len(want)


def test_tagged_lines_follow_the_header_above_them(spark, tmp_path):
    """From five million events on, lines of even events lie behind the second header."""
    ids = [4_999_989, 4_999_990, 4_999_992, 5_000_000, 5_000_002, 5_000_004, 5_000_006, 5_000_014, 6_000_001, 6_000_012]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame([(i, T0, "click", 2.5) for i in ids], "event_id long, ts timestamp, event_type string, value double").write.parquet(path)
    got = registry.QUERIES["tagged_runs"](spark, str(tmp_path)).collect()
    kept = [i for i in ids if i % 13 and (i % 2 or (i % 5 and i % 11))]
    want = [(i % 7, (i + 10) * 2 + (10_000_000 if i % 2 else 0), 2.5, 'click, "x"', "2024-01-01 00:00:00") for i in kept]
    assert sorted(tuple(r) for r in got) == sorted(want) and any(i % 2 == 0 for i in kept)


def test_missing_horizons_keep_the_last_forecast(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    runs = spark.createDataFrame([(at(0), at(1), "A-1", 1.0), (at(0), at(2), "A-1", 2.0), (at(2), at(3), "A-1", 9.0)], "run_ts timestamp, interval_ts timestamp, region string, v double")
    grid = spark.createDataFrame([(at(h), "A-1") for h in range(4)], "ts timestamp, region string")
    got = carried_vintage(grid, runs, ["region"], ["v"], 3600, 2, F.lit(at(1)))
    assert {(r["ts"].hour, r["h"]): r["v"] for r in got.collect()} == {(1, 1): 2.0, (1, 2): 2.0, (2, 1): 9.0, (2, 2): 2.0, (3, 1): 9.0, (3, 2): 2.0}
    assert vintage_columns(got, "region", ["A-1"], ["v"], 2).columns == ["ts", "v_a_1_h1", "v_a_1_h2"]


def test_sinks_replace_and_narrow(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, 300.0, [1, 2])], "k int, x double, small double, a array<int>")
    out = sinks.narrowed(df, small={"small": "byte"})
    assert [f.dataType.typeName() for f in out.schema] == ["integer", "float", "byte", "array"] and out.first()["small"] is None
    for form in ("parquet", "csv"):
        path = str(tmp_path / form)
        sinks.write(df.unionAll(df), path, form)
        sinks.write(df, path, form)
        assert spark.read.format(form).option("header", True).load(path).count() == 1
    with pytest.raises(ValueError):
        sinks.write(df, str(tmp_path / "x"), "xml")


def test_correlations_equal_pandas(spark):
    rng = random.Random(6)
    x = pd.DataFrame({c: [rng.choice([None, rng.gauss(1e6, 3)]) for _ in range(80)] for c in "abc"}, dtype=float)
    x["b"] = x["a"] * 2 + x["b"] * 0.1
    x["d"] = 7.0
    df = spark.createDataFrame([[None if pd.isna(v) else v for v in r] for r in x.to_numpy().tolist()], "a double, b double, c double, d double")
    for method in ("pearson", "spearman"):
        want = x.corr(method).fillna(0)
        got = {(r["a"], r["b"]): r["r"] for r in select.correlations(df.repartition(3), list("abcd"), method).collect()}
        assert len(got) == 6 and all(v == pytest.approx(want.loc[k], abs=1e-7) for k, v in got.items())


def test_feature_sets_of_a_horizon(spark):
    scores = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.9), ("c", 1, 0.1), ("a", 2, 0.2)], "feature string, h int, mi double")
    chosen = select.selected(scores, spark.createDataFrame([(1, 2)], "h int, n int"))
    df = spark.createDataFrame([(1, 2, 3.0, 4.0)], "ts int, region int, a double, b double")
    assert models.subset(df, chosen, 1)[1] == ["b", "a"] and models.subset(df, chosen, 2)[1] == []
    assert {tuple(r) for r in select.feature_matrix(chosen, [1, 2]).collect()} == {("a", True, False), ("b", True, False), ("c", False, False)}


def test_entry_without_the_corpus_operators():
    code = "import sys; sys.modules['gridcast.llm.queries'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_long_windows_equal_pandas():
    rng = random.Random(7)
    for n in (1, 5, 333):
        x = pd.Series([rng.choice([float("nan"), float(rng.randrange(4)), rng.random() * 1e4]) for _ in range(n)])
        line = windows.Line(x.to_numpy())
        for w, least in ((1, 1), (7, 3), (64, 20), (500, 1)):
            roll = x.rolling(w, min_periods=least)
            for agg, want in (("mean", roll.mean()), ("sum", roll.sum()), ("std", roll.std()), ("min", roll.min()), ("max", roll.max())):
                got = pd.Series(line.made(windows.Rolled("", "", w, least, None, agg)))
                pd.testing.assert_series_equal(got, want, check_names=False, rtol=1e-9, atol=1e-6)


def test_order_statistics_of_equal_and_no_values():
    for x in ([], [float("nan")] * 4, [3.0] * 9, [3.0] * 9 + [float("nan")] + [2.0] * 8):
        s = pd.Series(x, dtype=float)
        for q, want in ((None, s.rolling(5, min_periods=2).rank(pct=True)), (0.4, s.rolling(5, min_periods=2).quantile(0.4))):
            got = pd.Series(list(windows.walk(x, 5, 2, q)), dtype=float)
            pd.testing.assert_series_equal(got, want, check_names=False)


def test_gaps_are_runs_across_blocks(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    there = {"a": [0, 1, 5, 6, 30], "b": [3], "c": [0, 0, 2]}
    df = spark.createDataFrame([(k, at(h)) for k, own in there.items() for h in own], "k string, ts timestamp")
    for rows in (1, 4, 100):
        found = {(r["k"], r["begin"], r["steps"]) for r in quality.gaps(df, 3600, ["k"], rows=rows).collect()}
        assert found == {("a", at(2), 3), ("a", at(7), 23), ("c", at(1), 1)}
    missing = quality.missing_times(df, 3600, keys=["k"])
    assert sorted((r["k"], r["ts"]) for r in missing.collect()) == sorted([("a", at(h)) for h in (2, 3, 4, *range(7, 30))] + [("c", at(1))])
    plan = quality.missing_times(df, 3600, keys=["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 3 and "Join" not in plan  # the first one stands twice, and is used again


def test_rank_correlations_of_many_slices_equal_pandas(spark):
    """Slices of few rows, ties across them, patterns of nulls, constant and empty columns; no row is made for a pair."""
    rng = random.Random(8)
    x = pd.DataFrame({c: [rng.choice([None, float(rng.randrange(6)), rng.gauss(0, 3)]) for _ in range(300)] for c in "abcd"}, dtype=float)
    x["b"] = x["a"].fillna(0) ** 3 + x["b"] * 0.2
    x["flat"], x["none"] = 7.0, float("nan")
    names = list(x.columns)
    df = spark.createDataFrame([[None if pd.isna(v) else v for v in r] for r in x.to_numpy().tolist()], ", ".join(f"{n} double" for n in names)).repartition(3)
    for rows in (37, 10_000):
        found = select._spearman(df, names, rows)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Window" not in plan
        got = {(r["a"], r["b"]): r["r"] or 0.0 for r in found.collect()}
        want = x.corr("spearman").fillna(0)
        assert all(got[k] == pytest.approx(want.loc[k], abs=1e-9) for k in got) and len(got) == 15
    assert all(r["r"] == 0.0 for r in select.correlations(df.where("false"), names, "spearman").collect())
