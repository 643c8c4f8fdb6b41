"""Window, fill, join and selection operators against pandas and by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.functions.scalar import clip, flag, row_min, row_sum
from gridcast.operators import blend, grid, models, rolling, select
from gridcast.operators.asof import asof_backward, interpolate_time, latest_vintage
from gridcast.operators.rolling import Series

START = dt.datetime(2024, 1, 1)


def hourly(spark, values, region="a"):
    rows = [(START + dt.timedelta(hours=i), region, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ts timestamp, region string, price double")


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def same(got, want):
    a, b = (np.array([np.nan if v is None else v for v in x], float) for x in (got, want))
    np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)


GAP = [1, 2, 3, None, 5, 5, 5, None, 9, 10, 4, 4]


@pytest.mark.parametrize(("w", "least"), [(3, 3), (4, 2), (5, 1)])
def test_rolling_matches_pandas(spark, w, least):
    s, p = Series(), pd.Series(GAP, dtype=float)
    df = hourly(spark, GAP).select("ts", *(s.roll(a, "price", w, least).alias(a) for a in rolling.AGGREGATES), s.quantile("price", 0.9, w, least).alias("q"), s.pct_rank("price", w, least).alias("r"))
    r = p.rolling(w, min_periods=least)
    for name, want in {"mean": r.mean(), "sum": r.sum(), "min": r.min(), "max": r.max(), "std": r.std(), "q": r.quantile(0.9), "r": r.rank(pct=True)}.items():
        same(column(df, name), want)


def test_shifts_and_changes(spark):
    s, p = Series(), pd.Series(GAP, dtype=float)
    df = hourly(spark, GAP).withColumn("f", s.ffill("price")).select("ts", s.lag("price", 2).alias("lag"), s.lead("price", 1).alias("lead"), s.diff("price", 2).alias("diff"), s.diff2("price", 1).alias("diff2"), s.pct_change("f", 2).alias("pct"), s.bfill("price").alias("b"), "f")
    for name, want in {"lag": p.shift(2), "lead": p.shift(-1), "diff": p.diff(2), "diff2": p.diff(1).diff(1), "pct": p.ffill().pct_change(2).clip(-1, 1), "f": p.ffill(), "b": p.bfill()}.items():
        same(column(df, name), want)


def test_missing_comparisons_are_zero_and_nulls_survive_clips(spark):
    df = hourly(spark, [1, None, 500]).select("ts", flag(F.col("price") > 100).alias("f"), clip("price", 0, 10).alias("c"), row_sum("price", F.lit(1.0)).alias("s"), row_min("price", F.lit(2.0)).alias("m"))
    assert column(df, "f") == [0.0, 0.0, 1.0]
    assert column(df, "c") == [1.0, None, 10.0]
    assert column(df, "s") == [2.0, 1.0, 501.0]
    assert column(df, "m") == [1.0, 2.0, 2.0]


def test_rows_since_event(spark):
    s = Series()
    df = hourly(spark, [1, 9, 1, 1, None, 9, 1]).select("ts", s.rows_since(F.col("price") > 5, 3600, 3).alias("n"), s.seen_in(F.col("price") > 5, 2).alias("seen"))
    assert column(df, "n") == [3, 0, 1, 2, 3, 0, 1]
    assert column(df, "seen") == [0, 1, 1, 0, 0, 1, 1]


def test_wide_forms_equal_direct_frames(spark):
    values = [None if i % 7 == 3 else (i * 37) % 101 - 20 for i in range(300)]
    df, s = hourly(spark, values), Series()
    for w, least in ((24, 12), (50, 50), (13, 1)):
        direct = df.select("ts", *(s.roll(a, "price", w, least).alias(a) for a in ("mean", "sum", "max", "min")))
        same(column(rolling.wide_mean(df, "price", w, least, "x"), "x"), column(direct, "mean"))
        same(column(rolling.wide_mean(df, "price", w, least, "x", agg="sum"), "x"), column(direct, "sum"))
        same(column(rolling.wide_extreme(df, "price", w, least, "x", 3600), "x"), column(direct, "max"))
        same(column(rolling.wide_extreme(df, "price", w, least, "x", 3600, agg="min"), "x"), column(direct, "min"))


def test_blocks_with_halo_equal_one_partition(spark):
    df = hourly(spark, [(i * 37) % 101 for i in range(200)])
    cut, s = grid.blocks(df, 3600, 30, 23, 2), Series(("region", "block"))
    got = cut.select("ts", "own", s.roll("mean", "price", 24, 5).alias("x"), s.lead("price", 2).alias("y")).where("own")
    one = Series()
    want = df.select("ts", one.roll("mean", "price", 24, 5).alias("x"), one.lead("price", 2).alias("y"))
    same(column(got, "x"), column(want, "x"))
    same(column(got, "y"), column(want, "y"))


def test_causality(spark):
    values, s = [(i * 37) % 101 for i in range(120)], Series()
    build = lambda df: df.select("ts", s.roll("mean", "price", 24, 5).alias("m"), s.lag("price", 3).alias("l"), s.pct_rank("price", 24, 5).alias("r"))
    full, cut = build(hourly(spark, values)), build(hourly(spark, values[:80]))
    for c in ("m", "l", "r"):
        same(column(full, c)[:80], column(cut, c))


def test_asof(spark):
    left = hourly(spark, [0, 0, 0, 0]).select("ts", "region")
    right = spark.createDataFrame([(START + dt.timedelta(hours=1), "a", 7.0), (START + dt.timedelta(hours=1), "a", 8.0), (START + dt.timedelta(hours=2, minutes=1), "a", 9.0), (START, "b", 1.0)], "ts timestamp, region string, v double")
    assert column(asof_backward(left, right, ["region"], ["v"]), "v") == [None, 8.0, 8.0, 9.0]


def test_vintages_use_the_latest_run_and_whole_steps_ahead(spark):
    at = lambda h, m=0: START + dt.timedelta(hours=h, minutes=m)
    runs = spark.createDataFrame([(at(0), at(0, 30), "a", 1.0), (at(0), at(0), "a", 5.0), (at(1), at(1, 30), "a", 2.0), (at(1), at(1, 30), "a", 4.0), (at(3), at(4), "a", 9.0)], "run_ts timestamp, interval_ts timestamp, region string, value double")
    times = spark.createDataFrame([(at(0, 15), "a"), (at(1), "a")], "ts timestamp, region string")
    assert sorted((r["ts"], r["h"], r["value"]) for r in latest_vintage(times, runs, ["region"], "value", 1800).collect()) == [(at(0, 15), 1, 1.0), (at(1), 1, 3.0)]


def test_interpolation(spark):
    same(column(interpolate_time(hourly(spark, [None, 1, None, None, 4, None]), "price", ["region"]), "price"), [None, 1, 2, 3, 4, 4])


def test_fill_by_day(spark):
    df = hourly(spark, [None, 1, *[None] * 60, 5, None]).select("ts", "price")
    same(column(rolling.rolling_by_day(df, "price"), "price_filled"), [None, *[1] * 61, 5, 5])


def test_regular_grid_keeps_gaps(spark):
    df = spark.createDataFrame([(START + dt.timedelta(minutes=5), "a", 1.0), (START + dt.timedelta(minutes=50), "a", 3.0), (START + dt.timedelta(hours=3), "a", 4.0)], "ts timestamp, region string, price double")
    out = grid.regularise(df, 3600, df.select("region").distinct(), ["region"], ["price"])
    assert column(out, "price") == [2.0, None, None, 4.0]


def test_greedy_keep_depends_on_order():
    strong = {("a", "b"), ("b", "c"), ("d", "e")}
    assert select.greedy_keep(["a", "b", "c", "d", "e"], strong) == ["a", "c", "d"]
    assert select.greedy_keep(["b", "a", "c", "e", "d"], strong) == ["b", "e"]


def test_correlations_match_pandas(spark):
    a, b = [1, 2, 2, 4, None, 6, 9], [2, 1, 5, 5, 7, None, 8]
    df = spark.createDataFrame([(float(x) if x else None, float(y) if y else None, 1.0) for x, y in zip(a, b, strict=True)], "a double, b double, c double")
    p = pd.DataFrame({"a": a, "b": b}, dtype=float)
    for method in ("pearson", "spearman"):
        got = {(r["a"], r["b"]): r["r"] for r in select.correlations(df, ["a", "b", "c"], method).collect()}
        both = p.dropna()
        want = both["a"].corr(both["b"]) if method == "pearson" else both["a"].rank().corr(both["b"].rank())
        assert got["a", "b"] == pytest.approx(want)
        assert got["a", "c"] == 0.0


def test_folds_expand(spark):
    out = column(select.folds(hourly(spark, range(50)).select("ts"), 3), "fold")
    assert out == [0] * 14 + [1] * 12 + [2] * 12 + [3] * 12


def test_sample_is_the_same_for_any_partitioning(spark):
    df = hourly(spark, range(100))
    pick = lambda x: sorted(r["ts"] for r in select.sample(x, 10, 42).collect())
    assert pick(df.repartition(1)) == pick(df.repartition(7)) and len(pick(df)) == 10


def test_targets_and_weights(spark):
    t = blend.targets(hourly(spark, [1, 2, 3]), 2).orderBy("ts", "h")
    assert [r["y"] for r in t.collect()] == [1.0, 2.0, 2.0, 3.0, 3.0, None]
    w = blend.weights(F.lit(1.0), F.col("price"))
    out = hourly(spark, [200, -5, 10]).select("ts", *(c.alias(n) for n, c in w.items()))
    assert column(out, "w_spike3") == [3.0, 1.0, 1.0] and column(out, "w_dip7") == [1.0, 7.0, 1.0]


def test_policies_by_hand(spark):
    df = spark.createDataFrame([(100.0, 0.5, 200.0)], "b double, p double, s double")
    value = lambda mode: df.select(blend.spike_policy(F.col("b"), F.col("p"), F.col("s"), F.lit(mode), F.lit(0.0), F.lit(1.0), F.lit(0.8))).first()[0]
    assert [round(value(m), 3) for m in (0, 1, 2)] == [150.0, 140.0, 200.0]


def test_search_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1.0)], "h int, y double, one double, two double")
    g = spark.createDataFrame([(i, a) for i, a in enumerate(blend.ALPHAS)], "ordinal int, alpha double")
    assert blend.search(df, ["h"], g, blend.blend(F.col("one"), F.col("two"), F.col("alpha")), ["alpha"]).first()["alpha"] == 0.0


def test_metrics_on_an_empty_and_a_perfect_forecast(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (3.0, 3.0, 1.0), (None, 1.0, 1.0)], "y double, yhat double, naive double")
    r = blend.metrics(df).first()
    assert (r["n"], r["mae"], r["r2"], r["skill"], r["mae_spike"]) == (2, 0.0, 1.0, 100.0, None)
    assert blend.metrics(df.where("false"), ["y"]).count() == 0


def test_residual_quantile_shifts_by_bucket(spark):
    df = spark.createDataFrame([(float(i), float(i) + (i % 10)) for i in range(100)], "m double, y double")
    out = models.residual_quantile(df, df, "m", "y", 0.9, "q", 2)
    assert out.where("q >= y").count() >= 90


def test_isotonic_is_left_out_for_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert models.calibrate(df, df, "x", "y", "c").first()["c"] == 1.0
