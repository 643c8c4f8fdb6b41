"""Sketches, many models at once, line searches, pooled calibration and the chain over fitted models against plain versions."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridcast.operators import blend, boosting, models, policy, sketches

NAMES = ["a", "b", "c"]


def test_sketches_are_exact_while_small_and_near_beyond(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(size=900), np.full(300, 0.5)))
    rows = [(float(v), None if i % 7 == 0 else float(i), None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    shares = [0.01, 0.25, 0.5, 0.97, 1.0]
    disc = lambda v: [float(np.sort(v)[max(0, int(np.ceil(q * len(v) - 1e-9)) - 1)]) for q in shares]
    got = sketches.quantiles(df, NAMES, shares)
    assert got["a"] == disc(x) and got["b"] == disc(np.array([r[1] for r in rows if r[1] is not None])) and got["c"] == []
    near = sketches.quantiles(df, ["a"], shares, room=64)["a"]
    rank = [np.searchsorted(np.sort(x), v, "right") / len(x) for v in near]
    assert all(abs(r - q) < 0.06 or v == 0.5 for r, q, v in zip(rank, shares, near, strict=True))
    assert sketches.quantiles(df.where("false"), ["a"], shares) == {"a": []}


def test_compressed_values_keep_weighted_quantiles():
    rng = np.random.default_rng(2)
    v, w = rng.normal(size=5000), rng.uniform(0.1, 3, 5000)
    small = sketches.compressed(v, w, 128)
    assert len(small[0]) <= 128 and small[1].sum() == pytest.approx(w.sum())
    for q in (0.1, 0.5, 0.9):
        exact, near = sketches.weighted_quantile(v, w, q), sketches.weighted_quantile(*small, q)
        assert abs((w[v <= near]).sum() / w.sum() - q) < 0.02 and abs(exact - near) < 0.05
    assert sketches.weighted_quantile(np.array([3.0]), np.array([0.0]), 0.5) == 0.0


def toy(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[rng.random((n, 3)) < 0.05] = np.nan
    y = np.where(np.nan_to_num(x[:, 0]) > 0.3, 2.0, -1.0) + np.nan_to_num(x[:, 1]) + rng.normal(size=n) * 0.5
    fold = np.where(np.arange(n) < n * 2 // 3, 0, np.where(np.arange(n) < n * 5 // 6, 1, 2))
    rows = [(i, int(fold[i]), *(None if np.isnan(v) else float(v) for v in x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "i int, fold int, a double, b double, c double, y double"), x, y, fold


def fitted(spark, df, found, horizons=(1,), **options):
    ex = df.select(F.explode(F.array(*map(F.lit, horizons))).alias("h"), "fold", F.array(*NAMES).alias("x"), F.array("y", (F.col("y") > 1).cast("double")).alias("labels"), F.array(F.lit(1.0), 1 + (F.col("i") % 3).cast("double")).alias("weights"))
    cuts = sketches.quantiles(df.where("fold = 0"), NAMES, [k / 32 for k in range(1, 32)])
    return boosting.fit(ex, found, {h: NAMES for h in horizons}, cuts, **options), cuts


def test_all_losses_at_once_near_a_known_library(spark):
    df, x, y, fold = toy(spark)
    kinds = (("l1", "absolute", 0, 0.5), ("l2", "squared", 0, 0.5), ("p90", "quantile", 0, 0.9), ("p10", "quantile", 0, 0.1), ("chance", "binary", 1, 0.5))
    found = [boosting.Model(h, n, kind, label, None, q) for h in (1, 4) for n, kind, label, q in kinds]
    made, _ = fitted(spark, df, found, (1, 4), rounds=12, depth=3, rate=0.3, patience=4, block=700)
    one = [m for m in found if m.h == 1]
    alone, _ = fitted(spark, df, one[:1], (1,), rounds=12, depth=3, rate=0.3, patience=4, block=700)
    assert made.jobs <= 2 + 12 * (3 + 1) + 12 // boosting.RENEW and abs(made.jobs - alone.jobs) <= 12  # the number of models doesn't count
    forest = boosting.Forest(made.nodes, NAMES, [k[0] for k in kinds], ["chance"])
    out = boosting.predict(df, forest, ["i", "fold", "y"]).toPandas().sort_values(["h", "i"])
    a, b = (out[out.h == h].reset_index(drop=True) for h in (1, 4))
    assert np.allclose(a["l2"], b["l2"]) and np.allclose(a["p90"], b["p90"])
    test = a[a.fold == 2]
    filled = df.fillna(-99.0, NAMES).withColumn("is_valid", F.col("fold") == 1)
    spec = models.Spec("l2", "squared", "y")
    model = models.fit(filled.where("fold < 2"), spec, NAMES, rounds=12, depth=3, rate=0.3, validation="is_valid")
    known = models.predict(filled.where("fold = 2"), spec, model, NAMES).agg(F.sqrt(F.avg((F.col("l2") - F.col("y")) ** 2))).first()[0]
    assert np.sqrt(((test.y - test.l2) ** 2).mean()) < 1.08 * known
    assert np.abs(test.y - test.l1).mean() < 0.52 and ((test.chance > 0.5) == (test.y > 1)).mean() > 0.88
    assert 0.84 < (test.y <= test.p90).mean() < 0.97 and 0.03 < (test.y <= test.p10).mean() < 0.16


def test_pinball_loss_beats_residual_quantiles_where_the_spread_varies(spark):
    """The spread of y depends on c, which a mean with one residual quantile can't follow."""
    df, x, y, fold = toy(spark)
    df = df.withColumn("y", F.col("y") + F.when(F.col("c") > 0, 6.0).otherwise(0.3) * (F.rand(5) - 0.5))
    kinds = (("l1", "absolute", 0.5), ("p90", "quantile", 0.9), ("p10", "quantile", 0.1))
    made, _ = fitted(spark, df, [boosting.Model(1, n, kind, 0, None, q) for n, kind, q in kinds], rounds=20, depth=3, rate=0.2, patience=6)
    out = boosting.predict(df, boosting.Forest(made.nodes, NAMES, ["l1", "p90", "p10"]), ["i", "fold", "y"]).toPandas()
    train, test = out[out.fold == 0], out[out.fold == 2]
    pinball = lambda e, q: np.where(e > 0, q * e, (q - 1) * e).mean()
    for q, name in ((0.9, "p90"), (0.1, "p10")):
        assert pinball(test.y - test[name], q) < 0.95 * pinball(test.y - test.l1 - np.quantile(train.y - train.l1, q), q)
        assert abs((test.y <= test[name]).mean() - q) < 0.07


def test_a_tree_equals_a_plain_search(spark):
    """One squared-loss tree of depth 2 on few bins against a search of all splits by hand."""
    df, x, y, fold = toy(spark, 600, 3)
    made, cuts = fitted(spark, df, [boosting.Model(1, "l2", "squared", 0, 1)], rounds=1, depth=2, rate=1.0, least=15, block=100)
    use, w = fold == 0, 1 + np.arange(600) % 3.0
    bins = np.stack([np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(np.unique(cuts[c]), x[:, k])) for k, c in enumerate(NAMES)], 1)
    base = (w * y)[use].sum() / w[use].sum()

    def grow(rows, depth):
        e, u = (y - base)[rows], w[rows]
        mean = (e * u).sum() / u.sum()
        best = (1e-9, None)
        for f in range(3) if depth else ():
            for cut in range(33):
                left = bins[rows, f] <= cut
                if min(left.sum(), (~left).sum()) >= 15:
                    gain = sum((e * u)[s].sum() ** 2 / u[s].sum() for s in (left, ~left)) - (e * u).sum() ** 2 / u.sum()
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut))
        if best[1] is None:
            return lambda i: mean
        f, cut = best[1]
        left, right = grow(rows[bins[rows, f] <= cut], depth - 1), grow(rows[bins[rows, f] > cut], depth - 1)
        return lambda i: left(i) if bins[i, f] <= cut else right(i)

    tree = grow(np.flatnonzero(use), 2)
    got = {r["i"]: r["l2"] for r in boosting.predict(df, boosting.Forest(made.nodes, NAMES, ["l2"]), ["i"]).collect()}
    assert all(got[i] == pytest.approx(base + tree(i), abs=1e-9) for i in range(600))


def test_counts_of_features_and_importance_find_the_right_ones(spark):
    """y depends on the first two features: folds stop at two, and their gains are nearly all."""
    df, _, _, _ = toy(spark)
    tried = [boosting.Model(1, f"{n}", "absolute", 0, None, 0.5, 1.0, n, 1) for n in (1, 2, 3)]
    made, _ = fitted(spark, df, tried, rounds=12, depth=2, rate=0.4, patience=12)
    assert made.loss[1, "2"] < 0.8 * made.loss[1, "1"] and made.loss[1, "3"] > 0.97 * made.loss[1, "2"]
    gains = {(r["model"], r["feature"]): r["gain"] for r in boosting.importance(spark.createDataFrame(made.nodes)).collect()}
    assert gains["3", "a"] + gains["3", "b"] > 0.9 and ("1", "b") not in gains and gains["1", "a"] == pytest.approx(1.0)


def test_labels_that_are_missing_and_models_without_rows(spark):
    df = spark.createDataFrame([(0, 0, 1.0, None, None, None), (1, 0, None, 2.0, None, 3.0), (2, 1, 1.0, 1.0, 1.0, 5.0)], "i int, fold int, a double, b double, c double, y double")
    made, _ = fitted(spark, df, [boosting.Model(1, "l2", "squared"), boosting.Model(1, "none", "absolute", 0, None, 0.5, 1.0, 0, 0)], rounds=2, patience=1)
    out = boosting.predict(df, boosting.Forest(made.nodes, NAMES, ["l2", "none"]), ["i"]).collect()
    assert [r["l2"] for r in out] == pytest.approx([3.0] * 3) and all(r["none"] in (None, 0.0) for r in out)


def test_flattened_ensembles_predict_as_their_library(spark):
    df, _, _, _ = toy(spark, 900)
    whole = df.fillna(-99.0, NAMES).withColumn("label", (F.col("y") > 1).cast("double"))
    for spec, scale in ((models.Spec("m", "squared", "y"), 1.0), (models.Spec("m", "binary", "label"), 2.0)):
        model = models.fit(whole, spec, NAMES, rounds=5, depth=3)
        path = models.folder(spark)
        model.write().save(path)
        nodes = boosting.flattened(spark, model, 3, "m", path, NAMES, scale)
        got = boosting.predict(whole, boosting.Forest(nodes, NAMES, ["m"], ["m"] if scale == 2 else []), ["i"]).withColumnRenamed("m", "mine")
        off = got.join(models.predict(whole, spec, model, NAMES), "i").agg(F.max(F.abs(F.col("mine") - F.col("m"))), F.count("*")).first()
        assert off[0] < 1e-12 and off[1] == 900


def test_line_search_equals_a_plain_loop(spark):
    rng = random.Random(3)
    some = lambda: None if rng.random() < 0.1 else rng.uniform(-9, 9)
    rows = [(rng.choice("ab"), some(), some(), some()) for _ in range(200)] + [("c", 1.0, None, 2.0), ("d", None, 1.0, 1.0), ("e", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, y double, one double, two double").repartition(3)
    got = {r["g"]: (r["s"], r["mae"]) for r in blend.line_search(df, ["g"], "one", "two", blend.NAIVE_WEIGHTS, "s").collect()}
    for g in "ab":
        own = [r for r in rows if r[0] == g and None not in r]
        tried = [(round(sum(abs(y - ((1 - s) * a + s * b)) for _, y, a, b in own) / len(own), 9), i) for i, s in enumerate(blend.NAIVE_WEIGHTS)]
        assert got[g] == (blend.NAIVE_WEIGHTS[min(tried)[1]], pytest.approx(min(tried)[0], abs=1e-8))
    assert got["e"] == (1.0, 0.0) and "d" not in got and got["c"][1] is None
    assert "BroadcastNestedLoopJoin" not in blend.line_search(df, ["g"], "one", "two", blend.ALPHAS, "s")._jdf.queryExecution().executedPlan().toString()


def test_pooled_calibration_equals_a_plain_one(spark):
    rng = random.Random(6)
    rows = [(h, float(rng.randrange(40 * h)), rng.random() * 50 + h) for h, n in ((1, 700), (2, 900), (3, 30)) for _ in range(n)] + [(1, None, 1.0), (2, 3.0, None)]
    got = {r["h"]: [(k["x"], k["y"]) for k in r["knots"]] for r in models.calibrators(spark.createDataFrame(rows, "h int, p double, y double").repartition(7), [1, 2, 3], "p", "y").collect()}
    assert set(got) == {1, 2}
    for h, knots in got.items():
        by_x = {}
        for k, x, y in rows:
            if k == h and x is not None and y is not None:
                by_x.setdefault(x, []).append(y)
        xs = sorted(by_x)
        n, s = [len(by_x[x]) for x in xs], [sum(by_x[x]) for x in xs]
        # largest over the starts of the least mean over the ends
        fit = [max(min(sum(s[a : b + 1]) / sum(n[a : b + 1]) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]
        assert np.interp(xs, *zip(*knots, strict=True)) == pytest.approx(fit)


def test_policies_of_rows_and_of_columns_agree(spark):
    rng = np.random.default_rng(5)
    n = 40
    c = {"base": rng.uniform(-50, 200, n), "p": np.concatenate((rng.random(n - 4), [0.0, 1.0, 0.1, 0.3])), "p90": rng.uniform(0, 300, n), "l1": rng.uniform(0, 300, n), "dip": rng.uniform(-90, 60, n)}
    df = spark.createDataFrame([(i, *(float(v[i]) for v in c.values())) for i in range(n)], "i int, base double, p double, p90 double, l1 double, dip double")
    for made, settings, column in ((policy.spike_made, policy.spike_settings(), "spike"), (policy.dip_made, policy.dip_settings(), "dip")):
        table = spark.createDataFrame(settings, "ordinal int, source string, mode int, threshold double, power double, weight double")
        x = df.crossJoin(F.broadcast(table))
        source = F.when(F.col("source") == "p90", F.col("p90")).when(F.col("source") == "l1", F.col("l1")).otherwise(F.greatest("p90", "l1"))
        args = (F.col("base"), F.col("p"), source if column == "spike" else F.col("dip"), *(F.col(k) for k in ("mode", "threshold", "power", "weight")))
        value = blend.spike_policy(*args) if column == "spike" else blend.dip_policy(*args)
        got = x.select("i", "ordinal", value.alias("v")).toPandas().pivot(index="i", columns="ordinal", values="v").sort_index()
        assert len(settings) == got.shape[1]
        for s in settings:
            assert np.allclose(got[s[0]].to_numpy(), made(c, s), atol=1e-9)


def test_parameters_and_scores_equal_a_plain_loop(spark):
    """The whole chain after the models, horizon by horizon, in plain Python."""
    from gridcast.plans import forecasting

    rng = random.Random(11)
    names = ["l1", "l2", "p_spike", "spike_l1", "spike_p90", "p_dip", "dip_l1", "naive"]

    def rows(n, day):
        out = []
        for i in range(n):
            y = rng.choice([-20.0, 40.0, 60.0, 150.0]) + rng.gauss(0, 5)
            out.append((dt.datetime(2024, 1, day) + dt.timedelta(minutes=i), "nsw", 1 + i % 2, y, y + rng.gauss(0, 20), y + rng.gauss(5, 25), min(1, max(0, (y > 100) * 0.6 + rng.random() * 0.4)), y + rng.gauss(10, 9), y + rng.uniform(0, 60), min(1, max(0, (y < 0) * 0.7 + rng.random() * 0.3)), y - rng.uniform(0, 30), y + rng.gauss(0, 30)))
        return out

    schema = "ts timestamp, region string, h int, y double, " + ", ".join(f"{n} double" for n in names)
    valid, test = rows(1300, 22), rows(60, 28)
    found = {r["h"]: r for r in forecasting.parameters(spark.createDataFrame(valid, schema)).collect()}
    got = {(r["ts"], r["h"]): r["yhat"] for r in policy.scored(spark.createDataFrame(test, schema), spark.createDataFrame(list(found.values()), policy.PARAMETERS)).collect()}
    for h in (1, 2):
        own = [dict(zip(["ts", "region", "h", "y", *names], r, strict=True)) for r in valid if r[2] == h]
        c = {k: np.array([r[k] for r in own]) for k in ("y", *names)}
        mae = lambda v: np.abs(c["y"] - v).mean()  # noqa: B023, E731
        alpha = min((round(mae((1 - a) * c["l1"] + a * c["l2"]), 9), i) for i, a in enumerate(blend.ALPHAS))[1]
        alpha = blend.ALPHAS[alpha]
        base = (1 - alpha) * c["l1"] + alpha * c["l2"]

        def errors(v):
            e = np.abs(c["y"] - v)  # noqa: B023
            part = lambda m: e[m].mean() if m.any() else 0.0
            y = c["y"]  # noqa: B023
            return round(2.2 * part(y > 100) + 1.3 * part(y < 0) + part(y <= 100) + 0.25 * e.mean(), 9), part(y <= 100), part((y >= 0) & (y <= 100))

        arrays = {"base": base, "p": c["p_spike"], "p90": c["spike_p90"], "l1": c["spike_l1"]}
        settings = policy.spike_settings()
        limit = errors(policy.spike_made(arrays, settings[0]))[1] + 0.20
        spike = settings[min((e[0], s[0]) for s in settings if (e := errors(policy.spike_made(arrays, s)))[1] <= limit)[1]]
        spiked = policy.spike_made(arrays, spike)
        arrays = {"base": spiked, "p": c["p_dip"], "dip": c["dip_l1"]}
        at_base = errors(spiked)
        good = [(e[0], s[0]) for s in policy.dip_settings() if (e := errors(policy.dip_made(arrays, s)))[2] <= at_base[2] + 0.15 and e[0] < at_base[0]]
        dip = policy.dip_settings()[min(good)[1] if good else 0]
        dipped = policy.dip_made(arrays, dip)
        share = 1 - blend.NAIVE_WEIGHTS[min((round(mae((1 - w) * dipped + w * c["naive"]), 9), i) for i, w in enumerate(blend.NAIVE_WEIGHTS))[1]]
        p = found[h]
        assert (p["alpha"], p["spike_source"], p["spike_mode"], p["spike_threshold"], p["spike_power"], p["spike_weight"]) == (alpha, *spike[1:])
        assert (p["dip_mode"], p["dip_threshold"], p["dip_power"], p["dip_weight"]) == dip[2:] and p["model_share"] == pytest.approx(share)
        knots = [(k["x"], k["y"]) for k in p["knots"]]
        for r in (dict(zip(["ts", "region", "h", "y", *names], r, strict=True)) for r in test if r[2] == h):
            one = {k: np.array([v]) for k, v in r.items() if k in names}
            v = policy.spike_made({"base": (1 - alpha) * one["l1"] + alpha * one["l2"], "p": one["p_spike"], "p90": one["spike_p90"], "l1": one["spike_l1"]}, spike)
            v = policy.dip_made({"base": v, "p": one["p_dip"], "dip": one["dip_l1"]}, dip)
            v = share * v + (1 - share) * one["naive"] if share < 1 else v
            assert got[r["ts"], h] == pytest.approx(float(np.interp(v, *zip(*knots, strict=True))[0]), abs=1e-7)


def test_nodes_of_a_model_are_a_tree():
    table = pa.table({"h": [1, 1, 1], "model": ["m"] * 3, "tree": [0] * 3, "node": [1, 2, 3], "feature": ["a", None, None], "threshold": [0.5, None, None], "left": [2, None, None], "right": [3, None, None], "value": [None, 10.0, 20.0]})
    forest = boosting.Forest(table, ["b", "a"], ["m", "other"])
    x = np.array([[9.0, 0.5], [9.0, 0.6], [9.0, np.nan]])
    assert forest.predict(x, 1)[0].tolist() == [10.0, 20.0, 10.0] and forest.predict(x, 1)[1] is None and forest.predict(x, 2) == [None, None]


def test_scores_are_those_of_equal_frequency_bins(spark):
    """Against a plain count; a monotone transform changes nothing, and noise scores near 0 although it fills cells."""
    from gridcast.operators import select

    rng = np.random.default_rng(4)
    n = 900
    x = np.where(rng.random(n) < 0.1, np.nan, np.exp(rng.normal(size=n) * 3))
    y = np.where(rng.random(n) < 0.1, np.nan, np.round(np.log(np.nan_to_num(x, nan=1.0)) + rng.normal(size=n), 1))
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(x, np.log(x), rng.normal(size=n), y, strict=True)]
    df = spark.createDataFrame([(*r, 1.0, None) for r in rows], "x double, log double, noise double, y double, flat double, none double").repartition(4)
    got = {(r["feature"], r["target"]): r["mi"] for r in select.mutual_information(df, ["x", "log", "noise", "flat", "none"], ["y"]).collect()}
    there = ~np.isnan(x) & ~np.isnan(y)
    slot = lambda v: np.searchsorted(np.sort(v[~np.isnan(v)])[[int(np.ceil((~np.isnan(v)).sum() * k / 8)) - 1 for k in range(1, 8)]], v[there])
    a, b = slot(x), slot(y)
    joint = np.histogram2d(a, b, (range(9), range(9)))[0]
    p = joint / joint.sum()
    plain = np.nansum(np.where(p > 0, p * np.log(np.where(p > 0, p, 1) / (p.sum(1, keepdims=True) @ p.sum(0, keepdims=True) + 1e-300)), 0))
    plain -= ((joint > 0).sum() - len(set(a)) - len(set(b)) + 1) / (2 * joint.sum())
    assert got["x", "y"] == pytest.approx(plain) and got["log", "y"] == pytest.approx(plain)
    assert got["noise", "y"] < 0.03 < got["x", "y"] and got["flat", "y"] == got["none", "y"] == 0.0
