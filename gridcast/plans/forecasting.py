"""Registered queries from features to scores of fitted models: every horizon, every model, parameters found on the validation rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.functions.scalar import asinh100, sinh100
from gridcast.operators import blend, boosting, grid, models, policy, quantiles, rolling, select, shared, sketches
from gridcast.operators.rolling import Series
from gridcast.plans import registry, staging
from gridcast.plans.registry import FEATURES, HOUR, N_H, add

HORIZONS = list(range(1, N_H + 1))
TRAIN_TO, VALID_TO = "2024-01-20 00:00:00", "2024-01-26 00:00:00"
CHOSEN = 5  # features of a horizon in the queries that don't search their number
BOOST = {"rounds": 12, "depth": 3, "rate": 0.2, "patience": 4}
LABELS = ("y_capped", "y_asinh", "is_spike", "is_dip", "y")
WEIGHTS = ("w", "w_spike3", "w_spike10", "w_dip7")
MEDIAN = {"l1": "l1", "l2": "l2", "spike_l1": "spike_l1", "p90": "spike_p90", "dip_l1": "dip_l1", "p10": "dip_p10"}
CHANCE = {"spike_classifier": "p_spike", "dip_classifier": "p_dip"}


def table(spark: SparkSession, d: str) -> DataFrame:
    """ts, region, features, and arrays by horizon: y (the price h hours later) and naive (the price of the same hour of the last day known)."""
    x = registry.candidates(spark, d).drop("y1", "y6")
    bars = rolling.filled(staging.bars(spark, d), "price", "__price", HOUR, ["region"]).select("ts", "region", F.col("__price").alias("price"))
    s = Series(("region", "block"))
    cut = grid.blocks(bars, HOUR, 2880, 24, N_H)
    ahead = F.array(*(s.lead("price", h) for h in HORIZONS)).alias("y")
    naive = F.array(*(s.lag("price", -h % 24) for h in HORIZONS)).alias("naive")
    return x.join(cut.select("ts", "region", "own", ahead, naive).where("own").drop("own"), ["ts", "region"])


def _part(ts: str = "ts") -> Column:
    """0 for training rows, 1 for validation rows, 2 for test rows."""
    at = lambda t: F.lit(t).cast("timestamp")
    return F.when(F.col(ts) <= at(TRAIN_TO), 0).when(F.col(ts) <= at(VALID_TO), 1).otherwise(2)


def long(x: DataFrame) -> DataFrame:
    """One row for each time, region and horizon."""
    both = F.posexplode(F.arrays_zip("y", "naive")).alias("h", "v")
    return x.select("ts", "region", both).select("ts", "region", (F.col("h") + 1).alias("h"), F.col("v.y").alias("y"), F.col("v.naive").alias("naive"))


def orders(x: DataFrame) -> dict[int, list[str]]:
    """Each horizon's features, best first, by mutual information on the training rows; a row for each feature and horizon comes to the driver."""
    train = x.where(_part() == 0).select(*FEATURES, *(F.col("y")[h - 1].alias(f"y{h}") for h in HORIZONS))
    scores = select.mutual_information(train, FEATURES, [f"y{h}" for h in HORIZONS]).select("feature", F.substring("target", 2, 9).cast("int").alias("h"), F.round("mi", 9).alias("mi"))
    out: dict[int, list] = {h: [] for h in HORIZONS}
    for r in scores.collect():
        out[r["h"]].append((-r["mi"], r["feature"]))
    return {h: [f for _, f in sorted(own)] for h, own in out.items()}


def examples(x: DataFrame, features: dict[int, list[str]], fold: Column) -> DataFrame:
    """h, fold, x, labels and weights of all rows with a target. Caps are the training rows' 97 % quantiles, weights rise with time."""
    rows = x.select("ts", "region", fold.alias("fold"), _part().alias("part"), F.array(*(F.col(f).cast("double") for f in FEATURES)).alias("all"), F.posexplode("y").alias("h", "y"))
    rows = rows.withColumn("h", F.col("h") + 1).where("y is not null")
    caps = quantiles.quantile(rows.where("part = 0"), "y", 0.97, "cap", ["h"])
    span = x.where(_part() == 0).agg(F.min(F.unix_timestamp("ts")).alias("lo"), F.max(F.unix_timestamp("ts")).alias("hi"))
    rows = rows.join(F.broadcast(caps), "h", "left").crossJoin(F.broadcast(span))
    y = F.col("y")
    w = blend.recency((F.unix_timestamp("ts") - F.col("lo")) / HOUR, (F.col("hi") - F.col("lo")) / HOUR + 1)
    made = {"y_capped": asinh100(F.least("y", "cap")), "y_asinh": asinh100("y"), "y": y, **blend.labels(y, 100.0), **blend.weights(w, y, 100.0)}
    order = F.create_map(*(v for h, own in features.items() for v in (F.lit(h), F.array(*(F.lit(FEATURES.index(f)) for f in own)))))
    own = F.transform(order[F.col("h")], lambda i: F.get(F.col("all"), i))
    return rows.select("h", "fold", own.alias("x"), F.array(*(made[n].cast("double") for n in LABELS)).alias("labels"), F.array(*(made[n].cast("double") for n in WEIGHTS)).alias("weights"))


def edges(x: DataFrame) -> dict[str, list[float]]:
    """Upper ends of the bins: quantiles of the training rows' features, from one scan."""
    return sketches.quantiles(x.where(_part() == 0), FEATURES, [k / boosting.BINS for k in range(1, boosting.BINS)])


def specs(h: int) -> list[boosting.Model]:
    """The eight models of a horizon."""
    kind = lambda s: "quantile" if s.quantile else s.kind
    return [boosting.Model(h, s.name, kind(s), LABELS.index(s.label), WEIGHTS.index(s.weight) if s.weight else None, s.quantile or 0.5, s.positive) for s in models.SPECS]


@dataclass
class Trained:
    """Rows with their features, the features of each horizon, and the trees of all models, which lie as a table at `path`."""

    rows: DataFrame
    features: dict[int, list[str]]
    fitted: boosting.Fitted
    path: str


def trained(spark: SparkSession, d: str) -> Trained:
    x = shared.keep(table(spark, d), "features")
    features = {h: own[:CHOSEN] for h, own in orders(x).items()}
    fitted = boosting.fit(examples(x, features, _part()), [m for h in HORIZONS for m in specs(h)], features, edges(x), **BOOST)
    path = models.folder(spark)
    spark.createDataFrame(fitted.nodes).write.parquet(path)
    return Trained(x, features, fitted, path)


def predictions(t: Trained, rows: DataFrame) -> DataFrame:
    """(ts, region, h, a column for each model) for all horizons, by the trees as they were written."""
    nodes = rows.sparkSession.read.parquet(t.path).toArrow()
    return boosting.predict(rows, boosting.Forest(nodes, FEATURES, [s.name for s in models.SPECS], list(CHANCE)), ["ts", "region"])


def _fit_models(spark: SparkSession, d: str) -> DataFrame:
    """All eight models of all horizons on their own feature sets, with early stopping; written, read back and applied to the later rows."""
    t = trained(spark, d)
    later = t.rows.where(_part() > 0)
    names = F.create_map(*(v for h, own in t.features.items() for v in (F.lit(h), F.lit(",".join(own)))))
    out = predictions(t, later).join(long(later).drop("naive"), ["ts", "region", "h"])
    return out.select("ts", "region", "h", names[F.col("h")].alias("features"), "y", *(s.name for s in models.SPECS))


def priced(found: DataFrame) -> DataFrame:
    """Predictions as prices and chances, under the names that scoring takes."""
    return found.select("ts", "region", "h", *(sinh100(F.col(a)).alias(b) for a, b in MEDIAN.items()), *(F.col(a).alias(b) for a, b in CHANCE.items()))


def parameters(valid: DataFrame) -> DataFrame:
    """One row of policy.PARAMETERS for each horizon, each part found on what the parts before it give. valid: h, y, naive and the models' columns."""
    alpha = blend.line_search(valid, ["h"], "l1", "l2", blend.ALPHAS, "alpha").select("h", "alpha")
    with_ = lambda df, found: df.join(F.broadcast(found), "h", "left")  # noqa: E731  a row for each horizon
    x = shared.keep(with_(valid, alpha).withColumn("base", blend.blend(F.col("l1"), F.col("l2"), F.col("alpha"))), "based")
    put = lambda found, name: found.select("h", *(F.col(c).alias(f"{name}_{c}") for c in ("source", "mode", "threshold", "power", "weight") if c in found.columns))
    spikes = policy.spike_search(x.select("h", "y", "base", F.col("p_spike").alias("p"), F.col("spike_p90").alias("p90"), F.col("spike_l1").alias("l1")), ["h"], spike=100.0)
    spikes = shared.keep(put(spikes, "spike"), "spikes")
    source = F.when(F.col("spike_source") == "max", F.greatest("spike_p90", "spike_l1")).when(F.col("spike_source") == "l1", F.col("spike_l1")).otherwise(F.col("spike_p90"))
    setting = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    spiked = blend.spike_policy(F.col("base"), F.col("p_spike"), source, setting("spike_mode", 0), setting("spike_threshold", 0.20), setting("spike_power", 2.0), setting("spike_weight", 0.75))
    x = with_(x, spikes).withColumn("base", spiked)
    dips = shared.keep(put(policy.dip_search(x.select("h", "y", "base", F.col("p_dip").alias("p"), F.col("dip_l1").alias("dip")), ["h"], spike=100.0), "dip"), "dips")
    dipped = blend.dip_policy(F.col("base"), F.col("p_dip"), F.col("dip_l1"), setting("dip_mode", 0), setting("dip_threshold", 0.15), setting("dip_power", 1.0), setting("dip_weight", 0.60))
    x = shared.keep(with_(x, dips).withColumn("base", dipped), "dipped")
    share = blend.line_search(x, ["h"], "base", "naive", blend.NAIVE_WEIGHTS, "naive_share").select("h", (1 - F.col("naive_share")).alias("model_share"))
    x = with_(x, share).withColumn("base", F.when((F.col("model_share") < 1) & F.col("naive").isNotNull(), F.col("model_share") * F.col("base") + (1 - F.col("model_share")) * F.col("naive")).otherwise(F.col("base")))
    knots = models.calibrators(x.select("h", "base", "y"), HORIZONS, "base", "y")
    out = alpha
    for part in (spikes, dips, share, knots):
        out = out.join(part, "h", "left")
    names = [c.split()[0] for c in policy.PARAMETERS.split(", ")]
    return shared.keep(out.select(*names), "parameters")


def chain(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(validation rows, parameters, scored test rows): fitted on the training rows, parameters from the validation rows, scored on the test rows."""
    t = trained(spark, d)
    later = t.rows.where(_part() > 0)
    both = shared.keep(priced(predictions(t, later)).join(long(later), ["ts", "region", "h"]), "predictions")
    valid, test = both.where(_part() == 1), both.where(_part() == 2)
    found = parameters(valid)
    return valid, found, policy.scored(test, found)


def _chain(spark: SparkSession, d: str) -> DataFrame:
    """Errors of each horizon's test rows, beside the parameters that they were scored with."""
    _, found, scored = chain(spark, d)
    told = found.select("h", "alpha", "spike_source", "spike_mode", "dip_mode", "model_share", F.coalesce(F.size("knots"), F.lit(0)).alias("knots"))
    return blend.metrics(scored, ["h"], 100.0).join(told, "h")


add("fit_models", _fit_models)
add("forecast_chain", _chain)

COUNTS = tuple(range(1, len(FEATURES) + 1))
FOLDS = 3
SEARCH = {"rounds": 4, "depth": 3, "rate": 0.4}


def count_errors(spark: SparkSession, d: str) -> tuple[DataFrame, dict[int, list[str]]]:
    """(h, n, mae): the mean validation error over expanding folds of models of the first n features, for all horizons in the same jobs."""
    x = shared.keep(select.folds(table(spark, d), FOLDS), "folds")
    features = orders(x)
    tried = [boosting.Model(h, f"{n} {k}", "absolute", LABELS.index("y"), None, 0.5, 1.0, n, k) for h in HORIZONS for n in COUNTS for k in range(1, FOLDS + 1)]
    fitted = boosting.fit(examples(x, features, F.col("fold")), tried, features, edges(x), patience=SEARCH["rounds"], **SEARCH)
    rows = [(h, int(name.split()[0]), 2 * loss) for (h, name), loss in fitted.loss.items() if loss < float("inf")]
    return spark.createDataFrame(rows, "h int, n int, mae double").groupBy("h", "n").agg(F.avg("mae").alias("mae")), features


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """The best number of features of each horizon."""
    return select.best_count(count_errors(spark, d)[0])


def _selected(spark: SparkSession, d: str) -> DataFrame:
    """Which features each horizon's models see: the best count by its validation errors, of the features in the order of their scores."""
    errors, features = count_errors(spark, d)
    placed = spark.createDataFrame([(f, h, i + 1) for h, own in features.items() for i, f in enumerate(own)], "feature string, h int, place int")
    chosen = placed.join(F.broadcast(select.best_count(errors).select("h", "n")), "h").withColumn("selected", F.col("place") <= F.col("n"))
    return select.feature_matrix(chosen, HORIZONS)


def _importance(spark: SparkSession, d: str) -> DataFrame:
    """Each feature's share of the gains of all models of all horizons."""
    return boosting.importance(spark.createDataFrame(trained(spark, d).fitted.nodes))


add("cv_feature_count", _counts)
add("selected_features", _selected)
add("importance", _importance)
