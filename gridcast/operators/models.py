"""The models of a horizon, MLlib fits of single ones, calibration of all horizons, and feature sets; `boosting` fits all models at once.

MLlib has no quantile loss: a quantile model is an absolute-loss model plus the quantile of its residuals in each bucket
of its prediction. Trees grow level by level, and validation stops by tolerance, so compare errors, not values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.operators import quantiles, shared


@dataclass(frozen=True)
class Spec:
    """One model: its name, kind (absolute, squared or binary), label and weight columns, and positive weight."""

    name: str
    kind: str
    label: str
    weight: str | None = None
    positive: float = 1.0
    quantile: float | None = None


# The models trained for each horizon.
SPECS = (
    Spec("l1", "absolute", "y_capped", "w"),
    Spec("l2", "squared", "y_asinh", "w"),
    Spec("spike_classifier", "binary", "is_spike", None, 7.0),
    Spec("spike_l1", "absolute", "y_asinh", "w_spike3"),
    Spec("p90", "absolute", "y_asinh", "w_spike10", 1.0, 0.9),
    Spec("dip_classifier", "binary", "is_dip", None, 6.0),
    Spec("dip_l1", "absolute", "y_asinh", "w_dip7"),
    Spec("p10", "absolute", "y_asinh", "w_dip7", 1.0, 0.1),
)


def fit(df: DataFrame, spec: Spec, features: Sequence[str], rounds: int = 20, depth: int = 4, rate: float = 0.1, validation: str | None = None) -> PipelineModel:
    """df: features, label, weight; `validation` names a boolean column that marks the rows for early stopping."""
    rows = df.dropna(subset=[*features, spec.label])
    weight = spec.weight
    if spec.kind == "binary" and spec.positive != 1.0:
        rows = rows.withColumn("__weight", F.when(F.col(spec.label) > 0, spec.positive).otherwise(1.0))
        weight = "__weight"
    common = {"featuresCol": "features", "labelCol": spec.label, "maxIter": rounds, "maxDepth": depth, "stepSize": rate, "seed": 42}
    if weight:
        common["weightCol"] = weight
    if validation:
        common |= {"validationIndicatorCol": validation, "validationTol": 0.001}
    learner = GBTClassifier(**common) if spec.kind == "binary" else GBTRegressor(lossType=spec.kind, predictionCol="prediction", **common)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), learner]).fit(rows)


def predict(df: DataFrame, spec: Spec, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Adds a column of the model's name: the prediction, or the probability of class 1."""
    out = model.transform(df.dropna(subset=list(features)))
    value = vector_to_array("probability")[1] if spec.kind == "binary" else F.col("prediction")
    return out.select(*df.columns, value.alias(spec.name))


def folder(spark) -> str:
    """A new folder for models under spark.checkpoint.dir, which driver and executors share."""
    return shared.folder(spark, "models")


def residual_quantile(train: DataFrame, scored: DataFrame, prediction: str, label: str, q: float, name: str, buckets: int = 10) -> DataFrame:
    """The prediction plus the q-quantile of training residuals in the prediction's bucket; edges and offsets are a few rows."""
    edges = train.agg(F.percentile_approx(prediction, F.array(*(F.lit(i / buckets) for i in range(1, buckets))), F.lit(quantiles.ACCURACY)).alias("edges"))
    slot = lambda df: df.crossJoin(F.broadcast(edges)).withColumn("__slot", F.size(F.filter("edges", lambda e: e < F.col(prediction)))).drop("edges")
    offset = quantiles.quantile(slot(train).withColumn("__e", F.col(label) - F.col(prediction)), "__e", q, "__o", ["__slot"])
    return slot(scored).join(F.broadcast(offset), "__slot", "left").withColumn(name, F.col(prediction) + F.coalesce("__o", F.lit(0.0))).drop("__slot", "__o")


def calibrate(train: DataFrame, scored: DataFrame, prediction: str, label: str, name: str, least: int = 500) -> DataFrame:
    """Isotonic calibration, constant outside the training range; left out where fewer than `least` rows are complete."""
    rows = train.dropna(subset=[prediction, label])
    if rows.limit(least).count() < least:
        return scored.withColumn(name, F.col(prediction))
    model = IsotonicRegression(featuresCol=prediction, labelCol=label, predictionCol=name).fit(rows.select(prediction, label))
    return model.transform(scored)


def _pooled(first: np.ndarray, last: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pools neighbours (in order) until the means don't fall: (first x, last x, sum, count) of the blocks. Blocks of parts pool to the blocks of the whole."""
    out: list[list[float]] = []
    for a, b, s, c in zip(first.tolist(), last.tolist(), total.tolist(), n.tolist(), strict=True):
        out.append([a, b, s, c])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, b, s, c = out.pop()
            out[-1][1:] = [b, out[-1][2] + s, out[-1][3] + c]
    return tuple(np.array(x) for x in zip(*out, strict=True)) if out else (np.zeros(0),) * 4


def _pool_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, x) as pooled blocks, a batch at a time; what ends a batch may go on in the next, so blocks are pooled again by horizon."""
    for batch in batches:
        h = batch.column(0).to_numpy()
        x, s, n = (batch.column(i).to_numpy().astype(float) for i in (1, 2, 3))
        edge = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
        for a, b in zip(edge, edge[1:], strict=False):
            if b > a:
                parts = _pooled(x[a:b], x[a:b], s[a:b], n[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts[0]), h[a])), *(pa.array(p) for p in parts)], names=["h", "first", "last", "total", "n"])


def _knots(group: pa.Table) -> pa.Table:
    order = np.argsort(group["first"].to_numpy(), kind="stable")
    first, last, total, n = _pooled(*(group[c].to_numpy()[order] for c in ("first", "last", "total", "n")))
    knots = [{"x": x, "y": s / c} for a, b, s, c in zip(first.tolist(), last.tolist(), total.tolist(), n.tolist(), strict=True) for x in ([a, b] if b > a else [a])]
    return pa.table({"h": group["h"][:1], "knots": pa.array([knots], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))})


def calibrators(train: DataFrame, horizons: Sequence[int], prediction: str, label: str, least: int = 500) -> DataFrame:
    """(h, knots): an isotonic calibration for each horizon; no row for a horizon of fewer than `least` complete rows.

    All horizons in one job: equal predictions are averaged, neighbours are pooled within ranges of (h, prediction), and the pooled blocks by
    horizon. A fit's knots are the ends of its constant pieces; between them it is linear.
    """
    rows = train.where(F.col("h").isin(list(horizons))).dropna(subset=[prediction, label])
    rows = rows.select("h", F.col(prediction).cast("double").alias("x"), F.col(label).cast("double").alias("y"))
    big = rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h")  # a row for each horizon
    sums = rows.join(F.broadcast(big), "h").groupBy("h", "x").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    pooled = sums.repartitionByRange("h", "x").sortWithinPartitions("h", "x").mapInArrow(_pool_runs, f"h {rows.schema['h'].dataType.simpleString()}, first double, last double, total double, n double")
    return pooled.groupBy("h").applyInArrow(_knots, f"h {rows.schema['h'].dataType.simpleString()}, knots array<struct<x:double,y:double>>")


def subset(df: DataFrame, selected: DataFrame, h: int, keys: Sequence[str] = ("ts", "region")) -> tuple[DataFrame, list[str]]:
    """The columns of a horizon's feature set, and their names in the order of the selection. selected: feature, h, place, selected (a row for each feature and horizon)."""
    names = [r["feature"] for r in selected.where((F.col("h") == h) & F.col("selected")).orderBy("place").select("feature").collect()]
    present = [n for n in names if n in df.columns]
    return df.select(*keys, *present), present


def chronological(df: DataFrame, ts: str = "ts", share: float = 0.7) -> DataFrame:
    """Marks the first share of the times as training rows; the cut is one row."""
    cut = quantiles.quantile(df.withColumn("__t", F.unix_timestamp(ts)), "__t", share, "__cut")
    return df.crossJoin(F.broadcast(cut)).withColumn("is_train", F.unix_timestamp(ts) <= F.col("__cut")).drop("__cut")

