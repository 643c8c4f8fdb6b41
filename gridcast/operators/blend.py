"""Targets, weights, labels, blends, policies and metrics, all on long rows (ts, region or h, y, predictions)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.scalar import asinh100, clip, col, flag
from gridcast.operators import grid, quantiles
from gridcast.operators.rolling import Series

# The grids that are searched.
ALPHAS = tuple(i / 20 for i in range(10))
THRESHOLDS = (0.03, 0.05, 0.08, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)
POWERS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0)
MOST_WEIGHTS = (0.4, 0.6, 0.8, 1.0, 1.2)
NAIVE_WEIGHTS = tuple(1 - i / 40 for i in range(41))  # shares of the naive forecast, in the order of the search: from all of it to none


def targets(df: DataFrame, horizons: int, x: str = "price", step_rows: int = 1, first_offset: int = 0, keys: Sequence[str] = ("region",), ts: str = "ts", step: int = 3600, rows: int = 2880) -> DataFrame:
    """Long targets (ts, keys, h, y): y is the value (h - 1) * step_rows + first_offset rows later; null past the end. Blocks of `rows` rows of a dense grid of `step` seconds, with the rows behind them."""
    cut = grid.blocks(df.select(ts, *keys, x), step, rows, 0, (horizons - 1) * step_rows + first_offset, ts)
    s = Series([*keys, "block"], ts)
    ahead = [s.lead(x, (h - 1) * step_rows + first_offset) for h in range(1, horizons + 1)]
    wide = cut.select(ts, *keys, "own", F.array(*ahead).alias("y")).where("own")
    return wide.select(ts, *keys, F.posexplode("y").alias("h", "y")).withColumn("h", F.col("h") + 1)


def split(ts: Column | str, valid_from: Column, test_from: Column) -> Column:
    ts = col(ts)
    return F.when(ts <= valid_from, "train").when(ts <= test_from, "valid").otherwise("test")


def recency(position: Column, n: Column) -> Column:
    """exp of a line from 0 at the first training row to 1.5 at the last."""
    return F.exp(F.lit(1.5) * position / (n - 1))


def weights(w: Column, y: Column, spike: float = 150.0, compat: bool = False) -> dict[str, Column]:
    dip = (y > 0) if compat else (y < 0)
    return {"w": w, "w_spike3": w * F.when(y > spike, 3.0).otherwise(1.0), "w_spike10": w * F.when(y > spike, 10.0).otherwise(1.0), "w_dip7": w * F.when(dip, 7.0).otherwise(1.0)}


def capped(df: DataFrame, quantile: float = 0.97, per: Sequence[str] = ("h",)) -> DataFrame:
    """Caps y at its training quantile (by horizon) and transforms: y_capped, y_asinh. The caps are one row per horizon."""
    caps = quantiles.quantile(df.where("split = 'train'"), "y", quantile, "cap", per)
    out = df.join(F.broadcast(caps), list(per), "left")
    return out.withColumn("y_capped", asinh100(F.when(F.col("y").isNotNull(), F.least("y", "cap")))).withColumn("y_asinh", asinh100("y"))


def derived(df: DataFrame, w: Column, spike: float = 150.0) -> DataFrame:
    """The twelve derived targets of each (ts, keys, h) as one long table. df: split (train or valid), y, y_capped, y_asinh; w: the row's recency weight.

    Columns of a split are null in the other's rows; weights exist for training rows only.
    """
    y, train = F.col("y"), F.col("split") == "train"
    both = {"clipped": F.col("y_capped"), "unclipped": F.col("y_asinh"), "spike": F.when(y.isNotNull(), flag(y > spike)), "dip": F.when(y.isNotNull(), flag(y < 0))}
    out = {f"{n}_{k}": F.when(c, x) for n, x in both.items() for k, c in (("train", train), ("valid", F.col("split") == "valid"))}
    out |= {n: F.when(train, x) for n, x in weights(w, y, spike).items()}
    drop = {"y", "y_capped", "y_asinh"}
    return df.select(*(c for c in df.columns if c not in drop), *(c.alias(n) for n, c in out.items()))


def labels(y: Column, spike: float = 150.0) -> dict[str, Column]:
    return {"is_spike": flag(y > spike), "is_dip": flag(y < 0)}


def blend(one: Column, two: Column, alpha: Column) -> Column:
    return (1 - alpha) * one + alpha * two


def search(df: DataFrame, per: Sequence[str], grid: DataFrame, prediction: Column, params: Sequence[str]) -> DataFrame:
    """The grid row with the smallest mean absolute error for each group; the first of equals. grid: ordinal and parameters, a few thousand rows at most."""
    tried = df.where("y is not null").crossJoin(F.broadcast(grid)).groupBy(*per, "ordinal", *params).agg(F.avg(F.abs(F.col("y") - prediction)).alias("mae"))
    best = F.struct(F.round("mae", 9).alias("m"), F.col("ordinal"))
    return tried.groupBy(*per).agg(*(F.min_by(p, best).alias(p) for p in params), F.min("mae").alias("mae"))


def line_search(df: DataFrame, per: Sequence[str], one: str, two: str, shares: Sequence[float], name: str) -> DataFrame:
    """(per, name, mae): the share s with the least mean absolute error of (1 - s) * one + s * two in each group; the first of equals.

    Tasks add up the errors of all shares; only these sums are shuffled. Rows without y are left out, rows without a prediction have no error.
    """
    rows = df.where("y is not null").select(*per, *(F.col(c).cast("double").alias(f"__{c}") for c in ("y", one, two)))
    k, s = len(per), np.asarray(shares, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups = list(zip(*(batch.column(i).to_pylist() for i in range(k)), strict=True)) if per else [()] * batch.num_rows
            met = {g: i for i, g in enumerate(dict.fromkeys(groups))}
            at = np.array([met[g] for g in groups], np.int64)
            y, a, b = (batch.column(k + i).to_numpy(zero_copy_only=False) for i in range(3))
            e = np.abs(y[:, None] - ((1 - s) * a[:, None] + s * b[:, None]))
            there = ~np.isnan(e[:, 0])
            for g, i in met.items():
                own = e[there & (at == i)]
                sums[g] = sums.get(g, 0.0) + np.append(own.sum(0), len(own))
        heads = [pa.array([g[i] for g in sums for _ in s], batch.schema.field(i).type) for i in range(k)] if sums else []
        total = np.stack(list(sums.values())) if sums else np.zeros((0, len(s) + 1))
        body = [pa.array(np.tile(np.arange(len(s), dtype=np.int32), len(sums))), pa.array(total[:, :-1].ravel()), pa.array(np.repeat(total[:, -1], len(s)))]
        if sums:
            yield pa.RecordBatch.from_arrays([*heads, *body], names=[*per, "ordinal", "e", "n"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in per), "ordinal int, e double, n double"])
    tried = rows.mapInArrow(run, schema).groupBy(*per, "ordinal").agg(F.try_divide(F.sum("e"), F.sum("n")).alias("mae"))
    best = F.struct(F.round("mae", 9).alias("m"), F.col("ordinal"))
    share = F.array(*(F.lit(float(x)) for x in shares))[F.col("ordinal")]
    return tried.groupBy(*per).agg(F.min_by(share, best).alias(name), F.min("mae").alias("mae"))


def ramp(p: Column, threshold: Column, power: Column) -> Column:
    return F.pow(clip((p - threshold) / (1 - threshold + 1e-6), 0, 1), power)


def spike_policy(base: Column, p: Column, source: Column, mode: Column, threshold: Column, power: Column, most: Column, compat: bool = False) -> Column:
    """Mode 0: mix by probability; 1: uplift shaped by probability; 2: hard gate."""
    gap = F.greatest(source - base, F.lit(0.0))
    gate = (base + power) * gap if compat else base + power * gap
    return F.when(mode == 0, (1 - p) * base + p * source).when(mode == 1, base + gap * most * ramp(p, threshold, power)).otherwise(F.when(p >= threshold, gate).otherwise(base))


def dip_policy(base: Column, p: Column, source: Column, mode: Column, threshold: Column, power: Column, weight: Column) -> Column:
    gap = F.greatest(base - source, F.lit(0.0))
    return F.when(mode == 0, (1 - p) * base + p * source).when(mode == 1, base - weight * ramp(p, threshold, power) * gap).otherwise(F.when(p >= threshold, base - weight * gap).otherwise(base))


def metrics(df: DataFrame, per: Sequence[str] = (), spike: float = 150.0) -> DataFrame:
    """MAE, RMSE, R2, bias, wMAPE, skill against the naive column, and MAE and share of spikes, calm rows and dips. df: y, yhat, naive."""
    # the generator keeps the prediction's expression from being computed anew for each sum
    rows = df.withColumn("__e", F.explode(F.array(F.col("yhat") - F.col("y")))).where("__e is not null")
    y, e = F.col("y"), F.col("__e")
    mae, naive = F.avg(F.abs(e)), F.avg(F.abs(F.col("naive") - y))
    part = lambda c: F.avg(F.when(c, F.abs(e)))
    share = lambda c: F.avg(flag(c)) * 100
    return rows.groupBy(*per).agg(
        F.count("*").alias("n"), mae.alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count("*"))).alias("r2"), F.avg(e).alias("mbe"),
        (F.sum(F.abs(e)) / (F.sum(F.abs(y)) + 1e-8) * 100).alias("wmape"), naive.alias("mae_naive"), ((1 - F.try_divide(mae, naive)) * 100).alias("skill"),
        part(y > spike).alias("mae_spike"), part(y <= spike).alias("mae_calm"), part(y < 0).alias("mae_dip"), share(y > spike).alias("spike_share"), share(y < 0).alias("dip_share"),
    )


def complete(df: DataFrame, horizons: int, key: Sequence[str]) -> DataFrame:
    """Rows of times all of whose horizons have a value."""
    full = df.groupBy(*key).agg(F.count("y").alias("n")).where(F.col("n") == horizons).select(*key)
    return df.join(full, list(key), "left_semi")


def wide_rows(df: DataFrame, horizons: int, key: Sequence[str], values: dict[str, str]) -> DataFrame:
    """One row for each key with a column <prefix>_h<h> for each value and horizon: one aggregation whose groups are an array by horizon. values: prefix and column."""
    made = df.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("h", F.struct(*(F.col(c).alias(p) for p, c in values.items()))))).alias("__by"))
    return made.select(*key, *(F.col("__by")[h][p].alias(f"{p}_h{h}") for h in range(1, horizons + 1) for p in values))
