"""Searches of spike and dip policies over their whole grids, and scoring with the parameters found.

A search is one pass: every task holds the grid (some thousand settings at most) and, for each group, the sums of absolute
errors by setting and kind of row; only these sums are shuffled. No row is multiplied by the settings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.scalar import clip
from gridcast.operators import blend

# The grids of the dip policy.
DIP_THRESHOLDS = (0.03, 0.05, 0.08, 0.10, 0.15, 0.20, 0.30)
DIP_POWERS = (0.5, 1.0, 1.5, 2.0, 3.0)
DIP_WEIGHTS = (0.30, 0.50, 0.70, 0.90)
DIP_GATE_WEIGHTS = (0.40, 0.60, 0.80, 1.00)
KINDS = ("spike", "dip", "calm", "mid", "all")

Setting = tuple  # (ordinal, source, mode, threshold, power, weight)


def spike_settings(thresholds=blend.THRESHOLDS, powers=blend.POWERS, most=blend.MOST_WEIGHTS) -> list[Setting]:
    """In the order of the search: mode, source, threshold, power, weight; a parameter that a mode doesn't use takes its first value only."""
    out: list[Setting] = []
    for mode in (0, 1, 2):
        for source in ("p90", "max", "l1"):
            for t in thresholds if mode else thresholds[:1]:
                for p in powers if mode else powers[:1]:
                    for w in most if mode == 1 else most[:1]:
                        out.append((len(out), source, mode, float(t), float(p), float(w)))
    return out


def dip_settings(thresholds=DIP_THRESHOLDS, powers=DIP_POWERS, weights=DIP_WEIGHTS, gates=DIP_GATE_WEIGHTS) -> list[Setting]:
    """The mix, then shaped shifts, then gates."""
    rows = [(0, 0.0, 0.0, 0.0)] + [(1, t, p, w) for t in thresholds for p in powers for w in weights] + [(2, t, 0.0, w) for t in thresholds for w in gates]
    return [(i, "dip", mode, float(t), float(p), float(w)) for i, (mode, t, p, w) in enumerate(rows)]


def spike_made(c: dict[str, np.ndarray], s: Setting) -> np.ndarray:
    _, source, mode, threshold, power, weight = s
    v = c["p90"] if source == "p90" else c["l1"] if source == "l1" else np.maximum(c["p90"], c["l1"])
    if mode == 0:
        return (1 - c["p"]) * c["base"] + c["p"] * v
    gap = np.maximum(v - c["base"], 0.0)
    if mode == 1:
        return c["base"] + gap * weight * np.power(np.clip((c["p"] - threshold) / (1 - threshold + 1e-6), 0.0, 1.0), power)
    return np.where(c["p"] >= threshold, c["base"] + power * gap, c["base"])


def dip_made(c: dict[str, np.ndarray], s: Setting) -> np.ndarray:
    _, _, mode, threshold, power, weight = s
    if mode == 0:
        return (1 - c["p"]) * c["base"] + c["p"] * c["dip"]
    gap = np.maximum(c["base"] - c["dip"], 0.0)
    if mode == 1:
        return c["base"] - weight * np.power(np.clip((c["p"] - threshold) / (1 - threshold + 1e-6), 0.0, 1.0), power) * gap
    return np.where(c["p"] >= threshold, c["base"] - weight * gap, c["base"])


def errors(df: DataFrame, per: Sequence[str], columns: Sequence[str], settings: Sequence[Setting], made: Callable, spike: float, dip: float) -> DataFrame:
    """(per, ordinal, and for each kind of row n_<kind> and e_<kind>, the mean absolute error or 0 without rows); ordinal -1 is the base itself.

    df: y and `columns`; rows with a null among them are left out.
    """
    rows = df.dropna(subset=["y", *columns]).select(*per, *(F.col(c).cast("double").alias(c) for c in ("y", *columns)))
    keys = [rows.schema[k] for k in per]
    n = len(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(per))), strict=True)) if per else [()] * batch.num_rows
            met = {k: i for i, k in enumerate(dict.fromkeys(names))}
            group = np.array([met[k] for k in names])
            c = {name: batch.column(len(per) + i).to_numpy() for i, name in enumerate(("y", *columns))}
            y = c["y"]
            kinds = [y > spike, y < dip, y <= spike, (y >= dip) & (y <= spike), np.ones(len(y), bool)]
            # an error counts for its group and, as a bit pattern, for its kinds of row
            pattern = sum(k.astype(np.int64) << i for i, k in enumerate(kinds))
            slot = group * 2**n + pattern
            bits = (np.arange(2**n)[:, None] >> np.arange(n)) & 1
            total = np.zeros((len(met), len(settings) + 1, n))
            for j, s in enumerate((None, *settings)):
                e = np.abs(y - (c["base"] if s is None else made(c, s)))
                total[:, j] = np.bincount(slot, e, len(met) * 2**n).reshape(len(met), -1) @ bits
            count = np.bincount(slot, minlength=len(met) * 2**n).reshape(len(met), -1) @ bits
            for k, i in met.items():
                own = np.concatenate((total[i], count[i][None]))
                sums[k] = sums[k] + own if k in sums else own
        for k, own in sums.items():
            ordinal = np.arange(-1, len(settings))
            head = [pa.array([v] * len(ordinal), f) for v, f in zip(k, (batch.schema.field(i).type for i in range(len(per))), strict=True)]
            body = [pa.array(own[:-1, i]) for i in range(n)] + [pa.array(np.full(len(ordinal), own[-1, i])) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*head, pa.array(ordinal.astype(np.int32)), *body], names=[*per, "ordinal", *(f"s_{x}" for x in KINDS), *(f"n_{x}" for x in KINDS)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "ordinal int", *(f"s_{x} double" for x in KINDS), *(f"n_{x} double" for x in KINDS)])
    found = rows.mapInArrow(run, schema).groupBy(*per, "ordinal").agg(*(F.sum(f"{a}_{x}").alias(f"{a}_{x}") for a in "sn" for x in KINDS))
    return found.select(*per, "ordinal", *(F.col(f"n_{x}") for x in KINDS), *(F.coalesce(F.try_divide(F.col(f"s_{x}"), F.col(f"n_{x}")), F.lit(0.0)).alias(f"e_{x}") for x in KINDS))


def score_of() -> Column:
    return 2.2 * F.col("e_spike") + 1.3 * F.col("e_dip") + F.col("e_calm") + 0.25 * F.col("e_all")


def _table(spark, settings: Sequence[Setting]) -> DataFrame:
    return spark.createDataFrame(list(settings), "ordinal int, source string, mode int, threshold double, power double, weight double")


def spike_search(df: DataFrame, per: Sequence[str], settings: Sequence[Setting] | None = None, spike: float = 150.0, dip: float = 0.0, slack: float = 0.20) -> DataFrame:
    """(per, source, mode, threshold, power, weight, score): the first setting with the least score of those whose error on rows without a
    spike is at most that of the plain mix with p90 and `slack` more. df: y, base, p, p90, l1. An empty kind of row counts as 0."""
    settings = settings or spike_settings()
    e = errors(df, per, ["base", "p", "p90", "l1"], settings, spike_made, spike, dip).withColumn("score", F.round(score_of(), 9))
    first = next(s[0] for s in settings if s[1:3] == ("p90", 0))
    limit = e.where(F.col("ordinal") == first).select(*per, (F.col("e_calm") + slack).alias("__limit"))
    ok = (e.join(limit, list(per)) if per else e.crossJoin(limit)).where((F.col("ordinal") >= 0) & (F.col("e_calm") <= F.col("__limit")))
    best = ok.groupBy(*per).agg(F.min(F.struct("score", "ordinal")).alias("b")).select(*per, "b.score", "b.ordinal")
    return best.join(F.broadcast(_table(df.sparkSession, settings)), "ordinal").select(*per, "source", "mode", "threshold", "power", "weight", "score")


def dip_search(df: DataFrame, per: Sequence[str], settings: Sequence[Setting] | None = None, spike: float = 150.0, dip: float = 0.0, slack: float = 0.15) -> DataFrame:
    """(per, mode, threshold, power, weight, score): the first setting with the least score below the base's, among those whose error on rows
    from `dip` to `spike` (all rows, if there are none) is at most the base's and `slack` more; the mix if there is none. df: y, base, p, dip."""
    settings = settings or dip_settings()
    e = errors(df, per, ["base", "p", "dip"], settings, dip_made, spike, dip).withColumn("score", F.round(score_of(), 9))
    e = e.withColumn("mid", F.when(F.col("n_mid") > 0, F.col("e_mid")).otherwise(F.col("e_all")))
    base = e.where("ordinal = -1").select(*per, (F.col("mid") + slack).alias("__limit"), F.col("score").alias("__base"))
    tried = (e.join(base, list(per)) if per else e.crossJoin(base)).where("ordinal >= 0")
    good = (F.col("mid") <= F.col("__limit")) & (F.col("score") < F.col("__base"))
    best = tried.groupBy(*per).agg(F.min(F.when(good, F.struct("score", "ordinal"))).alias("b"), F.first("__base").alias("__base"))
    best = best.select(*per, F.coalesce("b.score", "__base").alias("score"), F.coalesce("b.ordinal", F.lit(0)).alias("ordinal"))
    return best.join(F.broadcast(_table(df.sparkSession, settings)), "ordinal").select(*per, "mode", "threshold", "power", "weight", "score")


PARAMETERS = "h int, alpha double, spike_source string, spike_mode int, spike_threshold double, spike_power double, spike_weight double, dip_mode int, dip_threshold double, dip_power double, dip_weight double, model_share double, knots array<struct<x:double,y:double>>"


def interpolated(x: Column, knots: Column) -> Column:
    """Linear between knots (sorted by x), constant outside; x itself without knots."""
    left = F.filter(knots, lambda k: k.x <= x)
    right = F.filter(knots, lambda k: k.x > x)
    a, b = F.try_element_at(left, F.lit(-1)), F.try_element_at(right, F.lit(1))
    line = a.y + (b.y - a.y) * (x - a.x) / (b.x - a.x)
    return F.when(F.coalesce(F.size(knots), F.lit(0)) <= 0, x).when(x.isNull(), x).when(a.isNull(), b.y).when(b.isNull(), a.y).otherwise(line)


def scored(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """Adds yhat: blend of l1 and l2, spike policy, dip policy, blend with the naive forecast, calibration; one pass.

    df: h and the models' predictions l1, l2, p_spike, spike_l1, spike_p90, p_dip, dip_l1, and naive; a model that a horizon lacks is a
    null column or value. parameters: PARAMETERS, one row for each horizon (a small table); what is null there falls back: no
    second model, the plain mix, thresholds 0.20 and 0.15, no naive share, no calibration.
    """
    x = df.join(F.broadcast(parameters), "h", "left")
    c, lit = F.col, F.lit
    alpha = F.when(c("l2").isNotNull(), F.coalesce("alpha", lit(0.0))).otherwise(0.0)
    x = x.withColumn("__base", blend.blend(c("l1"), F.coalesce("l2", "l1"), alpha))
    one = F.coalesce("spike_l1", "__base")
    nine = F.coalesce("spike_p90", one)
    source = F.when(c("spike_source") == "max", F.greatest(nine, one)).when(c("spike_source") == "l1", one).otherwise(nine)
    spiked = blend.spike_policy(c("__base"), c("p_spike"), source, F.coalesce("spike_mode", lit(0)), F.coalesce("spike_threshold", lit(0.20)), F.coalesce("spike_power", lit(2.0)), F.coalesce("spike_weight", lit(0.75)))
    x = x.withColumn("__base", F.when(c("p_spike").isNotNull(), spiked).otherwise(c("__base")))
    dipped = blend.dip_policy(c("__base"), c("p_dip"), c("dip_l1"), F.coalesce("dip_mode", lit(0)), F.coalesce("dip_threshold", lit(0.15)), F.coalesce("dip_power", lit(1.0)), F.coalesce("dip_weight", lit(0.60)))
    x = x.withColumn("__base", F.when(c("p_dip").isNotNull() & c("dip_l1").isNotNull(), dipped).otherwise(c("__base")))
    share = clip(F.coalesce("model_share", lit(1.0)), 0, 1)
    x = x.withColumn("__base", F.when((share < 1) & c("naive").isNotNull(), share * c("__base") + (1 - share) * c("naive")).otherwise(c("__base")))
    return x.withColumn("yhat", interpolated(c("__base"), c("knots"))).select(*(f"`{n}`" for n in df.columns), "yhat")
