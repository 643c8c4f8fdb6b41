"""Exact quantiles of large groups in two passes, so that no task holds a group's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rank accuracy of the first pass: its bounds hold about 6 / ACCURACY of a group's rows.
ACCURACY = 10_000


def quantile(df: DataFrame, x: str, q: float, name: str, per: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """The q-quantile of each group, linear between the two nearest ranks; null for a group without values.

    The first pass finds two values that enclose the quantile's rank, and the group's size; the second counts what lies below
    them and sorts only what lies between, counted by value, so ties cost one row.
    """
    d = df.select(*per, F.col(x).cast("double").alias("__x"))
    wide = 3 / accuracy
    ends = F.percentile_approx("__x", F.array(F.lit(max(0.0, q - wide)), F.lit(min(1.0, q + wide))), F.lit(accuracy))
    bounds = d.groupBy(*per).agg(F.count("__x").alias("__n"), F.min("__x").alias("__least"), F.max("__x").alias("__most"), ends.alias("__e"))
    # in a small group a step between ranks is wider than the margin
    low = F.when(F.lit(q - wide <= 0) | (F.col("__n") <= accuracy), F.col("__least")).otherwise(F.col("__e")[0])
    high = F.when(F.lit(q + wide >= 1) | (F.col("__n") <= accuracy), F.col("__most")).otherwise(F.col("__e")[1])
    bounds = bounds.select(*per, "__n", low.alias("__low"), high.alias("__high"))
    # one row for each group
    met = d.join(bounds, list(per)) if per else d.crossJoin(F.broadcast(bounds))
    met = met.where(F.col("__x") <= F.col("__high"))
    inside = F.when(F.col("__x") >= F.col("__low"), F.col("__x"))  # null: below the bounds
    counted = met.select(*per, "__n", inside.alias("__v")).groupBy(*per, "__n", "__v").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*per).orderBy(F.col("__v").asc_nulls_first())
    upto = F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rank = F.lit(q) * (F.col("__n") - 1)
    ranked = counted.withColumn("__upto", upto).withColumn("__r", rank)
    at = lambda r: F.min(F.when(F.col("__upto") > r, F.col("__v")))
    picked = ranked.groupBy(*per).agg(F.first("__r").alias("__r"), at(F.floor("__r")).alias("__a"), at(F.ceil("__r")).alias("__b"))
    value = F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__r") - F.floor("__r"))
    if not per:
        return picked.select(value.alias(name))
    return bounds.select(*per).join(picked, list(per), "left").select(*per, value.alias(name))
