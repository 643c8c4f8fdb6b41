"""Checks of a loaded table: missing values by year, and completeness of its grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def null_profile(df: DataFrame, columns: Sequence[str], ts: str = "ts") -> DataFrame:
    """Missing values of each column, in number and share, by year and in total (year null)."""
    counted = df.rollup(F.year(ts).alias("year")).agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    long = counted.unpivot(["year", "rows"], list(columns), "column", "nulls")
    return long.select("year", "column", "nulls", F.round(F.col("nulls") / F.col("rows"), 4).alias("share"))


def completeness(df: DataFrame, step: int, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Start, end, expected and actual number of times of each series, and how many are missing."""
    out = df.groupBy(*keys).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.countDistinct(ts).alias("actual"))
    expected = ((F.unix_timestamp("end") - F.unix_timestamp("start")) / step + 1).cast("long")
    return out.withColumn("expected", expected).withColumn("missing", F.col("expected") - F.col("actual"))


def gaps(df: DataFrame, step: int, keys: Sequence[str] = (), ts: str = "ts", rows: int = 2880) -> DataFrame:
    """(keys, begin, steps): runs of grid times between the first and the last of a series that no row has.

    Neighbours within blocks of `rows` steps, and blocks' ends against the next block with rows: the second window has one row for each block.
    """
    x = df.select(*keys, F.unix_timestamp(ts).alias("__t")).withColumn("__block", F.floor(F.col("__t") / (step * rows)))
    x = x.repartition(*keys, "__block").distinct()
    after = F.lead("__t").over(Window.partitionBy(*keys, "__block").orderBy("__t"))
    inside = x.withColumn("__next", after).where(F.col("__next") - F.col("__t") > step).select(*keys, "__t", "__next")
    ends = x.groupBy(*keys, "__block").agg(F.min("__t").alias("__first"), F.max("__t").alias("__t"))
    between = ends.withColumn("__next", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__block"))).where(F.col("__next") - F.col("__t") > step).select(*keys, "__t", "__next")
    found = inside.unionByName(between)
    return found.select(*keys, F.timestamp_seconds(F.col("__t") + step).alias("begin"), F.ceil((F.col("__next") - F.col("__t")) / step - 1).alias("steps"))


def missing_times(df: DataFrame, step: int, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Grid times between the first and the last of each series that no row has: its gaps, written out."""
    k = F.explode(F.sequence(F.lit(0), F.col("steps").cast("int") - 1)).alias("__k")
    return gaps(df, step, keys, ts).select(*keys, "begin", k).select(*keys, F.timestamp_seconds(F.unix_timestamp("begin") + F.col("__k") * step).alias(ts))
