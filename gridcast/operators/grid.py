"""Dense time grids: bucketing, gap rows, row positions, and blocks with a halo for parallel windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3600


def steps(seconds: int, step: int) -> int:
    """How many grid rows a duration has."""
    return seconds // step


def bucket(ts: Column | str, step: int) -> Column:
    """Left edge of the bucket of `step` seconds that holds ts."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts.cast("timestamp")) / step) * step)


def position(ts: Column | str, step: int) -> Column:
    """Row position on an absolute grid: needs no window and no first row."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_timestamp(ts) / step)


def bounds(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))


def calendar(span: DataFrame, step: int, ts: str = "ts") -> DataFrame:
    """One row for each step of [lo, hi]; span has one row (lo, hi). Below a day, days are exploded first, so that one row isn't a task's whole work."""
    width = F.make_interval(secs=F.lit(step))
    if step >= 86400:
        return span.select(F.explode(F.sequence("lo", "hi", width)).alias(ts))
    days = span.select("lo", "hi", F.explode(F.sequence(F.date_trunc("day", "lo"), F.date_trunc("day", "hi"), F.expr("interval 1 day"))).alias("d"))
    at = F.explode(F.sequence(F.col("d"), F.col("d") + F.expr("interval 1 day") - width, width))
    return days.select("lo", "hi", at.alias(ts)).where(F.col(ts).between(F.col("lo"), F.col("hi"))).select(ts)


def bucket_mean(df: DataFrame, step: int, keys: Sequence[str], values: Sequence[str], ts: str = "ts") -> DataFrame:
    """Mean by bucket and key; only buckets that hold rows."""
    return df.groupBy(bucket(ts, step).alias(ts), *keys).agg(*(F.avg(v).alias(v) for v in values))


def densify(df: DataFrame, step: int, dimensions: DataFrame, keys: Sequence[str], ts: str = "ts", span: DataFrame | None = None) -> DataFrame:
    """Every step of the span for every row of `dimensions` (a small table of key values); what is missing is null."""
    grid = calendar(span if span is not None else bounds(df, ts), step, ts).crossJoin(F.broadcast(dimensions))
    return grid.join(df, [ts, *keys], "left")


def regularise(df: DataFrame, step: int, dimensions: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str = "ts") -> DataFrame:
    """Bucket means on the dense grid."""
    found = bucket_mean(df, step, keys, values, ts)
    return densify(found, step, dimensions, keys, ts)


def wide(df: DataFrame, key: str, names: Sequence[str], values: Sequence[str], ts: str = "ts") -> DataFrame:
    """One column for each value and key, `<value>_<key>`; the key's values are given, so no extra pass finds them."""
    picked = [F.max(F.when(F.col(key) == n, F.col(v))).alias(f"{v}_{n}") for v in values for n in names]
    return df.groupBy(ts).agg(*picked)


def blocks(df: DataFrame, step: int, rows: int, before: int, after: int = 0, ts: str = "ts") -> DataFrame:
    """Cuts every series into blocks of `rows` grid rows, each with the `before` rows ahead of it (and `after` behind it).

    Adds `block` and `own` (false for halo rows). Windows are then partitioned by (keys, block), so a series of any
    length is worked on in parallel; the overhead is 1 + (before + after) / rows.
    """
    pos = position(ts, step)
    first, last = F.floor((pos - after) / rows), F.floor((pos + before) / rows)
    out = df.withColumn("block", F.explode(F.sequence(first, last)))
    return out.withColumn("own", F.col("block") == F.floor(pos / rows))
