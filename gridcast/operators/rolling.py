"""Backward-looking row windows over one dense series per key, with explicit minimum counts.

A window of w rows ends at the current row. Without `least` it needs all w values; with it, that many non-null ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.scalar import clip, col, flag
from gridcast.operators.grid import position

AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}


class Series:
    """Window expressions over the rows of one key in time order."""

    def __init__(self, keys: Sequence[str] = ("region",), ts: str = "ts"):
        self.keys, self.ts = list(keys), ts
        self.order = Window.partitionBy(*keys).orderBy(ts)

    def frame(self, w: int, shift: int = 0):
        return self.order.rowsBetween(-(w - 1) - shift, -shift)

    def lag(self, x: Column | str, k: int) -> Column:
        return F.lag(col(x), k).over(self.order) if k >= 0 else F.lead(col(x), -k).over(self.order)

    def lead(self, x: Column | str, k: int) -> Column:
        return self.lag(x, -k)

    def diff(self, x: Column | str, k: int) -> Column:
        return col(x) - self.lag(x, k)

    def diff2(self, x: Column | str, k: int, limit: float = 2000.0) -> Column:
        return clip(col(x) - 2 * self.lag(x, k) + self.lag(x, 2 * k), -limit, limit)

    def roll(self, agg: str, x: Column | str, w: int, least: int | None = None, shift: int = 0) -> Column:
        f = self.frame(w, shift)
        return F.when(F.count(col(x)).over(f) >= (w if least is None else least), AGGREGATES[agg](col(x)).over(f))

    def count_if(self, condition: Column, w: int, least: int | None = None) -> Column:
        """How many rows of the window meet the condition (unknown counts as no); needs rows, not values."""
        return self.roll("sum", flag(condition), w, least)

    def quantile(self, x: Column | str, q: float, w: int, least: int | None = None) -> Column:
        """Linear interpolation between the two nearest ranks."""
        f = self.frame(w)
        return F.when(F.count(col(x)).over(f) >= (w if least is None else least), F.percentile(col(x), F.lit(q)).over(f))

    def pct_rank(self, x: Column | str, w: int, least: int | None = None) -> Column:
        """Average rank of the current value among the window's values, as a share of their number."""
        x = col(x)
        values = F.collect_list(x).over(self.frame(w))
        below = F.size(F.filter(values, lambda v: v < x))
        equal = F.size(F.filter(values, lambda v: v == x))
        return F.when(x.isNotNull() & (F.size(values) >= (w if least is None else least)), (below + (equal + 1) / 2) / F.size(values))

    def ffill(self, x: Column | str) -> Column:
        return F.last(col(x), ignorenulls=True).over(self.order.rowsBetween(Window.unboundedPreceding, 0))

    def bfill(self, x: Column | str) -> Column:
        return F.first(col(x), ignorenulls=True).over(self.order.rowsBetween(0, Window.unboundedFollowing))

    def pct_change(self, padded: Column | str, k: int, limit: float = 1.0) -> Column:
        """Relative change over k rows of a series that has been filled forward."""
        return clip(F.try_divide(col(padded), self.lag(padded, k)) - 1, -limit, limit)

    def row(self) -> Column:
        return F.row_number().over(self.order)

    def rows_since(self, condition: Column, step: int, cap: int) -> Column:
        """Grid rows since the condition last held, at most `cap`; `cap` where it never did."""
        pos = position(self.ts, step)
        last = F.last(F.when(condition, pos), ignorenulls=True).over(self.order.rowsBetween(Window.unboundedPreceding, 0))
        return F.least(F.coalesce(pos - last, F.lit(cap)), F.lit(cap)).cast("double")

    def seen_in(self, condition: Column, w: int) -> Column:
        return self.roll("max", flag(condition), w, 1)


def wide_mean(df: DataFrame, x: str, w: int, least: int, name: str, keys: Sequence[str] = ("region",), ts: str = "ts", agg: str = "mean") -> DataFrame:
    """Rolling mean, sum or standard deviation of a long window in two linear passes: running sums of the centred series, and their difference over w rows.

    A sliding frame is evaluated anew for each row; from about 300 rows on this form is faster. The centre (the series'
    mean, one row per key) keeps the sums small, so little is lost by cancellation.
    """
    s = Series(keys, ts)
    running = s.order.rowsBetween(Window.unboundedPreceding, 0)
    centred = F.coalesce(F.col(x) - F.col("__c"), F.lit(0.0))
    out = df.withColumn("__c", F.avg(x).over(Window.partitionBy(*keys)))
    out = out.withColumn("__n", F.count(x).over(running)).withColumn("__s", F.sum(centred).over(running)).withColumn("__q", F.sum(centred * centred).over(running))
    n, total, square = (F.col(c) - F.coalesce(s.lag(c, w), F.lit(0)) for c in ("__n", "__s", "__q"))
    value = {
        "mean": F.try_divide(total, n) + F.col("__c"),
        "sum": total + n * F.col("__c"),
        "std": F.sqrt(F.greatest(F.try_divide(square - F.try_divide(total * total, n), n - 1), F.lit(0.0))),
    }[agg]
    return out.withColumn(name, F.when(n >= least, value)).drop("__c", "__n", "__s", "__q")


def wide_extreme(df: DataFrame, x: str, w: int, least: int, name: str, step: int, keys: Sequence[str] = ("region",), ts: str = "ts", agg: str = "max") -> DataFrame:
    """Rolling minimum or maximum of a long window on a dense grid in linear time.

    Rows are cut into blocks of w rows; a window of w rows is the end of one block and the beginning of the next, so the
    extreme so far inside the block and the extreme of the rest of the block w - 1 rows back are enough.
    """
    s = Series(keys, ts)
    f, pick = AGGREGATES[agg], F.greatest if agg == "max" else F.least
    inside = Window.partitionBy(*keys, "__b").orderBy(ts)
    out = df.withColumn("__b", F.floor(position(ts, step) / w))
    out = out.withColumn("__p", f(x).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__r", f(x).over(inside.rowsBetween(0, Window.unboundedFollowing)))
    running = s.order.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("__n", F.count(x).over(running))
    n = F.col("__n") - F.coalesce(s.lag("__n", w), F.lit(0))
    early = F.when(s.row() >= w, s.lag("__r", w - 1)).otherwise(f(x).over(running))
    return out.withColumn(name, F.when(n >= least, pick(F.col("__p"), early))).drop("__b", "__p", "__r", "__n")


def filled(df: DataFrame, x: str, name: str, step: int, keys: Sequence[str] = (), ts: str = "ts", rows: int = 2880, backward: bool = False) -> DataFrame:
    """Forward (or backward) fill of each key's series without one task for all of it: fill inside blocks of `rows` grid rows, then carry each block's last value on.

    The second step's window has one row for each key and block.
    """
    inside = Window.partitionBy(*keys, "__block").orderBy(F.desc(ts) if backward else F.col(ts)).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__block", F.floor(position(ts, step) / rows)).withColumn("__in", F.last(x, ignorenulls=True).over(inside))
    end = (F.min_by if backward else F.max_by)(x, F.when(F.col(x).isNotNull(), F.col(ts)))
    ends = out.groupBy(*keys, "__block").agg(end.alias("__end"))
    over = Window.partitionBy(*keys).orderBy(F.desc("__block") if backward else F.col("__block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "__block", F.last("__end", ignorenulls=True).over(over).alias("__carry"))
    return out.join(carried, [*keys, "__block"]).withColumn(name, F.coalesce("__in", "__carry")).drop("__block", "__in", "__carry")


def rolling_by_day(df: DataFrame, x: str, ts: str = "ts") -> DataFrame:
    """Forward fill of one unkeyed series by days; the second step's window has one row for each day."""
    return filled(df, x, f"{x}_filled", 86400, (), ts, 1)
