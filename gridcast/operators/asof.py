"""As-of join, time interpolation and alignment of forecast vintages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.operators.rolling import filled


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], values: Sequence[str], ts: str = "ts", right_ts: str = "ts", width: int | None = None) -> DataFrame:
    """For each left row the newest right row of the same key at or before its time; none gives nulls.

    Both sides are laid in one line per key, a right row ahead of left rows of the same time, and the last right row is
    carried along: one shuffle and one sort. Of several right rows at one time the largest by its values counts. For few keys with long lines,
    `width` cuts a line into pieces of so many seconds; the last right row of each piece is then carried on in a window with one row for each.
    """
    packed = F.struct(F.col(right_ts).alias("at"), *values)
    names = left.columns
    a = left.select("*", F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("__p"), F.col(ts).alias("__t"), F.lit(1).alias("__side"))
    b = right.select(*(F.col(k) if k in by else F.lit(None).cast(left.schema[k].dataType).alias(k) for k in names), packed.alias("__p"), F.col(right_ts).alias("__t"), F.lit(0).alias("__side"))
    line = a.unionByName(b)
    if width is None:
        w = Window.partitionBy(*by).orderBy("__t", "__side", "__p").rowsBetween(Window.unboundedPreceding, 0)
        out = line.withColumn("__got", F.last("__p", ignorenulls=True).over(w))
    else:
        line = line.withColumn("__piece", F.floor(F.unix_timestamp("__t") / width))
        w = Window.partitionBy(*by, "__piece").orderBy("__t", "__side", "__p").rowsBetween(Window.unboundedPreceding, 0)
        ends = line.groupBy(*by, "__piece").agg(F.max(F.when(F.col("__side") == 0, F.struct("__t", "__p"))).alias("__end"))
        before = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*by, "__piece", F.last("__end", ignorenulls=True).over(before)["__p"].alias("__carry"))
        out = line.withColumn("__in", F.last("__p", ignorenulls=True).over(w)).join(carried, [*by, "__piece"]).withColumn("__got", F.coalesce("__in", "__carry"))
    return out.where("__side = 1").select(*names, F.col("__got.at").alias("matched_ts"), *(F.col(f"__got.{v}").alias(v) for v in values))


def interpolate_time(df: DataFrame, x: str, keys: Sequence[str], ts: str = "ts", name: str | None = None, step: int = 3600, rows: int = 2880) -> DataFrame:
    """Linear in time between the values around a gap; the last value is carried to the end, the beginning stays null. The neighbours are found in blocks of `rows` steps."""
    seen = F.when(F.col(x).isNotNull(), F.struct(F.unix_timestamp(ts).alias("t"), F.col(x).alias("x")))
    out = filled(df.withColumn("__seen", seen), "__seen", "__a", step, keys, ts, rows)
    out = filled(out, "__seen", "__b", step, keys, ts, rows, backward=True).drop("__seen")
    a, b = (lambda f: F.col(f"__a.{f}")), (lambda f: F.col(f"__b.{f}"))
    between = a("x") + (b("x") - a("x")) * (F.unix_timestamp(ts) - a("t")) / F.nullif(b("t") - a("t"), F.lit(0))
    return out.withColumn(name or x, F.coalesce(F.col(x), between, a("x"))).select(*df.columns, *([name] if name and name not in df.columns else []))


def horizon(run: Column, interval: Column, seconds: int) -> Column:
    """Whole steps from run to interval, rounded up."""
    return F.ceil((F.unix_timestamp(interval) - F.unix_timestamp(run)) / seconds).cast("int")


def latest_vintage(grid: DataFrame, vintages: DataFrame, by: Sequence[str], value: str | Sequence[str], seconds: int, run: str = "run_ts", interval: str = "interval_ts", ts: str = "ts", most: int | None = None) -> DataFrame:
    """For each grid time the newest run at or before it, its intervals from one step ahead on, averaged by horizon.

    grid: ts and the keys; vintages: run, interval, keys, values. Returns ts, keys, h, values. Only the distinct runs take
    part in the as-of join; the vintages meet their run in an equi-join on (keys, run).
    """
    values = [value] if isinstance(value, str) else list(value)
    runs = vintages.select(*by, F.col(run).alias("run_at")).distinct()
    matched = asof_backward(grid.select(ts, *by), runs.withColumn("one", F.lit(1)), by, ["one"], ts, "run_at").where("matched_ts is not null")
    v = vintages.select(*by, F.col(run).alias("matched_ts"), F.col(interval).alias("__i"), *values)
    h = horizon(F.col(ts), F.col("__i"), seconds)
    out = matched.join(v, [*by, "matched_ts"]).withColumn("h", h).where("h >= 1")
    if most is not None:
        out = out.where(F.col("h") <= most)
    return out.groupBy(ts, *by, "h").agg(*(F.avg(c).alias(c) for c in values))


def carried_vintage(grid: DataFrame, vintages: DataFrame, by: Sequence[str], values: Sequence[str], seconds: int, horizons: int, start: Column, ts: str = "ts", **names: str) -> DataFrame:
    """The newest run's forecasts on every grid time from `start` on, for each key and horizon; a horizon that the newest run lacks keeps its last forecast.

    grid begins a lookback before `start`, so that runs published there reach into the window. Returns ts, keys, h, values, dense in h. The fill's
    windows are by (keys, h).
    """
    found = latest_vintage(grid, vintages, by, values, seconds, ts=ts, most=horizons, **names)
    dense = grid.select(ts, *by).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizons)))).join(found, [ts, *by, "h"], "left")
    w = Window.partitionBy(*by, "h").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    filled = dense.select(ts, *by, "h", *(F.last(v, ignorenulls=True).over(w).alias(v) for v in values))
    return filled.where(F.col(ts) >= start)


def vintage_columns(carried: DataFrame, key: str, names: Sequence[str], values: Sequence[str], horizons: int, ts: str = "ts") -> DataFrame:
    """One row for each time with a column <value>_<key>_h<h> for each value, key and horizon; keys in lower case, dashes as underscores."""
    clean = lambda n: n.lower().replace("-", "_")
    picked = [F.max(F.when((F.col(key) == n) & (F.col("h") == h), F.col(v))).alias(f"{v}_{clean(n)}_h{h}") for v in values for n in names for h in range(1, horizons + 1)]
    return carried.groupBy(ts).agg(*picked)
