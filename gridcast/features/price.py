"""Price feature families of one region's dense series (columns: ts, region, price). Each family maps names to columns.

Row counts are parameters of the families; the defaults are the published ones. Thresholds too, because hourly means
rarely reach the levels of five-minute prices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.scalar import asinh100, clip, cos_turn, flag, row_min, row_sum, sin_turn
from gridcast.operators import windows
from gridcast.operators.grid import wide
from gridcast.operators.rolling import Series

# The lags and windows that define the families.
ASINH_LAGS = (1, 2, 4, 12, 48, 96, 336, 335, 337)
ASINH_WINDOWS = (48, 336)
LAGS = (1, 2, 3, 4, 6, 8, 12, 24, *range(26, 71, 2), 48, 49, 50, 51, 52, 96, 97, 98, 143, 144, 145, 191, 192, 193, 335, 336, 337, 671, 672, 673)
WINDOWS = (4, 8, 24, 48, 96, 336, 672, 2016)
YEAR = 17532
RECENT_HOURS = (1, 6, 12, 24, 48, 168)

Family = dict[str, Column]


def asinh_lags(s: Series, x: str = "price") -> Family:
    out = {f"asinh_lag_{k}": s.lag(asinh100(x), k) for k in ASINH_LAGS}
    return out | {f"asinh_rmean_{w}": s.roll("mean", asinh100(x), w) for w in ASINH_WINDOWS}


def lags(s: Series, x: str = "price") -> Family:
    return {f"lag_{k}": s.lag(x, k) for k in sorted(set(LAGS))}


def long_range(s: Series, x: str = "price", base: int = YEAR, w: int = 96, least: int = 24, spike: float = 300.0) -> Family:
    """The same time a year ago. A lag of a lag is a shifted frame, so all of these are one window."""
    out: Family = {}
    for o in range(-2, 3):
        sign = f"+{o}" if o >= 0 else str(o)
        out[f"lag_annual_{sign}"] = s.lag(x, base + o)
        out[f"asinh_lag_annual_{sign}"] = s.lag(asinh100(x), base + o)
    for agg in ("mean", "max", "std"):
        out[f"annual_r{agg}_{w}"] = s.roll(agg, x, w, least, base)
    rows = F.count(F.lit(1)).over(s.frame(w))
    hits = F.sum(flag(F.col(x) >= spike)).over(s.frame(w, base))
    out[f"annual_spike_{w}"] = F.when(rows >= least, F.coalesce(hits, F.lit(0.0)))
    past = s.lag(x, base)
    out["yoy_change"] = F.col(x) - past
    out["yoy_ratio"] = clip(F.col(x) / (F.abs(past) + 1), 0, 20)
    return out


def rolling(s: Series, x: str = "price", spans: Sequence[int] = WINDOWS) -> Family:
    return {f"r{agg}_{w}": s.roll(agg, x, w, max(1, w // 2)) for w in spans for agg in ("mean", "std", "max", "min")}


def rolling_long(df: DataFrame, step: int, x: str = "price", spans: Sequence[int] = WINDOWS, keys: Sequence[str] = ("region",), rows: int = 8640) -> DataFrame:
    """The rolling family as columns of ts, keys: all windows of a block at once, from the same running sums and block extremes."""
    made = [windows.Rolled(f"r{agg}_{w}", x, w, max(1, w // 2), None, agg) for w in spans for agg in ("mean", "std", "max", "min")]
    return windows.rolled(df.select("ts", *keys, x), made, step, keys, rows=rows).drop(x)


def regime(s: Series, x: str = "price", spike: float = 300.0) -> Family:
    return {
        "spike_flag_48": flag(s.roll("max", x, 48) > spike),
        "neg_flag_48": flag(s.roll("min", x, 48) < 0),
        "q90_336": s.quantile(x, 0.9, 336),
        "q10_336": s.quantile(x, 0.1, 336),
        "pct_rank_48": s.pct_rank(x, 48),
    }


def since_spike(s: Series, x: str = "price", levels: Sequence[float] = (150, 300, 1000), step: int = 1800, cap: int = 672, rows_per_hour: int = 2) -> Family:
    out: Family = {}
    for level in levels:
        hit = F.col(x) >= level
        hours = s.rows_since(hit, step, cap) / rows_per_hour
        out[f"hours_since_spike_{level:g}"] = hours
        out[f"log1p_hours_since_spike_{level:g}"] = F.log1p(hours)
        for h in RECENT_HOURS:
            out[f"spike_{level:g}_last_{h}h"] = s.seen_in(hit, h * rows_per_hour)
    out["hours_since_any_spike"] = row_min(*(out[f"hours_since_spike_{level:g}"] for level in levels))
    return out


def predictors(s: Series, x: str = "price", spike: float = 300.0, intense: float = 150.0) -> Family:
    p = F.col(x)
    out = {f"mom_{k}": s.diff(x, k) for k in (4, 12, 48)}
    out |= {f"accel_{k}": s.diff2(x, k) for k in (4, 12)}
    out |= {f"spike_count_{w}": s.count_if(p >= spike, w) for w in (48, 336)}
    out["neg_count_48"] = s.count_if(p < 0, 48)
    out |= {f"spike_intensity_{w}": s.roll("sum", clip(p - intense, 0), w) for w in (48, 336)}
    out["pct_rank_336"] = s.pct_rank(x, 336)
    return out


def cross_region(df: DataFrame, regions: Sequence[str], step: int, x: str = "price", level: float = 150.0) -> DataFrame:
    """Spreads of each ordered pair of regions and their previous value, spike in all regions, number of regions in spike: one row per time.

    On a dense grid the previous row is the one a step earlier, so the lag is an equi-join and no window over all times.
    """
    w = wide(df, "region", regions, [x])
    spreads = {f"{a}_vs_{b}_spread": F.col(f"{x}_{a}") - F.col(f"{x}_{b}") for a in regions for b in regions if a != b}
    hits = [flag(F.col(f"{x}_{r}") >= level) for r in regions]
    out = w.select("ts", *(c.alias(n) for n, c in spreads.items()), row_min(*hits).alias("multi_region_spike"), row_sum(*hits).alias("region_spike_count"))
    previous = out.select((F.col("ts") + F.make_interval(secs=F.lit(step))).alias("ts"), *(F.col(n).alias(f"{n}_lag_1") for n in spreads))
    return out.join(previous, "ts", "left")


def cross_year(df: DataFrame, live: str = "sa", base: str = "nsw", x: str = "price") -> DataFrame:
    """Season of the year and the clipped asinh spread of two regions: one row per time."""
    w = wide(df, "region", [live, base], [x])
    day = F.dayofyear("ts")
    spread = (F.coalesce(F.col(f"{x}_{live}"), F.lit(0.0)) - F.coalesce(F.col(f"{x}_{base}"), F.lit(0.0))) / 100
    return w.select("ts", sin_turn(day, 365.25).alias("doy_sin"), cos_turn(day, 365.25).alias("doy_cos"), clip(F.asinh(spread), -10, 10).alias(f"{live}_spread_live"))
