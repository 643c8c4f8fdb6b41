"""Calendar, system, generation, gas, weather, forecast, offer and interaction features.

All but the calendar are families over one dense series per region: they take a Series and return names and columns. Each
feature named _ahead, and solar_ramp, solar_stress and solar_through_cloud, read later rows (the weather of the target time
stands in for its forecast).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.scalar import asinh100, clip, cos_turn, flag, ratio, row_max, sin_turn
from gridcast.operators import windows
from gridcast.operators.rolling import Series

Family = dict[str, Column]
LAGS = (1, 2, 4, 48, 96, 336)


def calendar(ts: str = "ts", holiday: Column | None = None) -> Family:
    """Parts of the time, their turns, and the hours of peak, shoulder and night. holiday: whether the day is one."""
    hour, dow, month, doy = F.hour(ts), F.weekday(ts), F.month(ts), F.dayofyear(ts)
    weekend, off = flag(dow >= 5), flag(holiday) if holiday is not None else F.lit(0.0)
    out = {"hour": hour, "dayofweek": dow, "month": month, "dayofyear": doy}
    for name, x, n in (("hour", hour, 24), ("dow", dow, 7), ("month", month - 1, 12)):
        out |= {f"{name}_sin": sin_turn(x, n), f"{name}_cos": cos_turn(x, n)}
    out |= {"is_weekend": weekend, "is_holiday": off, "is_peak": flag(hour.between(17, 20)), "is_shoulder": flag((hour >= 7) & (hour < 17))}
    return out | {"is_off_peak": flag((hour < 7) | (hour >= 21)), "is_offday": row_max(weekend, off)}


def with_calendar(df: DataFrame, holidays: DataFrame, ts: str = "ts") -> DataFrame:
    """holidays: one row for each date (a small table). Adds all calendar features."""
    marked = df.withColumn("__d", F.to_date(ts)).join(F.broadcast(holidays.select(F.col("date").alias("__d"), F.lit(True).alias("__h")).distinct()), "__d", "left")
    return marked.select("*", *(c.alias(n) for n, c in calendar(ts, F.coalesce("__h", F.lit(False))).items())).drop("__d", "__h")


def target_calendar(df: DataFrame, horizons: int, minutes: int, ts: str = "ts") -> DataFrame:
    """Calendar of the target time for each horizon."""
    h = df.select(ts, F.explode(F.sequence(F.lit(1), F.lit(horizons))).alias("h"))
    m = F.hour(ts) * 60 + F.minute(ts) + F.col("h") * minutes
    hr, dow = F.pmod(m, F.lit(1440)) / 60.0, F.pmod(F.weekday(ts) + F.floor(m / 1440), F.lit(7))
    return h.select(
        ts, "h",
        sin_turn(hr, 24).alias("target_hour_sin"), cos_turn(hr, 24).alias("target_hour_cos"),
        sin_turn(dow, 7).alias("target_dow_sin"), cos_turn(dow, 7).alias("target_dow_cos"),
        flag(dow >= 5).alias("target_is_weekend"), flag((hr >= 17) & (hr < 21)).alias("target_is_evening"),
        flag((hr >= 7) & (hr < 17)).alias("target_is_day"), flag((hr < 7) | (hr >= 21)).alias("target_is_overnight"),
    )


def system(s: Series, dispatched: bool = True) -> Family:
    ag, dm, ic, dc, dg = (F.col(c) for c in ("avail_gen", "demand", "interchange", "demand_forecast", "dispatch_gen"))
    margin = clip(ratio(ag - dm, dm), -2, 10)
    out = {"reserve_margin": margin, "reserve_margin_pct": clip(ratio(ag, dm), 0, 5), "demand_fcst_error": dc - dm}
    out |= {f"avail_gen_lag_{k}": s.lag(ag, k) for k in LAGS} | {f"interchange_lag_{k}": s.lag(ic, k) for k in LAGS}
    out |= {f"demand_forecast_lag_{k}": s.lag(dc, k) for k in (1, 2, 48)} | {f"interchange_rmean_{w}": s.roll("mean", ic, w) for w in (48, 336)}
    out |= {"reserve_margin_rmean_48": s.roll("mean", margin, 48), "reserve_margin_rmin_48": s.roll("min", margin, 48)}
    if dispatched:
        surplus = clip(ag - dg, -2000, 8000)
        out |= {"thermal_util": clip(ratio(dg, ag), 0, 1.5), "thermal_surplus_mw": surplus} | {f"dispatch_gen_lag_{k}": s.lag(dg, k) for k in LAGS}
        out |= {f"dispatch_gen_change_{k}": s.diff(dg, k) for k in (8, 48)} | {f"dispatch_gen_r{a}_48": s.roll(a, dg, 48) for a in ("min", "mean")}
        out["thermal_surplus_rmin_48"] = s.roll("min", surplus, 48)
    return out


def demand(s: Series, year: int = 17532, long: Sequence[int] = (672, 2016), means: dict[int, Column] | None = None) -> Family:
    """means: the means of some windows, if they are columns already."""
    out = {f"demand_lag_{k}": s.lag("demand", k) for k in (48, 96, 336, 672)} | {"demand_lag_annual": s.lag("demand", year)}
    out |= {f"demand_long_rmean_{w}": (means or {}).get(w, s.roll("mean", "demand", w, w // 2)) for w in long}
    return out | {f"demand_rmean_{w}": s.roll("mean", "demand", w, 1) for w in (4, 24, 48, 96)}


def stress(s: Series, padded: str = "avail_gen_filled") -> Family:
    """padded: available generation filled forward, for the relative change."""
    ag, dm, dc = F.col("avail_gen"), F.col("demand"), F.col("demand_forecast")
    load, forward = ratio(dm, ag), clip(dc - ag, -5000, 5000)
    out = {"supply_stress": clip(load, 0, 2)} | {f"supply_stress_rmax_{w}": s.roll("max", clip(load, 0, 2), w) for w in (48, 96)}
    out |= {f"tight_count_{w}": s.count_if(load > 0.92, w) for w in (48, 336)} | {"avail_gen_change_48": s.pct_change(padded, 48)}
    out |= {f"avail_gen_rmin_{w}": s.roll("min", ag, w) for w in (48, 96)}
    out |= {"demand_surprise": dm - dc, "demand_surprise_abs": F.abs(dm - dc), "demand_surprise_rmean_48": s.roll("mean", dm - dc, 48)}
    return out | {"supply_headroom_pct": clip(ratio(ag - dm, dm), -0.5, 1), "fwd_tight_proxy": forward, "fwd_tight_proxy_lag_48": s.lag(forward, 48)}


def coal(s: Series, most: float, x: str = "coal_mw", drop: float = 600.0) -> Family:
    c = F.col(x)
    out = {f"coal_lag_{k}": s.lag(c, k) for k in LAGS} | {f"coal_rmean_{w}": s.roll("mean", c, w) for w in (4, 48)} | {f"coal_rmin_{w}": s.roll("min", c, w) for w in (48, 96)}
    out |= {f"coal_change_{k}": s.diff(c, k) for k in (2, 12, 48)} | {"coal_outage_flag": flag(s.roll("min", c, 4) < s.lag(c, 4) - drop), "coal_util": clip(c / most, 0, 1.05)}
    return out | {"coal_low_flag": flag(c < 0.55 * most)} | {f"coal_low_count_{w}": s.count_if(c < 0.55 * most, w) for w in (48, 336)}


def gas(s: Series, x: str = "gas_price", day: int = 48, regime: int = 8640, ranks: Sequence[Column] | None = None) -> Family:
    """day: rows of a day; the lags and windows are 1, 2, 7 and 30 days. ranks: the week's rank, the month's rank, the regime's quantile and the means of both, if they are columns already."""
    g, week, month = F.col(x), 7 * day, 30 * day
    one, two, high, *means = ranks or (s.pct_rank(g, week, day // 2), s.pct_rank(g, month, week), s.quantile(g, 0.75, regime, week), s.roll("mean", g, week, 1), s.roll("mean", g, month, 1))
    out = {"gas_srmc": g * 10} | {f"gas_lag_{k}": s.lag(g, k) for k in (day, 2 * day, week, month)}
    out |= {f"gas_rmean_{w}": m for w, m in zip((week, month), means, strict=True)}
    out |= {f"gas_roc_{k}": clip(ratio(s.diff(g, k), s.lag(g, k), 0.01), -2, 2) for k in (week, month)}
    out |= {"gas_spread": g - means[1], f"gas_pct_rank_{week}": one, f"gas_pct_rank_{month}": two}
    return out | {"gas_regime_high": flag(g > high)}


def with_ranks(df: DataFrame, step: int, x: str = "gas_price", day: int = 48, regime: int = 8640, keys: Sequence[str] = ("region",)) -> tuple[DataFrame, list[Column]]:
    """Adds the long ranks, the quantile and the means that `gas` needs, all windows of a block at once; returns their columns as well."""
    week, month = 7 * day, 30 * day
    made = [windows.Rolled("__week", x, week, day // 2), windows.Rolled("__month", x, month, week), windows.Rolled("__high", x, regime, week, 0.75)]
    made += [windows.Rolled(f"__mean_{w}", x, w, 1, None, "mean") for w in (week, month)]
    return windows.rolled(df, made, step, keys), [F.col(m.name) for m in made]


def temperature(s: Series, ahead: int = 48, second: str = "temp_2", feels: str = "feelslike", humidity: str = "humidity", dew: str = "dew", near: Sequence[str] = ("temp_a", "temp_b", "temp_c")) -> Family:
    hdd, cdd = (lambda x: clip(18 - x, 0)), (lambda x: clip(x - 18, 0))
    t, t2, f, hum, d = (F.col(c) for c in ("temp", second, feels, humidity, dew))
    high, low, later = s.roll("max", t, 48, 1), s.roll("min", t, 48, 1), s.lead(t, ahead)
    out = {"hdd": hdd(t), "cdd": cdd(t), "hdd_sq": hdd(t) ** 2, "cdd_sq": cdd(t) ** 2, "temp_max_day": high, "temp_min_day": low, "temp_range_day": high - low}
    out |= {"heatwave_flag": flag(s.roll("max", t, 96, 1) > 35), "cold_flag": flag(low < 5), "temp_change_48": s.diff(t, 48)} | {f"temp_lag_{k}": s.lag(t, k) for k in (1, 2, 48, 96, 336)}
    out |= {"temp_ahead": later, "hdd_ahead": hdd(later), "cdd_ahead": cdd(later), "hdd_sq_ahead": hdd(later) ** 2, "cdd_sq_ahead": cdd(later) ** 2}
    out |= {"hot_ahead": flag(later > 35), "cold_ahead": flag(later < 5), "temp_delta_ahead": later - t}
    out |= {"temp_2": t2, "temp_2_ahead": s.lead(t2, ahead), "cdd_2": cdd(t2), "hdd_2": hdd(t2), "cdd_2_ahead": cdd(s.lead(t2, ahead))}
    out |= {"feels_cdd": cdd(f), "feels_hdd": hdd(f), "feels_cdd_sq": cdd(f) ** 2, "feels_ahead": s.lead(f, ahead), "feels_cdd_ahead": cdd(s.lead(f, ahead)), "feels_hdd_ahead": hdd(s.lead(f, ahead)), "feels_heatwave": flag(s.roll("max", f, 96, 1) > 38)}
    out |= {"humidity_ahead": s.lead(hum, ahead), "humidity_rmean_48": s.roll("mean", hum, 48, 1), "humid_flag": flag(hum > 80), "feels_humid": cdd(f) * hum / 100}
    out |= {"dew_ahead": s.lead(d, ahead), "dew_flag": flag(d > 18), "dew_flag_ahead": flag(s.lead(d, ahead) > 18)}
    for i, c in enumerate(near):
        out |= {f"cdd_{c}": cdd(F.col(c)), f"hdd_{c}": hdd(F.col(c)), f"{c}_ahead": s.lead(c, ahead)}
        if i < 2:
            out[f"cdd_{c}_ahead"] = cdd(s.lead(c, ahead))
    return out


def solar(s: Series, x: str = "solar", ahead: int = 48, near: Sequence[str] = ("solar_a",), pressure: str = "supply_stress") -> Family:
    v, later = F.col(x), s.lead(x, ahead)
    out = {"solar_log": F.log1p(v), "solar_ahead": later, "solar_log_ahead": F.log1p(later)} | {f"solar_lag_{k}": s.lag(v, k) for k in (48, 96, 336)}
    out |= {"solar_rmean_48": s.roll("mean", v, 48, 1), "solar_rmax_48": s.roll("max", v, 48, 1), "solar_rmean_336": s.roll("mean", v, 336, 1), "solar_rsum_24": s.roll("sum", v, 24, 1)}
    out |= {"sunny_flag": flag(v > 500), "sunny_ahead": flag(later > 500), "solar_ramp": later - v, "solar_stress": clip(F.log1p(later) * F.col(pressure), -20, 20)}
    for c in near:
        out |= {f"{c}_ahead": s.lead(c, ahead), f"{c}_rmean_48": s.roll("mean", c, 48, 1)}
    return out


def wind_cloud(s: Series, wind: str = "wind", second: str = "wind_2", cloud: str = "cloud", sun: str = "solar", ahead: int = 48) -> Family:
    w, w2, c = F.col(wind), F.col(second), F.col(cloud)
    out = {"wind_ahead": s.lead(w, ahead), "wind_lag_48": s.lag(w, 48)} | {f"wind_rmean_{n}": s.roll("mean", w, n, 1) for n in (48, 336)}
    out |= {"windy_flag": flag(w > 30), "windy_ahead": flag(s.lead(w, ahead) > 30), "wind_2_ahead": s.lead(w2, ahead), "wind_2_rmean_48": s.roll("mean", w2, 48, 1)}
    out |= {"cloud_ahead": s.lead(c, ahead), "cloud_lag_48": s.lag(c, 48), "cloud_rmean_48": s.roll("mean", c, 48, 1), "clear_flag": flag(c < 20)}
    out |= {"clear_ahead": flag(s.lead(c, ahead) < 20), "overcast_ahead": flag(s.lead(c, ahead) > 80)}
    return out | {"solar_through_cloud": s.lead(sun, ahead) * (1 - clip(s.lead(c, ahead) / 100, 0, 1))}


def forecast_steps(df: DataFrame, gap: int = 1, horizon: int = 48) -> DataFrame:
    """Forecast price, availability and median demand by horizon (columns h, rrp, avail, demand50), as features in long form."""
    h = df.where(F.col("h").between(gap, gap + horizon - 1))
    return h.select("ts", "region", "h", F.col("rrp").alias("pd_step"), asinh100("rrp").alias("pd_asinh"), flag(F.col("rrp") > 300).alias("pd_spike"), F.col("avail").alias("pasa_avail"), clip(F.col("avail") - F.col("demand50"), -5000, 10000).alias("pasa_margin"))


def day_ahead(s: Series, low: float = 8000.0) -> Family:
    """PASA availability and demand; missing outputs of the listed kinds count as 0."""
    a, d, ag, dm = (F.col(c) for c in ("pasa_avail", "pasa_demand50", "avail_gen", "demand"))
    error, zero = clip(dm - d, -3000, 3000), (lambda x: F.coalesce(x, F.lit(0.0)))
    code = zero(F.col("reserve_code").cast("double"))
    out = {"pasa_margin": clip(a - d, -5000, 10000), "pasa_util": clip(ratio(d, a), 0, 2), "pasa_vs_now": clip(a - ag, -8000, 8000), "pasa_vs_now_pct": clip(ratio(a - ag, ag), -1, 1)}
    out |= {"demand_vs_p50": error, "demand_vs_p50_abs": F.abs(error), "demand_vs_p50_rmean_48": s.roll("mean", error, 48, 1), "demand_p50_ratio": clip(ratio(dm, d), 0.5, 2)}
    out |= {f"pasa_rmean_{w}": s.roll("mean", a, w, 1) for w in (4, 48)} | {"pasa_rmin_48": s.roll("min", a, 48, 1), "pasa_trend_48": s.diff(a, 48)}
    out = {n: zero(x) if n not in ("pasa_rmean_4",) else x for n, x in out.items()}
    return out | {"pasa_low_flag": flag(a < low), "pasa_low_count_48": s.roll("sum", flag(a < low), 48, 1), "reserve_code": code, "reserve_flag": flag(code > 0)}


def coal_offer(s: Series, most: float, declared: str = "coal_declared", actual: str = "coal_mw") -> Family:
    v, c = F.col(declared), F.col(actual)
    out = {"coal_declared_gap": clip(v - c, -5000, 5000), "coal_declared_util": clip(ratio(c, v), 0, 1.5)} | {f"coal_declared_r{a}_48": s.roll(a, v, 48) for a in ("mean", "min")}
    out |= {f"coal_declared_trend_{k}": s.diff(v, k) for k in (48, 96)} | {"coal_declared_low": flag(v < 0.65 * most), "coal_declared_low_48": s.count_if(v < 0.65 * most, 48)}
    return out | {f"coal_declared_lag_{k}": s.lag(v, k) for k in (1, 2, 48, 96, 336)}


def interactions(df: DataFrame, median: DataFrame) -> DataFrame:
    """Products of other families' features; a missing input counts as 0. median: one row with q75_demand and mid_temp."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    x = df.crossJoin(F.broadcast(median))
    hot = clip(F.coalesce("temp", "mid_temp") - 25, 0)
    return x.select(
        "ts", "region",
        (zero("supply_stress") * zero("lag_1")).alias("stress_x_lag"),
        (zero("rrp_1") * zero("supply_stress") ** 2).alias("rrp_x_stress_sq"),
        (zero("coal_outage_flag") * flag(F.col("demand_lag_1") > F.col("q75_demand"))).alias("outage_x_high_demand"),
        (hot * zero("is_peak")).alias("hot_day_peak"),
        (zero("cdd") * zero("demand_lag_1")).alias("cdd_x_demand"),
        (zero("spike_count") * F.log1p(clip(zero("rrp_1"), 0))).alias("spike_x_rrp"),
        (zero("rrp_1") - zero("lag_1")).alias("forward_squeeze"),
    )
