"""Registered queries from derived targets to end-to-end scores, forecast vintages as columns, tagged rows, dense offers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.functions.scalar import row_sum
from gridcast.operators import blend, grid, models, policy, select, shared
from gridcast.operators.asof import carried_vintage, vintage_columns
from gridcast.plans import registry, sql, staging
from gridcast.plans.registry import DAY, FEATURES, HOUR, N_H, add
from gridcast.plans.sql import TS, flag, number
from gridcast.sources import ingest, loads, sinks

# ---- forecast vintages, tagged rows, offers ----------------------------------------------------------------------------

AHEAD, START = 8, "1996-01-01"
PRIORITIES = ["1", "2", "3", "4", "5"]
SECOND = 10_000_000


def _carried(spark: SparkSession, d: str) -> DataFrame:
    runs = staging.vintages(spark, d).withColumn("quantity", F.col("value") / 1000)
    lookback = F.lit(START).cast("timestamp") - F.expr("interval 30 days")
    return carried_vintage(staging.daily(spark, d).where(F.col("ts") >= lookback), runs, ["region"], ["value", "quantity"], 7 * DAY, AHEAD, F.lit(START).cast("timestamp"))


_CARRIED = f"""with {staging.DAILY}, {staging.VINTAGES},
runs as (select distinct region, run_ts from vintages),
g as (select ts, region from daily where ts >= timestamp '{START}' - interval 30 day),
m as (select g.ts, g.region, r.run_ts from g asof join runs r on g.region = r.region and g.ts >= r.run_ts),
x as (select m.ts, m.region, ceil((epoch(interval_ts) - epoch(m.ts)) / 604800)::int as h, value from m join vintages v on v.region = m.region and v.run_ts = m.run_ts),
found as (select ts, region, h, avg(value) as value, avg(value / 1000) as quantity from x where h between 1 and {AHEAD} group by all),
dense as (select g.ts, g.region, hs.h, value, quantity from g cross join (select unnest(range(1, {AHEAD + 1}))::int as h) hs left join found on found.ts = g.ts and found.region = g.region and found.h = hs.h),
carried as (select ts, region, h, last_value(value ignore nulls) over w as value, last_value(quantity ignore nulls) over w as quantity from dense window w as (partition by region, h order by ts rows between unbounded preceding and current row))"""
add("vintage_carried", _carried, f"{_CARRIED} select {TS}, region, h, {number('value')} as value, {number('quantity')} as quantity from carried where carried.ts >= timestamp '{START}'")
add(
    "vintage_columns",
    lambda spark, d: vintage_columns(_carried(spark, d), "region", PRIORITIES, ["value", "quantity"], AHEAD),
    f"{_CARRIED} select {TS}, " + ", ".join(f"{number(f'max({v}) filter (where region = {chr(39)}{r}{chr(39)} and h = {h})')} as {v}_{r}_h{h}" for v in ("value", "quantity") for r in PRIORITIES for h in range(1, AHEAD + 1)) + f" from carried where carried.ts >= timestamp '{START}' group by carried.ts",
)


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Lines of seven files from events: two headers a file with other column orders, quoted fields, interventions, short lines and another table.

    A line has the columns of the header that it lies behind, whatever its event: from five million events on, even ones lie behind the second header too.
    """
    e = staging.table(spark, d, "events").withColumn("ts", F.date_format(F.col("ts").cast("timestamp"), "yyyy/MM/dd HH:mm:ss"))
    odd = F.col("event_id") % 2 == 1
    e = e.withColumn("n", (F.col("event_id") + 10) * 2 + F.when(odd, SECOND).otherwise(0))
    value, why = F.format_string("%.2f", "value"), F.when(~odd & (F.col("event_id") % 11 == 0), "1").otherwise("0")
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit(', "'), F.lit('"x"""'))
    name = F.when(~odd & (F.col("event_id") % 5 == 0), "OTHER")
    one = F.concat_ws(",", F.lit("D"), F.coalesce(name, F.lit("Runs")), F.lit("T"), F.lit("1"), value, quoted, why, "ts")
    # odd events end before the last column, which counts as no intervention
    two = F.concat_ws(",", F.lit("D"), F.coalesce(name, F.lit("RUNS")), F.lit("T"), F.lit("2"), "ts", value, quoted, F.when(~odd, why))
    data = e.select((F.col("event_id") % 7).alias("file"), "n", F.when(F.col("event_id") % 13 == 0, F.lit("D,RUNS,T")).otherwise(F.when(F.col("n") > SECOND - 1, two).otherwise(one)).alias("line"))
    files = data.select("file").distinct()
    heads = F.array(F.struct(F.lit(1).cast("long").alias("n"), F.lit("I,RUNS,T,1,Value,Region,INTERVENTION,LastChanged").alias("line")), F.struct(F.lit(SECOND - 1).cast("long").alias("n"), F.lit("i,runs,T,2,LASTCHANGED,VALUE,REGION,Intervention").alias("line")))
    return data.unionByName(files.select("file", F.explode(heads).alias("x")).select("file", "x.n", "x.line"))


add(
    "tagged_runs",
    lambda spark, d: ingest.tagged_rows(_tagged(spark, d), "runs", ["value", "region", "lastchanged"]).select("file", "n", F.col("value").cast("double").alias("value"), "region", ingest.run_time(F.regexp_replace("lastchanged", "/", "-")).alias("run_ts")),
    f"""select event_id % 7 as file, (event_id + 10) * 2 + case when event_id % 2 = 1 then 10000000 else 0 end as n, {number("round(value, 2)")} as value, event_type || ', "x"' as region,
    strftime(to_timestamp(floor(epoch(ts::timestamp) / 1800) * 1800)::timestamp, '%Y-%m-%d %H:%M:%S') as run_ts from events where event_id % 13 <> 0 and (event_id % 2 = 1 or (event_id % 5 <> 0 and event_id % 11 <> 0))""",
)
def _dense(spark: SparkSession, d: str) -> DataFrame:
    volume = staging.bids(spark, d)[0]
    span = grid.bounds(volume).select(*(grid.bucket(c, 28 * DAY).alias(c) for c in ("lo", "hi")))
    return ingest.dense_offers(ingest.offers(volume, 28 * DAY), 28 * DAY, span=span).select("ts", "duid", "max_avail", "packed")


add(
    "bid_arrays_dense",
    _dense,
    f"""with {staging.BIDS},
    once as (select ts, duid, avg(max_avail) as max_avail, {", ".join(f"avg(band{i}) as band{i}" for i in range(1, 11))} from volume group by all),
    b as (select to_timestamp(floor(epoch(ts) / 2419200) * 2419200)::timestamp as ts, duid, avg(max_avail) as max_avail, arg_max(concat_ws(',', {", ".join(f"trunc(band{i})::int" for i in range(1, 11))}), once.ts) as packed from once group by floor(epoch(ts) / 2419200), duid),
    g as (select unnest(generate_series(min(ts), max(ts), interval 28 day)) as ts from b),
    u as (select distinct duid from b)
    select strftime(g.ts, '%Y-%m-%d %H:%M:%S') as ts, u.duid, {number("coalesce(max_avail, 0)")} as max_avail, coalesce(packed, '0,0,0,0,0,0,0,0,0,0') as packed from g cross join u left join b on b.ts = g.ts and b.duid = u.duid""",
)

# ---- derived targets, selection tables ---------------------------------------------------------------------------------


def _derived(spark: SparkSession, d: str) -> DataFrame:
    rows = blend.capped(registry._split(spark, d).where("split <> 'test'"))
    span = rows.where("split = 'train'").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    x = rows.crossJoin(F.broadcast(span))  # one row
    w = blend.recency((F.unix_timestamp("ts") - F.unix_timestamp("lo")) / HOUR, (F.unix_timestamp("hi") - F.unix_timestamp("lo")) / HOUR + 1)
    return blend.derived(x, w).drop("lo", "hi", "cap")


_both = {"clipped": "case when y is not null then asinh(least(y, cap) / 100) end", "unclipped": "asinh(y / 100)", "spike": f"case when y is not null then {flag('y > 150')} end", "dip": f"case when y is not null then {flag('y < 0')} end"}
_derived_sql = {f"{n}_{k}": f"case when split = '{k}' then {x} end" for n, x in _both.items() for k in ("train", "valid")}
_derived_sql |= {n: f"case when split = 'train' then {registry._w} * {x} end" for n, x in {"w": "1", "w_spike3": "case when y > 150 then 3 else 1 end", "w_spike10": "case when y > 150 then 10 else 1 end", "w_dip7": "case when y < 0 then 7 else 1 end"}.items()}
add(
    "derived_targets", _derived,
    f"with {registry._split_sql}, c as (select h, quantile_cont(y, 0.97) as cap from s where split = 'train' group by h), x as (select s.*, cap, lo, hi from s join c on c.h = s.h, (select min(ts) as lo, max(ts) as hi from s where split = 'train') where split <> 'test') "
    + sql.select(_derived_sql, "x", f"{TS}, region, h, split"),
)
PERIOD = ("2024-01-05 00:00:00", "2024-01-24 23:00:00")


def _period(df: DataFrame) -> DataFrame:
    return select.selection_period(df, *(F.lit(x).cast("timestamp") for x in PERIOD))


_inside = f"between timestamp '{PERIOD[0]}' and timestamp '{PERIOD[1]}'"
add(
    "selection_period",
    lambda spark, d: _period(registry.candidates(spark, d)).join(_period(blend.targets(staging.bars(spark, d), 3).groupBy("ts", "region").pivot("h", [1, 2, 3]).agg(F.first("y"))), ["ts", "region"]).select("ts", "region", *FEATURES, *(F.col(str(h)).alias(f"y_h{h}") for h in (1, 2, 3))),
    f"with {registry.CANDIDATES}, tg as (select ts, region, price as y_h1, {sql.lag('price', -1)} as y_h2, {sql.lag('price', -2)} as y_h3 from bars) select strftime(cand.ts, '%Y-%m-%d %H:%M:%S') as ts, cand.region, {', '.join(f'{number(f)} as {f}' for f in FEATURES)}, {', '.join(f'{number(f)} as {f}' for f in ('y_h1', 'y_h2', 'y_h3'))} from cand join tg on tg.ts = cand.ts and tg.region = cand.region where cand.ts {_inside}",
)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """Sample, mutual information, mean and ranks: the whole path from features to ranked scores. A sampled time counts with all its regions."""
    sampled = select.sampled_times(_period(registry.candidates(spark, d)), 300, 42)
    mi = select.mutual_information(sampled, FEATURES, ["y1", "y6"])
    return select.rank_scores(mi.select("feature", F.when(F.col("target") == "y1", 1).otherwise(6).alias("h"), "mi"))


_sampled = registry._MI.replace("cand as (", "cand0 as (", 1).replace(", edges as (", f", cand as (select * from cand0 where ts in (select ts from (select distinct ts from cand0 where ts {_inside}) order by md5(strftime(ts, '%Y-%m-%d %H:%M:%S') || ':42'), ts limit 300)), edges as (", 1)
_RANKED = f"with {_sampled}, m as (select feature, avg(mi) as mean_mi from mi group by 1), o as (select feature, mean_mi, row_number() over (order by round(mean_mi, 9) desc, feature)::int as position from m), ranked as (select mi.feature, case target when 'y1' then 1 else 6 end as h, mi, rank() over (partition by target order by round(mi, 9) desc)::int as rank, mean_mi, position from mi join o on o.feature = mi.feature)"
add("rank_pipeline", _ranked, f"{_RANKED} select feature, h, {number('mi')} as mi, rank, {number('mean_mi')} as mean_mi, position from ranked")


def _unique(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    scores = select.rank_scores(registry._mi(spark, d).select("feature", F.when(F.col("target") == "y1", 1).otherwise(6).alias("h"), "mi"))
    kept = select.deduplicate(registry.candidates(spark, d), FEATURES)
    return (*select.split_ranks(scores, kept), kept)


_SCORES = f"with {registry._MI}, {registry.KEPT}, {registry._walked}, m as (select feature, avg(mi) as mean_mi from mi group by 1), o as (select feature, mean_mi, row_number() over (order by round(mean_mi, 9) desc, feature)::int as position from m), scores as (select mi.feature, case target when 'y1' then 1 else 6 end as h, mi, rank() over (partition by target order by round(mi, 9) desc)::int as rank, mean_mi, position from mi join o on o.feature = mi.feature)"
for _i, (_name, _is) in enumerate((("unique_features", ""), ("duplicate_features", "not "))):
    add(_name, lambda spark, d, i=_i: _unique(spark, d)[i], f"{_SCORES} select feature, h, {number('mi')} as mi, rank, {number('mean_mi')} as mean_mi, position from scores where feature in (select feature from kept where {_is}kept)")


def _unique_data(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the unique features only (their names are a row for each feature), here with their names and sum."""
    x = registry.candidates(spark, d)
    kept = [r["feature"] for r in select.deduplicate(x, FEATURES).where("kept").orderBy("position").collect()]
    return x.select("ts", "region", *kept).select("ts", "region", F.lit(",".join(kept)).alias("names"), row_sum(*kept).alias("total"))


add(
    "unique_data", _unique_data,
    f"with {registry.CANDIDATES}, {registry.KEPT} select {TS}, region, concat_ws(',', {', '.join(f'case when k_{j} then {chr(39)}{f}{chr(39)} end' for j, f in enumerate(FEATURES))}) as names, {number(' + '.join(f'case when k_{j} then coalesce({f}, 0) else 0 end' for j, f in enumerate(FEATURES)))} as total from cand, kept_{len(FEATURES) - 1}",
)
COUNTS = (1, 2, 3, 5)


def _stand_in_errors(mi: DataFrame) -> DataFrame:
    """Errors by horizon and number of features for the best-count step: how far the first n scores are from half of all."""
    placed = select.selected(mi, mi.select("h").distinct().withColumn("n", F.lit(0))).join(mi, ["feature", "h"])
    total = placed.groupBy("h").agg(F.sum("mi").alias("all"))
    n = placed.sparkSession.createDataFrame([(n,) for n in COUNTS], "n int")
    some = placed.crossJoin(F.broadcast(n)).where(F.col("place") <= F.col("n")).groupBy("h", "n").agg(F.sum("mi").alias("some"))
    return some.join(total, "h").select("h", "n", F.round(F.abs(F.col("some") - F.col("all") / 2), 9).alias("mae"))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    mi = registry._mi(spark, d).select("feature", F.when(F.col("target") == "y1", 1).otherwise(6).alias("h"), "mi")
    return select.feature_matrix(select.selected(mi, select.best_count(_stand_in_errors(mi))), [1, 6])


add(
    "feature_matrix", _matrix,
    f"""with {registry._MI}, s as (select feature, case target when 'y1' then 1 else 6 end as h, mi, row_number() over (partition by target order by round(mi, 9) desc, feature) as place from mi),
    e as (select s.h, n, round(abs(sum(mi) filter (where place <= n) - sum(mi) / 2), 9) as mae from s, (select unnest([{", ".join(map(str, COUNTS))}]) as n) group by all),
    best as (select h, arg_min(n, mae * 1000000 + n * 0.0000001) as n from e group by h)
    select feature, coalesce(bool_or(place <= n) filter (where s.h = 1), false) as h1, coalesce(bool_or(place <= n) filter (where s.h = 6), false) as h6 from s join best on best.h = s.h group by feature""",
)
add(
    "mi_heatmap",
    lambda spark, d: select.top_matrix(registry._mi(spark, d).select("feature", F.when(F.col("target") == "y1", 1).otherwise(6).alias("h"), "mi"), 4),
    f"with {registry._MI}, s as (select feature, case target when 'y1' then 1 else 6 end as h, mi, row_number() over (partition by target order by round(mi, 9) desc, feature) as place from mi) select h, "
    + ", ".join(f"max(feature) filter (where place = {k}) as label_{k}, {number(f'max(1 - exp(-mi)) filter (where place = {k})')} as value_{k}" for k in range(1, 5)) + " from s group by h",
)

# ---- scoring by horizon ------------------------------------------------------------------------------------------------

#: Predictions by horizon from lags and rolling extremes; some horizons lack some models.
LACKS = {"l2": 5, "p_spike": 4, "spike_l1": 6, "p_dip": 3}
_PRED_H = f"""{registry.PREDICTED}, whole as (select ts, region, last_value(price ignore nulls) over (partition by region order by ts rows between unbounded preceding and current row) as price from bars), tg as (select ts, region, y0 as y, h from (select pred.ts, pred.region, b.price as y0, t.h from pred cross join (select unnest(range(1, {N_H + 1}))::int as h) t left join whole b on b.region = pred.region and b.ts = pred.ts + to_hours(t.h - 1))),
by_h as (select tg.ts, tg.region, tg.h, tg.y, l1, case when h % {LACKS["l2"]} <> 0 then l2 end as l2, case when h % {LACKS["p_spike"]} <> 0 then p end as p_spike, case when h % {LACKS["spike_l1"]} <> 0 then case when l1 is not null and l2 is not null then greatest(l1, l2) end end as spike_l1, p90 as spike_p90, case when h % {LACKS["p_dip"]} <> 0 then 1 - p end as p_dip, p10 as dip_l1, naive from tg join pred using (ts, region))"""


def predicted_by_h(spark: SparkSession, d: str) -> DataFrame:
    now = registry.predicted(spark, d).drop("y")
    has = lambda name, c: F.when(F.col("h") % LACKS[name] != 0, c).alias(name)
    x = registry.filled_targets(spark, d).join(now, ["ts", "region"])
    both = F.when(F.col("l1").isNotNull() & F.col("l2").isNotNull(), F.greatest("l1", "l2"))
    return x.select("ts", "region", "h", "y", "l1", has("l2", F.col("l2")), has("p_spike", F.col("p")), has("spike_l1", both), F.col("p90").alias("spike_p90"), has("p_dip", 1 - F.col("p")), F.col("p10").alias("dip_l1"), "naive")


KNOTS = [(-50.0, -40.0), (0.0, 5.0), (100.0, 90.0), (300.0, 280.0)]
SOURCES = ("p90", "max", "l1")


def _parameters() -> list[tuple]:
    """One row for each horizon; some parts are missing, so that the defaults show."""
    rows = []
    for h in range(1, N_H + 1):
        some = lambda v, k: None if h % k == 0 else v  # noqa: E731, B023
        rows.append((h, some(0.05 * (h % 10), 7), some(SOURCES[h % 3], 11), h % 3, some(0.1 + 0.02 * h, 9), 1 + 0.25 * (h % 4), 0.4 + 0.1 * (h % 5), some((h + 1) % 3, 10), 0.05 * (1 + h % 6), 1.0 + h % 2, some(0.3 + 0.1 * (h % 4), 8), some(1 - 0.05 * (h % 5), 12), KNOTS if h % 2 == 0 else None))
    return rows


def _scored(spark: SparkSession, d: str) -> DataFrame:
    test = predicted_by_h(spark, d).where(F.col("ts") > F.lit("2024-01-20").cast("timestamp"))
    return policy.scored(test, spark.createDataFrame(_parameters(), policy.PARAMETERS))


def _literal(v) -> str:
    return "null" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}" if isinstance(v, int) else f"{v!r}::double"


def _calibrated(x: str) -> str:
    parts = " ".join(f"when {x} < {b[0]} then {a[1]} + ({b[1]} - ({a[1]})) * ({x} - ({a[0]})) / ({b[0]} - ({a[0]}))" for a, b in zip(KNOTS, KNOTS[1:], strict=False))
    return f"case when not calibrated or {x} is null then {x} when {x} < {KNOTS[0][0]} then {KNOTS[0][1]} {parts} else {KNOTS[-1][1]} end"


_prm = ", ".join("(" + ", ".join([*(_literal(v) for v in r[:-1]), "true" if r[-1] else "false"]) + ")" for r in _parameters())
_ramp = lambda p, t, w: f"power(greatest(least(({p} - {t}) / (1 - {t} + 1e-6), 1), 0), {w})"
SCORED = f"""{_PRED_H},
prm(h, alpha, spike_source, spike_mode, st, sp, sw, dip_mode, dt, dp, dw, share, calibrated) as (values {_prm}),
s0 as (select by_h.*, prm.* exclude (h), case when l2 is null then l1 else (1 - coalesce(alpha, 0)) * l1 + coalesce(alpha, 0) * l2 end as b0 from by_h join prm on prm.h = by_h.h where by_h.ts > timestamp '2024-01-20'),
s1 as (select *, coalesce(spike_l1, b0) as one, coalesce(spike_p90, spike_l1, b0) as nine from s0),
s2 as (select *, case spike_source when 'max' then greatest(nine, one) when 'l1' then one else nine end as src, coalesce(st, 0.20) as t1, coalesce(sp, 2.0) as p1, coalesce(sw, 0.75) as w1, coalesce(dt, 0.15) as t2, coalesce(dp, 1.0) as p2, coalesce(dw, 0.60) as w2 from s1),
s3 as (select *, case when p_spike is null then b0 when coalesce(spike_mode, 0) = 0 then (1 - p_spike) * b0 + p_spike * src when spike_mode = 1 then b0 + greatest(src - b0, 0) * w1 * {_ramp("p_spike", "t1", "p1")} when p_spike >= t1 then b0 + p1 * greatest(src - b0, 0) else b0 end as b1 from s2),
s4 as (select *, case when p_dip is null or dip_l1 is null then b1 when coalesce(dip_mode, 0) = 0 then (1 - p_dip) * b1 + p_dip * dip_l1 when dip_mode = 1 then b1 - w2 * {_ramp("p_dip", "t2", "p2")} * greatest(b1 - dip_l1, 0) when p_dip >= t2 then b1 - w2 * greatest(b1 - dip_l1, 0) else b1 end as b2 from s3),
s5 as (select *, case when coalesce(share, 1) < 1 and naive is not null then share * b2 + (1 - share) * naive else b2 end as b3 from s4),
scored as (select *, {_calibrated("b3")} as yhat from s5)"""
add("score_end_to_end", lambda spark, d: _scored(spark, d).select("ts", "region", "h", "y", "yhat"), f"with {SCORED} select {TS}, region, h, {number('y')} as y, {number('yhat')} as yhat from scored")
_metric = registry._metric
add("score_metrics_by_h", lambda spark, d: blend.metrics(_scored(spark, d), ["h"]), f"with {SCORED}, m as (select h, y, naive, yhat - y as e from scored where y is not null and yhat is not null) select h, count(*) as n, {_metric} from m group by h")
add(
    "actual_predicted",
    lambda spark, d: blend.wide_rows(blend.complete(_scored(spark, d).select("ts", "region", "h", "y", "yhat"), N_H, ["ts", "region"]), N_H, ["ts", "region"], {"actual": "y", "predicted": "yhat"}),
    f"with {SCORED}, w as (select ts, region, list(y order by h) as a, list(yhat order by h) as p from scored group by all having count(y) = {N_H}) select {TS}, region, " + ", ".join(f"{number(f'{c}[{h}]')} as {n}_h{h}" for h in range(1, N_H + 1) for n, c in (("actual", "a"), ("predicted", "p"))) + " from w",
)
add("dip_search_by_h", lambda spark, d: policy.dip_search(predicted_by_h(spark, d).select("h", "y", F.col("l1").alias("base"), F.col("p_dip").alias("p"), F.col("dip_l1").alias("dip")), ["h"]), registry._dip_sql(f"with {_PRED_H}, cand as (select h, y, l1 as base, p_dip as p, dip_l1 as dip from by_h)", "h"))

CALIBRATED = 24


def _isotonic(spark: SparkSession, d: str) -> DataFrame:
    x = predicted_by_h(spark, d).where(F.col("h") <= CALIBRATED).select("ts", "region", "h", "y", F.col("l1").alias("yhat"))
    cut = F.lit("2024-01-20").cast("timestamp")
    # horizon 5 keeps too few rows for a fit
    train = x.where((F.col("ts") <= cut) & ((F.col("h") != 5) | (F.hour("ts") == 3)))
    knots = models.calibrators(train, list(range(1, CALIBRATED + 1)), "yhat", "y")
    out = x.where(F.col("ts") > cut).join(knots, "h", "left")
    return out.select("ts", "region", "h", "yhat", policy.interpolated(F.col("yhat"), F.col("knots")).alias("calibrated"))


add(
    "isotonic_by_h", _isotonic,
    f"""with {_PRED_H}, tr as (select h, l1 as x, y from by_h where h <= {CALIBRATED} and ts <= timestamp '2024-01-20' and l1 is not null and y is not null and (h <> 5 or hour(ts) = 3)),
    big as (select h from tr group by h having count(*) >= 500),
    u as (select h, x, sum(y) as s, count(*) as n, row_number() over (partition by h order by x) as i from tr join big using (h) group by h, x),
    c as (select *, sum(s) over w as ss, sum(n) over w as nn from u window w as (partition by h order by i rows between unbounded preceding and current row)),
    pair as (select a.h, a.i as a, b.i as b, (b.ss - a.ss + a.s) / (b.nn - a.nn + a.n) as m from c a join c b on b.h = a.h and b.i >= a.i),
    low as (select h, a, b as i, min(m) over (partition by h, a order by b rows between current row and unbounded following) as m from pair),
    fit as (select c.h, c.x, f.v from (select h, i, max(m) as v from low group by h, i) f join c using (h, i)),
    test as (select ts, region, h, l1 as x from by_h where h <= {CALIBRATED} and ts > timestamp '2024-01-20'),
    lo as (select test.*, fit.x as xa, fit.v as va from test asof left join fit on test.h = fit.h and test.x >= fit.x),
    ends as (select lo.*, fit.x as xb, fit.v as vb from lo asof left join fit on lo.h = fit.h and lo.x < fit.x)
    select {TS}, region, h, {number("x")} as yhat, {number("case when x is null or (va is null and vb is null) then x when va is null then vb when vb is null then va else va + (vb - va) * (x - xa) / (xb - xa) end")} as calibrated from ends""",
)

# ---- sinks -------------------------------------------------------------------------------------------------------------

_SMALL = {"spike": "byte", "slot": "short"}


def _narrow(spark: SparkSession, d: str) -> DataFrame:
    x = staging.system(spark, d).select("ts", "region", "price", "demand", (F.col("price") > 150).cast("double").alias("spike"), (F.hour("ts") * 60.0).alias("slot"))
    return sinks.narrowed(x, ["ts", "region"], _SMALL)


_narrow_sql = f"with {staging.SYSTEM} select {TS}, region, {number('price::float')} as price, {number('demand::float')} as demand, (case when price is not null then case when price > 150 then 1 else 0 end end)::tinyint as spike, (hour(ts) * 60)::smallint as slot from system"
add("sink_types", _narrow, _narrow_sql)


def _read_back(spark: SparkSession, d: str) -> DataFrame:
    """A full load twice (the second replaces the first) as Parquet and as CSV, read back and laid side by side."""
    x, path = _narrow(spark, d), models.folder(spark)
    for form in ("parquet", "csv"):
        sinks.write(x.limit(5), f"{path}/{form}", form, ["region"])
        sinks.write(x, f"{path}/{form}", form, ["region"])
    one = spark.read.parquet(f"{path}/parquet")
    two = spark.read.schema(one.drop("region").schema.add("region", "string")).option("header", True).csv(f"{path}/csv")
    return one.join(two.select("ts", "region", *(F.col(c).alias(f"{c}_csv") for c in ("price", "demand", "spike", "slot"))), ["ts", "region"])


add(
    "sink_read_back", _read_back,
    _narrow_sql.replace("from system", f", {number('price::float')} as price_csv, {number('demand::float')} as demand_csv, (case when price is not null then case when price > 150 then 1 else 0 end end)::tinyint as spike_csv, (hour(ts) * 60)::smallint as slot_csv from system"),
)


def _committed(spark: SparkSession, d: str) -> DataFrame:
    """Two loads, the second again and once more broken off before its commit, read back by another session: the rows of the two loads."""
    x = staging.system(spark, d).select("ts", "region", "price", "demand")
    table = loads.Table(spark, shared.folder(spark, "loads"))
    days = lambda a, b: x.where((F.dayofmonth("ts") > a) & (F.dayofmonth("ts") <= b)).withColumn("ts", F.col("ts") + F.make_interval(months=F.when(F.dayofmonth("ts") > 15, 1).otherwise(0)))
    table.load(days(0, 20), "first")  # two months: the days after the 15th count for the next one
    table.load(days(15, 31), "second")  # replaces the second month
    table.load(days(15, 18), "second")  # the id is there already
    table.stage(days(0, 3), "broken")  # never published
    return loads.Table(spark.newSession(), table.path).read()


add(
    "loads_committed", _committed,
    f"with {staging.SYSTEM} select strftime(case when day(ts) > 15 then ts + interval 1 month else ts end, '%Y-%m-%d %H:%M:%S') as ts, region, {number('price')} as price, {number('demand')} as demand from system",
)
