"""Registered queries over the given tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.features import market, price
from gridcast.functions.scalar import asinh100, clip, row_max, row_min, row_sum, sinh100
from gridcast.operators import blend, grid, models, policy, quality, quantiles, rolling, select, windows
from gridcast.operators.asof import asof_backward, interpolate_time, latest_vintage
from gridcast.operators.rolling import Series
from gridcast.plans import features_sql as fs
from gridcast.plans import sql, staging
from gridcast.plans.sql import TS, number
from gridcast.sources import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HOUR, DAY = 3600, 86400


def show(df: DataFrame) -> DataFrame:
    """Times and dates as text, doubles rounded to six places and without a negative zero.

    Means of prices often end exactly between two roundings, where the last bit would decide; a billionth is added first.
    """
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            c = c.cast("string")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double") + F.lit(1e-9), 6) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: show(query(spark, sf_dir))
    if oracle:
        SQL[name] = oracle


def family(df: DataFrame, build: Callable[[Series], dict], before: int, after: int = 0, rows: int = 2880, step: int = HOUR) -> DataFrame:
    """A family's columns, the series cut into blocks with the halo that the family needs; results as doubles."""
    s = Series(("region", "block"))
    cut = grid.blocks(df, step, rows, before, after)
    return cut.select("ts", "region", "own", *(c.cast("double").alias(n) for n, c in build(s).items())).where("own").drop("own")


def bars_query(name: str, build: Callable[[Series], dict], before: int, columns: dict[str, str], after: int = 0) -> None:
    add(name, lambda spark, d: family(staging.bars(spark, d), build, before, after), f"with {staging.BARS} {sql.select(columns, 'bars')}")


# ---- grids, scans and ingest ----------------------------------------------------------------------------------------

add(
    "grid_regularise",
    lambda spark, d: grid.densify(grid.bucket_mean(staging.events(spark, d).where("region is not null").withColumn("value", F.col("value").cast("double")), HOUR, ["region"], ["value"]), HOUR, staging.regions(spark), ["region"], span=staging.hours(spark, d).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))),
    f"with {staging.BARS} select {TS}, region, {number('price + 30.0')} as value from bars",
)
add(
    "grid_pivot",
    lambda spark, d: grid.wide(staging.bars(spark, d), "region", staging.REGIONS, ["price"]),
    f"with {staging.BARS} select {TS}, " + ", ".join(f"{number(f'max(case when region = {chr(39)}{r}{chr(39)} then price end)')} as price_{r}" for r in staging.REGIONS) + " from bars group by bars.ts",
)
add(
    "region_summary_wide",
    lambda spark, d: grid.wide(staging.system(spark, d), "region", staging.REGIONS, ["demand", "avail_gen", "interchange"]),
    f"with {staging.SYSTEM} select {TS}, " + ", ".join(f"{number(f'max(case when region = {chr(39)}{r}{chr(39)} then {v} end)')} as {v}_{r}" for v in ("demand", "avail_gen", "interchange") for r in staging.REGIONS) + " from system group by system.ts",
)


def _raw_registry(spark: SparkSession, d: str) -> DataFrame:
    r = staging.registry(spark, d)
    fuel = F.when(F.col("fuel") == "PROMO", "Fossil").when(F.col("fuel") == "SMALL", " biomass waste ").when(F.col("fuel") == "ECONOMY", "-").otherwise(F.col("fuel"))
    return r.select(F.concat(F.lit(" "), F.col("duid").cast("string")).alias("duid"), F.concat("region", F.lit("1 ")).alias("region"), fuel.alias("fuel"), F.when(F.col("size") % 2 == 0, "Black Coal").otherwise("Methane").alias("descriptor"), F.when(F.col("size") > 40, "Load").otherwise("Generating Unit").alias("dispatch"), F.when(F.col("size") < 5, "Non-Market").otherwise("Market").alias("category"), "participant", "station")


add(
    "registry_clean",
    lambda spark, d: ingest.clean_registry(_raw_registry(spark, d)),
    f"""with {staging.REGISTRY} select duid::varchar as duid, region, case fuel when 'PROMO' then case when size % 2 = 0 then 'Coal' else 'Gas' end when 'SMALL' then 'Biomass'
    else upper(substr(fuel, 1, 1)) || lower(substr(fuel, 2)) end as fuel, participant, station from registry where size between 5 and 40 and fuel <> 'ECONOMY'""",
)
add(
    "registry_flows",
    lambda spark, d: ingest.flows(staging.registry(spark, d), ["participant", "station", "class", "fuel"]),
    f"with {staging.REGISTRY} " + " union all ".join(f"select region, {i} as level, {a} as source, {b} as target, count(*) as n from registry group by all" for i, (a, b) in enumerate((("participant", "station"), ("station", "class"), ("class", "fuel")))),
)
add(
    "registry_participants",
    lambda spark, d: ingest.participants(staging.registry(spark, d)),
    f"with {staging.REGISTRY}, n as (select region, participant, count(distinct duid) as units from registry group by all) select *, row_number() over (partition by region order by units desc, participant) as place from n",
)
FUELS, SHORES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"], ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
add(
    "fuel_rollup_signed",
    lambda spark, d: ingest.fuel_rollup(staging.scada(spark, d), staging.registry(spark, d), 7 * DAY, "PROMO", FUELS, SHORES),
    f"""with {staging.REGISTRY}, {staging.SCADA},
    x as (select ts, region, fuel, mw from scada join registry using (duid)),
    long as (select ts, region, fuel, greatest(mw, 0) as mw from x where fuel <> 'PROMO' union all select ts, region, 'charge', greatest(-mw, 0) from x where fuel = 'PROMO' union all select ts, region, 'discharge', greatest(mw, 0) from x where fuel = 'PROMO'),
    summed as (select ts, region, fuel, sum(mw) as mw from long group by all),
    b as (select to_timestamp(floor(epoch(ts) / 604800) * 604800)::timestamp as ts, region, fuel, avg(mw) as mw from summed group by all),
    g as (select unnest(generate_series(min(ts), max(ts), interval 7 day)) as ts from b),
    dims as (select r, f from (select unnest([{", ".join(f"'{r}'" for r in SHORES)}]) as r), (select unnest(['ECONOMY', 'LARGE', 'MEDIUM', 'SMALL', 'STANDARD', 'charge', 'discharge']) as f))
    select strftime(g.ts, '%Y-%m-%d %H:%M:%S') as ts, r as region, f as fuel, {number("coalesce(mw, 0)")} as mw from g cross join dims left join b on b.ts = g.ts and b.region = r and b.fuel = f""",
)


def _daily_price(spark: SparkSession, d: str) -> DataFrame:
    e = staging.events(spark, d)
    day = F.to_date("ts")
    return e.where((F.dayofmonth("ts") % 3 == 0) & (F.dayofmonth("ts") > 3)).groupBy(day.alias("day")).agg((staging.money("value") / F.count("value")).alias("gas_price"))


add(
    "daily_broadcast_fill",
    lambda spark, d: ingest.daily_to_grid(_daily_price(spark, d), staging.hours(spark, d), "gas_price").select("ts", "gas_price"),
    f"""with {staging.BARS},
    dp as (select ts::date as day, sum(value::decimal(18,2))::double / count(value) as gas_price from ev where day(ts) % 3 = 0 and day(ts) > 3 group by 1),
    j as (select hours.ts, gas_price from hours left join dp on dp.day = hours.ts::date)
    select {TS}, {number("coalesce(last_value(gas_price ignore nulls) over (order by j.ts rows between unbounded preceding and current row), first_value(gas_price ignore nulls) over (order by j.ts rows between current row and unbounded following))")} as gas_price from j""",
)
add(
    "subdaily_asof",
    lambda spark, d: ingest.readings_to_grid(
        staging.events(spark, d).where("region is not null and event_type in ('click', 'view') and value > 400").groupBy("ts", "region").agg(F.max("value").alias("reading")),
        staging.hours(spark, d).crossJoin(F.broadcast(staging.regions(spark))), ["region"], "reading",
    ),
    f"""with {staging.BARS},
    rd as (select ts, region, max(value) as reading from ev where event_type in ('click', 'view') and value > 400 group by all),
    g as (select hours.ts, regions.region from hours cross join regions),
    a as (select g.ts, g.region, rd.reading from g asof left join rd on g.region = rd.region and g.ts >= rd.ts),
    f as (select region, arg_min(reading, ts) as first from rd group by region)
    select {TS}, a.region, {number("coalesce(a.reading, f.first)")} as reading from a left join f on f.region = a.region""",
)
add(
    "interp_time",
    lambda spark, d: interpolate_time(staging.bars(spark, d), "price", ["region"]),
    f"""with {staging.BARS},
    s as (select ts, region, price, last_value(case when price is not null then ts end ignore nulls) over a as ta, last_value(price ignore nulls) over a as pa, first_value(case when price is not null then ts end ignore nulls) over b as tb, first_value(price ignore nulls) over b as pb from bars
      window a as (partition by region order by ts rows between unbounded preceding and current row), b as (partition by region order by ts rows between current row and unbounded following))
    select {TS}, region, {number("coalesce(price, pa + (pb - pa) * (epoch(s.ts) - epoch(ta)) / nullif(epoch(tb) - epoch(ta), 0), pa)")} as price from s""",
)
add(
    "weather_clean",
    lambda spark, d: ingest.clean_weather(staging.table(spark, d, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("string").alias("ts"), F.col("event_type").alias("city"), F.format_string("%.2f", "value").alias(" Feels Like"), F.col("event_id").cast("string").alias("Dew"), F.lit("rain").alias("Con ditions")), "city"),
    f"""select strftime(h, '%Y-%m-%d %H:%M:%S') as ts, event_type as city, {number("fl::double")} as feelslike, {number("dew::double")} as dew
    from (select date_trunc('hour', ts)::timestamp as h, event_type, printf('%.2f', value) as fl, event_id::varchar as dew from events) qualify row_number() over (partition by h, event_type order by fl, dew) = 1""",
)
add(
    "vintage_horizon",
    lambda spark, d: latest_vintage(staging.daily(spark, d), staging.vintages(spark, d), ["region"], "value", 7 * DAY),
    f"""with {staging.DAILY}, {staging.VINTAGES},
    runs as (select distinct region, run_ts from vintages),
    m as (select g.ts, g.region, r.run_ts from daily g asof join runs r on g.region = r.region and g.ts >= r.run_ts),
    x as (select m.ts, m.region, ceil((epoch(interval_ts) - epoch(m.ts)) / 604800)::int as h, value from m join vintages v on v.region = m.region and v.run_ts = m.run_ts)
    select {TS}, region, h, {number("avg(value)")} as value from x where h >= 1 group by x.ts, region, h""",
)
add(
    "asof_backward",
    lambda spark, d: asof_backward(
        staging.hours(spark, d).crossJoin(F.broadcast(staging.regions(spark))),
        staging.events(spark, d).where("region is not null").groupBy("ts", "region").agg(F.max("value").alias("value")), ["region"], ["value"], width=7 * DAY,
    ),
    f"""with {staging.BARS},
    rd as (select ts, region, max(value) as value from ev where region is not null group by all),
    g as (select hours.ts, regions.region from hours cross join regions)
    select strftime(g.ts, '%Y-%m-%d %H:%M:%S') as ts, g.region, strftime(rd.ts, '%Y-%m-%d %H:%M:%S') as matched_ts, {number("rd.value")} as value from g asof left join rd on g.region = rd.region and g.ts >= rd.ts""",
)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    e = staging.table(spark, d, "events")
    tag = F.when(F.col("event_type") == "signup", "OTHER").otherwise("PRICE")
    data = e.select((F.col("event_id") % 7).alias("file"), (F.col("event_id") + 1).alias("n"), F.concat_ws(",", F.lit("D"), tag, F.col("event_type"), F.format_string("%.2f", "value"), F.col("user_id")).alias("line"))
    heads = data.select("file").distinct().select("file", F.lit(0).cast("long").alias("n"), F.when(F.col("file") == 3, "I,PRICE,REGION,VALUE").otherwise("I,PRICE,REGION,VALUE,USER").alias("line"))
    return data.unionByName(heads)


add(
    "tagged_records",
    lambda spark, d: ingest.tagged_records(_lines(spark, d), "PRICE", ["VALUE", "USER", "REGION"]).withColumn("value", F.col("value").cast("double")),
    f"select event_id % 7 as file, event_id + 1 as n, {number('value')} as value, case when event_id % 7 = 3 then null else user_id::varchar end as user, event_type as region from events where event_type <> 'signup'",
)
_bands = ", ".join(f"band{i}" for i in range(1, 11))
add(
    "bid_arrays",
    lambda spark, d: ingest.offers(staging.bids(spark, d)[0], 7 * DAY).select("ts", "duid", "max_avail", "packed"),
    f"""with {staging.BIDS},
    once as (select ts, duid, avg(max_avail) as max_avail, {", ".join(f"avg(band{i}) as band{i}" for i in range(1, 11))} from volume group by all)
    select strftime(to_timestamp(floor(epoch(ts) / 604800) * 604800)::timestamp, '%Y-%m-%d %H:%M:%S') as ts, duid, {number("avg(max_avail)")} as max_avail,
      arg_max(concat_ws(',', {", ".join(f"trunc(band{i})::int" for i in range(1, 11))}), once.ts) as packed from once group by floor(epoch(ts) / 604800), duid""",
)


def _price_spans(spark: SparkSession, d: str) -> DataFrame:
    p = staging.bids(spark, d)[1]
    return ingest.offer_spans(p, p.select("day"))


# All units and days are millions of rows: no SQL here (a test has brute force), but for their totals by unit and year. Prices become text once for each span.
add("bid_price_ffill", lambda spark, d: ingest.span_days(_price_spans(spark, d).withColumn("prices", F.concat_ws(",", F.col("prices").cast("array<string>")))).select("day", "duid", "prices"))
add(
    "bid_price_totals",
    lambda spark, d: ingest.span_totals(_price_spans(spark, d)),
    f"""with {staging.BIDS},
    once as (select day, duid, {", ".join(f"floor(avg(price{i}))::int as p{i}" for i in range(1, 11))} from day_price group by all),
    e as (select max(day) as last from day_price),
    line as (select duid, unnest(generate_series(min(day), any_value(last), interval 1 day))::date as day from once, e group by duid),
    f as (select line.day, line.duid, {", ".join(f"last_value(p{i} ignore nulls) over w as p{i}" for i in range(1, 11))} from line left join once using (duid, day) window w as (partition by line.duid order by line.day rows between unbounded preceding and current row))
    select duid, year(day)::int as year, count(*) as n_days, {", ".join(f"sum(p{i})::bigint as sum_{i}" for i in range(1, 11))} from f group by all""",
)


def _tier_sql(low, high) -> str:
    bound = lambda i: " and ".join([f"price{i} is not null", *([f"price{i} > {low}"] if low is not None else []), *([f"price{i} <= {high}"] if high is not None else [])])
    return " + ".join(f"case when {bound(i)} then coalesce(band{i}, 0) else 0 end" for i in range(1, 11))


add(
    "bid_tier_stack",
    lambda spark, d: ingest.bid_stack(*staging.bids(spark, d), staging.registry(spark, d), start_hour=0),
    f"""with {staging.BIDS}, {staging.REGISTRY},
    x as (select v.ts, region, v.*, p.* from volume v left join day_price p on p.duid = v.duid and p.day = v.ts::date join registry r on r.duid = v.duid)
    select {TS}, region, """ + ", ".join(f"{number(f'sum({_tier_sql(a, b)})')} as tier_{i}" for i, (a, b) in enumerate(ingest.TIERS)) + " from x group by x.ts, region",
)


def _loads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = staging.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").cast("double").alias("price"))
    return o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumn("price", F.col("price") + 1)


add(
    "incremental_upsert",
    lambda spark, d: ingest.upsert(ingest.upsert(*_loads(spark, d), ["o_orderkey"]), _loads(spark, d)[1], ["o_orderkey"]),
    f"select o_orderkey, strftime(o_orderdate::timestamp, '%Y-%m-%d %H:%M:%S') as ts, {number('o_totalprice + case when o_orderkey % 2 = 0 then 1 else 0 end')} as price from orders where o_orderkey % 3 <> 0 or o_orderkey % 2 = 0",
)
add(
    "source_priority",
    lambda spark, d: ingest.by_priority([s for o in [_loads(spark, d)[0]] for s in (o.where("month(ts) % 3 = 0"), o.where("month(ts) % 2 = 0"), o.where("o_orderkey % 2 = 1"))]),
    f"""with o as (select o_orderkey, o_orderdate::timestamp as ts, o_totalprice as price, month(o_orderdate) as m from orders where o_orderkey % 3 <> 0)
    select o_orderkey, {TS}, {number("price")} as price, case when m % 3 = 0 then 0 when m % 2 = 0 then 1 else 2 end as source from o where m % 3 = 0 or m % 2 = 0 or o_orderkey % 2 = 1""",
)
add(
    "months_to_load",
    lambda spark, d: ingest.months_to_load(spark, "1995-01-01", "2001-08-01", ingest.loaded_months(_loads(spark, d)[0].where("month(ts) % 4 <> 1"))),
    "select m::date::varchar as month from (select unnest(generate_series(date '1995-01-01', date '2001-08-01', interval 1 month)) as m) where m::date not in (select date_trunc('month', o_orderdate)::date from orders where o_orderkey % 3 <> 0 and month(o_orderdate) % 4 <> 1)",
)

# ---- scalar functions -----------------------------------------------------------------------------------------------

add(
    "scalar_functions",
    lambda spark, d: staging.system(spark, d).select(
        "ts", "region", asinh100("price").alias("asinh"), sinh100(asinh100("price") / 2).alias("sinh"), clip("price", 0, 100).alias("clipped"), row_sum("price", "demand", "interchange").alias("total"),
        row_min("price", "demand").alias("least"), row_max("price", "demand").alias("most"), F.log1p(F.abs("price")).alias("log1p"), F.pmod(F.hour("ts") * 60 + 55, F.lit(120)).cast("int").alias("slot"), F.coalesce("price", F.lit(0.0)).alias("filled"),
    ),
    f"with {staging.SYSTEM} select {TS}, region, (hour(ts) * 60 + 55)::int % 120 as slot, "
    + ", ".join(f"{number(x)} as \"{n}\"" for n, x in {"asinh": sql.asinh("price"), "sinh": "sinh(asinh(price / 100) / 2) * 100", "clipped": sql.clip("price", 0, 100), "total": "coalesce(price, 0) + coalesce(demand, 0) + coalesce(interchange, 0)", "least": "least(price, demand)", "most": "greatest(price, demand)", "log1p": "ln(1 + abs(price))", "filled": "coalesce(price, 0)"}.items())
    + " from system",
)
add(
    "median_fill",
    lambda spark, d: (b := staging.bars(spark, d)).crossJoin(F.broadcast(quantiles.quantile(b, "price", 0.5, "mid"))).select("ts", "region", F.coalesce("price", "mid").alias("price")),
    f"with {staging.BARS}, m as (select quantile_cont(price, 0.5) as mid from bars) select {TS}, region, {number('coalesce(price, mid)')} as price from bars, m",
)

# ---- windows --------------------------------------------------------------------------------------------------------

bars_query("diffs", lambda s: {"diff_4": s.diff("price", 4), "diff2_4": s.diff2("price", 4), "lead_3": s.lead("price", 3), "lead_1": s.lead("price", 1)}, 8, {"diff_4": f"price - {sql.lag('price', 4)}", "diff2_4": sql.clip(f"price - 2 * {sql.lag('price', 4)} + {sql.lag('price', 8)}", -2000, 2000), "lead_3": sql.lag("price", -3), "lead_1": sql.lag("price", -1)}, 3)
bars_query(
    "roll_minperiods",
    lambda s: {f"{a}_{w}_{m}": s.roll(a, "price", w, m) for a in ("mean", "std", "min", "max", "sum") for w, m in ((24, 24), (24, 12), (48, 1))},
    47,
    {f"{a}_{w}_{m}": sql.roll(a, "price", w, m) for a in ("mean", "std", "min", "max", "sum") for w, m in ((24, 24), (24, 12), (48, 1))},
)
bars_query("roll_lagged", lambda s: {"mean": s.roll("mean", "price", 24, 6, 168), "sum": s.roll("sum", "price", 12, 1, 5)}, 191, {"mean": sql.roll("mean", "price", 24, 6, 168), "sum": sql.roll("sum", "price", 12, 1, 5)})
bars_query("roll_quantile", lambda s: {"q25": s.quantile("price", 0.25, 48, 10), "q90": s.quantile("price", 0.9, 168, 24)}, 167, {"q25": sql.quantile("price", 0.25, 48, 10), "q90": sql.quantile("price", 0.9, 168, 24)})
bars_query("roll_rank", lambda s: {"r48": s.pct_rank("price", 48, 1), "r168": s.pct_rank("price", 168, 24)}, 167, {"r48": sql.pct_rank("price", 48, 1), "r168": sql.pct_rank("price", 168, 24)})
bars_query("event_flags", lambda s: {"seen_6": s.seen_in(F.col("price") > 100, 6), "count_24": s.count_if(F.col("price") < 100, 24), "since": s.rows_since(F.col("price") > 250, HOUR, 96)}, 96, {
    "seen_6": sql.roll("max", sql.flag("price > 100"), 6, 1), "count_24": sql.roll("sum", sql.flag("price < 100"), 24),
    "since": "least(coalesce(epoch(ts) / 3600 - last_value(case when price > 250 then epoch(ts) / 3600 end ignore nulls) over (partition by region order by ts rows between unbounded preceding and current row), 96), 96)",
})
add(
    "fills",
    lambda spark, d: rolling.filled(rolling.filled(staging.bars(spark, d).withColumn("row", Series().row()), "price", "forward", HOUR, ["region"], rows=96), "price", "backward", HOUR, ["region"], rows=96, backward=True).select("ts", "region", "forward", "backward", "row"),
    f"with {staging.BARS} select {TS}, region, {number('last_value(price ignore nulls) over (partition by region order by ts rows between unbounded preceding and current row)')} as forward, {number('first_value(price ignore nulls) over (partition by region order by ts rows between current row and unbounded following)')} as backward, row_number() over (partition by region order by ts)::int as row from bars",
)
def _wide_rolls(spark: SparkSession, d: str) -> DataFrame:
    by = ["region", "block"]
    x = grid.blocks(staging.bars(spark, d), HOUR, 2880, 335)
    for agg in ("mean", "sum"):
        x = rolling.wide_mean(x, "price", 336, 168, f"{agg}_336", by, agg=agg)
    x = rolling.wide_extreme(x, "price", 336, 168, "max_336", HOUR, by)
    x = rolling.wide_extreme(x, "price", 100, 50, "min_100", HOUR, by, agg="min")
    return x.where("own").drop("price", "own", "block")


add(
    "wide_rolls", _wide_rolls,
    f"with {staging.BARS} {sql.select({'mean_336': sql.roll('mean', 'price', 336, 168), 'sum_336': sql.roll('sum', 'price', 336, 168), 'max_336': sql.roll('max', 'price', 336, 168), 'min_100': sql.roll('min', 'price', 100, 50)}, 'bars')}",
)

add(
    "roll_rank_long",
    lambda spark, d: windows.rolled(staging.fine(spark, d).select("ts", "region", "price"), [windows.Rolled("r336", "price", 336, 1), windows.Rolled("r1440", "price", 1440, 720), windows.Rolled("q75_8640", "price", 8640, 336, 0.75), windows.Rolled("q10_2016", "price", 2016, 1008, 0.1)], staging.FINE),
    f"with {staging.FINE_BARS} " + sql.select({"price": "price", "r336": sql.pct_rank("price", 336, 1), "r1440": sql.pct_rank("price", 1440, 720), "q75_8640": sql.quantile("price", 0.75, 8640, 336), "q10_2016": sql.quantile("price", 0.1, 2016, 1008)}, "fine"),
)

# ---- feature families -----------------------------------------------------------------------------------------------

LEVELS = (staging.SPIKE, staging.HIGH_SPIKE, staging.TOP_SPIKE)
bars_query("feat_price_asinh", price.asinh_lags, 337, fs.asinh_lags())
bars_query("feat_price_lags", price.lags, 673, fs.lags())
bars_query("feat_price_rolling", price.rolling, 2015, fs.rolling())
add("feat_price_rolling_fine", lambda spark, d: price.rolling_long(staging.fine(spark, d), staging.FINE), f"with {staging.FINE_BARS} {sql.select(fs.rolling(), 'fine')}")
bars_query("feat_price_regime", lambda s: price.regime(s, spike=staging.TOP_SPIKE), 335, fs.regime(staging.TOP_SPIKE))
bars_query("feat_price_since_spike", lambda s: price.since_spike(s, levels=LEVELS, step=HOUR), 672, fs.since_spike(LEVELS, 2, 672))
bars_query("feat_price_predictors", lambda s: price.predictors(s, spike=staging.TOP_SPIKE, intense=staging.HIGH_SPIKE), 335, fs.predictors(staging.TOP_SPIKE, staging.HIGH_SPIKE))
add(
    "feat_price_year",
    lambda spark, d: family(staging.daily(spark, d), lambda s: price.long_range(s, base=365, spike=200.0), 365 + 96, 0, 2880, DAY),
    f"with {staging.DAILY} {sql.select(fs.long_range(365, 200.0), 'daily')}",
)
_pairs = [(a, b) for a in staging.REGIONS for b in staging.REGIONS if a != b]
_wide = ", ".join(f"max(case when region = '{r}' then price end) as p_{r}" for r in staging.REGIONS)
_spread = {f"{a}_vs_{b}_spread": f"p_{a} - p_{b}" for a, b in _pairs}
_hits = [sql.flag(f"p_{r} >= {staging.HIGH_SPIKE}") for r in staging.REGIONS]
add(
    "feat_price_regions",
    lambda spark, d: price.cross_region(staging.bars(spark, d), staging.REGIONS, HOUR, level=staging.HIGH_SPIKE),
    f"with {staging.BARS}, wide as (select ts, {_wide} from bars group by ts) "
    + sql.select(_spread | {f"{n}_lag_1": f"lag({x}) over (order by wide.ts)" for n, x in _spread.items()} | {"multi_region_spike": f"least({', '.join(_hits)})", "region_spike_count": " + ".join(_hits)}, "wide", TS),
)
add(
    "feat_price_cross",
    lambda spark, d: price.cross_year(staging.bars(spark, d)),
    f"with {staging.BARS}, wide as (select ts, {_wide} from bars group by ts) " + sql.select({"doy_sin": sql.turn("sin", "dayofyear(ts)", 365.25), "doy_cos": sql.turn("cos", "dayofyear(ts)", 365.25), "sa_spread_live": sql.clip("asinh((coalesce(p_sa, 0) - coalesce(p_nsw, 0)) / 100)", -10, 10)}, "wide", TS),
)


def _calendar(spark: SparkSession, d: str) -> DataFrame:
    days = spark.createDataFrame([(x,) for x in staging.HOLIDAYS], "date string").select(F.to_date("date").alias("date"))
    out = market.with_calendar(staging.hours(spark, d), days)
    return out.select("ts", *(F.col(c).cast("double") for c in out.columns if c != "ts"))


_days = ", ".join(f"date '{x}'" for x in staging.HOLIDAYS)
add("feat_calendar", _calendar, f"with {staging.BARS} {sql.select(fs.calendar(f'ts::date in ({_days})'), 'hours', TS)}")
_m = "(hour(ts) * 60 + minute(ts) + h * 60)"
_hr, _dw = f"({_m} % 1440 / 60.0)", f"((isodow(ts) - 1 + {_m} // 1440) % 7)"
add(
    "feat_target_calendar",
    lambda spark, d: market.target_calendar(staging.hours(spark, d), 24, 60),
    f"with {staging.BARS}, x as (select ts, h from hours, (select unnest(range(1, 25))::int as h)) "
    + sql.select({"target_hour_sin": sql.turn("sin", _hr, 24), "target_hour_cos": sql.turn("cos", _hr, 24), "target_dow_sin": sql.turn("sin", _dw, 7), "target_dow_cos": sql.turn("cos", _dw, 7), "target_is_weekend": sql.flag(f"{_dw} >= 5"), "target_is_evening": sql.flag(f"{_hr} >= 17 and {_hr} < 21"), "target_is_day": sql.flag(f"{_hr} >= 7 and {_hr} < 17"), "target_is_overnight": sql.flag(f"{_hr} < 7 or {_hr} >= 21")}, "x", f"{TS}, h"),
)

# Stand-ins for inputs that the tables lack, as arithmetic on the system series.
STANDINS = {
    "temp": "price * 0.15 + 8", "temp_2": "price * 0.1 + 15", "feelslike": "price * 0.16 + 9", "humidity": "demand * 2", "dew": "demand * 0.5", "temp_a": "price * 0.12 + 10", "temp_b": "price * 0.05 + 18", "temp_c": "price * 0.2",
    "solar": "avail_gen * 10", "solar_a": "avail_gen * 7", "wind": "demand * 1.0", "wind_2": "demand * 0.5", "cloud": "price * 0.4", "supply_stress": "demand / (avail_gen + 1)", "coal_mw": "demand * 30", "coal_declared": "avail_gen * 28",
    "gas_price": "abs(price) / 10", "pasa_avail": "avail_gen * 300", "pasa_demand50": "demand_forecast * 1.1", "reserve_code": "case when price > 200 then 2.0 when price >= 0 then 0.0 end",
}
STOOD = f"{staging.SYSTEM}, stood as (select *, " + ", ".join(f"({x})::double as {n}" for n, x in STANDINS.items()) + ", last_value(avail_gen ignore nulls) over (partition by region order by ts rows between unbounded preceding and current row) as avail_gen_filled from system)"


def stood(spark: SparkSession, d: str) -> DataFrame:
    x = staging.system(spark, d).selectExpr("*", *(f"cast({v} as double) as {n}" for n, v in STANDINS.items()))
    return rolling.filled(x, "avail_gen", "avail_gen_filled", HOUR, ["region"])


def stood_query(name: str, build: Callable[[Series], dict], before: int, columns: dict[str, str], after: int = 0) -> None:
    add(name, lambda spark, d: family(stood(spark, d), build, before, after), f"with {STOOD} {sql.select(columns, 'stood')}")


stood_query("feat_system", market.system, 336, fs.system())
stood_query("feat_demand", lambda s: market.demand(s, 500, (48, 672)), 672, fs.demand(500, (48, 672)))
stood_query("feat_stress", market.stress, 336, fs.stress())
stood_query("feat_coal", lambda s: market.coal(s, 2000.0, drop=60.0), 336, fs.coal(2000.0, 60.0))
stood_query("feat_gas", lambda s: market.gas(s, day=6, regime=400), 400, fs.gas(6, 400))
def _demand_fine(spark: SparkSession, d: str) -> DataFrame:
    means = {w: f"__mean_{w}" for w in (672, 2016)}
    x = windows.rolled(staging.fine(spark, d), [windows.Rolled(n, "demand", w, w // 2, None, "mean") for w, n in means.items()], staging.FINE)
    return family(x, lambda s: market.demand(s, 4032, means={w: F.col(n) for w, n in means.items()}), 4032, 0, 8640, staging.FINE)


add(
    "feat_demand_fine",
    _demand_fine,
    f"with {staging.FINE_BARS} {sql.select(fs.demand(4032, (672, 2016)), 'fine')}",
)


def _gas_fine(spark: SparkSession, d: str) -> DataFrame:
    x, ranks = market.with_ranks(staging.fine(spark, d), staging.FINE)
    return family(x, lambda s: market.gas(s, ranks=ranks), 1440, 0, 8640, staging.FINE)


add("feat_gas_fine", _gas_fine, f"with {staging.FINE_BARS} {sql.select(fs.gas(48, 8640), 'fine')}")
stood_query("feat_temperature", lambda s: market.temperature(s, 24), 336, fs.temperature(24), 24)
stood_query("feat_solar", lambda s: market.solar(s, ahead=24), 336, fs.solar(24), 24)
stood_query("feat_wind_cloud", lambda s: market.wind_cloud(s, ahead=24), 336, fs.wind_cloud(24), 24)
stood_query("feat_day_ahead", market.day_ahead, 95, fs.day_ahead(8000.0))
stood_query("feat_coal_offer", lambda s: market.coal_offer(s, 2000.0), 336, fs.coal_offer(2000.0))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    v = latest_vintage(staging.daily(spark, d), staging.vintages(spark, d), ["region"], "value", 7 * DAY, most=60)
    return market.forecast_steps(v.select("ts", "region", "h", (F.col("value") / 100).alias("rrp"), F.col("value").alias("avail"), (F.col("value") * 0.8).alias("demand50")), 2, 48)


add(
    "feat_forecast_steps", _steps,
    SQL["vintage_horizon"].replace(f"select {TS}, region, h, {number('avg(value)')} as value from x where h >= 1 group by x.ts, region, h", "")
    + f", y as (select ts, region, h, avg(value) as v from x where h between 2 and 49 group by all) select {TS}, region, h, {number('v / 100')} as pd_step, {number('asinh(v / 10000)')} as pd_asinh, {number(sql.flag('v / 100 > 300'))} as pd_spike, {number('v')} as pasa_avail, {number(sql.clip('v - v * 0.8', -5000, 10000))} as pasa_margin from y",
)


def _interactions(spark: SparkSession, d: str) -> DataFrame:
    s = Series(("region", "block"))
    x = grid.blocks(stood(spark, d), HOUR, 2880, 24, 1).select(
        "ts", "region", "own", "supply_stress", "temp", s.lag("price", 1).alias("lag_1"), s.lag("demand", 1).alias("demand_lag_1"), s.lead("price", 1).alias("rrp_1"), s.count_if(F.col("price") > 200, 24).alias("spike_count"),
        market.coal(s, 2000.0, drop=60.0)["coal_outage_flag"].alias("coal_outage_flag"), market.calendar()["is_peak"].alias("is_peak"), clip(F.col("temp") - 18, 0).alias("cdd"),
    ).where("own").drop("own")
    one = quantiles.quantile(x, "demand_lag_1", 0.75, "q75_demand").crossJoin(quantiles.quantile(x, "temp", 0.5, "mid_temp"))
    return market.interactions(x, one)


add(
    "feat_interactions", _interactions,
    f"with {STOOD}, x as (select ts, region, supply_stress, temp, {sql.lag('price', 1)} as lag_1, {sql.lag('demand', 1)} as demand_lag_1, {sql.lag('price', -1)} as rrp_1, {sql.roll('sum', sql.flag('price > 200'), 24)} as spike_count, {fs.coal(2000.0, 60.0)['coal_outage_flag']} as outage, {sql.flag('hour(ts) between 17 and 20')} as is_peak, {sql.clip('temp - 18', 0)} as cdd from stood), one as (select quantile_cont(demand_lag_1, 0.75) as q75, quantile_cont(temp, 0.5) as mid from x) "
    + sql.select({"stress_x_lag": "coalesce(supply_stress, 0) * coalesce(lag_1, 0)", "rrp_x_stress_sq": "coalesce(rrp_1, 0) * power(coalesce(supply_stress, 0), 2)", "outage_x_high_demand": f"outage * {sql.flag('demand_lag_1 > q75')}", "hot_day_peak": "greatest(coalesce(temp, mid) - 25, 0) * is_peak", "cdd_x_demand": "coalesce(cdd, 0) * coalesce(demand_lag_1, 0)", "spike_x_rrp": "coalesce(spike_count, 0) * ln(1 + greatest(coalesce(rrp_1, 0), 0))", "forward_squeeze": "coalesce(rrp_1, 0) - coalesce(lag_1, 0)"}, "x, one"),
)

# ---- targets, weights, labels ---------------------------------------------------------------------------------------

N_H = 96
TARGETS = f"{staging.BARS}, t as (select ts, region, price, unnest(range(1, {N_H + 1}))::int as h from bars), targets as (select t.ts, t.region, h, b.price as y from t left join bars b on b.region = t.region and b.ts = t.ts + to_hours(h - 1))"
add("targets_multi_h", lambda spark, d: blend.targets(staging.bars(spark, d), N_H), f"with {TARGETS} select {TS}, region, h, {number('y')} as y from targets")

#: Of prices filled forward, so that times with a value for every horizon exist.
FILLED = TARGETS.replace("t as (", "whole as (select ts, region, last_value(price ignore nulls) over (partition by region order by ts rows between unbounded preceding and current row) as price from bars), t as (", 1).replace("from bars), targets", "from whole), targets").replace("left join bars b", "left join whole b")


def filled_targets(spark: SparkSession, d: str) -> DataFrame:
    bars = rolling.filled(staging.bars(spark, d), "price", "__price", HOUR, ["region"]).select("ts", "region", F.col("__price").alias("price"))
    return blend.targets(bars, N_H)


def _split(spark: SparkSession, d: str) -> DataFrame:
    t = blend.targets(staging.bars(spark, d), N_H)
    return t.withColumn("split", blend.split("ts", F.lit("2024-01-20 00:00:00").cast("timestamp"), F.lit("2024-01-26 00:00:00").cast("timestamp")))


_split_sql = f"{TARGETS}, s as (select *, case when ts <= timestamp '2024-01-20' then 'train' when ts <= timestamp '2024-01-26' then 'valid' else 'test' end as split from targets)"
add(
    "targets_transformed",
    lambda spark, d: blend.capped(_split(spark, d).where("split <> 'test'")).select("ts", "region", "h", "split", "cap", "y_capped", "y_asinh"),
    f"with {_split_sql}, c as (select h, quantile_cont(y, 0.97) as cap from s where split = 'train' group by h) select {TS}, region, s.h, split, {number('cap')} as cap, {number('case when y is not null then asinh(least(y, cap) / 100) end')} as y_capped, {number('asinh(y / 100)')} as y_asinh from s join c on c.h = s.h where split <> 'test'",
)


def _weights(spark: SparkSession, d: str) -> DataFrame:
    rows = _split(spark, d).where("split = 'train'")
    span = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    x = rows.crossJoin(F.broadcast(span))
    pos, n = (F.unix_timestamp("ts") - F.unix_timestamp("lo")) / HOUR, (F.unix_timestamp("hi") - F.unix_timestamp("lo")) / HOUR + 1
    w = blend.recency(pos, n)
    return x.select("ts", "region", "h", *(c.alias(k) for k, c in blend.weights(w, F.col("y")).items()), *(c.alias(k) for k, c in blend.labels(F.col("y")).items()))


_w = "exp(1.5 * ((epoch(ts) - epoch(lo)) / 3600) / ((epoch(hi) - epoch(lo)) / 3600))"
add(
    "weights_labels", _weights,
    f"with {_split_sql}, x as (select * from s, (select min(ts) as lo, max(ts) as hi from s where split = 'train') where split = 'train') "
    + sql.select({"w": _w, "w_spike3": f"{_w} * case when y > 150 then 3 else 1 end", "w_spike10": f"{_w} * case when y > 150 then 10 else 1 end", "w_dip7": f"{_w} * case when y < 0 then 7 else 1 end", "is_spike": sql.flag("y > 150"), "is_dip": sql.flag("y < 0")}, "x", f"{TS}, region, h"),
)

# ---- quality and selection ------------------------------------------------------------------------------------------

add(
    "null_profile",
    lambda spark, d: quality.null_profile(staging.system(spark, d), ["price", "demand", "avail_gen", "demand_forecast"]),
    f"with {staging.SYSTEM} " + " union all ".join(f"select year(ts)::int as year, '{c}' as \"column\", count(*) - count({c}) as nulls, round((count(*) - count({c})) / count(*), 4) as share from system group by rollup(year(ts))" for c in ("price", "demand", "avail_gen", "demand_forecast")),
)
add(
    "grid_completeness",
    lambda spark, d: quality.completeness(staging.bars(spark, d).where("price is not null"), HOUR, ["region"]),
    f"with {staging.BARS} select region, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as \"end\", count(distinct ts) as actual, ((epoch(max(ts)) - epoch(min(ts))) / 3600 + 1)::bigint as expected, ((epoch(max(ts)) - epoch(min(ts))) / 3600 + 1)::bigint - count(distinct ts) as missing from bars where price is not null group by region",
)


add(
    "missing_times",
    lambda spark, d: quality.missing_times(staging.bars(spark, d).where("price is not null"), HOUR, keys=["region"]),
    f"with {staging.BARS}, g as (select region, ts from bars where price is not null), a as (select region, unnest(generate_series(min(ts), max(ts), interval 1 hour)) as ts from g group by region) select {TS}, region from a where (region, ts) not in (select (region, ts) from g)",
)
add(
    "fill_by_day",
    lambda spark, d: rolling.filled(staging.bars(spark, d), "price", "price_filled", DAY, ["region"], rows=1).select("ts", "region", "price_filled"),
    f"with {staging.BARS} select {TS}, region, {number('last_value(price ignore nulls) over (partition by region order by bars.ts rows between unbounded preceding and current row)')} as price_filled from bars",
)
FEATURES = ["price", "lag_1", "lag_2", "lag_24", "mean_24", "mean_48", "demand", "avail_gen"]
CANDIDATES = f"{staging.SYSTEM}, cand as (select ts, region, price, demand, avail_gen, {', '.join(f'{sql.lag(chr(112) + chr(114) + chr(105) + chr(99) + chr(101), k)} as lag_{k}' for k in (1, 2, 24))}, round(({sql.roll('mean', 'price', 24, 12)}) + 1e-9, 6) as mean_24, round(({sql.roll('mean', 'price', 48, 24)}) + 1e-9, 6) as mean_48, {sql.lag('price', -1)} as y1, {sql.lag('price', -6)} as y6 from system)"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Features and targets of the selection queries; means are rounded, so that equal ones tie in ranks."""
    s = Series(("region", "block"))
    x = grid.blocks(staging.system(spark, d), HOUR, 2880, 47, 6)
    mean = lambda w: F.round(s.roll("mean", "price", w, w // 2) + F.lit(1e-9), 6).alias(f"mean_{w}")
    out = x.select("ts", "region", "own", "price", "demand", "avail_gen", *(s.lag("price", k).alias(f"lag_{k}") for k in (1, 2, 24)), mean(24), mean(48), s.lead("price", 1).alias("y1"), s.lead("price", 6).alias("y6"))
    return out.where("own").drop("own")


_fpairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
add("corr_pairs", lambda spark, d: select.correlations(candidates(spark, d), FEATURES), f"with {CANDIDATES} " + " union all ".join(f"select '{a}' as a, '{b}' as b, {number(f'coalesce(corr({a}, {b}), 0)')} as r from cand" for a, b in _fpairs))
_rank = lambda v: f"(rank() over (order by {v}) + (count(*) over (partition by {v}) - 1) / 2.0)"
add(
    "spearman_pairs",
    lambda spark, d: select.correlations(candidates(spark, d), FEATURES, "spearman"),
    f"with {CANDIDATES} " + " union all ".join(f"select '{a}' as a, '{b}' as b, {number('coalesce(corr(ra, rb), 0)')} as r from (select {_rank(a)} as ra, {_rank(b)} as rb from cand where {a} is not null and {b} is not null)" for a, b in _fpairs),
)
_slot = lambda c: f"case when {c} is not null then " + " + ".join(f"({c} > l_{c}[ceil(len(l_{c}) * {k} / 8.0)::int])::int" for k in range(1, 8)) + " end"
_MI = (
    f"{CANDIDATES}, edges as (select " + ", ".join(f"list_sort(list({c}) filter (where {c} is not null)) as l_{c}" for c in (*FEATURES, "y1", "y6")) + " from cand), slots as (select " + ", ".join(f"{_slot(c)} as s_{c}" for c in (*FEATURES, "y1", "y6")) + " from cand, edges), mi as ("
    + " union all ".join(
        f"select '{f}' as feature, '{t}' as target, coalesce(greatest(sum(n / n_all * ln(n * n_all / (n_x * n_y))) - (count(*) - count(distinct x) - count(distinct y) + 1) / (2 * max(n_all)), 0), 0) as mi from (select x, y, n, sum(n) over () as n_all, sum(n) over (partition by x) as n_x, sum(n) over (partition by y) as n_y from (select s_{f} as x, s_{t} as y, count(*)::double as n from slots where s_{f} is not null and s_{t} is not null group by all))"
        for f in FEATURES for t in ("y1", "y6")
    ) + ")"
)


def _mi(spark: SparkSession, d: str) -> DataFrame:
    return select.mutual_information(candidates(spark, d), FEATURES, ["y1", "y6"])


add("mi_binned", _mi, f"with {_MI} select feature, target, {number('mi')} as mi from mi")
add(
    "rank_scores",
    lambda spark, d: select.rank_scores(_mi(spark, d).withColumn("h", F.when(F.col("target") == "y1", 1).otherwise(6))),
    f"with {_MI}, m as (select feature, avg(mi) as mean_mi from mi group by 1), o as (select feature, mean_mi, row_number() over (order by round(mean_mi, 9) desc, feature)::int as position from m) select mi.feature, case target when 'y1' then 1 else 6 end as h, {number('mi')} as mi, rank() over (partition by target order by round(mi, 9) desc)::int as rank, {number('mean_mi')} as mean_mi, position from mi join o on o.feature = mi.feature",
)
add(
    "topn_per_h",
    lambda spark, d: select.top_n(_mi(spark, d).withColumn("share", select.normalised(F.col("mi"))), 3, ["target"], F.desc(F.round("mi", 9))).select("target", "feature", "place", "share"),
    f"with {_MI} select target, feature, row_number() over (partition by target order by round(mi, 9) desc, feature)::int as place, {number('1 - exp(-mi)')} as share from mi qualify place <= 3",
)
_strong = ", ".join(f"abs(coalesce(corr({a}, {b}), 0)) > 0.95 or abs(coalesce((select corr(ra, rb) from (select {_rank(a)} as ra, {_rank(b)} as rb from cand where {a} is not null and {b} is not null)), 0)) > 0.95 as s_{i}_{j}" for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i < j)
_kept = lambda j: " and ".join(["true", *(f"not (s_{i}_{j} and k_{i})" for i in range(j))])
#: The greedy walk, one step a feature: kept_<j> has whether each of the first j + 1 features is kept.
KEPT = f"strong as (select {_strong} from cand), kept_0 as (select *, true as k_0 from strong), " + ", ".join(f"kept_{j} as (select *, {_kept(j)} as k_{j} from kept_{j - 1})" for j in range(1, len(FEATURES)))
_walked = f"kept as (" + " union all ".join(f"select '{f}' as feature, {j + 1} as position, k_{j} as kept from kept_{len(FEATURES) - 1}" for j, f in enumerate(FEATURES)) + ")"
add("dedup_features", lambda spark, d: select.deduplicate(candidates(spark, d), FEATURES), f"with {CANDIDATES}, {KEPT}, {_walked} select * from kept")
add(
    "cv_folds",
    lambda spark, d: select.folds(staging.hours(spark, d), 3).select("ts", "fold"),
    f"with {staging.BARS}, p as (select ts, row_number() over (order by ts) - 1 as i, count(*) over () as n from hours) select {TS}, case when i >= n - 3 * (n // 4) then ((i - (n - 3 * (n // 4))) // (n // 4) + 1)::int else 0 end as fold from p",
)
add("sample_seeded", lambda spark, d: select.sample(staging.hours(spark, d), 200, 42), f"with {staging.BARS} select {TS} from hours order by md5(strftime(hours.ts, '%Y-%m-%d %H:%M:%S') || ':42'), hours.ts limit 200")

# ---- blends, policies, evaluation -----------------------------------------------------------------------------------

PREDICTED = f"{staging.BARS}, pr as (select ts, region, price as y, {sql.lag('price', 1)} as l1, {sql.lag('price', 2)} as l2, {sql.roll('max', 'price', 24, 12, 1)} as p90, {sql.roll('min', 'price', 24, 12, 1)} as p10, {sql.lag('price', 24)} as naive from bars), pred as (select *, case when l1 is not null and p90 is not null then greatest(least(l1 / p90, 1), 0) end as p, l1 as base from pr)"


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """Lags and rolling extremes stand in for models' predictions."""
    s = Series(("region", "block"))
    x = grid.blocks(staging.bars(spark, d), HOUR, 2880, 25)
    x = x.select("ts", "region", "own", F.col("price").alias("y"), s.lag("price", 1).alias("l1"), s.lag("price", 2).alias("l2"), s.roll("max", "price", 24, 12, 1).alias("p90"), s.roll("min", "price", 24, 12, 1).alias("p10"), s.lag("price", 24).alias("naive")).where("own").drop("own")
    return x.withColumn("p", F.when(F.col("l1").isNotNull() & F.col("p90").isNotNull(), F.greatest(F.least(F.col("l1") / F.nullif("p90", F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))).withColumn("base", F.col("l1"))


def _search_sql(values, prediction: str, name: str) -> str:
    table = ", ".join(f"({i}, {v}::double)" for i, v in enumerate(values))
    return f"with {PREDICTED}, g(ordinal, a) as (values {table}), tried as (select region, ordinal, a, avg(abs(y - ({prediction}))) as mae from pred, g where y is not null group by all) select region, {number('arg_min(a, round(mae, 9) * 1000000 + ordinal * 0.0000001)')} as {name}, {number('min(mae)')} as mae from tried group by region"


add("blend_alpha", lambda spark, d: blend.line_search(predicted(spark, d), ["region"], "l1", "l2", blend.ALPHAS, "alpha"), _search_sql(blend.ALPHAS, "(1 - a) * l1 + a * l2", "alpha"))
add("naive_blend", lambda spark, d: blend.line_search(predicted(spark, d), ["region"], "base", "naive", blend.NAIVE_WEIGHTS, "weight"), _search_sql(blend.NAIVE_WEIGHTS, "(1 - a) * base + a * naive", "weight"))


def _policies(spark: SparkSession, d: str) -> DataFrame:
    x = predicted(spark, d)
    lit = F.lit
    spikes = [blend.spike_policy(F.col("base"), F.col("p"), F.col("p90"), lit(m), lit(0.3), lit(2.0), lit(0.8)).alias(f"spike_{m}") for m in (0, 1, 2)]
    dips = [blend.dip_policy(F.col("base"), 1 - F.col("p"), F.col("p10"), lit(m), lit(0.3), lit(2.0), lit(0.8)).alias(f"dip_{m}") for m in (0, 1, 2)]
    return x.where("base is not null and p90 is not null and p10 is not null and p is not null").select("ts", "region", *spikes, *dips)


_r = lambda p: f"power(greatest(least(({p} - 0.3) / (1 - 0.3 + 1e-6), 1), 0), 2)"
_up, _down = "greatest(p90 - base, 0)", "greatest(base - p10, 0)"
add(
    "policies", _policies,
    f"with {PREDICTED} " + sql.select({"spike_0": "(1 - p) * base + p * p90", "spike_1": f"base + {_up} * 0.8 * {_r('p')}", "spike_2": f"case when p >= 0.3 then base + 2 * {_up} else base end", "dip_0": "p * base + (1 - p) * p10", "dip_1": f"base - 0.8 * {_r('(1 - p)')} * {_down}", "dip_2": f"case when 1 - p >= 0.3 then base - 0.8 * {_down} else base end"}, "pred where base is not null and p90 is not null and p10 is not null and p is not null"),
)
_values = lambda settings: ", ".join(f"({i}, '{s}', {m}, {t}::double, {p}::double, {w}::double)" for i, s, m, t, p, w in settings)
add(
    "policy_grid",
    lambda spark, d: policy.spike_search(predicted(spark, d), ["region"]),
    f"""with {PREDICTED}, g(ordinal, source, mode, threshold, power, weight) as (values {_values(policy.spike_settings())}),
    v as (select *, case source when 'p90' then p90 when 'l1' then l1 else greatest(p90, l1) end as s from pred, g where y is not null and base is not null and p90 is not null and l1 is not null and p is not null),
    w as (select *, case mode when 0 then (1 - p) * base + p * s when 1 then base + greatest(s - base, 0) * weight * power(greatest(least((p - threshold) / (1 - threshold + 1e-6), 1), 0), power) else case when p >= threshold then base + power * greatest(s - base, 0) else base end end as made from v),
    e as (select region, ordinal, source, mode, threshold, power, weight, 2.2 * coalesce(avg(abs(y - made)) filter (where y > 150), 0) + 1.3 * coalesce(avg(abs(y - made)) filter (where y < 0), 0) + coalesce(avg(abs(y - made)) filter (where y <= 150), 0) + 0.25 * avg(abs(y - made)) as score,
      coalesce(avg(abs(y - made)) filter (where y <= 150), 0) as calm from w group by all),
    l as (select region, calm + 0.20 as most from e where mode = 0 and source = 'p90')
    select region, source, mode, {number("threshold")} as threshold, {number("power")} as power, {number("weight")} as weight, {number("score")} as score from e join l using (region) where calm <= most qualify row_number() over (partition by region order by round(score, 9), ordinal) = 1""",
)


def _dip_sql(source: str, per: str) -> str:
    """source: a table cand with y, base, p, dip and the group."""
    return f"""{source}, g(ordinal, source, mode, threshold, power, weight) as (values {_values(policy.dip_settings())}),
    ok as (select * from cand where y is not null and base is not null and p is not null and dip is not null),
    w as (select ok.*, g.*, case mode when 0 then (1 - p) * base + p * dip when 1 then base - weight * power(greatest(least((p - threshold) / (1 - threshold + 1e-6), 1), 0), power) * greatest(base - dip, 0) else case when p >= threshold then base - weight * greatest(base - dip, 0) else base end end as made from ok, g
      union all select ok.*, -1, 'dip', 9, 0, 0, 0, base from ok),
    e as (select {per}, ordinal, mode, threshold, power, weight, round(2.2 * coalesce(avg(abs(y - made)) filter (where y > 150), 0) + 1.3 * coalesce(avg(abs(y - made)) filter (where y < 0), 0) + coalesce(avg(abs(y - made)) filter (where y <= 150), 0) + 0.25 * avg(abs(y - made)), 9) as score,
      coalesce(avg(abs(y - made)) filter (where y between 0 and 150), avg(abs(y - made))) as mid from w group by all),
    l as (select {per}, mid + 0.15 as most, score as base_score from e where ordinal = -1),
    t as (select e.*, base_score, mid <= most and score < base_score as good from e join l using ({per}) where ordinal >= 0)
    select {per}, mode, {number("threshold")} as threshold, {number("power")} as power, {number("weight")} as weight, {number("case when good then score else base_score end")} as score from t qualify row_number() over (partition by {per} order by not good, case when good then score end, ordinal) = 1"""


add("dip_search", lambda spark, d: policy.dip_search(predicted(spark, d).select("region", "y", "base", (1 - F.col("p")).alias("p"), F.col("p10").alias("dip")), ["region"]), _dip_sql(f"with {PREDICTED}, cand as (select region, y, base, 1 - p as p, p10 as dip from pred)", "region"))
_M = {
    "mae": "avg(abs(e))", "rmse": "sqrt(avg(e * e))", "r2": "1 - sum(e * e) / (var_pop(y) * count(*))", "mbe": "avg(e)", "wmape": "sum(abs(e)) / (sum(abs(y)) + 1e-8) * 100", "mae_naive": "avg(abs(naive - y))", "skill": "(1 - avg(abs(e)) / avg(abs(naive - y))) * 100",
    "mae_spike": "avg(abs(e)) filter (where y > 150)", "mae_calm": "avg(abs(e)) filter (where y <= 150)", "mae_dip": "avg(abs(e)) filter (where y < 0)", "spike_share": f"avg({sql.flag('y > 150')}) * 100", "dip_share": f"avg({sql.flag('y < 0')}) * 100",
}
_metric = ", ".join(f"{number(x)} as {n}" for n, x in _M.items())
add("naive_metrics", lambda spark, d: blend.metrics(predicted(spark, d).withColumn("yhat", F.col("l1")), ["region"]), f"with {PREDICTED}, m as (select *, l1 - y as e from pred where y is not null and l1 is not null) select region, count(*) as n, {_metric} from m group by region")
add("metrics_overall", lambda spark, d: blend.metrics(predicted(spark, d).withColumn("yhat", F.col("p90"))), f"with {PREDICTED}, m as (select *, p90 - y as e from pred where y is not null and p90 is not null) select count(*) as n, {_metric} from m")


def _by_horizon(spark: SparkSession, d: str) -> DataFrame:
    s = Series(("region", "block"))
    now = grid.blocks(staging.bars(spark, d), HOUR, 2880, 24).select("ts", "region", "own", s.lag("price", 1).alias("yhat"), s.lag("price", 24).alias("naive")).where("own").drop("own")
    full = blend.complete(filled_targets(spark, d), N_H, ["ts", "region"])
    return blend.metrics(full.join(now, ["ts", "region"]), ["h"]).withColumn("lead_hours", F.col("h") * 30 / 60)


add(
    "metrics_by_h", _by_horizon,
    f"with {FILLED}, ok as (select ts, region from targets group by all having count(y) = {N_H}), now as (select ts, region, {sql.lag('price', 1)} as yhat, {sql.lag('price', 24)} as naive from bars), m as (select h, y, naive, yhat - y as e from targets join ok using (ts, region) join now using (ts, region) where y is not null and yhat is not null) select h, count(*) as n, {_metric}, {number('h * 30 / 60')} as lead_hours from m group by h",
)
_all_h = range(1, N_H + 1)
add(
    "valid_rows",
    lambda spark, d: blend.wide_rows(blend.complete(filled_targets(spark, d), N_H, ["ts", "region"]), N_H, ["ts", "region"], {"y": "y"}),
    f"with {FILLED}, w as (select ts, region, list(y order by h) as a from targets group by all having count(y) = {N_H}) select {TS}, region, " + ", ".join(f"{number(f'a[{k}]')} as y_h{k}" for k in _all_h) + " from w",
)

# ---- model fits (rows only) -----------------------------------------------------------------------------------------

FIT = ["price", "lag_1", "lag_24", "mean_24"]
#: Rounds, depth and rate of the substitute's fits.
BOOST = {"rounds": 8, "depth": 3, "rate": 0.3}


def _training(spark: SparkSession, d: str, h: int = 1) -> DataFrame:
    """Features, targets, labels and weights of a horizon; is_train for the first 70 % of the times, is_valid for the last part of these."""
    x = models.chronological(candidates(spark, d)).where(f"y{h} is not null")
    y = F.col(f"y{h}")
    lab, w = blend.labels(y, 150.0), blend.weights(F.lit(1.0), y)
    return x.withColumns({"y": y, "y_asinh": asinh100(y), "y_capped": asinh100(F.least(y, F.lit(400.0))), "is_valid": ~F.col("is_train"), **lab, **w})


def _quantile(spark: SparkSession, d: str) -> DataFrame:
    """p90 and p10: an absolute-loss model each, and the quantile of its residuals in the prediction's bucket."""
    x = _training(spark, d)
    out = x.where("not is_train").select("ts", "region", "y_asinh", *FIT)
    for spec in (models.SPECS[4], models.SPECS[7]):
        model = models.fit(x.where("is_train"), spec, FIT, **BOOST)
        train = models.predict(x.where("is_train"), spec, model, FIT).withColumnRenamed(spec.name, "mid")
        scored = models.predict(out, spec, model, FIT).withColumnRenamed(spec.name, f"mid_{spec.name}")
        out = models.residual_quantile(train.withColumnRenamed("mid", f"mid_{spec.name}"), scored, f"mid_{spec.name}", "y_asinh", spec.quantile, spec.name)
    return out.select("ts", "region", "y_asinh", "mid_p90", "p90", "mid_p10", "p10")


def _isotonic(spark: SparkSession, d: str) -> DataFrame:
    x = _training(spark, d).where("price is not null")
    return models.calibrate(x.where("is_train"), x.where("not is_train"), "price", "y1", "calibrated").select("ts", "region", "price", "calibrated")


add("quantile_substitute", _quantile)
_TRAIN = f"{CANDIDATES}, cut as (select quantile_cont(epoch(ts), 0.7) as t from cand), tr as (select *, epoch(ts) <= t as is_train from cand, cut where y1 is not null)"
add(
    "isotonic", _isotonic,
    f"""with {_TRAIN}, u as (select price as x, sum(y1) as s, count(*) as n, row_number() over (order by price) as i from tr where is_train and price is not null group by price),
    big as (select sum(n) >= 500 as fits from u),
    c as (select *, sum(s) over w as ss, sum(n) over w as nn from u window w as (order by i rows between unbounded preceding and current row)),
    pair as (select a.i as a, b.i as b, (b.ss - a.ss + a.s) / (b.nn - a.nn + a.n) as m from c a join c b on b.i >= a.i, big where fits),
    low as (select a, b as i, min(m) over (partition by a order by b rows between current row and unbounded following) as m from pair),
    fit as (select c.x, f.v from (select i, max(m) as v from low group by i) f join c using (i)),
    test as (select ts, region, price as x from tr where not is_train and price is not null),
    lo as (select test.*, fit.x as xa, fit.v as va from test asof left join fit on test.x >= fit.x),
    ends as (select lo.*, fit.x as xb, fit.v as vb from lo asof left join fit on lo.x < fit.x)
    select {TS}, region, {number("x")} as price, {number("case when va is null and vb is null then x when va is null then vb when vb is null then va else va + (vb - va) * (x - xa) / (xb - xa) end")} as calibrated from ends""",
)
