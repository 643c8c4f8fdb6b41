"""The given tables laid out as market series, once as DataFrames and once as the SQL of the same names.

bars: hourly price of four regions on the dense grid (gaps are null), from events. system: demand, available capacity, net
interchange and demand forecast of the same hours. daily: daily price of five series, from orders. registry, scada,
vintages and bids stand in for the unit registry, unit output, forecast runs and offers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.operators import grid
from gridcast.operators.rolling import Series, filled

REGIONS = ["nsw", "qld", "vic", "sa"]
# Which event type stands for which region, and the thresholds that fit hourly means.
REGION_OF = {"click": "nsw", "error": "qld", "view": "vic", "purchase": "sa"}
FINE = 300
SPIKE, HIGH_SPIKE, TOP_SPIKE = 50.0, 100.0, 200.0
HOLIDAYS = ["2024-01-01", "2024-01-06", "2024-01-12", "2024-01-15", "2024-01-26", "2024-01-29"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    region = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in REGION_OF.items()))
    return e.select(F.col("ts").cast("timestamp").alias("ts"), region.alias("region"), F.col("event_type"), F.col("value"))


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r,) for r in REGIONS], "region string")


def money(x: str):
    """Sums of prices as decimals, so that no order of rows changes them."""
    return F.sum(F.col(x).cast("decimal(18,2)")).cast("double")


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = events(spark, sf_dir).agg(F.date_trunc("hour", F.min("ts")).alias("lo"), F.date_trunc("hour", F.max("ts")).alias("hi"))
    return grid.calendar(span, grid.HOUR)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(spark, sf_dir).select("ts", "region", "price")


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and number of events of each hour and region on the dense grid: one grouped pass over events (a region is null for 'signup'), and one for their span."""
    e = events(spark, sf_dir).where("region is not null")
    found = e.groupBy(grid.bucket("ts", grid.HOUR).alias("ts"), "region").agg((money("value") / F.count("value") - 30.0).alias("price"), (F.count("*") * 10.0).alias("demand"))
    return hours(spark, sf_dir).crossJoin(F.broadcast(regions(spark))).join(found, ["ts", "region"], "left")


def fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of the regions on the grid of five minutes, gaps filled forward, and a demand and a gas price that follow it."""
    e = events(spark, sf_dir).where("region is not null")
    found = e.groupBy(grid.bucket("ts", FINE).alias("ts"), "region").agg((money("value") / F.count("value") - 30.0).alias("price"))
    span = events(spark, sf_dir).agg(grid.bucket(F.min("ts"), FINE).alias("lo"), grid.bucket(F.max("ts"), FINE).alias("hi"))
    dense = grid.densify(found, FINE, regions(spark), ["region"], span=span)
    out = filled(dense, "price", "price", FINE, ["region"])
    return out.select("ts", "region", "price", (F.col("price") * 3 + 100).alias("demand"), (F.abs("price") / 10).alias("gas_price"))


def system(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = events(spark, sf_dir).where("event_type = 'signup'").groupBy(grid.bucket("ts", grid.HOUR).alias("ts")).agg(F.count("*").alias("extra"))
    # the four regions of an hour meet in one row, so the next region's price needs no join of the series with itself
    row = _hourly(spark, sf_dir).groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("region", F.struct("price", "demand")))).alias("all"))
    following = F.create_map(*[x for i, r in enumerate(REGIONS) for x in (F.lit(REGIONS[i - 1]), F.lit(r))])
    out = row.join(extra, "ts", "left").select("ts", "extra", "all", F.explode("all").alias("region", "own"))
    out = out.select("ts", "region", "own.price", "own.demand", "extra", F.element_at("all", following[F.col("region")])["price"].alias("other"))
    s = Series(("region", "block"))
    return grid.blocks(out, grid.HOUR, 2880, 1).select(
        "own", "ts", "region", "price", "demand",
        (F.col("demand") * 1.2 + F.coalesce("extra", F.lit(0))).alias("avail_gen"),
        s.lag("demand", 1).alias("demand_forecast"),
        (F.col("other") - F.col("price")).alias("interchange"),
        (F.col("demand") * 0.9).alias("dispatch_gen"),
    ).where("own").drop("own")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.to_timestamp(F.to_date("o_orderdate")).alias("ts"), F.substring("o_orderpriority", 1, 1).alias("region"), "o_totalprice")
    found = o.groupBy("ts", "region").agg((money("o_totalprice") / F.count("o_totalprice") / 1000 - 150).alias("price"))
    keys = o.select("region").distinct()
    return grid.densify(found, 86400, keys, ["region"])


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    out = p.join(pairs, p["p_partkey"] == pairs["l_partkey"]).join(s, s["s_suppkey"] == pairs["l_suppkey"])
    out = out.join(F.broadcast(n), n["n_nationkey"] == s["s_nationkey"]).join(F.broadcast(r), r["r_regionkey"] == n["n_regionkey"])
    return out.select(F.col("p_partkey").alias("duid"), F.upper("r_name").alias("region"), F.col("s_name").alias("participant"), F.col("p_brand").alias("station"), F.col("p_type").alias("fuel"), F.col("p_size").alias("size"), F.col("p_name").alias("descriptor"), F.col("n_name").alias("class"))


def scada(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_partkey").alias("duid"), (F.col("l_quantity") * sign).cast("double").alias("mw"))


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_orderdate").cast("timestamp").alias("run_ts"), F.col("l_shipdate").cast("timestamp").alias("interval_ts"), F.substring("o_orderpriority", 1, 1).alias("region"), F.col("l_extendedprice").cast("double").alias("value"))


def bids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Offers by time and unit (ten volumes), and day prices by unit (ten prices)."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    volume = li.select(F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_partkey").alias("duid"), F.col("l_quantity").cast("double").alias("max_avail"), *((F.col("l_quantity") * i).cast("double").alias(f"band{i}") for i in range(1, 11)))
    days = li.select(F.to_date("l_shipdate").alias("day"), F.col("l_partkey").alias("duid")).distinct()
    price = days.join(p, p["p_partkey"] == days["duid"]).select("day", "duid", *((F.col("p_retailprice") * (i - 3) / 2).cast("double").alias(f"price{i}") for i in range(1, 11)))
    return volume, price


_CASE = " ".join(f"when '{k}' then '{v}'" for k, v in REGION_OF.items())
_NAMES = ", ".join(f"'{r}'" for r in REGIONS)
_NEXT = " ".join(f"when '{r}' then '{REGIONS[i - 1]}'" for i, r in enumerate(REGIONS))
BARS = f"""
ev as (select date_trunc('hour', ts)::timestamp as h, ts::timestamp as ts, event_type, case event_type {_CASE} end as region, value from events),
span as (select min(h) as lo, max(h) as hi from ev),
hours as (select unnest(generate_series(lo, hi, interval 1 hour)) as ts from span),
regions as (select unnest([{_NAMES}]) as region),
found as (select h, region, sum(value::decimal(18,2))::double / count(value) - 30.0 as price, count(*) * 10.0::double as demand from ev where region is not null group by all),
bars as (select hours.ts, regions.region, price from hours cross join regions left join found on h = hours.ts and found.region = regions.region)
"""
FINE_BARS = f"""
ev as (select ts::timestamp as ts, case event_type {_CASE} end as region, value from events),
at5 as (select to_timestamp(floor(epoch(ts) / 300) * 300)::timestamp as m5, region, value from ev),
grid5 as (select unnest(generate_series(min(m5), max(m5), interval 5 minute)) as ts from at5),
found5 as (select m5, region, sum(value::decimal(18,2))::double / count(value) - 30.0 as price from at5 where region is not null group by all),
dense5 as (select grid5.ts, r.region, price from grid5 cross join (select unnest([{_NAMES}]) as region) r left join found5 on m5 = grid5.ts and found5.region = r.region),
filled5 as (select ts, region, last_value(price ignore nulls) over (partition by region order by ts rows between unbounded preceding and current row) as price from dense5),
fine as (select *, price * 3 + 100 as demand, abs(price) / 10 as gas_price from filled5)
"""
SYSTEM = f"""{BARS},
extra as (select h, count(*) as extra from ev where event_type = 'signup' group by h),
full0 as (
  select b.ts, b.region, b.price, f.demand, f.demand * 1.2 + coalesce(extra, 0) as avail_gen, o.price - b.price as interchange, f.demand * 0.9 as dispatch_gen
  from bars b left join found f on f.h = b.ts and f.region = b.region left join extra e on e.h = b.ts
  left join bars o on o.ts = b.ts and case o.region {_NEXT} end = b.region
),
system as (select *, lag(demand) over (partition by region order by ts) as demand_forecast from full0)
"""
DAILY = """
o as (select o_orderdate::date::timestamp as ts, substr(o_orderpriority, 1, 1) as region, o_totalprice from orders),
dfound as (select ts, region, sum(o_totalprice::decimal(18,2))::double / count(o_totalprice) / 1000 - 150 as price from o group by all),
ddays as (select unnest(generate_series(min(ts), max(ts), interval 1 day)) as ts from o),
daily as (select ddays.ts, k.region, price from ddays cross join (select distinct region from o) k left join dfound on dfound.ts = ddays.ts and dfound.region = k.region)
"""
REGISTRY = """
pairs as (select l_partkey, min(l_suppkey) as l_suppkey from lineitem group by 1),
registry as (
  select p_partkey as duid, upper(r_name) as region, s_name as participant, p_brand as station, p_type as fuel, p_size as size, p_name as descriptor, n_name as class
  from part join pairs on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey
)
"""
SCADA = """scada as (select l_shipdate::timestamp as ts, l_partkey as duid, (l_quantity * case when l_returnflag = 'R' then -1 else 1 end)::double as mw from lineitem)"""
VINTAGES = """vintages as (
  select o_orderdate::timestamp as run_ts, l_shipdate::timestamp as interval_ts, substr(o_orderpriority, 1, 1) as region, l_extendedprice::double as value
  from lineitem join orders on l_orderkey = o_orderkey
)"""
BIDS = f"""
volume as (select l_shipdate::timestamp as ts, l_partkey as duid, l_quantity::double as max_avail, {", ".join(f"(l_quantity * {i})::double as band{i}" for i in range(1, 11))} from lineitem),
day_price as (
  select day, duid, {", ".join(f"(p_retailprice * ({i} - 3) / 2)::double as price{i}" for i in range(1, 11))}
  from (select distinct l_shipdate::date as day, l_partkey as duid from lineitem) join part on p_partkey = duid
)
"""
