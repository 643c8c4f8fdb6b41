"""Landed tables in, regular long tables out: loads, merges, regularisers, roll-ups and parsers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcast.functions.scalar import clip, to_number, to_time
from gridcast.operators import grid
from gridcast.operators.asof import asof_backward


def month(ts: str = "ts") -> Column:
    return F.trunc(F.col(ts).cast("date"), "month")


def loaded_months(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Months that hold rows; only the time column is read."""
    return df.select(month(ts).alias("month")).distinct()


def months_to_load(spark: SparkSession, first: str, last: str, present: DataFrame) -> DataFrame:
    wanted = spark.sql(f"select explode(sequence(trunc(date'{first}', 'month'), trunc(date'{last}', 'month'), interval 1 month)) as month")
    return wanted.join(present, "month", "left_anti")


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both loads in one table, the later load's row for each key; repeating a load changes nothing."""
    both = old.withColumn("__load", F.lit(0)).unionByName(new.withColumn("__load", F.lit(1)))
    values = [F.desc(c) for c in old.columns if c not in keys]
    return keep_one(both, keys, [F.desc("__load"), *values]).drop("__load")


def write_months(df: DataFrame, path: str, ts: str = "ts", files: int = 8) -> None:
    """Replaces the months that df holds and leaves the others. Times are dealt into about `files` files a month, so that a month isn't one task."""
    out = df.withColumn("month", F.date_format(F.col(ts), "yyyy-MM"))
    out.repartition("month", F.pmod(F.xxhash64(ts), F.lit(files))).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("month").parquet(path)


def by_priority(sources: Sequence[DataFrame], ts: str = "ts") -> DataFrame:
    """For each month the rows of the first source that has any; a month that none has is absent."""
    union = reduce(lambda a, b: a.unionByName(b), (s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)))
    first = union.groupBy(month(ts).alias("__m")).agg(F.min("source").alias("__s"))
    return union.join(F.broadcast(first), (month(ts) == F.col("__m")) & (F.col("source") == F.col("__s"))).drop("__m", "__s")


def regular_prices(raw: DataFrame, step: int, dimensions: DataFrame, values: Sequence[str] = ("price",), key: str = "region", ts: str = "ts") -> DataFrame:
    """Coerced values, mean of each (time, key), then bucket means on the dense grid."""
    clean = raw.select(to_time(ts).alias(ts), F.trim(key).alias(key), *(to_number(v).alias(v) for v in values))
    once = clean.groupBy(ts, key).agg(*(F.avg(v).alias(v) for v in values))
    return grid.regularise(once, step, dimensions, [key], values, ts)


def clean_registry(raw: DataFrame) -> DataFrame:
    """Units on the market: id and fuel present, no loads; biomass by its name, fossil fuels by their descriptor, region without its last '1'."""
    text = lambda c: F.trim(F.col(c))
    fuel, descriptor = text("fuel"), F.lower(text("descriptor"))
    kept = raw.where((text("dispatch") != "Load") & (text("duid") != "-") & (fuel != "") & (fuel != "-") & (text("category") != "Non-Market"))
    group = F.when(F.lower(fuel).contains("biomass"), "Biomass").when((F.lower(fuel) == "fossil") & descriptor.contains("coal"), "Coal").when(F.lower(fuel) == "fossil", "Gas").otherwise(F.initcap(fuel))
    return kept.select(text("duid").alias("duid"), F.upper(F.regexp_replace(text("region"), "1$", "")).alias("region"), group.alias("fuel"), text("participant").alias("participant"), text("station").alias("station"))


def flows(registry: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Unit counts between neighbouring levels of the registry, by region: one pass."""
    pairs = F.array(*(F.struct(F.lit(i).alias("level"), F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target")) for i, (a, b) in enumerate(zip(levels, levels[1:], strict=False))))
    return registry.select("region", F.explode(pairs).alias("p")).groupBy("region", "p.level", "p.source", "p.target").agg(F.count("*").alias("n"))


def participants(registry: DataFrame) -> DataFrame:
    """Participants of each region by number of distinct units, most first."""
    n = registry.groupBy("region", "participant").agg(F.countDistinct("duid").alias("units"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("units"), "participant")))


def fuel_rollup(scada: DataFrame, registry: DataFrame, step: int, battery: str, fuels: Sequence[str], regions: Sequence[str]) -> DataFrame:
    """Output by fuel and region: negatives count as 0, batteries are split into charge and discharge, every combination is there, gaps are 0.

    registry (duid, fuel, region) is joined without a hint: AQE broadcasts it while it is small. Values are summed by (time, fuel, region) and
    then averaged by bucket; both aggregations combine before the shuffle.
    """
    x = scada.join(registry.select("duid", "fuel", "region"), "duid")
    is_battery = F.col("fuel") == battery
    sides = F.when(is_battery, F.array(F.struct(F.lit("charge").alias("fuel"), clip(-F.col("mw"), 0).alias("mw")), F.struct(F.lit("discharge").alias("fuel"), clip(F.col("mw"), 0).alias("mw"))))
    plain = F.array(F.struct(F.col("fuel").alias("fuel"), clip(F.col("mw"), 0).alias("mw")))
    long = x.select("ts", "region", F.explode(F.coalesce(sides, plain)).alias("s")).select("ts", "region", "s.fuel", "s.mw")
    summed = long.groupBy("ts", "region", "fuel").agg(F.sum("mw").alias("mw"))
    spark = scada.sparkSession
    names = [f for f in fuels if f != battery] + ["charge", "discharge"]
    dims = spark.createDataFrame([(r, f) for r in regions for f in names], "region string, fuel string")
    return grid.regularise(summed, step, dims, ["region", "fuel"], ["mw"]).withColumn("mw", F.coalesce("mw", F.lit(0.0)))


def daily_to_grid(daily: DataFrame, times: DataFrame, value: str, day: str = "day", ts: str = "ts") -> DataFrame:
    """A daily value on every time of its day, then filled forward and, at the beginning, backward."""
    joined = times.join(daily.select(F.col(day).alias("__d"), value), F.to_date(ts) == F.col("__d"), "left").drop("__d")
    by_day = joined.groupBy(F.to_date(ts).alias("__d")).agg(F.first(value).alias("__v"))
    w = Window.orderBy("__d")  # one row for each day
    filled = by_day.select("__d", F.coalesce(F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("__v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).alias("__f"))
    return joined.join(F.broadcast(filled), F.to_date(ts) == F.col("__d")).withColumn(value, F.coalesce(value, "__f")).drop("__d", "__f")


def readings_to_grid(readings: DataFrame, times: DataFrame, by: Sequence[str], value: str, ts: str = "ts") -> DataFrame:
    """An irregular reading carried forward to every time, the first one backward; of readings at one time the largest counts."""
    found = asof_backward(times, readings, by, [value], ts, ts)
    first = readings.groupBy(*by).agg(F.min_by(value, ts).alias("__first"))
    return found.join(first, list(by), "left").withColumn(value, F.coalesce(value, "__first")).drop("__first", "matched_ts")


def clean_weather(raw: DataFrame, city: str, ts: str = "ts") -> DataFrame:
    """First row of each (time, city), plain column names, numbers only, columns without any number dropped (one row of counts comes to the driver)."""
    names = {c: "".join(c.strip().lower().split()) for c in raw.columns if c not in (ts, city)}
    once = keep_one(raw, [ts, city], [F.col(c) for c in raw.columns if c not in (ts, city)])
    typed = once.select(to_time(ts).alias(ts), city, *(to_number(F.col(f"`{c}`")).alias(n) for c, n in names.items()))
    counts = typed.agg(*(F.count(n).alias(n) for n in names.values())).first().asDict() if names else {}
    return typed.select(ts, city, *(n for n in names.values() if counts[n]))


def tagged_records(lines: DataFrame, table: str, columns: Sequence[str], line: str = "line", file: str = "file", number: str = "n") -> DataFrame:
    """Rows of a tagged text: an `I` line names a table's columns, the `D` lines of that table hold values.

    lines: file, n (line number), line. Header and data lines meet in a join on (file, table); a column that the header
    lacks is null. The latest header of a table in a file counts.
    """
    parts = lines.select(file, number, F.split(line, ",").alias("p")).where(F.element_at("p", 2) == table)
    heads = parts.where(F.element_at("p", 1) == "I").groupBy(file).agg(F.max_by("p", number).alias("names"))
    data = parts.where(F.element_at("p", 1) == "D").join(heads, file)
    at = lambda c: F.try_element_at(F.col("p"), F.nullif(F.array_position("names", c).cast("int"), F.lit(0)))
    return data.select(file, number, *(at(c).alias(c.lower()) for c in columns))


def tagged_rows(lines: DataFrame, table: str, columns: Sequence[str], skip: int = 4, least: int = 5, intervention: str = "INTERVENTION", line: str = "line", file: str = "file", number: str = "n", most: int = 64) -> DataFrame:
    """Rows of a tagged text with quoted fields (at most `most` of them): an `I` line names a table's columns, which holds for the `D` lines after it up to the next one.

    The first `skip` fields are tags; tag, table and column names count in any case. Lines of fewer than `least` fields, data lines
    before any header, those that lack a wanted column, and those with an intervention other than 0 are left out. A
    file has a header line for each of its parts only, so data lines meet the headers of their file in an equi-join and keep the one whose range
    holds them.
    """
    fields = F.from_csv(line, ", ".join(f"c{i} string" for i in range(most)), {"mode": "PERMISSIVE", "escape": '"'})
    # named in a lambda, or the optimizer would parse a line once for each field; a line has at most as many fields as commas + 1, and no more are kept
    all_ = F.transform(F.array(fields), lambda x: F.array(*(x[f"c{i}"] for i in range(most))))[0]
    n = F.size(F.split(line, ","))
    parts = lines.where(n >= least).select(file, number, F.slice(all_, 1, F.least(n, F.lit(most))).alias("p"))
    parts = parts.where(F.upper(F.get("p", F.lit(1))) == table.upper())
    tag = F.upper(F.get("p", F.lit(0)))
    names = F.transform(F.slice("p", skip + 1, most), lambda c: F.upper(c))
    heads = parts.where(tag == "I").select(file, F.col(number).alias("__from"), names.alias("__names"))
    heads = heads.withColumn("__to", F.lead("__from").over(Window.partitionBy(file).orderBy("__from")))
    data = parts.where(tag == "D").join(heads, file).where((F.col(number) > F.col("__from")) & (F.col("__to").isNull() | (F.col(number) < F.col("__to"))))
    place = lambda c: F.array_position("__names", c.upper()).cast("int")
    at = lambda c: F.try_element_at(F.col("p"), F.nullif(place(c), F.lit(0)) + skip)
    meant = F.when(place(intervention) > 0, F.coalesce(F.trim(at(intervention)), F.lit("0"))).otherwise("0")
    found = data.where(meant == "0").where(reduce(lambda a, b: a & b, (at(c).isNotNull() for c in columns)))
    return found.select(file, number, *(at(c).alias(c.lower()) for c in columns))


def run_time(x: Column, step: int = 1800) -> Column:
    """The time of a run, from text, floored to the half hour in which it was published."""
    return grid.bucket(to_time(x), step)


def offers(raw: DataFrame, step: int, bands: int = 10) -> DataFrame:
    """Offers by bucket and unit: mean of the maximum, the last row's bands as integers in an array, and that array as text.

    Rows are dealt by unit once: both groupings, and what follows by unit, need no further shuffle.
    """
    names = [f"band{i}" for i in range(1, bands + 1)]
    once = raw.select("ts", "duid", "max_avail", *names).repartition("duid").groupBy("duid", "ts").agg(F.avg("max_avail").alias("max_avail"), *(F.avg(b).alias(b) for b in names))
    out = once.groupBy("duid", grid.bucket("ts", step).alias("ts")).agg(F.coalesce(F.avg("max_avail"), F.lit(0.0)).alias("max_avail"), F.max_by(F.array(*(F.col(b).cast("int") for b in names)), "ts").alias("bands"))
    return out.select("ts", "duid", "max_avail", "bands", F.concat_ws(",", F.col("bands").cast("array<string>")).alias("packed"))


def dense_offers(found: DataFrame, step: int, bands: int = 10, span: DataFrame | None = None) -> DataFrame:
    """Offers of `offers` on every step of their whole span for each unit; a step without an offer has 0 everywhere.

    An offer makes the empty steps up to the unit's next one, the first also those ahead of it, so the grid meets nothing in a join. A row without
    a time counts for its unit only, a row without a unit for the grid only. span: one row (lo, hi) of the steps, if it is known.
    """
    span = grid.bounds(found) if span is None else span
    none = F.array(*[F.lit(0)] * bands)
    own = Window.partitionBy("duid").orderBy("ts")
    width = F.make_interval(secs=F.lit(step))
    row = found.select("duid", "ts", "max_avail", "bands", F.lead("ts").over(own).alias("__next"), (F.row_number().over(own) == 1).alias("__first")).crossJoin(F.broadcast(span))
    begin, until = F.when(F.col("__first"), F.col("lo")).otherwise(F.col("ts")), F.coalesce(F.col("__next") - width, F.col("hi"))
    line = row.select("duid", F.col("ts").alias("__own"), "max_avail", "bands", F.explode(F.when(begin <= until, F.sequence(begin, until, width))).alias("ts"))
    held = (F.col("ts") == F.col("__own")) & F.col("duid").isNotNull()
    filled = line.select("ts", "duid", F.coalesce(F.when(held, F.col("max_avail")), F.lit(0.0)).alias("max_avail"), F.coalesce(F.when(held, F.col("bands")), none).alias("bands"))
    return filled.withColumn("packed", F.concat_ws(",", F.col("bands").cast("array<string>")))


def offer_spans(raw: DataFrame, days: DataFrame, bands: int = 10) -> DataFrame:
    """Day prices of each unit, as integers in an array, with the first and the last of the days on which they hold: up to the unit's next prices, or the last of the given days.

    One row for each offer, so nothing of the size of units times days is shuffled.
    """
    names = [f"price{i}" for i in range(1, bands + 1)]
    once = raw.where("day is not null and duid is not null").groupBy("duid", "day").agg(*(F.avg(b).alias(b) for b in names)).select("duid", "day", F.array(*(F.floor(b).cast("int") for b in names)).alias("prices"))
    following = F.lead("day").over(Window.partitionBy("duid").orderBy("day"))
    spans = once.select("duid", F.col("day").alias("first"), F.date_sub(following, 1).alias("until"), "prices")
    end = days.agg(F.max("day").alias("end"))
    return spans.crossJoin(F.broadcast(end)).select("duid", "first", F.coalesce("until", "end").alias("last"), "prices")


def span_days(spans: DataFrame) -> DataFrame:
    """A row for each day of each span: made where the span lies, without a shuffle."""
    rest = [c for c in spans.columns if c not in ("first", "last", "duid")]
    return spans.select("duid", F.explode(F.sequence("first", "last")).alias("day"), *rest)


def offer_prices(raw: DataFrame, days: DataFrame, bands: int = 10) -> DataFrame:
    """Day prices of each unit, carried forward over the given days, as integers in an array."""
    return span_days(offer_spans(raw, days, bands))


def span_totals(spans: DataFrame, bands: int = 10) -> DataFrame:
    """Number of days and sums of prices of each unit and year: a span adds its days in a year times its prices, in whole numbers."""
    years = spans.select("*", F.explode(F.sequence(F.year("first"), F.year("last"))).alias("year"))
    begin, end = F.greatest("first", F.make_date("year", F.lit(1), F.lit(1))), F.least("last", F.make_date("year", F.lit(12), F.lit(31)))
    held = years.select("duid", "year", (F.datediff(end, begin) + 1).cast("long").alias("n"), "prices")
    return held.groupBy("duid", "year").agg(F.sum("n").alias("n_days"), *(F.sum(F.col("prices")[i].cast("long") * F.col("n")).alias(f"sum_{i + 1}") for i in range(bands)))


# The price tiers (low, high] of the bid stack.
TIERS = ((None, 0.0), (0.0, 100.0), (100.0, 300.0), (300.0, 1000.0), (1000.0, 5000.0), (5000.0, None))


def bid_stack(volume: DataFrame, price: DataFrame, registry: DataFrame, tiers=TIERS, bands: int = 10, start_hour: int = 4) -> DataFrame:
    """Offered MW by time, region and price tier. A trade day begins at 04:00; offers meet the day's prices on (unit, day)."""
    v = volume.withColumn("day", F.to_date(F.col("ts") - F.make_interval(hours=F.lit(start_hour))))
    x = v.join(price, ["duid", "day"], "left").join(registry.select("duid", "region"), "duid")

    def within(p: Column, low, high) -> Column:
        return (p > low if low is not None else F.lit(True)) & (p <= high if high is not None else F.lit(True))

    tier = lambda low, high: reduce(lambda a, b: a + b, (F.when(within(F.col(f"price{i}"), low, high) & F.col(f"price{i}").isNotNull(), F.coalesce(f"band{i}", F.lit(0.0))).otherwise(0.0) for i in range(1, bands + 1)))
    return x.groupBy("ts", "region").agg(*(F.sum(tier(a, b)).alias(f"tier_{i}") for i, (a, b) in enumerate(tiers)))
