"""Ingest jobs on small hand-made tables."""

import datetime as dt

from gridcast.plans import registry
from gridcast.sources import ingest

T0 = dt.datetime(2024, 1, 1)


def test_upsert_keeps_the_later_load_and_is_idempotent(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    new = spark.createDataFrame([(2, 5.0), (3, None)], "k int, v double")
    once = ingest.upsert(old, new, ["k"])
    rows = lambda df: sorted((r["k"], r["v"]) for r in df.collect())
    assert rows(once) == [(1, 1.0), (2, 5.0), (3, None)] == rows(ingest.upsert(once, new, ["k"]))


def test_months_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda m, v: (dt.datetime(2024, m, 3), v)
    ingest.write_months(spark.createDataFrame([row(1, 1), row(2, 2)], "ts timestamp, v int"), path)
    ingest.write_months(spark.createDataFrame([row(2, 9)], "ts timestamp, v int"), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 9]
    present = ingest.loaded_months(spark.read.parquet(path))
    assert [str(r["month"]) for r in ingest.months_to_load(spark, "2024-01-15", "2024-03-31", present).collect()] == ["2024-03-01"]


def test_source_priority(spark):
    make = lambda *rows: spark.createDataFrame([(dt.datetime(2024, m, d), v) for m, d, v in rows], "ts timestamp, v int")
    out = ingest.by_priority([make((1, 1, 1)), make((1, 2, 2), (2, 1, 3)), make((2, 2, 4), (3, 1, 5))])
    assert sorted((r["v"], r["source"]) for r in out.collect()) == [(1, 0), (3, 1), (5, 2)]


def test_prices_are_coerced(spark):
    raw = spark.createDataFrame([("2024-01-01 00:01:00", " a ", "1.5"), ("2024-01-01 00:02:00", "a", "x"), ("bad", "a", "NaN"), ("2024-01-01 00:11:00", "a", "NaN")], "ts string, region string, price string")
    dims = spark.createDataFrame([("a",)], "region string")
    out = ingest.regular_prices(raw, 300, dims).orderBy("ts")
    assert [r["price"] for r in out.collect()] == [1.5, None, None]


def test_registry_cleaning(spark):
    rows = [("U1", "NSW1", "Fossil", "Black Coal", "Generating Unit", "Market"), ("U2", "SA1", "fossil ", "Natural Gas", "Generating Unit", "Market"), ("-", "SA1", "Wind", "", "Generating Unit", "Market"), ("U4", "VIC1", "Wind", "", "Load", "Market"), ("U5", "VIC1", "Biomass and waste", "", "Generating Unit", "Market"), ("U6", "VIC1", " ", "", "Generating Unit", "Market"), ("U7", "VIC1", "Wind", "", "Generating Unit", "Non-Market")]
    raw = spark.createDataFrame([(*r, "p", "s") for r in rows], "duid string, region string, fuel string, descriptor string, dispatch string, category string, participant string, station string")
    assert sorted((r["duid"], r["region"], r["fuel"]) for r in ingest.clean_registry(raw).collect()) == [("U1", "NSW", "Coal"), ("U2", "SA", "Gas"), ("U5", "VIC", "Biomass")]


def test_battery_is_split_and_gaps_are_zero(spark):
    scada = spark.createDataFrame([(T0, "b", -5.0), (T0, "w", -1.0), (T0 + dt.timedelta(hours=2), "b", 3.0)], "ts timestamp, duid string, mw double")
    reg = spark.createDataFrame([("b", "Battery", "X"), ("w", "Wind", "X")], "duid string, fuel string, region string")
    out = ingest.fuel_rollup(scada, reg, 3600, "Battery", ["Battery", "Wind"], ["X", "Y"])
    got = {(r["ts"].hour, r["region"], r["fuel"]): r["mw"] for r in out.collect()}
    assert len(got) == 3 * 2 * 3
    assert (got[0, "X", "charge"], got[0, "X", "discharge"], got[2, "X", "discharge"], got[0, "X", "Wind"], got[1, "Y", "charge"]) == (5.0, 0.0, 3.0, 0.0, 0.0)


def test_tagged_records_follow_their_header(spark):
    lines = [("f", 0, "I,P,A,B"), ("f", 1, "D,P,1,2"), ("f", 2, "D,Q,8,8"), ("g", 0, "I,P,B"), ("g", 1, "D,P,7")]
    df = spark.createDataFrame(lines, "file string, n int, line string")
    assert sorted((r["file"], r["a"], r["b"]) for r in ingest.tagged_records(df, "P", ["A", "B"]).collect()) == [("f", "1", "2"), ("g", None, "7")]


def test_weather_keeps_the_first_and_drops_text(spark):
    raw = spark.createDataFrame([("2024-01-01 00:00:00", "s", "1", "rain"), ("2024-01-01 00:00:00", "s", "2", "sun")], ["ts", "city", " Feels Like", "Conditions"])
    out = ingest.clean_weather(raw, "city")
    assert out.columns == ["ts", "city", "feelslike"] and [r["feelslike"] for r in out.collect()] == [1.0]


def test_trade_day_begins_at_four(spark):
    names = ", ".join(f"band{i} double" for i in range(1, 11)), ", ".join(f"price{i} double" for i in range(1, 11))
    volume = spark.createDataFrame([(T0.replace(hour=h), "u", *[1.0] * 10) for h in (3, 4)], f"ts timestamp, duid string, {names[0]}")
    price = spark.createDataFrame([(T0.date(), "u", *[float(x) for x in (-5, 0, 50, 100, 200, 300, 900, 2000, 5000, 9000)])], f"day date, duid string, {names[1]}")
    reg = spark.createDataFrame([("u", "X")], "duid string, region string")
    got = {r["ts"].hour: [r[f"tier_{i}"] for i in range(6)] for r in ingest.bid_stack(volume, price, reg).collect()}
    assert got[4] == [2, 2, 2, 1, 2, 1] and got[3] == [0] * 6


def test_daily_value_is_filled_both_ways(spark):
    times = spark.createDataFrame([(T0 + dt.timedelta(hours=12 * i),) for i in range(8)], "ts timestamp")
    daily = spark.createDataFrame([((T0 + dt.timedelta(days=1)).date(), 5.0)], "day date, gas double")
    assert [r["gas"] for r in ingest.daily_to_grid(daily, times, "gas").collect()] == [5.0] * 8


def test_registered_offer_prices_cover_all_units_and_days(spark, monkeypatch):
    """Brute force over units outside the twentieth, and days before June 2000."""
    given = {1: {0: 5, 3: 7}, 2: {1: 4}, 22: {2: 9, 5: None}}
    at = lambda k: dt.date(1999, 12, 28) + dt.timedelta(k)
    rows = [(at(k), u, *([None if v is None else float(v * i) for i in range(1, 11)])) for u, days in given.items() for k, v in days.items()]
    price = spark.createDataFrame(rows, "day date, duid long, " + ", ".join(f"price{i} double" for i in range(1, 11)))
    monkeypatch.setattr(registry.staging, "bids", lambda spark, d: (None, price))
    got = {(r["duid"], str(r["day"])): r["prices"] for r in registry.QUERIES["bid_price_ffill"](spark, "").collect()}
    want = {}
    for u, days in given.items():
        for k in range(min(days), 6):
            last = max(x for x in days if x <= k)
            want[u, str(at(k))] = "" if days[last] is None else ",".join(str(days[last] * i) for i in range(1, 11))
    assert got == want


def test_offer_prices_by_day_are_not_shuffled(spark):
    """Days are made after the last shuffle, and totals by year are those of the days."""
    at = lambda k: dt.date(1999, 12, 28) + dt.timedelta(k)
    rows = [(at(k), u, *([None] * 10 if p is None else [float(p * i) for i in range(1, 11)])) for u, k, p in ((1, 0, 5), (1, 3, -7), (1, 3, -8), (2, 399, 4), (3, 2, None), (3, 4, 2), (None, 1, 1))]
    rows.append((None, 4, *[1.0] * 10))
    price = spark.createDataFrame(rows, "day date, duid long, " + ", ".join(f"price{i} double" for i in range(1, 11)))
    found = ingest.offer_prices(price, price.select("day"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.index("Generate") < plan.index("Exchange")
    want: dict = {}
    for r in found.collect():
        t = want.setdefault((r["duid"], r["day"].year), [0, [None] * 10])
        t[0] += 1
        t[1] = [a if b is None else (a or 0) + b for a, b in zip(t[1], r["prices"], strict=True)]
    got = ingest.span_totals(ingest.offer_spans(price, price.select("day"))).collect()
    assert {(r["duid"], r["year"]): [r["n_days"], [r[f"sum_{i}"] for i in range(1, 11)]] for r in got} == want
    assert want[1, 1999] == [4, [15 * i - -(-15 * i // 2) for i in range(1, 11)]] and {k[0] for k in want} == {1, 2, 3}


def test_loads_are_whole_or_not_there(spark, tmp_path):
    from gridcast.sources import loads

    at = lambda m, d: dt.datetime(2024, m, d)
    make = lambda rows: spark.createDataFrame(rows, "ts timestamp, load string, x int")
    table, path = loads.Table(spark, f"file://{tmp_path}/t"), f"file://{tmp_path}/t"
    seen = lambda t=None: sorted((str(r["ts"])[:10], r["x"]) for r in (t or table).read().collect())
    assert table.read() is None and table.load(make([]), "nothing") == 0 and not table.loaded("a")
    assert table.load(make([(at(1, 1), "l", 1), (at(1, 2), "l", 2), (at(2, 1), "l", 3), (None, "l", 9)]), "a") == 1
    before = table.read()
    staged = table.stage(make([(at(2, 5), "l", 4)]), "b")
    assert seen() == [("2024-01-01", 1), ("2024-01-02", 2), ("2024-02-01", 3), ("None", 9)]  # broken off before the commit
    assert table.load(make([(at(2, 6), "l", 5), (at(3, 1), "l", 6)]), "b") == 2
    assert seen() == [("2024-01-01", 1), ("2024-01-02", 2), ("2024-02-06", 5), ("2024-03-01", 6), ("None", 9)]
    assert before.count() == 4 and len(table.manifest(1)) == 3  # a reader of the older version still sees it
    assert table.load(make([(at(3, 1), "l", 7)]), "b") == 2 and seen() == seen(loads.Table(spark.newSession(), path))
    assert table.tidy() >= 2 and len(seen()) == 5 and staged
