"""Registered queries give the rows of their SQL on the smallest tables, and the executed price families their full width."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridcast.features import price
from gridcast.operators.rolling import Series
from gridcast.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FITS = {"fit_models", "quantile_substitute", "isotonic", "cv_feature_count", "importance", "selected_features"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in FITS])
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*(f"`{n}`" for n in names)).collect()]
    if name not in registry.SQL:
        assert got
        return
    found = con.execute(registry.SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    want = [tuple(plain(r[order.index(n)]) for n in names) for r in found.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_price_families_have_the_published_width(spark):
    s = Series()
    width = sum(len(f(s)) for f in (price.asinh_lags, price.lags, price.long_range, price.rolling, price.regime, price.since_spike, price.predictors))
    regions, calendar, pairs, cross = 4, 16, 4 * 3 * 2 + 2, 3
    assert width * regions + calendar + pairs + cross == 637
