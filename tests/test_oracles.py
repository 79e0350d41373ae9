"""Every query with an SQL twin is compared with it, on the smallest tables, by rows and values."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
#: Queries that find nothing in the smallest tables.
EMPTY_HERE = {"docker_images"}
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(D):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{D}/{f}'")
    return c


def _value(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_value, v)) if isinstance(v, (list, tuple)) else v


def _rows(frame, columns):
    return sorted(repr(tuple(_value(v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, D).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) or name in EMPTY_HERE, "a twin without a row compares nothing"
    assert _rows(got, sorted(got.columns)) == _rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and (n.startswith("p1_") or not (n[0] == "p" and n[1].isdigit()))))
def test_others_run(spark, name):
    """Queries without a twin at least run whole and have a schema."""
    got = QUERIES[name](spark, D)
    assert got.columns and len(set(got.columns)) == len(got.columns)
    got.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)
