"""Every registered query against its oracle SQL on the driver tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return repr(x + 0.0) if isinstance(x, float) else str(x)


def no_cross_products(plans):
    assert plans
    for plan in plans:
        assert "NestedLoop" not in plan and "Cartesian" not in plan, plan


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_oracle(spark, sf, con, executed_plans, name):
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    assert sorted(df.columns) == sorted(cols)
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    order = sorted(cols)
    want = sorted(tuple(plain(r[cols.index(c)]) for c in order) for r in cur.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == want
    no_cross_products(executed_plans())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, sf, executed_plans, name):
    assert entry.queries()[name](spark, sf).count() > 0
    no_cross_products(executed_plans())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
