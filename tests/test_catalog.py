"""Queries against their SQL in another engine, on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__
from granary import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def engine():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def values(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, engine, name):
    got = catalog.QUERIES[name](spark, DATA)
    ask = engine.execute(catalog.ORACLES[name])
    columns = [x[0] for x in ask.description]
    assert values(got.collect(), got.columns) == values(ask.fetchall(), columns)


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["row_id", "group_no", "slot", "pos", "dist"]


@pytest.mark.parametrize("name", ["soft_cap_assign", "kcenter_select"])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
