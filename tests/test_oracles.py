"""Every base query against its oracle on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from lodestone.plans import registry
from lodestone.sources.loader import TABLES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, decimal.Decimal):
        return x.normalize() + 0
    return tuple(map(plain, x)) if isinstance(x, list) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    found = duck.execute(registry.ORACLES[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) - set(registry.ORACLES) == set()


@pytest.mark.parametrize("name", [n for n in sorted(registry.ORACLES) if n.startswith("set_")])
def test_set_queries_have_whole_tables(spark, duck, name):
    """Both sides of each set operation are whole, growing tables; nothing comes out empty."""
    count = lambda t: duck.execute(f"SELECT count(*) FROM {t}").fetchone()[0]
    df = registry.QUERIES[f"{name}"](spark, DIR)
    assert not df.isEmpty()
    if name == "set_union_all":
        assert df.count() == count("orders") + count("lineitem")
    assert "s_suppkey" not in registry.ORACLES[f"{name}"] and "where" not in registry.ORACLES[f"{name}"].lower()


def test_prefix_and_decimal_joins_have_whole_tables(spark, duck):
    assert registry.QUERIES["chain_prefix"](spark, DIR).select("source_key").distinct().count() == duck.execute("SELECT count(*) FROM customer").fetchone()[0]
    assert registry.QUERIES["join_decimal_key"](spark, DIR).select("p_partkey").distinct().count() == duck.execute("SELECT count(*) FROM part WHERE p_retailprice IS NOT NULL").fetchone()[0]


@pytest.mark.parametrize("name", ["filter_between", "agg_scalar_filtered", "forecast_revenue"])
def test_ranges_of_amounts_reach_the_scan(spark, name):
    plan = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(" in plan[plan.index("PushedFilters") :]


def test_an_out_of_core_join_sorts_and_merges(spark):
    assert "SortMergeJoin" in registry.QUERIES["join_out_of_core"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
