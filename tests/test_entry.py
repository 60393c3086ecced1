"""Every registered query of the library's own operators against its SQL, on small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from planloom import queries_plans, queries_relational

SMALL = "/root/testdata/sf0.001"
OWN = {**queries_relational.queries(), **queries_plans.queries()}
SQL = {**queries_relational.oracle_sql(), **queries_plans.oracle_sql()}

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the small tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = OWN[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_all_are_registered(spark):
    names = entry.queries()
    assert set(OWN) <= set(names) and set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() == 5


def test_scans_prune_and_push(spark):
    plan = OWN["scan_filter_project"](spark, SMALL)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_tax" not in plan.split("ReadSchema:")[1].split("\n")[0]
    plan = OWN["scan_column_prune"](spark, SMALL)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_partkey:bigint>" in plan
    plan = OWN["win_topk_per_group"](spark, SMALL)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
