"""Every query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="no test tables here")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [n for n in SQL if not n.startswith(("op", "pipeline"))])
def test_query_equals_its_sql(spark, db, name):
    frame, expected = entry.queries()[name](spark, str(SF)), db.sql(SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(expected.columns)
    got = sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    assert got == sorted(tuple(map(plain, r)) for r in expected.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_all_queries_have_sql():
    without = {n for n in entry.queries() if n not in SQL and not n.startswith("op") and n != "pipeline"}
    assert without == set()


def test_running_windows_never_sort_everything_in_one_task(spark):
    plan = entry.queries()["loc_timeline"](spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(block#" in plan
