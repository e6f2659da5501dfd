"""Every registered query with SQL gives the same rows in both engines."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as driver  # noqa: E402
from tools.check_oracle import TABLES, rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", list(driver.queries()))
def test_query(spark, sql, name):
    frame = driver.queries()[name](spark, FOLDER)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name not in driver.oracle_sql():
        assert got[1]
        return
    cursor = sql.execute(driver.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert driver.entry(spark).columns == ["id", "event_date", "status", "verified", "total", "has_more"]
