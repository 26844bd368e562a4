"""Every registered query that SQL can express, against DuckDB on the small tables."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from pitchlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from pitchlake.operators import control
    from pitchlake.plans.tables import table

    df = control.filtered(table(spark, SF, "events"), equal={"event_type": "error"}).select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan and "props" not in plan.split("ReadSchema")[1]
    assert F is not None


def test_queries_import_without_a_session():
    """The driver imports the entry before it has a session."""
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, timeout=120).returncode == 0
