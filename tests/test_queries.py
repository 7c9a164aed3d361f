"""Every query of the engine against its SQL, and the entry module."""

import datetime as dt
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from framewright import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    if isinstance(v, dict):
        return tuple(sorted((k, value(x)) for k, x in v.items()))
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else str(v) if type(v).__name__ == "Decimal" else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf, duck, name):
    df = plans.queries()[name](spark, sf)
    rows = df.collect()
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    columns = want.columns
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, rows) == table(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_part(tmp_path):
    """The training-data operators can be absent."""
    code = "import sys; sys.modules['framewright.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'flagship_orders' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_native_frames_have_no_python(spark, sf):
    plan = plans.queries()["native_customer_frames"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_keyed_reader_prunes_the_scan(spark, sf):
    from pyspark.sql import functions as F

    from framewright.operators import frames as fr

    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    some = df.where("l_quantity > 49").select(fr.encode(F.struct("l_orderkey", "l_tax"), df.select("l_orderkey", "l_tax").schema).alias("frame"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_tax:double>" in plan
