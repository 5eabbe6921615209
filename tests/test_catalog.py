"""Every catalogue query agrees with its DuckDB statement on the smallest tables; rows-only queries run."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from conftest import DATA

from tessera.plans import catalog


def canon(df):
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return f"{v:.4f}"
        return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)

    return sorted("|".join(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert e.queries()["vec_topk"](spark, DATA).count() == 10


def test_top_k_plan_moves_k_rows(spark):
    plan = catalog.queries()["vec_topk"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    plan = catalog.queries()["path_admission"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<file_path:string>" in plan
