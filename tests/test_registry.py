"""Registered queries against DuckDB. GRIDLOOM_ALL=1 compares every query instead of a selection."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as registry
from tests.conftest import SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SELECTION = (
    "src_raw_csv", "dq_report", "silver", "gold_hourly", "gold_weekly", "gold_meter", "ml_features",
    "ml_split", "predictions", "predict_requests", "predict_requests_rejected", "anom_severity",
    "wide_fact", "metrics_by_month", "rep_drill", "vw_peak_offpeak", "vw_meter_ranking", "rel_check",
)
TYPES = {
    "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "bigint": "BIGINT", "date": "DATE",
    "timestamp": "TIMESTAMP", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def rows(df: pd.DataFrame, dates: list[str]) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for column in df.columns:
        if column in dates or "datetime" in str(df[column].dtype):
            df[column] = [None if pd.isna(v) else str(v)[: 10 if column in dates else 19] for v in df[column]]
    plain = [tuple(None if pd.isna(v) else v for v in row) for row in df.itertuples(index=False)]
    return sorted(plain, key=str)


def test_every_query_is_registered_once_and_most_have_sql():
    names, sql = set(registry.queries()), set(registry.oracle_sql())
    assert sql <= names
    own = {n for n in names if not n.startswith("op") and n != "pipeline"}
    assert own - sql == {"ml_train", "predictions_fitted", "predict_requests_fitted", "anom_iforest", "anomalies"}


@pytest.mark.parametrize("name", sorted(n for n in registry.oracle_sql() if not n.startswith("op")) if os.environ.get("GRIDLOOM_ALL") else SELECTION)
def test_query_equals_sql(spark, database, name):
    found = registry.queries()[name](spark, SMALL)
    statement = registry.oracle_sql()[name]
    wanted_types = {r[0]: r[1] for r in database.execute(f"DESCRIBE {statement}").fetchall()}
    assert {c: TYPES[t] for c, t in found.dtypes} == wanted_types
    dates = [c for c, t in found.dtypes if t == "date"]
    assert rows(found.toPandas(), dates) == rows(database.execute(statement).df(), dates)


def test_entry(spark):
    found = registry.entry(spark)
    assert found.count() > 0 and found.columns[:2] == ["date", "meter_id"]
