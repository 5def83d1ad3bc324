"""Each query with SQL gives what the SQL gives."""

import inspect

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from inkstrata.plans import catalogue as Q
from inkstrata.sources.corpus import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in ("documents", "events", "labels", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.fixture(scope="module")
def whole(spark):
    return cut(Q.whole(spark, SF))


def rows(df, columns):
    plain = lambda v: "" if pd.isna(v) else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_as_sql(spark, db, whole, monkeypatch, name):
    # The findings of the whole scan are made once for all queries that score them.
    monkeypatch.setattr(Q, "whole", lambda *_: whole)
    run = Q.QUERIES[name]
    got = (run(spark, SF, lambda *_: whole) if "findings" in inspect.signature(run).parameters else run(spark, SF)).toPandas()
    want = db.sql(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(Q.ORACLES) == set(Q.QUERIES)


def test_scan_reads_its_table_once_and_splits_once(spark):
    from inkstrata import api
    from inkstrata.sources import overlay

    plan = api.file_findings(overlay.code_files(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("\\r?\\n") + plan.count("\r?\n") == 1
