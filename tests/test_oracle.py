"""Every registered query against its DuckDB oracle on the smallest tables,
and the driver entry point."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import TABLES, rows_of  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["run", "label", "precision", "recall", "f1", "mcc", "support"]
    assert df.count() == 50


def test_every_query_has_sql_or_is_declared_rows_only():
    rows_only = {"G3_pca_points", "G3_explained_variance", "B4_near_copies_documents", "G5_knn_lsh"}
    own = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    assert own - set(entry.oracle_sql()) == rows_only


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    b = rows_of(cols, res.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert a == b
