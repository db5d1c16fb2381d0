"""Registered queries of the holdings engine against DuckDB, where the tables are there."""

import os

import pytest

import __spark_entry__ as entry
from stackline import plans

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(plans.oracle_sql()) <= set(plans.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["holdings_clusters", "holdings_values", "record_links", "rules_by_source", "rules_applied", "roles_inferred", "clusters_decide", "statement_origins"])
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({plans.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
