"""Queries of the catalog against the same results in SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lingloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, FOLDER).toArrow()
    assert got.num_rows
    if name not in catalog.SQL:
        return
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.sql(catalog.SQL[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert columns == sorted(got.column_names)
    rows = lambda t: sorted(map(repr, t.select(columns).to_pylist()))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
