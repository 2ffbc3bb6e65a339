"""The queries' rows against their DuckDB SQL, over the whole smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from lodeseek.llm.queries import oracle_sql, queries

TABLES = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not TABLES.is_dir(), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_rows_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{TABLES}/{table}.parquet')")
    expected = con.execute(oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    got = queries()[name](spark, str(TABLES))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(expected.fetchall())
