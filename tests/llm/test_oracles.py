"""Queries of the text operators against their DuckDB oracles."""

from __future__ import annotations

import duckdb
import pytest

from semaspark.llm import queries

TABLES = ("documents", "embeddings", "benchmark", "conversations")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, found.fetchall()))
