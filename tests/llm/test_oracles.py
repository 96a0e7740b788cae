"""The queries that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from ophelion.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_duckdb(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
    want = duck.sql(queries.ORACLES[name])
    found = queries.QUERIES[name](spark, FOLDER)
    assert sorted(found.columns) == sorted(want.columns)
    rows = [plain(r) for r in found.select(*want.columns).collect()]
    assert sorted(map(repr, rows)) == sorted(repr(plain(r)) for r in want.fetchall())
    assert rows
