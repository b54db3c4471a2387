"""Every log query against its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from conftest import rows_of
from tidelog.queries import ORACLES, QUERIES
from tidelog.streaming.queries import ORACLES as STREAM_ORACLES
from tidelog.streaming.queries import QUERIES as STREAMS


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    want = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, want)


@pytest.mark.parametrize("name", sorted(STREAM_ORACLES))
def test_stream_equals_sql(name, spark, duck, sf_dir):
    df = STREAMS[name](spark, sf_dir)
    result = duck.execute(STREAM_ORACLES[name])
    columns = [c[0] for c in result.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())
