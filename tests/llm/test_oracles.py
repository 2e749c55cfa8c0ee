"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from quillon.llm.queries import oracle_sql, queries
from quillon.session import TABLES


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_duckdb(spark, sf_dir, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = c.sql(oracle_sql()[name])
    names = list(want.columns)
    got = queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    rows = sorted(tuple(str(r[n]) for n in names) for r in got.collect())
    assert rows == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries()} == set(range(1, 11)) and set(oracle_sql()) <= set(queries())
