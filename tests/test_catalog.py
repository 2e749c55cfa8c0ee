"""Every query against its DuckDB equivalent, by values and by types."""

import duckdb
import pytest

from quillon.plans import catalog
from quillon.session import TABLES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _plain(v):
    return None if v is None else repr(v + 0.0) if isinstance(v, float) else str(v)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: KINDS[k] for c, k in got.dtypes} == kinds
    at = [want.columns.index(c) for c in names]
    rows = sorted(([_plain(r[c]) for c in names] for r in got.collect()), key=str)
    assert rows == sorted(([_plain(r[i]) for i in at] for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_an_oracle(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0
