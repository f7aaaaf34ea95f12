"""Every registered query against its SQL counterpart in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as registry

# The training-data queries have tests of their own.
QUERIES = {k: q for k, q in registry.queries().items() if k not in registry.LLM_QUERIES}
ORACLES = {k: q for k, q in registry.oracle_sql().items() if k not in registry.LLM_QUERIES}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    # SQL has no such hash, and cannot follow 32,505 merges: test_split.py and test_bpe.py hold these
    # against Python and the public library; the first merges have SQL (bpe_prefix).
    assert set(QUERIES) - set(ORACLES) == {"hash_split_blake2b", "bpe_train", "bpe_encode"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)
    assert rows
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str)


def test_entry(spark):
    assert registry.entry(spark).count() > 0
