"""The registered queries over whole small tables, against their SQL where they have one."""

import os

import duckdb
import pytest

import __spark_entry__ as registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def test_all_are_registered():
    assert set(registry.LLM_ORACLES) <= set(registry.LLM_QUERIES)
    numbers = {n.split("_")[0] for n in registry.LLM_QUERIES}
    assert numbers == {"pipeline", *(f"op{n}" for n in range(1, 14))}


@pytest.mark.parametrize("name", sorted(registry.LLM_ORACLES))
def test_against_sql(spark, sf, duck, name):
    frame = registry.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)
    result = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns and rows
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str)
