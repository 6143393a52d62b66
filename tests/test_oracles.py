"""Each query against its oracle SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.plans.base import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def shaped(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", sorted(ORACLE_SQL.keys() & QUERIES.keys()))
def test_matches_oracle(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    found = duck.execute(ORACLE_SQL[key])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert shaped(df.columns, df.collect()) == shaped(names, found.fetchall())


@pytest.mark.parametrize("key", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs_without_oracle(spark, key):
    df = entry.queries()[key](spark, SF)
    assert df.columns
    df.collect()


def test_flagship(spark):
    assert entry.entry(spark).count() == 1
