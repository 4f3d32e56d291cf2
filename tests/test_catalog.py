"""Every registered query with SQL gives DuckDB's rows on the small tables."""

import math

import duckdb
import pytest

from quillon.plans.registry import ORACLES, QUERIES
from tests import fixture_cases

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(columns), sorted(map(repr, (tuple(clean(r[i]) for i in order) for r in rows)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, BASE)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    assert got == canonical([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(fixture_cases.CASES))
def test_fixture_case(spark, duck, name):
    df = fixture_cases.CASES[name](spark, BASE)
    cur = duck.execute(fixture_cases.ORACLES[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([c[0] for c in cur.description], cur.fetchall())


def test_queries_without_sql(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, BASE).count() > 0
