"""Every registered query against its SQL twin on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from revlens.plans import oracle, registry

QUERIES = registry.all_queries()
SQL = oracle.all_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


# Queries over the eigenvectors of a matrix: tests/test_trained.py has their references.
WITHOUT_SQL = {"word_vectors_trained", "soft_match_trained", "turn_similarity_trained"}


def test_every_other_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WITHOUT_SQL])
def test_same_rows(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(repr(tuple(row[c] for c in names)) for row in df.collect())
    cur = duck.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    place = [columns.index(c) for c in names]
    want = sorted(repr(tuple(row[i] for i in place)) for row in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert entry_points.entry(spark).count() == 21


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_queries_without_sql_have_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
