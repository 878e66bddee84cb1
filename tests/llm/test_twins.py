"""The registered queries that SQL can express, against it."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from revlens.llm import queries, sql


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def test_all_thirteen_are_registered():
    names = entry_points.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert set(sql.all_sql()) <= set(queries.all_queries()) <= set(names)


@pytest.mark.parametrize("name", list(sql.all_sql()))
def test_same_rows(spark, duck, sf, name):
    df = queries.all_queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(repr(tuple(row[c] for c in names)) for row in df.collect())
    cur = duck.execute(sql.all_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    place = [columns.index(c) for c in names]
    assert got == sorted(repr(tuple(row[i] for i in place)) for row in cur.fetchall())
