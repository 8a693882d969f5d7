"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import pytest

from downfield.plans import more, oracle, oracle_more  # noqa: F401
from downfield.plans.queries import QUERIES

SQL = oracle.SQL | oracle_more.SQL
DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def plain(rows):
    def cell(v):
        if v is None or v != v:
            return "~"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    names = sorted(got.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == names
    have = plain(tuple(r[c] for c in names) for r in got.collect())
    order = [want.columns.index(c) for c in names]
    assert have == plain(tuple(r[i] for i in order) for r in want.fetchall())


def test_registered_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(SQL) | {"train_predict", "lineup_search"} == set(QUERIES)
