"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from siltstone.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(rows):
    show = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = rows_of(df.select(cols).collect())
    if name not in ORACLES:
        assert got
        return
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert got == rows_of(duck.execute(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall())
