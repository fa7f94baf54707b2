"""Each registered query of the subpackage on the smallest tables, against its SQL where it has one."""

import os

import duckdb
import pytest

from siltstone.llm.entry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    got = queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(tuple(map(str, r)) for r in got.select(cols).collect())
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    if name in oracle_sql():
        quoted = ", ".join(f'"{c}"' for c in cols)
        assert rows == sorted(tuple(map(str, r)) for r in con.execute(f"SELECT {quoted} FROM ({oracle_sql()[name]})").fetchall())
    elif "doc_id" in cols and "sequence_id" not in cols:
        assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    else:
        assert rows
