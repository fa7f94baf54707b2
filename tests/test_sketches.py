"""Mergeable sketches against whole data."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import sketches as K


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    data = [(g, rng.randint(0, n * 3), rng.lognormvariate(0, 2), k % 5) for g, n in (("a", 6000), ("b", 300), ("c", 1)) for k in range(n)] + [("d", None, None, 0)]
    return spark.createDataFrame(data, "lang string, item int, size double, part int").cache()


def checked(rows, got):
    for g in ("a", "b", "c"):
        own = [r for r in rows.filter(F.col("lang") == g).collect()]
        exact, r = len({x["item"] for x in own}), got[g]
        assert abs(r.n_distinct - exact) <= max(2, 4 * K.distinct_error() * exact)
        sizes = sorted(x["size"] for x in own)
        for q in (25, 50, 75, 95):
            v = r[f"q{q}"]
            assert sum(s < v for s in sizes) / len(sizes) <= q / 100 + K.rank_error() and sum(s <= v for s in sizes) / len(sizes) >= q / 100 - K.rank_error()


def test_parts_and_two_tables(spark, rows, tmp_path):
    K.sketches(rows.filter("part < 2"), ["lang"], F.col("part"), "item", "size").write.parquet(str(tmp_path / "t"))
    K.sketches(rows.filter("part >= 2"), ["lang"], F.col("part"), "item", "size").write.mode("append").parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.filter("lang = 'a'").count() == 10
    checked(rows, {r.lang: r for r in K.answers(table, ["lang"]).collect()})
    # merged in steps, the answers stay within the bounds
    coarse = K.merged(table, ["lang"], part=F.col("part").cast("int") % 2)
    assert coarse.filter("lang = 'a'").count() == 4
    checked(rows, {r.lang: r for r in K.answers(coarse.unionByName(K.merged(table.limit(0), ["lang"])), ["lang"]).collect()})


def test_one_kind_and_nothing(rows):
    only = K.answers(K.sketches(rows, ["lang"], F.lit("x"), distinct="item"), ["lang"]).collect()
    assert {r.lang for r in only} == {"a", "b", "c", "d"} and all(r.q50 is None for r in only) and next(r for r in only if r.lang == "d").n_distinct == 0
    assert K.answers(K.sketches(rows.limit(0), ["lang"], F.lit("x"), "item", "size"), ["lang"]).collect() == []
