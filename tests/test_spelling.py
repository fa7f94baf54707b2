"""Edit distances and joins of names against plain versions."""

import random

import duckdb
import pytest

from siltstone.operators import spelling as S


def plain(a, b, once):
    """The whole table; without once, swapped letters may be apart."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            for x in range(1, 2 if once else i):
                for y in range(1, 2 if once else j):
                    if i > x and j > y and a[i - 1 - x] == b[j - 1] and a[i - 1] == b[j - 1 - y]:
                        d[i, j] = min(d[i, j], d[i - 1 - x, j - 1 - y] + x + y - 1)
    return d[len(a), len(b)]


def words(seed, n, letters="abc", longest=9):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("once", [True, False])
@pytest.mark.parametrize("cap", [1, 2, 3])
def test_distances(cap, once):
    a, b = words(1, 3000), words(2, 3000)
    a += ["", "", "ca", "reqeusts", "x" * 200, "é😀"]
    b += ["", "abc", "abc", "requests", "x" * 198 + "yx", "😀é"]
    got = S.capped_distances(a, b, cap, once).tolist()
    assert got == [min(cap + 1, plain(x, y, once)) for x, y in zip(a, b)]
    if not once:
        ascii_ = [(x, y) for x, y in zip(a, b) if x.isascii()]
        want = [min(cap + 1, r[0]) for r in (duckdb.execute("SELECT damerau_levenshtein(?, ?)", [x, y]).fetchone() for x, y in ascii_[-400:])]
        assert [min(cap + 1, v) for v in S.capped_distances([x for x, _ in ascii_[-400:]], [y for _, y in ascii_[-400:]], cap, once).tolist()] == want


@pytest.mark.parametrize("once", [True, False])
@pytest.mark.parametrize("cap", [1, 2, 3])
def test_near_names_against_all_pairs(spark, cap, once):
    names, listed = words(3, 120, "abcd", 7) + ["ca"], words(4, 60, "abcd", 7) + ["abca", "abc"]
    rows = [(n,) for n in names] + [(None,)]
    got = {tuple(r) for r in S.near_names(spark.createDataFrame(rows, "name string"), spark.createDataFrame([(x,) for x in listed] * 2, "listed string"), cap, 3, once).collect()}
    want = {(n, x, plain(n, x, once)) for n in names for x in listed if len(x) >= 3 and n != x and plain(n, x, once) <= cap}
    assert got == want and want


def test_suffixes_both_ways_against_all_pairs(spark):
    rng = random.Random(6)
    part = lambda: rng.choice(["src", "lib", "a", "app.py", "x/app.py", "main", "é", "tests"])
    path = lambda: "/".join(part() for _ in range(rng.randint(1, 5)))[rng.choice([0, 0, 1, 2]) :]
    left, right = sorted({path() for _ in range(10_000)} | {"", "y"}), sorted({path() for _ in range(400)} | {"", "py"})
    out = S.suffix_pairs(spark.createDataFrame([(x,) for x in left] + [(None,)], "left string"), spark.createDataFrame([(x,) for x in right], "right string"))
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    assert {tuple(r) for r in out.collect()} == {(x, y) for x in left for y in right if x and y and (x.endswith(y) or y.endswith(x))}
