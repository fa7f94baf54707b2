"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest

from siltstone.llm import voronoi_negatives as V

FIELDS = "vec_id long, embedding array<float>, label int, v string, grp string, cell string, score string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, x, k, "a", "b", "c", "d") for i, x, k in rows], FIELDS)


def plain(rows, every=100, n_positives=5, n_negatives=10):
    full = [(i, k, [math.floor(256 * float(np.float32(c))) for c in x]) for i, x, k in rows if i is not None and k is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    sizes = [len(v) for _, _, v in full]
    width = max(set(sizes), key=lambda s: (sizes.count(s), -s)) if sizes else 0
    full = [(i, (k + 1) % 10 if i % 7 == 0 else k, v) for i, k, v in full if len(v) == width]
    anchors = {}
    for i, k, v in full:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (k, v)), (k, v))
    out = []
    for a, (label, q) in anchors.items():
        scored = sorted(((-sum(x * y for x, y in zip(q, v)), i, k) for i, k, v in full if i != a))
        for s, p, _ in [x for x in scored if x[2] == label][:n_positives]:
            near = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:n_negatives]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(near)]
    return sorted(out)


def clusters(seed, n=600, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims)) * 3
    rows = [(i, (centres[i % 8] + rng.normal(size=dims) * 0.3).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    return rows + [(n + i, rows[16][1], 2) for i in range(60)]  # many equal vectors


ODD = [(None, [1.0] * 6, 1), (9001, None, 1), (9002, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (9003, [float("nan")] + [1.0] * 5, 1), (9004, [float("inf")] + [1.0] * 5, 1), (9005, [2.0] * 5, 1), (9006, [], 1), (9007, [1.0] * 6, None), (9100, [0.0] * 6, 3), (9108, [0.0] * 6, 0)]


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 20, "group_rows": 3, "block_rows": 50}, {"cell_rows": 10, "pivots": 64, "group_rows": 10, "block_rows": 1000, "sample_rows": 100}])
def test_against_all_pairs(spark, sizes):
    rows = clusters(3) + ODD + [(200, [5.0] * 6, 1), (41, [1.0] * 6, 2), (41, [1.0] * 6, 2)]
    got = V.hard_negatives(table_of(spark, rows).repartition(3), every=20, **sizes).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 20)


def test_large_components(spark):
    rows = [(i, [float(c * 2**20) for c in x], k) for i, x, k in clusters(5, 80)]
    assert sorted(tuple(r) for r in V.hard_negatives(table_of(spark, rows), every=10).collect()) == plain(rows, 10)
    with pytest.raises(ValueError, match="64-bit"):
        V.hard_negatives(table_of(spark, [(100, [1e30] * 6, 1)]))


def test_nothing(spark):
    assert V.hard_negatives(table_of(spark, []).limit(0)).collect() == []
    assert V.hard_negatives(table_of(spark, [(100, [1.0], 1)])).collect() == []


def test_bounds_leave_far_candidates_out(spark):
    """Groups of anchors in one cluster are sent few of the other clusters' candidates."""
    rng = np.random.default_rng(7)
    centres = np.linalg.qr(rng.normal(size=(8, 8)))[0] * 10
    rows = [(i, (centres[i % 8] + rng.normal(size=8) * 0.05).tolist(), int(rng.integers(0, 2))) for i in range(2000)]
    copies, full = [], V.routed
    V.routed = lambda placed, bounds: copies.append(full(placed, bounds)) or copies[-1]
    try:
        V.hard_negatives(table_of(spark, rows), every=25, cell_rows=50, group_rows=4).collect()
    finally:
        V.routed = full
    groups = copies[1].select("grp").distinct().count()
    assert groups > 10 and copies[1].count() < 0.5 * groups * len(rows)


@pytest.mark.parametrize("score", [0, 1, 3, 7, 10, 99, 100, 101, 12345678901])
def test_bands_are_exact(score):
    low, high = V.band(score)
    fits = lambda s: 30 * score <= 100 * s <= 90 * score
    assert all(fits(s) == (low <= s <= high) for c in (low, high) for s in (c - 1, c, c + 1))
