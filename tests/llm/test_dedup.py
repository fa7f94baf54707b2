"""Exact and near deduplication against brute force, ODD rows included."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm.components import components
from siltstone.llm.exact_lsm import LsmIndex, _known, drop_copies, exact_groups
from siltstone.llm.tensor_minhash import collection_size, drop_near_copies, link_cell, near_groups

from .conftest import ODD, docs_of


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("bits,keep", [(256, "largest"), (256, "smallest"), (4, "largest")])
def test_exact(spark, bits, keep):
    rows = ODD + [(100 + i, "copy") for i in range(40)] + [(200 + i, f"text {i % 7}") for i in range(20)]
    got = exact_groups(docs_of(spark, rows), keep=keep, digest_bits=bits).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[low(t)] if x is not None]
        k = (max if keep == "largest" else min)(ids) if ids else None
        want.append((i, k, len(groups[low(t)]), i == k, hashlib.sha256(low(t).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def digest_rows(spark, rows):
    return spark.createDataFrame([(hashlib.sha256(low(t).encode()).digest(), i) for i, t in rows], "digest binary, doc_id long")


def test_index_merges_levels_and_probes(spark):
    """Seven memtables on two levels: every digest once after each merge, smallest ids kept, old runs gone, probes exact."""
    rng = random.Random(4)
    index, all_rows = LsmIndex(expected=200, fan_in=3), []
    for k in range(7):
        rows = [(rng.randint(0, 10**6), f"text {rng.randint(0, 60)}") for _ in range(40)] + [(10**7 + k, f"own {k}")]
        index.flush(digest_rows(spark, rows))
        all_rows += rows
        assert [r.level for r in index.runs] in ([0], [0, 0], [1], [1, 0], [1, 0, 0], [1, 1], [1, 1, 0])
    want = {}
    for i, t in all_rows:
        want.setdefault(hashlib.sha256(t.encode()).digest(), []).append(i)
    probes = digest_rows(spark, [(1, "own 3"), (2, "text 7"), (3, "nothing")])
    found = {}
    for r in index.probe(probes).collect():
        a = found.setdefault(r.doc_id, [10**9, 0, 0])
        found[r.doc_id] = [min(a[0], r.smallest), max(a[1], r.largest), a[2] + r.copies]
    seven = want[hashlib.sha256(b"text 7").digest()]
    assert found == {1: [10**7 + 3, 10**7 + 3, 1], 2: [min(seven), max(seven), len(seven)]}
    old = [f for r in index.runs for f in r.rows.inputFiles()]
    got = {bytes(r.digest): (r.smallest, r.largest, r.copies) for r in index.compact().collect()}
    assert got == {d: (min(i), max(i), len(i)) for d, i in want.items()} and index.compact().count() == len(want)
    assert len(index.runs) == 1 and not any(os.path.exists(f.removeprefix("file://")) for f in old)


@pytest.mark.parametrize("parts", [40])
def test_many_memtables_make_levels(spark, monkeypatch, parts):
    """Twenty memtables of ten rows: five merges to level 1, one of these to level 2, and the result is that of one memtable."""
    made, merge = [], LsmIndex._merge
    monkeypatch.setattr(LsmIndex, "_merge", lambda self, old: (merge(self, old), made.append(self.merges[-1])) and None)
    docs = docs_of(spark, [(i, f"Text {i % 71}") for i in range(200)]).repartition(parts)
    got = sorted(map(tuple, exact_groups(docs, memtable_rows=10).collect()))
    assert made == [1, 1, 1, 1, 2, 1, 3]
    made.clear()
    assert got == sorted(map(tuple, exact_groups(docs).collect())) and made == [] and sum(r[3] for r in got) == 71


def test_filters_know_what_runs_hold(spark):
    held, other = [(i, f"a{i}") for i in range(3000)], [(i, f"b{i}") for i in range(3000)]
    index = LsmIndex(expected=3000)
    index.flush(digest_rows(spark, held))
    bits = index.runs[0].filter
    known = lambda rows: digest_rows(spark, rows).crossJoin(F.broadcast(bits)).filter(_known(F.col("digest"), F.col("bits"))).count()
    assert known(held) == 3000 and known(other) < 120


def test_drop_copies_keeps_columns(spark):
    docs = docs_of(spark, ODD)
    out = drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [1, 3, 4, 6, 7, 8, 9]


def test_drop_copies_leaves_one_row_of_each_text(spark):
    out = drop_copies(docs_of(spark, [(3, "A"), (5, "A"), (5, "B"), (6, "b"), (None, "A"), (7, "c"), (7, "C"), (None, "d"), (None, "D"), (None, None), (None, "")])).collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in out) == [(0, ""), (0, "d"), (3, "a"), (5, "b"), (7, "c")]


def test_empty(spark):
    docs = docs_of(spark, [])
    assert exact_groups(docs).count() == 0 and near_groups(docs).count() == 0 and drop_near_copies(docs).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got[n] == min(seen)
    assert set(got) == set(near)


def brute(rows, num, den):
    """The smallest id that each row reaches; None for rows without an id."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if rows[a][0] is not None and rows[b][0] is not None and x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)]


def family(rng, first, n, words, edits):
    base = [f"w{rng.randint(0, 9999)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"x{rng.randint(0, 9999)}"
        out.append((first + k, " ".join(w)))
    return out


@pytest.mark.parametrize("threshold,cell_rows", [((85, 100), 4000), ((80, 100), 12)])
def test_near(spark, threshold, cell_rows):
    rng = random.Random(5)
    rows = ODD + family(rng, 1000, 70, 90, 3) + family(rng, 2000, 40, 60, 5) + [(3000 + i, f"one two three {i % 3}") for i in range(9)]
    for f in range(10):
        rows += family(rng, 4000 + 10 * f, 5, 120, 4)
    base, other = family(rng, 0, 1, 100, 0)[0][1], family(rng, 0, 1, 100, 0)[0][1]
    rows += [(9009, base), (9009, other), (9001, base + " a"), (9002, other + " b"), (9009, base), (9020, base)]
    got = near_groups(docs_of(spark, rows), threshold=threshold, cell_rows=cell_rows, samples=2).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows, *threshold), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_copies_leave_one_row_of_a_group(spark):
    """Rows that share an id with other texts are judged each; of repeated rows one stays."""
    rng = random.Random(8)
    base, other, alone = (family(rng, 0, 1, 100, 0)[0][1] for _ in range(3))
    rows = [(9, base), (9, other), (1, base + " a"), (2, other + " b"), (9, alone), (9, alone), (5, None), (5, ""), (None, base), (4, "one two"), (4, "ONE two"), (4, "one three")]
    docs = docs_of(spark, rows)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [x for x in got if x[0] != 4] == sorted([(1, base + " a"), (2, other + " b"), (9, alone), (5, ""), (5, ""), (0, base)])
    assert [x[1].lower() for x in got if x[0] == 4] in (["one three", "one two"], ["one two", "one three"])


def test_links_of_a_cell_are_those_of_all_pairs():
    """The bound by rarest elements leaves out no linked pair, in large cells of many clusters, too."""
    rng = np.random.default_rng(4)
    for num in (80, 85):
        pool = [np.unique(rng.integers(0, 1 << 40, 60).astype(np.uint64)) for _ in range(12)]
        sets = []
        for _ in range(150):
            s = pool[rng.integers(12)].copy()
            s[rng.permutation(len(s))[: rng.integers(0, 9)]] = rng.integers(1 << 41, 1 << 42, 1)[0] + np.arange(1, dtype=np.uint64)
            sets.append(np.unique(s)[: rng.integers(40, 61)])
        root = list(range(150))
        for i in range(150):
            for j in range(i):
                x, y = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(x & y) >= num * len(x | y):
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
        assert link_cell(sets, num, 100).tolist() == root


def test_components_of_a_hub(spark):
    edges = [(0, i) for i in range(1, 1500)] + [(i, 5000 + i) for i in range(1, 700)] + [(9000, 8999), (8999, 8000)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {k for k, c in got.items() if c == 0} == {*range(1500), *range(5001, 5700)} and got[9000] == got[8999] == got[8000] == 8000


def test_tensoring_saves_hashes():
    m = collection_size(0.8, 0.9999)
    assert (1 - (1 - 0.8**3) ** m) ** 2 >= 0.9999 > (1 - (1 - 0.8**3) ** (m - 1)) ** 2
