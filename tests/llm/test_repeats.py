"""Repeated passages against a count of all windows, and maximal repeats against all pairs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm import repeats as R

FIELDS = "doc_id long, text string, fp long, cls long, block long, left int, asked string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "x") for i, t in rows], FIELDS)


def plain(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[k : k + length] for _, t in raw for k in range(len(t) - length + 1))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone[:-1] & ~np.append(False, gone[:-1])[:-1]).sum()) if len(t) else 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((i, len(t), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(12) for _ in range(4)]
    rows = [(None, None), (1, ""), (2, "short"), (3, "x" * 300), (4, "y" * 19), (5, "ab" * 40), (6, "\x00" * 70), (6, "\x00" * 30 + "z" + "\x00" * 30), (None, passages[0])]
    for i in range(7, 60):
        parts = [text(rng.randint(0, 15)), rng.choice(passages), text(rng.randint(0, 15)), rng.choice([*passages, ""])[: rng.randint(0, 60)]]
        rows.append((i, " ".join(parts)))
    return [*rows, rows[20], rows[20], (99, rows[21][1]), (100, "long " + text(3000))]


@pytest.mark.parametrize(("seed", "group_rows"), [(1, 4096), (2, 3), (3, 2)])
def test_against_all_windows(spark, seed, group_rows):
    rows = corpus(seed)
    got = R.cut_repeats(docs_of(spark, rows).repartition(3), length=20, gram=6, group_rows=group_rows, block_bytes=500)
    keys = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in got.select(*keys).collect()), key=str) == plain(rows, 20)


def test_spans_and_texts(spark):
    line = "the quick brown fox jumps over the lazy dog"
    rows = [(1, f"a1 {line} b1"), (2, f"c2 {line} d2"), (3, "nothing of this kind")]
    got = {r.doc_id: r for r in R.cut_repeats(docs_of(spark, rows), length=20, gram=6, texts=True).collect()}
    assert got[1].kept == b"a1b1" and got[1].n_spans == 1
    assert rows[0][1].encode()[got[1].starts[0] : got[1].ends[0]] == f" {line} ".encode() and got[3].starts == []
    assert {r.doc_id: r.text for r in R.drop_repeats(docs_of(spark, rows), length=20, gram=6).collect()} == {1: "a1b1", 2: "c2d2", 3: rows[2][1]}


def test_nothing(spark):
    assert R.cut_repeats(docs_of(spark, [(1, "a")]).limit(0)).collect() == []


def test_tiles_have_the_anchors_of_the_whole(monkeypatch):
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.integers(97, 100, 4000), np.full(900, 120), rng.integers(97, 123, 3000)]).astype(np.uint8)
    off = np.array([0, 3, 3, 6000, 7900])
    whole = [(int(p), int(f), int(c)) for low, _, x in R.tiles(data, off, 30, 8) for p, f, c in zip(low + x.at, x.fp, x.cls)]
    monkeypatch.setattr(R, "TILE", 700)
    assert [(int(p), int(f), int(c)) for low, _, x in R.tiles(data, off, 30, 8) for p, f, c in zip(low + x.at, x.fp, x.cls)] == whole
    assert len(set(whole)) == len(whole)
    # each window has an anchor at the same offset as an equal window
    seen = defaultdict(set)
    places = np.array([p for p, _, _ in whole])
    for a, b in zip(off, off[1:]):
        for k in range(a, b - 30 + 1):
            inside = places[(places >= k) & (places <= k + 22)]
            assert len(inside)
            seen[data[k : k + 30].tobytes()].add(tuple(inside - k))
    assert all(set.intersection(*map(set, s)) for s in seen.values())


def test_maximal_repeats_against_pairs():
    """Each two contexts share a repeat exactly as far as they agree, and the members of a repeat are all that hold it."""
    rng = random.Random(4)
    for _ in range(60):
        n, length, gram = rng.randint(2, 14), 10, 3
        rows = {("".join(rng.choice("ab") for _ in range(rng.randint(0, 7))), "ccc" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))) for _ in range(n)}
        rows = sorted(rows, key=lambda r: r[1])
        n = len(rows)
        ahead = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        by_left = sorted(range(n), key=lambda k: rows[k][0])
        rank = np.empty(n, np.int64)
        rank[by_left] = np.arange(n)
        lcp = np.array([-1, *(ahead(rows[k - 1][1], rows[k][1]) for k in range(1, n))])
        lcs = np.array([-1, *(ahead(rows[by_left[k - 1]][0], rows[by_left[k]][0]) for k in range(1, n))])
        got = {(left, right, frozenset(m.tolist())) for left, right, m in R.maximal(lcp, lcs, rank, length, gram)}
        want = set()
        for i in range(n):
            for j in range(i):
                left, right = ahead(rows[i][0], rows[j][0]), ahead(rows[i][1], rows[j][1])
                if left + right >= length:
                    want.add((left, right, frozenset(k for k in range(n) if rows[k][0][:left] == rows[i][0][:left] and rows[k][1][:right] == rows[i][1][:right])))
        assert got == want
