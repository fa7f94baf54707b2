"""The Katz model against a plain dictionary version."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from siltstone.llm.katz import discounts, katz_scores

from .conftest import ODD, docs_of


def brute(docs, order, cut=5):
    toks = [(i, re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["</s>"]) for i, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in toks]
    grams = [Counter() for _ in range(order + 1)]
    total = [Counter() for _ in range(order + 1)]
    for (_, w), h in zip(toks, held):
        if h:
            continue
        for n in range(1, order + 1):
            full = ["<s>"] * (n - 1) + w
            for k in range(len(w)):
                grams[n][tuple(full[k : k + n])] += 1
                total[n][tuple(full[k : k + n - 1])] += 1
    d = []
    for n in range(order + 1):
        hist = Counter(grams[n].values())
        d.append(discounts([hist[r] for r in range(1, cut + 2)], cut))
    kept = lambda n, c: c * (d[n][c] if c <= cut else 1)
    N = sum(grams[1].values())
    mass = sum(kept(1, c) for c in grams[1].values())
    div = N if mass < N - 1e-9 else N + 1
    unknown = (div - mass) / div if div else 1.0
    followers = defaultdict(list)
    for n in range(2, order + 1):
        for g, c in grams[n].items():
            followers[g[:-1]].append((g[-1], c))

    def p(g):
        n = len(g)
        if n == 1:
            return kept(1, grams[1][g]) / div if grams[1][g] else unknown
        h, t = g[:-1], total[n][g[:-1]]
        if not t:
            return p(g[1:])
        k = sum(kept(n, c) for _, c in followers[h])
        t = t + 1 if k >= t * (1 - 1e-12) else t
        if grams[n][g]:
            return kept(n, grams[n][g]) / t
        return (1 - k / t) / (1 - sum(p(g[1:-1] + (w,)) for w, _ in followers[h])) * p(g[1:])

    V = len(grams[1])
    out = []
    for (i, w), h in zip(toks, held):
        full = ["<s>"] * (order - 1) + w
        c = [grams[1][(x,)] for x in w]
        out.append((i, h, len(w), sum(x > 0 for x in c), N, sum(math.log10((x + 0.5) / (N + 0.5 * (V + 1))) for x in c), sum(math.log10(p(tuple(full[k : k + order]))) for k in range(len(w)))))
    if N:  # each context's probabilities add up to one
        for h in [(), *list(total[2])[:20]] if order > 1 else [()]:
            assert math.isclose(sum(p(h + (w,)) for (w,) in grams[1]) + p(h + ("\0",)) * 1, 1, abs_tol=1e-9)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_dictionaries(spark, order):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("a b c d e ff GG hh ii jj kk".split()) for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(i, t) for i, t in ODD if i != 8]
    got = katz_scores(docs_of(spark, docs), order=order, block_tokens=300).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute(docs, order), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_empty(spark):
    assert katz_scores(docs_of(spark, [])).count() == 0
