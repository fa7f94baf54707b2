"""Ranked search against a plain ranking."""

import math
import re
from collections import Counter

import pytest

from siltstone.llm.postings import rank_documents, search, write_postings
from siltstone.llm.common import materialize
from siltstone.llm.postings import item_terms

FIELDS = "doc_id long, text string, term string, row long, n long, tf long, bucket int, w long, m long"
ITEMS = "item_id long, text string, doc_id long, term string, times long, asked string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5, 6) for i, t in rows], FIELDS)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in rows], ITEMS)


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, k):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(counts), sum(x[2] for x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(words(t))
    out = []
    for item, q in asked.items():
        hits = [(sum(q[t] * weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * size * n // total))) for t in q if t in c), i) for i, c, size in counts]
        best = sorted((h for h in hits if h[0] > 0), key=lambda h: (-h[0], h[1] is not None, h[1] or 0))[:k]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out, key=str)


DOCS = [(None, None), (None, "alpha beta"), (1, ""), (2, " \t--"), (3, "Alpha, beta: GAMMA!"), (3, "alpha alpha ñandú"), (4, "ÑANDÚ ñandú 漢字x x漢字"), (5, "alpha beta"), (6, "alpha beta"), (7, "beta " * 30000 + "delta"), (8, "a1b2 a1-b2 a_1"), (9, "é\x00é"), (10, "gamma")]
ASK = [(1, "alpha gamma gamma"), (2, None), (2, "delta"), (2, "delta beta"), (None, "ñandú 漢字x"), (3, "..."), (4, "nowhere"), (5, "é a1 b2 1"), (6, "ALPHA BETA")]


@pytest.mark.parametrize("k", [2, 20])
def test_against_plain_ranking(spark, k):
    got = rank_documents(docs_of(spark, DOCS), items_of(spark, ASK), k).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(DOCS, ASK, k)


def test_nothing(spark):
    none = docs_of(spark, DOCS).limit(0), items_of(spark, ASK).limit(0)
    assert rank_documents(none[0], items_of(spark, ASK)).collect() == []
    assert rank_documents(docs_of(spark, DOCS), none[1]).collect() == []
    assert rank_documents(docs_of(spark, [(1, None), (2, "--")]), items_of(spark, ASK)).collect() == []


def test_whole_index_in_buckets(spark, tmp_path):
    """An index of all terms gives what one of the wanted terms gives, and a term lies in one bucket."""
    index = write_postings(docs_of(spark, DOCS), str(tmp_path / "index"), buckets=3)
    asked = materialize(item_terms(items_of(spark, ASK)), "asked")
    assert sorted((tuple(r) for r in search(index, asked).collect()), key=str) == plain(DOCS, ASK, 20)
    assert index.filter("term is not null").groupBy("term").agg({"bucket": "max"}).count() == len({w for _, t in DOCS for w in words(t)})
    assert index.filter("bucket >= 0").select("term", "bucket").distinct().groupBy("term").count().filter("count > 1").isEmpty()
