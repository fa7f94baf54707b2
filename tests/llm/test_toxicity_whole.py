"""Toxicity learns and calibrates on every labelled document."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.llm import cnn_toxicity
from siltstone.llm import kernels as K
from siltstone.llm.cnn_toxicity import PAD, RARE, TextCnn, best_threshold, buckets, cut_points, train
from siltstone.llm.langmask import train as train_languages

from .conftest import docs_of

RUDE = ["blarg", "zorp", "krunk"]


def test_cuts_of_all_rows_equal_those_of_one_array(spark):
    rng = np.random.default_rng(5)
    for n, step in ((1, 1e-3), (7, 0.25), (400, 0.125), (4000, 1e-6)):
        y = (rng.random(n) < 0.2).astype(int)
        x = np.round((rng.normal(0, 1, n) + 2 * y) / step) * step
        lang = [[None, "en", "de", ""][k] for k in rng.integers(0, 4, n)]
        got = cut_points(spark.createDataFrame(list(zip(lang, y.tolist(), x.tolist())), "lang string, label int, logit double").repartition(3), 20)
        want = {None: best_threshold(x, y)}
        for name in ("en", "de", ""):
            mine = np.array([v == name for v in lang])
            if mine.sum() >= 20 and len({*y[mine]}) == 2:
                want[name] = best_threshold(x[mine], y[mine])
        assert got == want


def test_every_labelled_document_counts(spark, monkeypatch):
    """Words of five clean documents in 4,500 are known, and the threshold is that of all documents kept back."""
    monkeypatch.setattr(cnn_toxicity, "SHARD_ROWS", 1000)
    rng = random.Random(8)
    common = ["".join(rng.choice("abdegilnorstu") for _ in range(5)) for _ in range(60)]
    rare = [f"seldom{chr(97 + k)}" for k in range(20)]
    rows = []
    for i in range(5000):
        words = [rng.choice(common) for _ in range(10)]
        if i % 10 == 0:
            words[rng.randrange(10)] = rng.choice(RUDE)
        rows.append((i, " ".join(words)))
    hold = {r.id for r in spark.range(5000).filter(F.pmod(F.xxhash64(F.lit("part"), "id"), 5) == 0).collect()}
    plain = [i for i in range(5000) if i % 10 and i not in hold]
    for k, word in enumerate(rare):
        for i in plain[k * 5 : k * 5 + 5]:
            rows[i] = (i, f"{rows[i][1]} {word}")
    docs, labels = docs_of(spark, rows), spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(5000)], "doc_id long, toxic int")
    model = train(docs, labels)
    assert all(model.index[buckets(*K.utf8(pa.array([w])))[0][0]] > RARE for w in rare)
    kept = sorted(hold)
    y = np.array([int(i % 10 == 0) for i in kept])
    z = model.logits(*buckets(*K.utf8(pa.array([rows[i][1] for i in kept]))), model.tables()).astype(np.float64)
    assert abs(model.threshold - best_threshold(z, y)) < 1e-4
    assert ((z >= model.threshold) == y).mean() > 0.97
    again = train(docs.repartition(7), labels)
    assert all(np.allclose(model.p[k], again.p[k], atol=1e-3) for k in model.p)


def test_languages_of_all_documents(spark):
    rows = [(i, "alpha beta" + (" gamma" if i < 2 else ""), "en") for i in range(5000)]
    model, _ = train_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=None)
    from siltstone.llm.langmask import grams

    known = grams(*K.utf8(pa.array(["gamma"])))[0]
    assert model.masks(known).all()


def plain_fit(model, docs, labels, passes, batch=32, drop=0.3, seed=11, rate=0.1, decay=0.02):
    """fit() with the whole gradient of every embedding in each step, window by window, in doubles."""
    rng, half = np.random.default_rng(seed), batch // 2
    p, sums = ({k: x.astype(float) for k, x in part.items()} for part in (model.p, model.sums))
    classes = [np.flatnonzero(labels == k) for k in (0, 1)]
    steps = passes * -(-max(map(len, classes)) // half)
    order = [np.concatenate([rng.permutation(c) for _ in range(-(-steps * half // len(c)))]) for c in classes]
    for s in range(0, steps * half, half):
        at, grad = np.concatenate([o[s : s + half] for o in order]), {k: np.zeros_like(x) for k, x in p.items()}
        tokens = np.concatenate([[*model.index[docs[i]], PAD, PAD] for i in at])
        tokens[(tokens > RARE) & (rng.random(len(tokens)) < drop)] = RARE
        begin = 0
        for i in at:
            t, features, places = tokens[begin : begin + len(docs[i]) + 2], [], []
            begin += len(t)
            for k, w in enumerate((1, 2, 3)):
                h = sum(p["e"][t[o : len(t) - 2 + o]] @ p[f"w{w}"][o] for o in range(w))
                places.append(h.argmax(0))
                features.append(h.max(0) + p["b"][k])
            raw = np.concatenate(features)
            g = (1 / (1 + np.exp(-(np.maximum(raw, 0) @ p["v"] + p["c"][0]))) - labels[i]) / batch
            grad["v"] += np.maximum(raw, 0) * g
            grad["c"] += g
            for k, w in enumerate((1, 2, 3)):
                for f in range(16):
                    d = g * p["v"][k * 16 + f] * (raw[k * 16 + f] > 0)
                    grad["b"][k, f] += d
                    for o in range(w):
                        row = t[places[k][f] + o]
                        grad[f"w{w}"][o][:, f] += d * p["e"][row]
                        grad["e"][row] += d * p[f"w{w}"][o][:, f]
        for k, x in p.items():
            d = grad[k] + decay * x
            sums[k] += (d * d).mean(1, keepdims=True) if k == "e" else d * d
            x -= rate * d / np.sqrt(sums[k])
        p["e"][PAD] = 0
    return p, sums


def test_training_equals_plain_steps():
    """Each step moves all embeddings, those that no text of the batch has by decay alone."""
    rng = np.random.default_rng(6)
    index = np.append(RARE, np.arange(2, 400)).astype(np.int32)
    docs = [rng.zipf(1.3, n).astype(np.int64) % 300 for n in rng.integers(1, 30, 60)]  # the last hundred buckets are in no text
    labels = np.array([int(3 in d) for d in docs])
    model, plain = TextCnn(index, 400), TextCnn(index, 400)
    p, sums = plain_fit(plain, docs, labels, 12)
    model.fit(docs, labels, 12)
    for k in p:
        assert np.allclose(model.p[k], p[k], atol=2e-3) and np.allclose(model.sums[k], sums[k], rtol=2e-2, atol=1e-5), k
    untouched = np.arange(302, 400)
    assert np.allclose(model.p["e"][untouched], p["e"][untouched], rtol=1e-3, atol=1e-9) and p["e"][untouched].any()


def test_embeddings_in_no_text_do_not_slow_training():
    """Decay ends at 0, not in denormal numbers, on which every operation takes many times as long."""
    rng = np.random.default_rng(7)
    index = np.append(RARE, np.arange(2, 5000)).astype(np.int32)
    docs = [rng.integers(0, 50, 8) for _ in range(64)]
    model = TextCnn(index, 5000)
    model.fit(docs, np.arange(64) % 2, 250)
    e = np.abs(model.p["e"])
    assert e[:50].any() and not ((e > 0) & (e < np.finfo(np.float32).tiny)).any()


def test_thresholds_by_language_of_rows_learned_from(spark):
    """Too few rows are kept back: languages of all others are named after all."""
    texts = {"en": "the quick brown fox runs over the lazy dog", "de": "der schnelle braune fuchs springt hinweg"}
    lang = {i: ("en", "de")[i // 2 % 2] for i in range(300)}
    hold = {r.id for r in spark.range(300).filter(F.pmod(F.xxhash64(F.lit("part"), "id"), 5) == 0).collect()}
    docs = spark.createDataFrame([(i, texts[x] + (" blarg zorp" if i % 2 else ""), x) for i, x in lang.items()], "doc_id long, text string, lang string")
    languages = spark.sparkContext.broadcast(train_languages(docs, sample_docs=None))
    for away in (set(), hold):
        model = train(docs, spark.createDataFrame([(i, i % 2) for i in lang if i not in away], "doc_id long, toxic int"), least_language=5, languages=languages)
        assert {*model.by_language} == {"en", "de"}
