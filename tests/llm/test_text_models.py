"""Language masks, pieces, packing, quality, toxicity and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from siltstone.llm import kernels as K
from siltstone.llm.bm25_packing import ENCODED, NO_TERM, Encoder, Index, _encode, corpus_of, cuts, gains, order_documents, pack_documents, routes
from siltstone.llm.cnn_toxicity import TextCnn, best_threshold, buckets, drop_toxic, toxicity_held_out
from siltstone.llm.kn_quality import END, REPEAT, START, classify, drop_low, perplexities
from siltstone.llm.langmask import grams as language_grams
from siltstone.llm.langmask import identify, identify_held_out
from siltstone.llm.langmask import train as train_languages
from siltstone.llm.unigram_piece import NEVER, UnigramModel, encode_documents, log_scores, model_of, read_pieces

from .conftest import ODD, docs_of

public_tokenizers = pytest.importorskip("public_tokenizers")
EN, DE = "the of and to that with this from not are was for".split(), "der die und das nicht mit ist von auch eine zu den".split()


def prose(rng, words, n):
    own = ["".join(rng.choice("abdegilnorstu") for _ in range(rng.randint(3, 7))) for _ in range(15)]
    return " ".join(rng.choice(words if rng.random() < 0.7 else own) for _ in range(n))


def test_language(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, EN if i % 2 else DE, 40), "en" if i % 2 else "de") for i in range(120)] + [(None, "12 34", "en"), (901, None, "de"), (902, "", None), (903, "été ÖÜ", None), (904, "z", None)]
    got = identify_held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    right = [r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert sum(right) / len(right) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].lang_pred == by[901].lang_pred == by[902].lang_pred == "und" and by[904].lang_pred in ("en", "de")
    assert identify_held_out(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first().lang_pred == "und"


def naive_score(model, text):
    s = ("▁" + text.replace(" ", "▁")) if text else ""
    ids = {model.pieces[i]: i for i in range(3, len(model.pieces)) if not model.is_byte[i]}
    best = [0.0] + [-1e18] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - model.longest), e):
            i = ids.get(s[b:e].encode())
            if i is not None:
                best[e] = max(best[e], best[b] + model.score[i])
        if s[e - 1].encode() not in ids:
            best[e] = max(best[e], best[e - 1] + model.unknown_score)
    return best[-1]


def test_pieces(spark):
    rng = random.Random(4)
    texts = ["", None, "hello world", "  two  spaces \n x\t", "日本語 テスト \U0001f600 é", "a" * 3000, " "] + [prose(rng, EN, 60) for _ in range(20)] + ["".join(rng.choice("abc é\n▁漢") for _ in range(50)) for _ in range(20)]
    model = model_of(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in encode_documents(docs_of(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert model.decode(np.array(got[i].ids, np.int64)) == t.replace("▁", " ")
        assert got[i].lossless == ("▁" not in t) and got[i].n_pieces == len(got[i].ids)
        assert got[i].log_score == pytest.approx(naive_score(model, t))
    assert encode_documents(docs_of(spark, [])).count() == 0


def test_piece_scores_are_log_probabilities():
    pieces = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    score = log_scores(pieces)
    own = [s for s, (_, raw, t) in zip(score, pieces) if t == 1 and raw > NEVER]
    assert np.exp(own).sum() == pytest.approx(1) and all(s <= 0 for s in own)
    given = [(b"a", -1.5, 1), (b"b", -2.25, 1)]
    assert log_scores(given).tolist() == [-1.5, -2.25]
    with pytest.raises(ValueError):
        UnigramModel([("a▁b".encode(), -1.5, 1), (b"a", -0.5, 1)])


def plain_language(model, text):
    """Corrected shares by one look at a time."""
    words = re.findall(rb"[a-z\x80-\xff]+", text.encode().lower() if text.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
    grams = [x[k : k + 4] for w in words for x in [b" " + w + b" "] for k in range(len(x) - 3)]
    out = []
    for b in range(len(model.languages)):
        hits = sum(bool(all(model.table[b // 32, int(s[0])] >> np.uint32(b % 32) & 1 for s in model._slots(np.array([int.from_bytes(g, "little")], np.uint32)))) for g in grams)
        out.append(min(max((hits / max(len(grams), 1) - model.false[b]) / (1 - model.false[b]), 0), 1))
    return out


def test_language_masks_against_one_look_at_a_time(spark):
    """Masks, correction and score, on texts with ties, repeats, foreign letters and none; and no language is missed by its own n-grams."""
    rng = random.Random(21)
    rows = [(i, prose(rng, EN if i % 2 else DE, 30), "en" if i % 2 else "de") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, most = train_languages(df)
    texts = ["", "the der", "the the the", "Über straße été", "x", "a-b c'd", "THE Quick", prose(rng, EN, 3000), rows[0][1], rows[0][1]]
    data, off = K.utf8(pa.array(texts))
    shares = model.shares(*language_grams(data, off))
    for k, t in enumerate(texts):
        assert shares[k].tolist() == pytest.approx(plain_language(model, t)), t
    got = identify(docs_of(spark, list(enumerate(texts))), model, most).orderBy("doc_id").collect()
    for k, r in enumerate(got):
        best, total = shares[k].argmax(), shares[k].sum()
        want = ("und", 0.0) if not any(c.isalpha() for c in texts[k]) else (most, 0.0) if total <= 0 else (model.languages[best], shares[k][best] / total)
        assert (r.lang_pred, pytest.approx(r.score)) == want
    assert identify(docs_of(spark, []), model, most).count() == 0


def test_convolution_against_loops():
    """The forward pass over tables equals one window, filter and word at a time."""
    rng = np.random.default_rng(3)
    index = np.where(rng.random(1 << 18) < 0.5, 1, rng.integers(2, 40, 1 << 18)).astype(np.int32)
    model = TextCnn(index, 40)
    texts = ["", "one", "one two", "a b c d e f g h", "same same same", "word " * 500, "123 --"]
    words, woff = buckets(*K.utf8(pa.array(texts)))
    got = model.logits(words, woff, model.tables())
    for k, t in enumerate(texts):
        own = index[words[woff[k] : woff[k + 1]]].tolist() or [0]
        windows = max(len(own), 1)
        padded_words, features = own + [0, 0], []
        for w, width in enumerate((1, 2, 3)):
            for f in range(16):
                best = max(sum(float(model.p["e"][padded_words[i + o]] @ model.p[f"w{width}"][o][:, f]) for o in range(width)) for i in range(windows))
                features.append(max(best + float(model.p["b"][w][f]), 0.0))
        assert got[k] == pytest.approx(float(np.dot(features, model.p["v"]) + model.p["c"][0]), abs=1e-4), t


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(31)
    rows = [(i, prose(rng, EN, 20) + (" blarg zorp" if i % 2 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    odd = [(500, prose(rng, EN, 20_000) + " blarg zorp"), (501, rows[1][1]), (501, rows[1][1]), (502, ""), (503, None)]
    got = toxicity_held_out(docs_of(spark, rows + odd), labels).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.score, r.predicted))
    assert len(got) == 205 and len(set(by[501])) == 1 and by[501][0] == by[1][0] and by[502] == by[503]
    assert toxicity_held_out(docs_of(spark, []), labels).count() == 0


def test_chunked_encoding_equals_whole():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(6)
    texts = ["", " ", "  a b", "it's we'll 'x", "a  b", "x 　y", "<|endoftext|> a", "a   b c"] + ["".join(rng.choice(["a", "Bc", " ", "  ", "\n", "'s", "é", " ", "1", "%%", "日", " ", "\x1c"]) for _ in range(60)) for _ in range(300)]
    tokens, off = Encoder(path).encode(*K.utf8(pa.array(texts)))
    plain = Tokenizer.from_file(path)
    assert Encoder(path).fast is not None
    for k, t in enumerate(texts):
        assert tokens[off[k] : off[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids + [0], repr(t)


def test_other_tokenizers_see_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["", "Hello, wörld  x", "a b", "a b", " \n"]
    encoder, plain = Encoder(path), Tokenizer.from_file(path)
    tokens, off = encoder.encode(*K.utf8(pa.array(texts)))
    assert not encoder.cut and encoder.fast is None
    for k, t in enumerate(texts):
        assert tokens[off[k] : off[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids + [0]


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    rows = [(100 + i, prose(rng, EN, rng.randint(0, 120))) for i in range(60)] + [r for r in ODD if r[0] not in (None, 4)]
    got = pack_documents(docs_of(spark, rows), window=64, shard_tokens=1500).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in rows}
    at, full = defaultdict(int), defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(want[r.doc_id])
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        at[r.doc_id] += r.length
        full[r.sequence_id].append((r.offset, r.length))
    assert all(at[i] == len(x) for i, x in want.items())
    for spans in full.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= 64 and (end & (end - 1)) == 0
    assert pack_documents(docs_of(spark, [])).count() == 0
    assert cuts(150, 64).tolist() == [64, 128, 144, 148, 150]


def test_packing_finds_neighbours_in_other_files(spark):
    """Related documents lie as far apart as they can; shards of the scan's runs would never join them."""
    rng = random.Random(14)
    own = [["".join(rng.choice("bdfghklmnp") for _ in range(8)) for _ in range(10)] for _ in range(40)]
    rows = [(i, " ".join(own[i % 40] + [rng.choice(EN) for _ in range(8)])) for i in range(320)]
    got = pack_documents(docs_of(spark, rows).repartitionByRange(8, "doc_id"), window=256, shard_tokens=2000, run_bytes=3000).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.doc_id % 40))
    pairs = [a[1] == b[1] for x in by.values() for a, b in zip(sorted(x), sorted(x)[1:])]
    assert sum(pairs) > 0.6 * len(pairs) > 60


def test_packing_keeps_repeated_rows(spark):
    rows = [(4, "same text here")] * 7 + [(None, "same text here")] * 3 + [(4, "other text")]
    got = pack_documents(docs_of(spark, rows), window=16, shard_tokens=20).collect()
    assert sum(r.length for r in got if r.start == 0) >= 11 and sum(r.start == 0 for r in got) == 11
    assert sum(r.start == 0 and r.doc_id is None for r in got) == 3
    spans = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(a[0] != b[0] and b[1] == 0 or a[1] + a[2] == b[1] for a, b in zip(spans, spans[1:]))


def plain_bm25(docs, seed, df, n, mean):
    """Scores of all documents for the terms of one, term by term."""
    out = [0.0] * len(docs)
    for t in set(docs[seed]):
        for k, d in enumerate(docs):
            if tf := d.count(t):
                out[k] += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return out


def test_neighbours_are_those_of_plain_bm25(spark):
    """Frequencies over all files, and the order of neighbours, against a term-by-term version."""
    rng = random.Random(15)
    rows = [(i, prose(rng, EN, rng.randint(1, 40))) for i in range(80)] + [(90, ""), (91, None)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = docs_of(spark, rows).select("doc_id", "text").repartition(5).mapInArrow(_encode(path, 500), ENCODED)
    corpus = corpus_of(encoded)
    tokens, off = Encoder(path).encode(*K.utf8(pa.array([t for _, t in rows])))
    docs = [tokens[a : b - 1].tolist() for a, b in zip(off, off[1:])]
    df = Counter(t for d in docs for t in set(d))
    assert {t: int(n) for t, n in enumerate(corpus.df) if n} == df and corpus.n == 82 and corpus.mean == pytest.approx(sum(map(len, docs)) / 82)
    index = Index(np.array([t for d in docs for t in d]), np.append(0, np.cumsum([len(d) for d in docs])), corpus.df, corpus.n, corpus.mean)
    for seed in (0, 7, 33, 80):
        used = np.zeros(82, bool)
        used[[seed, 5, 6]] = True
        want = [(-s, k) for k, s in enumerate(plain_bm25(docs, seed, df, corpus.n, corpus.mean)) if s > 0 and not used[k]]
        got = index.neighbours(seed, used, 0, 10)
        assert [round(-s, 9) for s, _ in sorted(want)[:10]] == [round(-dict((k, s) for s, k in want)[int(g)], 9) for g in got]
        # the routes: the weightiest terms that another document has
        if docs[seed]:
            gain = {t: gains(docs[seed].count(t), df[t], len(docs[seed]), corpus.n, corpus.mean) for t in set(docs[seed]) if df[t] > 1}
            best = sorted(gain, key=lambda t: (-gain[t], t))[:3]
            route = int(routes(tokens, off, corpus)[seed])
            assert [x for x in (route >> 42, route >> 21 & NO_TERM, route & NO_TERM) if x != NO_TERM] == best


def test_packing_asks_until_no_neighbour_is_left():
    """Two topics in turn, many short documents to a window: the second topic waits for the first to be used up."""
    terms = np.array([[3 * (i % 2), 3 * (i % 2) + 1, 3 * (i % 2) + 2] for i in range(120)]).ravel()
    order = order_documents(np.full(120, 4), Index(terms, np.arange(121) * 3), 1024, 12, 16)
    assert sorted(order) == list(range(120)) and [i % 2 for i in order] == [0] * 60 + [1] * 60
    # a long seed shares one term with each document but document 1
    terms = np.array([*range(30), 50, *(t for t in range(29) for _ in range(3)), 29])
    off = np.cumsum([0, 30, 1, *[3] * 29, 1])
    order = order_documents(np.full(32, 4), Index(terms, off), 1024, 12, 16)
    assert order[0] == 0 and order[-1] == 1


def junk(rng):
    w = ["".join(rng.choice("abdegil") for _ in range(5)) for _ in range(6)]
    return rng.choice([" | ".join(w * 8), " ".join(x for x in w for _ in range(12)), " ".join(x + "***" for x in w * 8)])


def test_quality(spark):
    rng = random.Random(9)
    rows = [(i, junk(rng) if i % 6 == 0 else prose(rng, EN, 80)) for i in range(10, 300)] + ODD
    labels = spark.createDataFrame([(i, int(i % 6 != 0)) for i in range(10, 150)] + [(None, 1), (5000, 1), (3, None)], "doc_id long, quality int")
    docs = docs_of(spark, rows)
    got = classify(docs, labels).collect()
    assert len(got) == len(rows)
    fine = [r.kept for r in got if r.doc_id is not None and 10 <= r.doc_id < 300 and r.doc_id % 6]
    bad = [r.kept for r in got if r.doc_id is not None and 10 <= r.doc_id < 300 and r.doc_id % 6 == 0]
    assert sum(fine) >= 0.99 * len(fine) and sum(bad) <= 0.1 * len(bad)
    kept = drop_low(docs, labels)
    assert kept.columns == docs.columns
    assert drop_low(docs, labels.limit(0)).count() == len(rows)


def test_quality_knows_the_order_of_words(spark):
    """Hundreds of rare words that trusted documents share are words of the model; the same words shuffled are not clean."""
    rng = random.Random(13)
    lines = [" ".join("".join(rng.choice("abdegilnorstu") for _ in range(7)) for _ in range(10)) for _ in range(150)]
    clean = lambda: " ".join(rng.choice(lines) for _ in range(5))

    def shuffled():
        w = clean().split()
        rng.shuffle(w)
        return " ".join(w)

    rows = [(i, clean()) for i in range(400)] + [(i, shuffled()) for i in range(400, 440)]
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in classify(docs_of(spark, rows), labels).collect()}
    assert sum(got[i] for i in range(300, 400)) >= 95 and not any(got[i] for i in range(400, 440))


def brute_kneser_ney(rows, learned, order):
    """Interpolated modified Kneser-Ney in plain Python: logp and number of tokens of each row; checks that probabilities add up."""

    def grams(text):
        pieces = re.findall(rb"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", (text or "").encode())
        out, past, word = [], [START] * (order - 1), None
        held = b""
        for piece in pieces:
            if not piece.strip(b" \t\n\v\f\r"):
                held = piece
                continue
            # of the space before a word repeated, the first byte gives way to REPEAT and the others go with it
            if word == piece:
                out.append((*past[len(past) - order + 1 :], REPEAT))
            else:
                for byte in held + piece:
                    out.append((*past[len(past) - order + 1 :], byte))
                    past.append(byte)
            word, held = piece, b""
        for byte in [*held, END]:
            out.append((*past[len(past) - order + 1 :], byte))
            past.append(byte)
        return out

    all_grams = [grams(t) for _, t in rows]
    counts = {order: Counter(g for (i, _), gs in zip(rows, all_grams) if i in learned for g in gs)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    total, mass, d = defaultdict(int), defaultdict(float), {}
    for k, table in counts.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d[k] = [0.0] + [min(max(r - (r + 1) * y * n[r + 1] / n[r] if n[r] else 0.5 * r, 0.1 * r), 0.95 * r) for r in (1, 2, 3)]
        for g, c in table.items():
            total[k, g[:-1]] += c
            mass[k, g[:-1]] += d[k][min(c, 3)]

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / 258
        t, c = total[k, g[:-1]], counts[k][g]
        return (c - d[k][min(c, 3)] + mass[k, g[:-1]] * lower) / t if t else lower

    for h in [g[:-1] for g in list(counts[order])[:5]] + [(7,) * (order - 1)]:
        assert sum(p((*h, w)) for w in range(258)) == pytest.approx(1)
    return [(len(gs), sum(math.log(p(g)) for g in gs)) for gs in all_grams]


@pytest.mark.parametrize("order", [2, 3, 5])
def test_perplexities_against_plain_kneser_ney(spark, order):
    rng = random.Random(5)
    rows = [(i, prose(rng, EN, rng.randint(0, 25))) for i in range(60)] + [(i, t) for i, t in ODD if i != 8] + [(70, "a a a  a b\nb é é\t "), (71, "x" * 300 + " x x")]
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    got = perplexities(docs_of(spark, rows), trusted, order=order, block_bytes=700).collect()
    learned = {i for i in range(0, 60, 2) if zlib.crc32(str(i).encode()) % 5}
    want = brute_kneser_ney(rows, learned, order)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 2))
    for a, b in zip(sorted(((r.doc_id, r.n_tokens, r.logp) for r in got), key=key), sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-5, abs=1e-5)


def test_quality_drops_by_id_and_text(spark):
    """Of rows that share an id, or have none, the junk goes and the clean text stays; a very long text, an empty table."""
    rng = random.Random(6)
    rows = [(i, prose(rng, EN, 80)) for i in range(200)] + [(300, "zq%% " * 90), (None, "zq%% " * 90), (None, prose(rng, EN, 80)), (300, prose(rng, EN, 40_000))]
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    kept = drop_low(docs_of(spark, rows), labels).select("doc_id", "text").collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted((i or -1, t) for i, t in rows if "%" not in t)
    assert classify(docs_of(spark, []), labels).count() == 0


def test_toxicity(spark):
    rng = random.Random(10)
    rude = ["blarg", "zorp", "krunk"]
    rows = []
    for i in range(400):
        w = prose(rng, EN, 40).split()
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(rude)
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = docs_of(spark, rows + [(None, None), (990, ""), (991, "123")])
    got = toxicity_held_out(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(got) == 403 and len(held) > 50
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len({i for i in range(400) if i % 4} - ids) < 6 and len({i for i in range(0, 400, 4)} & ids) < 6
    assert toxicity_held_out(docs, labels.limit(0)).filter("score <> 0").count() == 0


def test_threshold():
    assert best_threshold(np.array([0.0, 1, 2, 3]), np.array([0, 0, 1, 1])) == 1.5
    assert best_threshold(np.array([1.0, 1, 1, 1]), np.array([0, 1, 0, 1])) == 1.5  # equal values are never cut apart


def test_pipeline_stages(spark, tmp_path):
    """Junk, copies, near copies go; of nulls and empty texts, rows repeated and rows without an id one stays; very long texts stay."""
    rng = random.Random(12)
    rows = [(i, prose(rng, EN, 60)) for i in range(200)]
    rows += [(500 + i, rows[i][1].upper()) for i in range(20)] + [(600 + i, rows[i][1] + " tail") for i in range(20)] + [(700 + i, junk(rng)) for i in range(20)]
    long, own, other = prose(rng, EN, 20_000), prose(rng, EN, 60), prose(rng, EN, 60)
    rows += [(800, None), (801, ""), (802, ""), (803, long), (804, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, own), (None, own), (5, other), (None, None)]
    docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 700), 0) for i, _ in rows[:260] if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    first = Counter(r.doc_id for r in got.filter("start = 0").select("doc_id").collect())
    assert first == Counter([*range(200), 5, 800, 803, None])


def test_pipeline_of_nothing(spark, tmp_path):
    docs_of(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
