"""Toxicity: a convolutional text classifier with hashed word embeddings, trained over Spark's partitions.

Words are runs of letters (bytes of non-ASCII characters count as letters) after lower-casing
A-Z, hashed into `buckets`; buckets seen in fewer than `min_docs` training documents share one
embedding, so that words met once teach nothing.  Filters of widths 1, 2 and 3, rectified,
max-pooled over the whole text, feed one logistic unit.  Adagrad on balanced batches, with
decay and word dropout, which keep single documents from being learned by heart.

Training reads the whole text of every labelled document, at least twice.  Rows are dealt into
shards and turns by hashes; in a turn each shard goes on from the common parameters over its own
rows, in chunks of bounded size, and the parameters and Adagrad's sums are averaged, weighted by
rows.  A fifth of the labelled ids is kept from training and calibrates: the threshold, overall
and for each language with enough documents, is the logit that parts all of these documents best
(a false alarm's share weighs four times a miss's), found exactly from sums by bins and within
them, and is subtracted, so that 0.5 is the threshold of every score.

Semantics: a null or empty text, or one without letters, is one padding word and gets a score
like any other.  Every row gives one row.  Labels that are null or belong to no document are
left out; a document with several labels counts by each.  Thresholds by language go by a column of
languages, or by the language that the text itself seems to have, as bit-sliced n-gram filters tell.  With fewer than two classes to learn
from every score is 0.0.  Texts and ids may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .common import discard, fresh, materialize, prepare, remainder, sized
from .langmask import LETTER, predicted
from .langmask import train as train_languages

WIDTHS, DIM, FILTERS = (1, 2, 3), 16, 16
BUCKETS_LOG2 = 18
PAD, RARE = 0, 1
#: Up to FEW shards have SHARD_ROWS rows at least; more, SHARDS at most, FULL_ROWS, whose words outweigh the parameters that a shard sends.
SHARD_ROWS, FEW, FULL_ROWS, SHARDS = 3_000, 4, 16_000, 64
#: Words of the documents that a task holds at once, words of a step and of a score worked out at once, numbers in a row of parameters.
CHUNK_WORDS, STEP_WORDS, BLOCK, PIECE = 8_000_000, 200_000, 4096, 1 << 16
#: Rows of scalars that fit in a cache; steps after which embeddings whose mean square has sunk below TINY become 0, long before slow denormal numbers.
ROWS, SETTLE, TINY = 16_384, 32, 1e-24


def buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word in order, and for each document the first of its words."""
    data, start, end, woff = K.words(LETTER[data], off, fold=False)
    return (K.span_hashes(data, start, end) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int32), woff


def _bucketed(languages, held: bool):
    """(roll, hold, label, text, lang) -> (roll, hold, label, lang, words); languages: a broadcast model that names the language, of rows with hold only if held, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column(3))
            w, woff = buckets(data, off)
            lang = batch.column(4)
            if languages is not None:
                at = np.flatnonzero(batch.column(1).to_numpy(zero_copy_only=False)) if held else np.arange(len(batch))
                names = np.full(len(batch), None, object)
                names[at] = predicted(*languages.value, *K.utf8(batch.column(3).take(pa.array(at))))[0]
                lang = pa.array(names, pa.string())
            yield _bucket_rows(batch, lang, w, woff)

    return run


def _bucket_rows(batch: pa.RecordBatch, lang: pa.Array, w: np.ndarray, woff: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:3], lang, pa.array([w[a:b].tobytes() for a, b in zip(woff, woff[1:])], pa.binary())], ["roll", "hold", "label", "lang", "words"])


def padded(words: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with PADs after each document: tokens, first positions, numbers of windows."""
    n, tail = np.diff(woff), max(WIDTHS) - 1
    windows = np.maximum(n, 1)
    first = np.cumsum(windows + tail) - windows - tail
    out = np.zeros(int((windows + tail).sum()), np.int32)
    out[np.repeat(first - woff[:-1], n) + np.arange(len(words))] = words
    return out, first, windows


class TextCnn:
    """Parameters, forward pass over tables of filter responses, and the training step."""

    def __init__(self, index: np.ndarray, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.index = index  # bucket -> row of the embeddings
        self.p = {"e": rng.normal(0, 0.1, (rows, DIM)).astype(np.float32), "v": rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), "c": np.zeros(1, np.float32), "b": np.zeros((len(WIDTHS), FILTERS), np.float32)}
        self.p["e"][PAD] = 0
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(DIM * w), (w, DIM, FILTERS)).astype(np.float32)
        self.sums = {k: np.full_like(x[:, :1] if k == "e" else x, 1e-4) for k, x in self.p.items()}  # Adagrad's, one for an embedding; only while training
        self.threshold, self.by_language = 0.0, {}

    def vector(self) -> np.ndarray:
        """Parameters and sums in one row."""
        return np.concatenate([x.ravel() for part in (self.p, self.sums) for x in part.values()])

    def put(self, vector: np.ndarray) -> None:
        at = 0
        for part in (self.p, self.sums):
            for k, x in part.items():
                part[k] = vector[at : at + x.size].reshape(x.shape).copy()
                at += x.size

    def filters(self) -> np.ndarray:
        """All filters side by side, by offset and width."""
        return np.concatenate([self.p[f"w{w}"][o] for o in range(max(WIDTHS)) for w in WIDTHS if o < w], axis=1)

    def tables(self) -> np.ndarray:
        """Every embedding row's response to the filters."""
        return self.p["e"] @ self.filters()

    def pooled(self, tokens: np.ndarray, first: np.ndarray, windows: np.ndarray, tables: np.ndarray) -> np.ndarray:
        last, top = first + windows, np.full((len(first), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        for a in range(0, int(last[-1]), BLOCK):
            b = min(a + BLOCK, int(last[-1]))
            h = _responses(tables.take(tokens[a : b + max(WIDTHS) - 1], axis=0))
            for d in range(int(np.searchsorted(last, a, "right")), int(np.searchsorted(first, b))):
                np.maximum(top[d], h[max(first[d] - a, 0) : last[d] - a].max(0), out=top[d])
        return np.maximum(top + self.p["b"].ravel(), 0)

    def logits(self, words: np.ndarray, woff: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        out, a, n = [], 0, len(woff) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(woff, woff[a] + 100_000, "right")) - 1)
            b = min(b, a + 2000)
            out.append(self.pooled(*padded(self.index[words[woff[a] : woff[b]]], woff[a : b + 1] - woff[a]), tables) @ self.p["v"] + self.p["c"])
            a = b
        return np.concatenate(out) if out else np.zeros(0)

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, passes: int = 1, batch: int = 32, drop: float = 0.3, seed: int | tuple[int, ...] = 11) -> None:
        """Balanced batches: in a pass each document of the larger class comes once, one of the smaller at least once."""
        rng = np.random.default_rng(seed)
        half = batch // 2
        classes = [c for k in (0, 1) if len(c := np.flatnonzero(labels == k))]
        steps = passes * -(-max(map(len, classes)) // half)
        order = [np.concatenate([rng.permutation(c) for _ in range(-(-steps * half // len(c)))]) for c in classes]
        # while fitting, an embedding is its row of e times its scale, so that decay alone moves one number of it; square: its mean square
        self.scale, self.square = np.ones(len(self.p["e"]), np.float32), np.square(self.p["e"]).mean(1)
        for k, s in enumerate(range(0, steps * half, half)):
            if k % SETTLE == 0:
                self.scale[self.square < TINY] = self.square[self.square < TINY] = 0
            at = np.concatenate([o[s : s + half] for o in order])
            self.step([docs[i] for i in at], labels[at].astype(np.float32), batch, drop, rng)
        self.p["e"] *= self.scale[:, None]
        del self.scale, self.square

    def step(self, docs: list[np.ndarray], y: np.ndarray, batch: int, drop: float, rng: np.random.Generator, rate: float = 0.1, decay: float = 0.02) -> None:
        grad, own = {k: np.zeros_like(x) for k, x in self.p.items() if k != "e"}, []
        part = np.cumsum([len(d) for d in docs]) // STEP_WORDS  # long texts a few at a time
        for k in np.unique(part):
            at = np.flatnonzero(part == k)
            woff = np.cumsum([0, *(len(docs[i]) for i in at)])
            tokens, first, windows = padded(self.index[np.concatenate([docs[i] for i in at])], woff)
            tokens[(tokens > RARE) & (rng.random(len(tokens)) < drop)] = RARE
            own += self._gradient(tokens, first, windows, y[at], batch, grad)
        for k, g in grad.items():
            d = g + decay * self.p[k]
            self.sums[k] += d * d
            self.p[k] -= rate * d / np.sqrt(self.sums[k])
        self._embed(np.concatenate([t for t, _ in own]), np.concatenate([g for _, g in own]), rate, decay)

    def _embed(self, rows: np.ndarray, grad: np.ndarray, rate: float, decay: float) -> None:
        """Adagrad's step of all embeddings: decay shrinks each as a whole, and those of `rows` move by their gradients besides."""
        order = np.argsort(rows, kind="stable")
        start = np.flatnonzero(np.diff(rows[order], prepend=-1))
        rows, e, sums = rows[order[start]], self.p["e"], self.sums["e"][:, 0]
        x, total = e[rows] * self.scale[rows, None], sums[rows]
        d = np.add.reduceat(grad[order], start, axis=0) + decay * x
        for a in range(0, len(e), ROWS):
            at = slice(a, a + ROWS)
            sums[at] += decay * decay * self.square[at]
            shrink = 1 - rate * decay / np.sqrt(sums[at])
            self.scale[at] *= shrink
            self.square[at] *= shrink * shrink
        total += (d * d).mean(1)
        x -= rate * d / np.sqrt(total)[:, None]
        x[rows == PAD] = 0
        e[rows], sums[rows], self.scale[rows], self.square[rows] = x, total, 1, np.square(x).mean(1)

    def _gradient(self, tokens: np.ndarray, first: np.ndarray, windows: np.ndarray, y: np.ndarray, batch: int, grad: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Adds these documents' part of a batch's gradient; rows of embeddings and their gradients are returned."""
        x, own = self.p["e"].take(tokens, axis=0) * self.scale.take(tokens)[:, None], []
        h = _responses((self.filters().T @ x.T).T).T
        peaks = np.array([h[:, a : a + n].argmax(1) + a for a, n in zip(first, windows)])
        raw = h[np.arange(len(h)), peaks] + self.p["b"].ravel()
        z = np.maximum(raw, 0)
        g = 1 / (1 + np.exp(-(z @ self.p["v"] + self.p["c"]))) - y
        grad["v"] += z.T @ g / batch
        grad["c"] += g.sum() / batch
        back = (raw > 0) * g[:, None] * self.p["v"] / batch
        for k, w in enumerate(WIDTHS):
            at = slice(k * FILTERS, (k + 1) * FILTERS)
            d = back[:, at]
            grad["b"][k] += d.sum(0)
            for o in range(w):
                rows = peaks[:, at] + o
                grad[f"w{w}"][o] += np.einsum("bfd,bf->df", x[rows], d)
                own.append((tokens[rows].ravel(), (d[:, :, None] * self.p[f"w{w}"][o].T).reshape(-1, DIM)))
        return own


def _responses(r: np.ndarray) -> np.ndarray:
    """Responses of the tokens to filters() -> responses of each width's filters to the windows that begin there."""
    n, at = len(r) - max(WIDTHS) + 1, FILTERS * len(WIDTHS)
    h = r[:n, :at].copy(order="K")
    for o in range(1, max(WIDTHS)):
        own = h[:, FILTERS * sum(w <= o for w in WIDTHS) :]  # those wide enough
        own += r[o : o + n, at : at + own.shape[1]]
        at += own.shape[1]
    return h


def best_threshold(logits: np.ndarray, labels: np.ndarray, alarm: float = 4.0) -> float:
    """The middle of the widest gap among cuts with the least missed share + alarm * false-alarm share; cut_points() over one array."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order].astype(np.float64), labels[order]
    clean, toxic = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    # cut after k values: toxic below are missed, clean above are false alarms
    wrong = np.append(0, np.cumsum(y == 1)) / toxic + alarm * ((y == 0).sum() - np.append(0, np.cumsum(y == 0))) / clean
    edges = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    gaps = np.diff(edges)
    wrong = np.where(gaps > 0, wrong, np.inf)  # no cut between equal values
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    k = best[np.argmax(gaps[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def cut_points(scored: DataFrame, least: int = 60, alarm: float = 4.0) -> dict[str | None, float]:
    """best_threshold() of all rows of (lang, label, logit), under None, and of each language with both labels and `least` rows.  Exact.

    Equal logits are one cell; cells are summed by bin, so that no task sees more than a bin's cells or a language's bins.
    """
    of = F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))))).alias("of")
    cells = scored.select(of, "logit", "label").groupBy("of", "logit").agg(F.count_if(F.col("label") == 0).alias("clean"), F.count_if(F.col("label") == 1).alias("toxic"))
    cells = materialize(cells.withColumn("bin", F.floor(F.col("logit") * 1024)), "toxicity-cells")
    bins = cells.groupBy("of", "bin").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"), F.min("logit").alias("least"))
    up, all_bins, own = W.partitionBy("of").orderBy("bin"), W.partitionBy("of"), W.partitionBy("of", "bin").orderBy("logit")
    bins = bins.select("of", "bin", "least", F.lead("least").over(up).alias("later"), F.row_number().over(up).alias("at"), (F.sum("c").over(up) - F.col("c")).alias("c0"), (F.sum("t").over(up) - F.col("t")).alias("t0"), F.sum("c").over(all_bins).alias("cs"), F.sum("t").over(all_bins).alias("ts"))
    # cuts: low, high, clean and toxic rows up to the cut
    after = cells.join(bins, ["of", "bin"]).select("of", "cs", "ts", F.col("logit").alias("low"), F.coalesce(F.lead("logit").over(own), "later", F.col("logit") + 1).alias("high"), (F.col("c0") + F.sum("clean").over(own)).alias("c"), (F.col("t0") + F.sum("toxic").over(own)).alias("t"))
    before = bins.filter("at = 1").select("of", "cs", "ts", (F.col("least") - 1).alias("low"), F.col("least").alias("high"), F.lit(0).alias("c"), F.lit(0).alias("t"))
    # shares times both classes' sizes: whole numbers, so that ties are ties
    wrong = F.col("t") * F.greatest("cs", F.lit(1)) + alarm * (F.col("cs") - F.col("c")) * F.greatest("ts", F.lit(1))
    cuts = after.unionByName(before).select("of", "cs", "ts", F.struct(wrong.alias("wrong"), (F.col("low") - F.col("high")).alias("gap"), "low", "high").alias("cut"))
    best = cuts.groupBy("of", "cs", "ts").agg(F.min("cut").alias("cut")).filter((F.col("of") == "") | (F.col("cs") + F.col("ts") >= least) & (F.col("cs") > 0) & (F.col("ts") > 0))
    out = {r.of[1:] if r.of else None: (r.cut.low + r.cut.high) / 2 for r in best.collect()}  # a row per language
    discard(cells)
    return out


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words) -> (bucket, docs) of a partition."""
    seen = np.zeros(1 << BUCKETS_LOG2, np.int64)
    for batch in batches:
        for b in batch.column(0):
            seen[np.unique(np.frombuffer(b.as_py(), np.int32))] += 1
    own = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seen[own])], ["bucket", "docs"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], list[int]]]:
    """(shard, label, words) in order of shards -> documents of one shard, as many as a task may hold."""
    shard, docs, labels, size = None, [], [], 0
    for batch in batches:
        for of, label, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if docs and (of != shard or size > CHUNK_WORDS):
                yield shard, docs, labels
                docs, labels, size = [], [], 0
            shard = of
            docs.append(np.frombuffer(words.as_py(), np.int32))
            labels.append(label)
            size += len(docs[-1])
    if docs:
        yield shard, docs, labels


def _turn(shared, turn: int, passes: int):
    """(shard, label, words) -> (shard, rows, piece, data): each shard's parameters after its rows, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, chunks in groupby(_chunks(batches), key=lambda c: c[0]):
            index, vector = shared.value
            model, rows = TextCnn(index, int(index.max()) + 1), 0
            model.put(vector)
            for k, (_, docs, labels) in enumerate(chunks):
                model.fit(docs, np.array(labels), passes, seed=(11, turn, shard, k))
                rows += len(docs)
            vector = model.vector()
            for piece, a in enumerate(range(0, len(vector), PIECE)):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([rows], pa.int64()), pa.array([piece], pa.int64()), pa.array([vector[a : a + PIECE].tobytes()], pa.binary())], ["shard", "rows", "piece", "data"])

    return run


def _mean(pieces: pd.DataFrame) -> pd.DataFrame:
    """One piece of all shards -> their mean by rows."""
    pieces = pieces.sort_values("shard")
    data = np.average([np.frombuffer(b, np.float32) for b in pieces["data"]], axis=0, weights=pieces["rows"])
    return pd.DataFrame({"piece": pieces["piece"].iloc[:1], "data": [data.astype(np.float32).tobytes()]})


def _fit(rows: DataFrame, counts: dict[int, int], index: np.ndarray, steps: int = 700, batch: int = 32) -> TextCnn:
    """The model of all rows of (roll, label, words): `steps` one after the other at least, and two passes."""
    spark = rows.sparkSession
    model = TextCnn(index, int(index.max()) + 1)
    n = sum(counts.values())
    shards = min(SHARDS, max(1, min(FEW, n // SHARD_ROWS), n // FULL_ROWS))
    passes = max(2, -(-steps // -(-max(counts.values()) // (shards * batch // 2))))
    slices = 2 if shards > 1 and passes < 4 else 1  # parameters are averaged four times or more
    turns, passes = (1, passes) if shards == 1 else (slices * passes, 1)
    place = F.xxhash64("roll", "words")
    dealt = rows.select(F.pmod(place, shards).alias("shard"), F.pmod(F.xxhash64(F.lit("slice"), place), slices).alias("slice"), F.xxhash64(F.lit("order"), place).alias("order"), "label", "words")
    for turn in range(turns):
        shared = spark.sparkContext.broadcast((index, model.vector()))  # of fixed size
        mine = dealt.filter(F.col("slice") == turn % slices).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "order", "words", "label")
        fitted = mine.select("shard", "label", "words").mapInArrow(_turn(shared, turn, passes), "shard long, rows long, piece long, data binary")
        mean = fitted.groupBy("piece").applyInPandas(_mean, "piece long, data binary").toPandas().sort_values("piece")
        if len(mean):
            model.put(np.frombuffer(b"".join(mean["data"]), np.float32))
        shared.destroy()
    model.sums = {}
    return model


def _logits(shared):
    """(label, lang, words) -> (label, lang, logit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: TextCnn = shared.value
        tables = model.tables()
        for batch in batches:
            docs = [np.frombuffer(b.as_py(), np.int32) for b in batch.column(2)]
            z = model.logits(np.concatenate([np.zeros(0, np.int32), *docs]), np.cumsum([0, *map(len, docs)]), tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z.astype(np.float64))], ["label", "lang", "logit"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, label_col: str = "toxic", min_docs: int = 5, least_language: int = 60, languages=None) -> TextCnn | None:
    """Fit and calibrate on all labelled rows of docs; languages: a broadcast (filter, default) in place of lang_col."""
    spark = docs.sparkSession
    prepare(spark)
    marks = labels.select(labels[id_col].alias("label__id"), labels[label_col].cast("int").alias("label")).filter("label in (0, 1) and label__id is not null")
    lang = F.lit(None).cast("string") if lang_col is None else docs[lang_col].cast("string")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), lang.alias("lang"))
    hold = F.pmod(F.xxhash64(F.lit("part"), "id"), 5) == 0
    marked = rows.join(sized(marks), F.col("id") == F.col("label__id")).select(F.xxhash64(F.lit("toxicity"), "id").alias("roll"), hold.alias("hold"), "label", "text", "lang")

    def written(held: bool) -> DataFrame:
        return materialize(marked.mapInArrow(_bucketed(languages, held), "roll long, hold boolean, label int, lang string, words binary"), "toxicity-words")

    rows = written(True)
    try:
        counts = {False: {}, True: {}}
        for r in rows.groupBy("hold", "label").count().collect():
            counts[r[0]][r[1]] = r[2]
        if len(counts[False]) < 2:
            return None
        if len(counts[True]) < 2 and languages is not None:  # calibrates on what it learns from, whose languages are not named yet
            discard(rows)
            rows = written(False)
        learn = rows.filter("not hold")
        own = learn.select("words").mapInArrow(_seen, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("bucket").toPandas()  # of 2 ** BUCKETS_LOG2 at most
        index = np.full(1 << BUCKETS_LOG2, RARE, np.int32)
        index[np.sort(own["bucket"])] = np.arange(2, len(own) + 2)
        model = _fit(learn, counts[False], index)
        use = rows.filter("hold") if len(counts[True]) == 2 else learn
        shared = spark.sparkContext.broadcast(model)
        model.by_language = cut_points(use.select("label", "lang", "words").mapInArrow(_logits(shared), "label int, lang string, logit double"), least_language)
        model.threshold = model.by_language.pop(None)
        shared.destroy()
        return model
    finally:
        discard(rows)


def _score(shared, text_at: int, lang_at: int | None, name: str, languages=None):
    """Appends the score to each batch; all columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: TextCnn | None = shared.value
        tables = model.tables() if model else None
        for batch in batches:
            if model is None:
                score = np.zeros(len(batch))
            else:
                shift = np.full(len(batch), model.threshold)
                data, off = K.utf8(batch.column(text_at))
                if model.by_language and (lang_at is not None or languages is not None):
                    named = batch.column(lang_at).to_pylist() if lang_at is not None else predicted(*languages.value, data, off)[0]
                    shift = np.array([model.by_language.get(x, model.threshold) for x in named])
                z = model.logits(*buckets(data, off), tables).astype(np.float64) - shift
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, name])

    return run


def with_scores(docs: DataFrame, model: TextCnn | None, name: str, text_col: str = "text", lang_col: str | None = None, languages=None) -> DataFrame:
    """docs and a score column of that name.  Map-only; lang_col, or else languages, chooses the threshold."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # embeddings of at most 2 ** BUCKETS_LOG2 buckets
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*docs.schema.fields]).add(name, DoubleType())
    low = [c.lower() for c in docs.columns]
    return docs.mapInArrow(_score(shared, low.index(text_col.lower()), None if lang_col is None else low.index(lang_col.lower()), name, languages), schema)


def toxicity_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labels whose crc32(doc_id) mod 5 is not 0.

    A score sees the text alone: its threshold is that of the language which the text seems to have.
    """
    away = F.coalesce(remainder(docs["doc_id"]) == 0, F.lit(False))
    languages = docs.sparkSession.sparkContext.broadcast(train_languages(docs.filter(~away), sample_docs=None))  # of fixed size
    model = train(docs, labels.filter(remainder(labels["doc_id"]) != 0), languages=languages)
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    out = with_scores(rows, model, "score", languages=languages)
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """docs without the rows that score 0.5 or more; columns stay as they are."""
    name = fresh(docs, "toxicity")
    scored = with_scores(docs, train(docs, labels, text_col=text_col, lang_col=lang_col), name, text_col, lang_col)
    return scored.filter(F.col(name) < 0.5).drop(name)
