"""Language identification by bit-sliced Bloom filters of byte n-grams.

A filter is a table of slots, each a bit mask with one bit per language; an n-gram sets its
language's bit in `hashes` slots.  The AND of a query n-gram's slots is the mask of all languages
that hold it.  For each document the bits are counted per language, hits/n is corrected for the
language's false-positive rate f (fill rate to the power `hashes`), (x - f)/(1 - f), and the largest
corrected share decides.  score is its part of the sum over languages.

N-grams: 4 bytes of the text after lower-casing A-Z, ASCII non-letters as one space, inside
words with one space at either edge at most.  Training: about `sample_docs` whole documents per
language (chosen by a hash of the id, a documented bound), n-grams of at least `min_docs` of
them, the `grams` most frequent per language.  Predictions see nothing but the text.

Semantics: a null text or one without a letter gives `und` and 0.0, as does every text when
nothing was learned.  A text with letters but no known n-gram gives the language with most
training documents, score 0.0.  Ties go to the language first by name.  Every row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .common import prepare, remainder

#: Letters of ASCII fold to lower case, other ASCII to a space; the bytes of other characters stay.
LETTER = np.where((np.arange(256) >= 128) | ((np.arange(256) | 32) >= 97) & ((np.arange(256) | 32) <= 122), K.FOLD, 32).astype(np.uint8)
MAX_LANGUAGES = 1024
#: The bits of each byte, as numbers.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the documents in order, and for each document the first of its own."""
    # documents apart: each is taken with a space before and after it
    count = len(off) - 1
    at = off[:-1] + 2 * np.arange(count)
    own = np.ones(len(data) + 2 * count, bool)
    own[at] = own[off[1:] + 2 * np.arange(count) + 1] = False
    out = np.full(len(own), 32, np.uint8)
    out[own] = LETTER.take(data)
    if len(out) < 4:
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    letter = out != 32
    fine = np.flatnonzero(letter[1:-2] & letter[2:-1])
    g = np.ndarray(len(out) - 3, "<u4", out, 0, 1)  # four bytes from each place on
    return g[fine], np.append(np.searchsorted(fine, at), len(fine))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, documents) of each batch."""
    for batch in batches:
        data, off = K.utf8(batch.column(1))
        g, goff = grams(data, off)
        langs, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        doc = np.repeat(np.arange(len(batch), dtype=np.uint64), np.diff(goff))
        once = np.unique(doc << np.uint64(32) | g)
        key, n = np.unique(at[(once >> np.uint64(32)).astype(np.int64)].astype(np.uint64) << np.uint64(32) | once & np.uint64(2**32 - 1), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(langs[(key >> np.uint64(32)).astype(np.int64)]), pa.array((key & np.uint64(2**32 - 1)).astype(np.int64)), pa.array(n)], ["lang", "gram", "docs"])


class BitSliced:
    """Slots of language masks."""

    def __init__(self, languages: list[str], grams: list[np.ndarray], slots_log2: int = 18, hashes: int = 3):
        self.languages, self.shift, self.hashes = languages, np.uint64(64 - slots_log2), hashes
        self.table = np.zeros((max(1, -(-len(languages) // 32)), 1 << slots_log2), np.uint32)
        for bit, g in enumerate(grams):
            for at in self._slots(g):
                self.table[bit // 32, at] |= np.uint32(1 << bit % 32)
        self.false = np.array([float(((self.table[b // 32] >> np.uint32(b % 32)) & 1).mean()) ** hashes for b in range(len(languages))])

    def _slots(self, g: np.ndarray):
        h = K.fmix(g.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for k in range(self.hashes):
            yield ((h * np.uint64(2 * k + 1)) ^ (h << np.uint64(21 * k))) >> self.shift

    def masks(self, g: np.ndarray) -> np.ndarray:
        out = None
        for at in self._slots(g):
            hit = self.table.take(at.view(np.int64), axis=1)
            out = hit if out is None else np.bitwise_and(out, hit, out=out)
        return out

    def shares(self, g: np.ndarray, goff: np.ndarray) -> np.ndarray:
        """Documents x languages: corrected shares of n-grams that the language holds."""
        masks, n = self.masks(g), np.diff(goff)
        out = np.zeros((len(n), len(self.languages)))
        first = np.repeat(np.arange(len(n)) << 8, n)
        for b in range(0, len(self.languages), 8):
            # n-grams of a document by the mask of eight languages, and from those the hits of each
            by_mask = np.bincount(first + (masks[b // 32] >> np.uint32(b % 32) & np.uint32(255)), minlength=len(n) << 8).reshape(len(n), 256)
            false = self.false[b : b + 8]
            hits = (by_mask @ BITS)[:, : len(false)]
            out[:, b : b + 8] = np.clip((hits / np.maximum(n, 1)[:, None] - false) / (1 - false), 0, 1)
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int | None = 2000, grams: int = 20_000, min_docs: int = 2) -> tuple[BitSliced | None, str]:
    """The filter, and the language with most documents; only rows with text and language count, all of them if sample_docs is None."""
    prepare(docs.sparkSession)
    rows = docs.select(docs[lang_col].alias("lang"), docs[text_col].alias("text"), docs[id_col].alias("id")).filter("lang is not null and text is not null")
    seen = sorted(rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect())
    if not seen:
        return None, "und"
    if len(seen) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if sample_docs is not None:
        chance = F.create_map(*(F.lit(x) for r in seen for x in (r[0], sample_docs / r[1])))
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("language"), "id"), 1_000_000) / 1e6 < chance[F.col("lang")])
    counted = rows.select("lang", "text").mapInArrow(_count, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    best = counted.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("docs"), "gram"))).filter(F.col("rank") <= grams)
    table = best.select("lang", "gram").toPandas()  # at most `grams` rows per language
    names = [r[0] for r in seen]
    return BitSliced(names, [table.loc[table["lang"] == x, "gram"].to_numpy(np.int64) for x in names]), max(seen, key=lambda r: (r[1], [-ord(c) for c in r[0]]))[0]


def predicted(model: BitSliced | None, most: str, data: np.ndarray, off: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of each document."""
    pred, score = [], []
    for a, b in K.pieces(off):
        piece = data[off[a] : off[b]]
        ascii_letters = np.append(0, np.cumsum((LETTER[piece] != 32) & (piece < 128)))
        at = off[a : b + 1] - off[a]
        letters = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
        for d in np.flatnonzero(~letters):
            letters[d] = any(c.isalpha() for c in piece[at[d] : at[d + 1]].tobytes().decode())
        if model is None:
            pred += ["und"] * (b - a)
            score += [0.0] * (b - a)
            continue
        shares = model.shares(*grams(piece, at))
        best, total = shares.argmax(1), shares.sum(1)
        for d in range(b - a):
            if not letters[d]:
                pred.append("und")
                score.append(0.0)
            elif total[d] <= 0:
                pred.append(most)
                score.append(0.0)
            else:
                pred.append(model.languages[best[d]])
                score.append(float(shares[d, best[d]] / total[d]))
    return pred, score


def _predict(shared, most: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = predicted(shared.value, most, *K.utf8(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: BitSliced | None, most: str, text_col: str = "text", id_col: str = "doc_id", held_out: F.Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.  Map-only."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # slots x masks: its size is a parameter
    flag = F.lit(False) if held_out is None else held_out
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(flag, F.lit(False)).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_predict(shared, most), "doc_id long, held_out boolean, lang_pred string, score double")


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Train on the documents whose crc32(doc_id) mod 5 is not 0, predict all."""
    held = F.coalesce(remainder(docs["doc_id"]) == 0, F.lit(False))
    return identify(docs, *train(docs.filter(~held)), held_out=held)
