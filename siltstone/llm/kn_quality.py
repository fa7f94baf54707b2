"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The model learns from trusted text: documents that labels mark as good.  Its tokens are the bytes of
the text and an end, so that it has no unknown words and leaves nothing out, in any language.  A word
that equals the word before it is one token, REPEAT, in place of its bytes and the space before it.  It is
predicted where it stands, but contexts pass over it: a run of one word stays as improbable as its
first repeat.

Every trusted document whose crc32(doc_id as text) mod 5 is not 0 is counted; the other fifth of the
trusted documents is held back, and its perplexities give the thresholds.

Counts are joined in shards, not held in memory.  Documents are cut into blocks that keep their text;
each block sends its distinct n-grams with their counts in the text learned from, as sorted compressed
keys, to the shards of these keys, which add up all blocks.  From this table of n-grams come the
continuation counts of each lower order, and P(w|h) = (c(hw) - D(c) + mass(h) P(w|h')) / c(h), mass(h)
being the sum of the discounts in h, from the uniform distribution upwards, with the three discounts of
modified Kneser-Ney per order.  The shards send each block the log-probabilities of its n-grams, in the
order in which it asked, and each document's perplexity follows.  A context has as many rows as
bytes may follow, at most, so that no group grows with the data; a hot n-gram is one row of a block.

Thresholds: for each language, `margin` times the `quantile` of the held-back perplexities; for
languages with less than `least` held-back documents, and for null languages, that of all of them.
With less than `least` in all, every trusted document counts as held back.  Short documents are drawn
towards their language's mean by `prior` tokens.  A document above its threshold is rejected.

Semantics: a null or empty text is its end token alone.  Without trusted rows every document is kept,
perplexity null.  Rows are judged each by itself, also where they repeat an id, or have none: drop_low
drops by id and text.  Rows without an id are never trusted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize, prepare, remainder, scratch_path, sized, without
from .katz import pack, pack_keys, unpack, unpack_keys

#: Bits of a token; bytes stand for themselves.
BITS = 9
REPEAT, END, START = 256, 257, 258
#: How many tokens may follow a context: all but START.
PREDICTED = 258
#: Bytes whose n-grams are worked out at once, and distinct n-grams held before equal ones are added up.
PIECE_BYTES, HELD_KEYS = 250_000, 1_000_000
SEEN, LEARN, HELD = 0, 1, 2
BLOCKS = "block long, shard int, doc_ids array<long>, langs array<string>, digests array<long>, roles array<byte>, lens array<int>, text binary, keys binary, counts binary"
NAMES = [f.split()[0] for f in BLOCKS.split(", ")]
SCORES = "doc_id long, lang string, digest long, role byte, n_tokens long, logp double"


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all documents, END after each, and their offsets."""
    _, start, end, woff = K.words(data, off, fold=False)
    h = K.span_hashes(data, start, end)
    same = np.append(False, h[1:] == h[:-1]) if len(h) else np.zeros(0, bool)
    same[woff[:-1][woff[:-1] < len(h)]] = False
    again = np.flatnonzero(same)
    out = data.astype(np.uint16)
    out[end[again - 1]] = REPEAT
    within = np.zeros(len(data) + 1, np.int8)
    within[end[again - 1] + 1] += 1
    within[end[again]] -= 1
    stays = np.cumsum(within[:-1], dtype=np.int8) == 0
    at = np.append(0, np.cumsum(stays))[off]
    return np.insert(out[stays], at[1:], END), at + np.arange(len(off))


def ngrams(t: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """The key of each token and the order - 1 tokens before it that are not REPEAT, the last token in the lowest bits."""
    own = t != REPEAT
    rank = np.append(0, np.cumsum(own))
    base, first = t[own].astype(np.int64), rank[off]
    lens = np.diff(first)
    context = np.zeros(len(base), np.int64)
    for back in range(1, order):
        before = np.full(len(base), START)
        before[back:] = base[:-back]
        for k in range(back):
            before[first[:-1][lens > k] + k] = START
        context |= before << BITS * (back - 1)
    return context[rank[:-1]] << BITS | t


def _encoded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the place of each key among them."""
    d = pa.array(keys).dictionary_encode()
    return d.dictionary.to_numpy(), d.indices.to_numpy()


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    distinct, at = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate([np.zeros(0), *counts]), len(distinct)).astype(np.int64)


def _by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted keys by shard, and where the shards begin in it."""
    shard = (K.fmix(keys.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
    return np.argsort(shard, kind="stable"), np.append(0, np.cumsum(np.bincount(shard, minlength=shards)))


def _blocks(order: int, shards: int, block_bytes: int):
    """(doc_id, lang, digest, role, text) -> for each block a row with its documents and a row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        meta, texts, lens, keys, counts, size = [], [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal meta, texts, lens, keys, counts, size, number
            block = part << 24 | number
            text = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            rows = pa.Table.from_batches(meta).combine_chunks()
            own = [[c.combine_chunks().to_pylist()] for c in rows.columns]
            values = {"block": [block], **dict(zip(("doc_ids", "langs", "digests", "roles"), own)), "lens": [np.concatenate(lens)], "text": [text]}
            yield _batch(values)
            distinct, n = _added(keys, counts)
            to, bounds = _by_shard(distinct, shards)
            spans = [(s, to[a:b]) for s, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
            yield _batch({"block": [block] * len(spans), "shard": [s for s, _ in spans], "keys": [pack_keys(distinct[x].view(np.uint64)) for _, x in spans], "counts": [pack(n[x].astype(np.uint32)) for _, x in spans]})
            meta, texts, lens, keys, counts, size, number = [], [], [], [], [], 0, number + 1
            K.release()

        for batch in batches:
            data, off = K.utf8(batch.column(4))
            learn = batch.column(3).to_numpy(zero_copy_only=False) == LEARN
            for a, b in K.pieces(off, PIECE_BYTES):
                t, toff = tokens(data[off[a] : off[b]], off[a : b + 1] - off[a])
                distinct, at = _encoded(ngrams(t, toff, order))
                meta.append(batch.select([0, 1, 2, 3]).slice(a, b - a))
                texts.append(data[off[a] : off[b]].tobytes())
                lens.append(np.diff(off[a : b + 1]))
                keys.append(distinct)
                counts.append(np.bincount(at[np.repeat(learn[a:b], np.diff(toff))], minlength=len(distinct)))
                size += int(off[b] - off[a]) + b - a
                if len(keys) > 1 and sum(map(len, keys)) - len(keys[0]) > HELD_KEYS:
                    keys, counts = ([x] for x in _added(keys, counts))
                if size >= block_bytes:
                    yield from flush()
        if meta:
            yield from flush()

    return run


_TYPES = {"block": pa.int64(), "shard": pa.int32(), "doc_ids": pa.list_(pa.int64()), "langs": pa.list_(pa.string()), "digests": pa.list_(pa.int64()), "roles": pa.list_(pa.int8()), "lens": pa.list_(pa.int32()), "text": pa.binary(), "keys": pa.binary(), "counts": pa.binary()}


def _batch(values: dict) -> pa.RecordBatch:
    n = len(values["block"])
    return pa.RecordBatch.from_arrays([pa.array(values.get(c, [None] * n), kind) for c, kind in _TYPES.items()], NAMES)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """All requests of a shard -> its distinct n-grams and their counts."""
    keys, counts, held = [], [], 0
    for k, n in zip(rows["keys"], rows["counts"]):
        keys.append(unpack_keys(k).view(np.int64))
        counts.append(unpack(n, np.uint32))
        held += len(keys[-1])
        if held > HELD_KEYS:  # beside those that are added up
            keys, counts = ([x] for x in _added(keys, counts))
            held = 0
    key, c = _added(keys, counts)
    del keys, counts
    K.release()
    return pd.DataFrame({"shard": rows["shard"].iloc[0], "key": key, "c": c})


def _answer(asks: pd.DataFrame, logs: pd.DataFrame) -> pd.DataFrame:
    """Each block's n-grams of a shard -> their log-probabilities in the same order."""
    order = np.argsort(logs["key"].to_numpy())
    key, logp = logs["key"].to_numpy()[order], logs["logp"].to_numpy(np.float32)[order]
    out = [(b, s, pack(logp[np.searchsorted(key, unpack_keys(k).view(np.int64))])) for b, s, k in zip(asks["block"], asks["shard"], asks["keys"])]
    K.release()
    return pd.DataFrame(out, columns=["block", "shard", "logs"])


def _tell(order: int, shards: int):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        logs = np.concatenate([unpack(b, np.float32) for b in answers.sort_values("shard")["logs"]]).astype(np.float64)
        for row in blocks.to_dict("records"):
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
            off = np.append(0, np.cumsum(row["lens"], dtype=np.int64))
            found, n, sums = [], [], []
            for a, b in K.pieces(off, PIECE_BYTES):
                t, toff = tokens(data[off[a] : off[b]], off[a : b + 1] - off[a])
                found.append((*_encoded(ngrams(t, toff, order)), toff[:-1]))
                n.append(np.diff(toff))
            keys = np.unique(np.concatenate([x[0] for x in found]))
            to, _ = _by_shard(keys, shards)
            if len(to) != len(logs):
                raise ValueError("a block's n-grams and answers differ")
            own = np.empty(len(keys))
            own[to] = logs
            for distinct, at, first in found:
                sums.append(np.add.reduceat(own[np.searchsorted(keys, distinct)][at], first))
            out.append(pd.DataFrame({"doc_id": pd.array(list(row["doc_ids"]), "Int64"), "lang": list(row["langs"]), "digest": row["digests"], "role": row["roles"], "n_tokens": np.concatenate(n), "logp": np.concatenate(sums)}))
        K.release()
        return pd.concat(out)

    return run


def _discounts(level: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney, for counts of 1, 2, and more."""
    n = level.agg(*(F.count_if(F.col("c") == r) for r in (1, 2, 3, 4))).first()
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
    return [min(max(r - (r + 1) * y * n[r] / n[r - 1] if n[r - 1] else 0.5 * r, 0.1 * r), 0.95 * r) for r in (1, 2, 3)]


def _probabilities(grams: DataFrame, order: int) -> DataFrame:
    """(shard, key, c) of every n-gram that a block has, c = 0 where it was not learned -> (shard, key, logp)."""
    mask = lambda k: F.col("key").bitwiseAND((1 << BITS * k) - 1)
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        lower = levels[k + 1].groupBy(mask(k).alias("key")).agg(F.count_if(F.col("c") > 0).alias("c"))
        levels[k] = materialize(lower, f"kn-level{k}")
    below = None
    for k in range(1, order + 1):
        rows, d, c = levels[k], _discounts(levels[k]), F.col("c")
        if below is None:
            rows = rows.withColumn("lower", F.lit(1.0 / PREDICTED))
        else:
            rows = rows.join(sized(below.select(F.col("key").alias("below"), F.col("p").alias("lower"))), mask(k - 1) == F.col("below")).drop("below")
        less = F.when(c > 2, d[2]).when(c == 2, d[1]).when(c == 1, d[0]).otherwise(0.0)
        follow = Window.partitionBy(F.shiftright("key", BITS))  # not more rows than tokens that may follow
        rows = rows.withColumns({"total": F.sum("c").over(follow), "mass": F.sum(less).over(follow)})
        p = F.when(F.col("total") > 0, (c - less + F.col("mass") * F.col("lower")) / F.col("total")).otherwise(F.col("lower"))
        if k == order:
            return materialize(rows.select("shard", "key", F.ln(p).cast("float").alias("logp")), "kn-logp")
        below = materialize(rows.select("key", p.alias("p")), f"kn-p{k}")


def perplexities(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 5, block_bytes: int = 8_000_000) -> DataFrame | None:
    """doc_id, lang, digest (xxhash64 of the text), role (0; 1: learned from; 2: trusted, held back), n_tokens and logp (natural) of every row; None if nothing is trusted.

    trusted_ids: a written table with a column doc_id of distinct trusted ids.
    """
    spark = docs.sparkSession
    prepare(spark)
    if trusted_ids.isEmpty():
        return None
    marks = trusted_ids.select(F.col("doc_id").alias("trusted__id"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    role = F.when(F.col("trusted__id").isNull(), SEEN).when(remainder(F.col("doc_id")) == 0, HELD).otherwise(LEARN).cast("byte")
    rows = rows.join(sized(marks), F.col("doc_id") == F.col("trusted__id"), "left").select("doc_id", "lang", F.xxhash64("text").alias("digest"), role.alias("role"), "text")
    name, shards = f"kn_blocks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.mapInArrow(_blocks(order, shards, block_bytes), BLOCKS).write.bucketBy(shards, "block").option("path", scratch_path(spark, "kn-blocks")).saveAsTable(name)
    try:
        table = spark.table(name)
        asks = table.filter("shard is not null").select("shard", "block", "keys", "counts")
        grams = materialize(asks.groupBy("shard").applyInPandas(_merge, "shard int, key long, c long"), "kn-grams")
        logs = _probabilities(grams, order)
        answers = asks.drop("counts").groupBy("shard").cogroup(logs.groupBy("shard")).applyInPandas(_answer, "block long, shard int, logs binary")
        texts = table.filter("shard is null").select("block", *NAMES[2:8])
        return materialize(texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_tell(order, shards), SCORES), "kn-scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.998, margin: float = 1.25, prior: float = 50.0, least: int = 50) -> DataFrame:
    """One row per row of docs: doc_id, lang, digest, n_tokens, perplexity, threshold, kept."""
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    good = materialize(good.join(docs.select(docs[id_col].cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi"), "kn-trusted")
    rows = perplexities(docs, good, id_col, text_col, lang_col)
    if rows is None:
        none = F.lit(None).cast("double")
        kept = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), F.xxhash64(docs[text_col].cast("string")).alias("digest"))
        return kept.select("*", F.lit(None).cast("long").alias("n_tokens"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    own, all_ = rows.filter(f"role <> {SEEN}"), (F.sum("logp") / F.sum("n_tokens"))
    if (held := rows.filter(f"role = {HELD}")).limit(least).count() == least:
        own = held
    # one row a language: counted, then broadcast
    many = (F.count(F.lit(1)) >= least) & F.col("lang").isNotNull()
    mean = materialize(own.groupBy("lang").agg(all_.alias("mean"), many.alias("many")).filter("many").select(F.col("lang").alias("of"), "mean"), "kn-means")
    overall = own.agg(all_).first()[0]

    def with_perplexity(rows: DataFrame) -> DataFrame:
        drawn = F.coalesce("mean", F.lit(overall))
        return rows.join(sized(mean), F.col("lang") == F.col("of"), "left").withColumn("perplexity", F.exp(-(F.col("logp") + prior * drawn) / (F.col("n_tokens") + prior))).drop("of", "mean")

    known, cut = with_perplexity(own), F.percentile_approx("perplexity", quantile, 100_000)
    cuts = materialize(known.groupBy("lang").agg(cut.alias("cut"), many.alias("many")).filter("many").select(F.col("lang").alias("of"), "cut"), "kn-cuts")
    out = with_perplexity(rows).join(sized(cuts), F.col("lang") == F.col("of"), "left")
    threshold = margin * F.coalesce("cut", F.lit(known.agg(cut).first()[0]))
    return out.select("doc_id", "lang", "digest", "n_tokens", "perplexity", threshold.alias("threshold"), (F.col("perplexity") <= threshold).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, lang, n_tokens, perplexity, threshold, kept.  how: as for judged."""
    return judged(docs, labels, **how).drop("digest")


def drop_low(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rejected rows; columns stay as they are."""
    rejected = judged(docs, labels, id_col, text_col, lang_col).filter(~F.col("kept")).select("doc_id", "digest").distinct()
    return without(docs, materialize(rejected, "kn-rejected"), docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string")))
