"""Katz back-off language model over whole corpora, scored per document.

Counts never leave packed tables.  Documents are cut into blocks; a block keeps its tokens as
indexes into its own sorted list of n-grams, and for each order exchanges with hash-partitioned
tables: it sends its distinct n-grams with their training counts (sorted 64-bit keys, compressed)
to the partitions of the key, which add up the counts of all blocks and send back, in the same
order, the total and whether this block speaks for the n-gram (the first block that holds it).
Each n-gram has one speaker, so the sums that back-off weights need are complete and free of
repeats.  Rows on the wire are one per block and partition; a hot n-gram is one entry per block.

Model of order n.  A count r up to `gt_cut` is discounted by Good-Turing, r* = (r+1) N_{r+1}/N_r,
in Katz's form d_r = (r*/r - a)/(1 - a), a = (k+1) N_{k+1}/N_1, where that is between 0 and 1;
otherwise d_r = 1 - 1/(2 (r + 1)).  P(w|h) = d_r c(hw)/c(h) if hw was seen, else
alpha(h) P(w|h'), and alpha(h) = (1 - sum P*(w|h)) / (1 - sum P(w|h')), both sums over the w seen
after h, so each context's probabilities add up to one exactly.  A context not seen backs off
with weight one.  Order 1 is discounted likewise and what is left goes to the one unknown word
class, whose probability each unknown token gets; if nothing is left, it gets 0.5 / (N + 1).

Semantics: tokens are the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, then one end token;
a null or empty text has the end alone.  The first token's context is the document's start.  Rows
whose crc32(doc_id as text) mod 5 is `held_out` are not learned from; a null id is not held out.
Rows that repeat are scored and counted each.  With no training rows every token is unknown.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize, prepare, remainder, scratch_path

U64 = np.uint64
END, START = U64(0x2545F4914F6CDD1D), U64(0x6C62272E07BB0142)
BLOCK_TOKENS = 1_000_000


def pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed; falling arrays of keys should be differenced first."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T if len(a) else np.zeros((0, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=1 << 31), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype) if len(raw) else np.zeros(0, dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, U64), dtype=U64)


def join_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of the n-gram that extends a context by a word."""
    return K.fmix(context * U64(0x9E3779B97F4A7C15) + word)


BLOCKS = "block long, doc_ids binary, null_ids binary, train binary, lens binary, vocabulary binary, at binary"


def _blocks(tokens: int):
    """(doc_id, train, text) -> one row per block; words are hashes, documents end with END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            ids, nulls, train, lens, hashes = (np.concatenate(x) for x in zip(*held))
            vocabulary, at = np.unique(hashes, return_inverse=True)
            row = [pack(ids), pack(nulls), pack(train), pack(lens), pack_keys(vocabulary), pack(at.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) | number]), *(pa.array([x], pa.binary()) for x in row)], NAMES[BLOCKS])

        for batch in batches:
            ids = batch.column(0)
            data, off = K.utf8(batch.column(2))
            for a, b in K.pieces(off):
                h, woff = K.word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
                lens = np.diff(woff) + 1
                hashes = np.insert(h, woff[1:], END)
                here = ids.slice(a, b - a)
                held.append((here.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), here.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.uint8), lens.astype(np.uint32), hashes))
                size += len(hashes)
                if size >= tokens:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return run


class Block:
    """A block's tokens as indexes into its sorted vocabulary."""

    def __init__(self, row):
        self.ids, self.nulls = unpack(row["doc_ids"], np.int64), unpack(row["null_ids"], np.uint8)
        self.train, self.lens = unpack(row["train"], np.uint8), unpack(row["lens"], np.uint32).astype(np.int64)
        self.vocabulary = unpack_keys(row["vocabulary"])
        self.at = unpack(row["at"], np.uint32).astype(np.int64)
        self.first = np.cumsum(self.lens) - self.lens
        self.learn = np.repeat(self.train, self.lens).astype(bool)

    def contexts(self, order: int) -> np.ndarray:
        """Key of the order-1 tokens before each token."""
        words = self.vocabulary[self.at]
        key = np.zeros(len(words), U64)
        for back in range(order - 1, 0, -1):
            key = join_hash(key, self.shifted(words, back, START))
        return key

    def shifted(self, values: np.ndarray, back: int, fill) -> np.ndarray:
        out = np.empty_like(values)
        out[back:], out[:back] = values[:-back], fill
        for k in range(back):
            at = self.first + k
            out[at[self.lens > k]] = fill
        return out

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct n-gram keys, and each token's place among them."""
        if order == 1:
            return self.vocabulary, self.at
        keys = join_hash(self.contexts(order), self.vocabulary[self.at]) >> U64(64 - KEY_BITS)
        return np.unique(keys, return_inverse=True)


#: Keys of n-grams longer than one word keep this many bits.
KEY_BITS = 56
WIRE = "shard int, block long, keys binary, counts binary, kept binary, low binary"
ANSWER = "kind string, shard int, block long, counts binary, extra binary, histogram array<long>"
NAMES = {s: [f.split()[0] for f in s.split(", ")] for s in (BLOCKS, WIRE, ANSWER)}


def _requests(block: int, keys: np.ndarray, bits: int, shards: int, *values: np.ndarray) -> pd.DataFrame:
    """Sorted keys of so many bits and their values, cut into the key ranges of the shards."""
    step = 2**bits // shards
    cuts = [0, *np.searchsorted(keys, np.array([step * s for s in range(1, shards)], U64)), len(keys)]
    rows = [(s, block, pack_keys(keys[a:b]), *(pack(v[a:b]) for v in values)) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    return pd.DataFrame([r + (b"",) * (6 - len(r)) for r in rows], columns=NAMES[WIRE])


def _send_grams(order: int, shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.to_dict("records"):
                block = Block(row)
                keys, at = block.grams(order)
                yield _requests(row["block"], keys, 64 if order == 1 else KEY_BITS, shards, np.bincount(at[block.learn], minlength=len(keys)).astype(np.uint32))

    return run


def _merge(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    each = [unpack_keys(b) for b in rows["keys"]]
    distinct, first, at = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
    counts = np.concatenate([unpack(b, np.uint32) for b in rows["counts"]])
    total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    return each, first, at, total


def _answer_grams(order: int, cut: int):
    """All requests of a shard -> an answer per block; the first carries N, V and N_1 .. N_{cut+1}."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        each, first, at, total = _merge(rows)
        speaks = np.zeros(len(at), np.uint8)
        speaks[first] = 1
        small = np.bincount(np.minimum(total, cut + 2), minlength=cut + 3)
        histogram = [int(total.sum()), int((total > 0).sum()), *map(int, small[1 : cut + 2])]
        out, b = [], 0
        for k, block in enumerate(rows["block"]):
            a, b = b, b + len(each[k])
            out.append((f"g{order}", rows["shard"].iloc[0], block, pack(total[at[a:b]]), pack(speaks[a:b]), [] if k else histogram))
        return pd.DataFrame(out, columns=NAMES[ANSWER])

    return run


def _answer_contexts(order: int):
    """Totals and back-off weights of the contexts of a shard."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        each, _, at, total = _merge(rows)
        kept, low = (np.bincount(at, weights=np.concatenate([unpack(b, np.float64) for b in rows[c]]), minlength=len(total)) for c in ("kept", "low"))
        divisor = np.where(kept >= total * (1 - 1e-12), total + 1, total)
        alpha = np.where(total > 0, (1 - kept / np.maximum(divisor, 1)) / np.maximum(1 - low, 1e-300), 1.0)
        out, b = [], 0
        for k, block in enumerate(rows["block"]):
            a, b = b, b + len(each[k])
            out.append((f"c{order}", rows["shard"].iloc[0], block, pack(np.where(total > 0, divisor, 0)[at[a:b]]), pack(alpha[at[a:b]]), []))
        return pd.DataFrame(out, columns=NAMES[ANSWER])

    return run


def discounts(histogram: list[int], cut: int) -> np.ndarray:
    """d_r for r = 0..cut; larger counts are not discounted.  histogram: N_1 .. N_{cut+1}."""
    n = [0, *histogram]
    d = np.ones(cut + 1)
    common = (cut + 1) * n[cut + 1] / n[1] if n[1] else 1.0
    for r in range(1, cut + 1):
        turing = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        value = (turing - common) / (1 - common) if common < 1 else 0.0
        d[r] = value if 0 < value < 1 else 1 - 1 / (2 * (r + 1))
    return d


class Order:
    """Training totals of one order: N, V, discounts, and the mass of the unknown word (order 1)."""

    def __init__(self, total: int, distinct: int, histogram: list[int], cut: int):
        self.total, self.distinct, self.d = total, distinct, discounts(histogram, cut)
        r = np.arange(1, cut + 1)
        lost = float((np.array(histogram[:cut]) * r * (1 - self.d[1:])).sum())
        self.divisor = max(total if lost > 0 else total + 1, 1)
        self.unknown = lost / self.divisor if lost > 0 else 1 / self.divisor

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * np.where(counts < len(self.d), self.d[np.minimum(counts, len(self.d) - 1)], 1.0)


def _order(answers: DataFrame, cut: int) -> Order:
    row = answers.filter(F.size("histogram") > 0).agg(*(F.sum(F.col("histogram")[i]).alias(f"h{i}") for i in range(cut + 3))).first()
    row = [x or 0 for x in row]
    return Order(row[0], row[1], row[2:], cut)


class Model:
    """A block together with the answers it got: probabilities by recursion over the orders."""

    def __init__(self, block: Block, answers: pd.DataFrame, orders: list[Order]):
        self.block, self.orders, self.got = block, orders, {}
        for kind, rows in answers.groupby("kind"):
            rows = rows.sort_values("shard")
            self.got[kind] = [np.concatenate([unpack(b, kind_of) for b in rows[c]]) for c, kind_of in (("counts", np.int64), ("extra", np.uint8 if kind[0] == "g" else np.float64))]
        self.places = {n: block.grams(n)[1] for n in range(1, len(orders) + 1)}

    def p(self, n: int) -> np.ndarray:
        """P(token | n - 1 tokens before it) of each token."""
        counts = self.got[f"g{n}"][0][self.places[n]]
        order = self.orders[n - 1]
        kept = order.kept(counts)
        if n == 1:
            return np.where(counts > 0, kept / order.divisor, order.unknown)
        total, alpha = (x[np.unique(self.block.contexts(n), return_inverse=True)[1]] for x in self.got[f"c{n}"])
        return np.where(counts > 0, kept / np.maximum(total, 1), np.where(total > 0, alpha, 1.0) * self.p(n - 1))

    def context_sums(self, n: int) -> tuple[np.ndarray, ...]:
        """Sorted contexts of order n, training counts, and this block's shares of the two sums."""
        contexts, at = np.unique(self.block.contexts(n), return_inverse=True)
        counts, speaks = self.got[f"g{n}"]
        once = np.full(len(counts), -1)
        once[self.places[n]] = np.arange(len(at))
        once = once[(speaks == 1) & (counts > 0)]
        kept = self.orders[n - 1].kept(counts[self.places[n][once]])
        sums = (np.bincount(at[once], weights=w, minlength=len(contexts)) for w in (kept, self.p(n - 1)[once]))
        return contexts, np.bincount(at[self.block.learn], minlength=len(contexts)).astype(np.uint32), *sums


def _send_contexts(order: int, shards: int, orders: list[Order]):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_requests(row["block"], *(lambda c: (c[0], 64, shards, *c[1:]))(Model(Block(row), answers, orders).context_sums(order))) for row in blocks.to_dict("records")])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(orders: list[Order]):
    n = len(orders)

    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.to_dict("records"):
            block = Block(row)
            model = Model(block, answers, orders)
            counts = model.got["g1"][0][model.places[1]]
            base = np.log10((counts + 0.5) / (orders[0].total + 0.5 * (orders[0].distinct + 1)))
            sums = [np.add.reduceat(x, block.first) for x in ((counts > 0).astype(np.int64), base, np.log10(model.p(n)))]
            ids = pd.array(block.ids, dtype="Int64")
            ids[block.nulls == 1] = pd.NA
            out.append(pd.DataFrame({"doc_id": ids, "held_out": block.train == 0, "n_tokens": block.lens, "n_known": sums[0], "train_tokens": orders[0].total, "base_score": sums[1], "score": sums[2]}))
        return pd.concat(out)

    return run


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, held_out: int = 1, gt_cut: int = 5, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    prepare(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), ~(F.coalesce(remainder(docs[id_col]), F.lit(-1)) == held_out), docs[text_col].cast("string"))
    path, name = scratch_path(spark, "katz-blocks"), f"katz_blocks_{uuid.uuid4().hex}"
    rows.mapInArrow(_blocks(block_tokens), BLOCKS).write.bucketBy(shards, "block").option("path", path).saveAsTable(name)
    blocks, answers, orders = spark.table(name), None, []
    # a shard for each block at least, so that shards hold about as much as blocks, however many there are
    shards = max(shards, blocks.count())
    try:
        for n in range(1, order + 1):
            sent = blocks.mapInPandas(_send_grams(n, shards), WIRE)
            got = materialize(sent.groupBy("shard").applyInPandas(_answer_grams(n, gt_cut), ANSWER), f"katz-g{n}")
            orders.append(_order(got, gt_cut))
            answers = got if answers is None else answers.union(got)
            if n > 1:
                sent = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_send_contexts(n, shards, orders), WIRE)
                answers = answers.union(materialize(sent.groupBy("shard").applyInPandas(_answer_contexts(n), ANSWER), f"katz-c{n}"))
        scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score(orders), SCORES)
        return materialize(scored, "katz-scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
