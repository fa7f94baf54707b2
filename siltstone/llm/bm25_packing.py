"""Packing by lexical retrieval: BM25 neighbours fill the windows of seed documents.

Documents are encoded once and travel as compressed token ids.  The terms of the index are these
tokens: their document frequencies, the number of documents and their mean length are those of the
whole corpus, in a table that has a row for each token of the vocabulary and does not grow with the data.
Each document is routed by its three weightiest terms that another document has, too; documents are sorted
by these over all files and dealt into shards of about `shard_tokens`, each with an inverted index of its
own, so that neighbours come from any file.  The document at the start of a window is its seed; the
index returns the unused documents of the shard with the highest BM25 scores for the seed's `query_terms`
weightiest terms, `most` at a time, and these are appended until the window is full.  Once they are used, the
index is asked for the next best unused documents by all of the seed's terms, as often as needed.  A
document that overflows is cut there and seeds the next window.  Only when no unused document scores
above zero the shard's next unused document follows.  So every window is full but a shard's last one, which
is cut into sequences whose lengths are powers of two: no token is padding, and none is lost or repeated.

Token ids are those of the given tokenizer file.  For byte-level BPE with its usual pattern, texts are cut before
single spaces and such places, where no pre-token crosses, and each distinct chunk of a run of documents is
encoded once; for any other tokenizer each text is one chunk.

Semantics: a null or empty text is its end id alone.  Repeated rows and ids are packed each.
sequence_id is partition << 32 | number, the same in every attempt of a task.  Ties in scores go
to the document that is first in the shard: by route, id and tokens.  An empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import discard, materialize, prepare

END_ID = 0
#: Bits of a token in a route, and what stands for no token there.
ROUTE_BITS, NO_TERM = 21, (1 << 21) - 1
ENCODED = "doc_id long, ids binary, terms array<int>, docs array<long>, n_docs long, n_tokens long"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Bytes of texts on which both libraries' patterns agree: ASCII and the letters from U+00C0 to U+017F.
_PLAIN = np.isin(np.arange(256), [9, 10, 13, *range(32, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])
_BLANK = np.isin(np.arange(256), [9, 10, 13, 32])


def _byte_of_sign() -> dict[str, int]:
    """The bytes that the signs of a byte-level vocabulary stand for: printing ones for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder:
    """Encodes runs of documents, each distinct chunk once.

    Byte-level BPE whose merges are ranked by their ids goes through tiktoken, which needs a fraction of the
    time; other tokenizers, letters on which Unicode versions might differ, and chunks with special tokens
    through the tokenizers library.  Chunks without white space inside are encoded together, a line each.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.whole = path, None
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        cutter, model = parts["pre_tokenizer"] or {}, parts["model"]
        usual = not parts["normalizer"] and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        usual = usual and (parts["post_processor"] or {"type": "ByteLevel"}).get("type") == "ByteLevel"
        self.special = [t["content"].encode() for t in parts["added_tokens"]]
        #: Whether texts may be cut: the pattern of byte-level BPE and no special token that a cut could divide.
        self.cut = usual and model["type"] == "BPE" and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or b" " in s for t, s in zip(parts["added_tokens"], self.special))
        n = 1 + max([*model["vocab"].values(), *(t["id"] for t in parts["added_tokens"])])
        self.size, self.kind, self.fast = n, np.uint16 if n <= 1 << 16 else np.uint32, None
        if self.cut:
            merged = [model["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in model["merges"]]
            signs = _byte_of_sign()
            if all(a < b for a, b in zip(merged, merged[1:])) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
                ranks = {bytes(signs[c] for c in k): i for k, i in model["vocab"].items() if k.encode() not in self.special}
                pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
                self.fast = tiktoken.Encoding("from " + os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
                self.line = ranks[b"\n"]

    def _slow(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.whole is None:
            os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = "1", "false"
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        out = []
        for a in range(0, len(texts), 5_000):
            out += [np.array(e.ids, self.kind) for e in self.whole.encode_batch_fast([t.decode() for t in texts[a : a + 5_000]], add_special_tokens=False)]
        return out

    def _lines(self, texts: list[bytes], most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without white space inside, and how many each has."""
        flat, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for a in range(0, len(texts), most):
            ids = self.fast.encode_to_numpy(b"\n".join(texts[a : a + most]).decode(), disallowed_special=())
            ends = np.append(np.flatnonzero(ids == self.line), len(ids))
            if len(ends) != len(texts[a : a + most]):
                raise ValueError("a chunk has a line's end inside")
            sizes.append(np.diff(np.append(-1, ends)) - 1)
            flat.append(ids[ids != self.line].astype(self.kind))
        return np.concatenate(flat), np.concatenate(sizes)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents with END_ID after each, and their offsets."""
        full = np.flatnonzero(np.diff(off))
        start, end, coff = K.chunks(data, off) if self.cut else (off[full], off[full + 1], np.searchsorted(full, np.arange(len(off))))
        d = pa.array(K.span_hashes(data, start, end)).dictionary_encode().indices.to_numpy()
        top = np.maximum.accumulate(d) if len(d) else d
        first = np.flatnonzero(np.append(True, top[1:] > top[:-1])) if len(d) else np.zeros(0, np.int64)
        plain, spaced = np.zeros(len(first), bool), np.zeros(len(first), bool)
        if self.fast is not None and len(start):
            # chunks lie end to end
            plain = ~np.logical_or.reduceat(~_PLAIN[data], start)[first]
            blank, spaces = _BLANK[data], data[start] == 32
            blank[start[spaces]] = False
            spaced = np.logical_or.reduceat(blank, start)[first] | (spaces & (end - start == 1))[first]
            del blank
        start, end, raw = start[first], end[first], data.tobytes()
        texts = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
        for token in self.special:
            if token in raw:
                plain &= np.array([token not in t for t in texts])
        del raw
        together = plain & ~spaced
        pool, n = self._lines([t for t, x in zip(texts, together) if x])
        size, where = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        size[together], where[together] = n, np.cumsum(n) - n
        alone = {k: self.fast.encode_to_numpy(texts[k].decode(), disallowed_special=()).astype(self.kind) for k in np.flatnonzero(plain & spaced)}
        rest = np.flatnonzero(~plain)
        alone |= dict(zip(rest, self._slow([texts[k] for k in rest])))
        if alone:
            at, ids = np.fromiter(alone, np.int64), list(alone.values())
            size[at] = [len(x) for x in ids]
            where[at] = len(pool) + np.cumsum(size[at]) - size[at]
            pool = np.concatenate([pool, *ids])
        lens = size[d]
        total = np.append(0, np.cumsum(lens))
        at = np.repeat((where[d] - total[:-1]).astype(np.int32), lens)
        at += np.arange(len(at), dtype=np.int32)
        tokens = pool[at]
        docs = total[coff]
        return np.insert(tokens, docs[1:], END_ID), docs + np.arange(len(docs))


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder of this file; workers live on between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Corpus:
    """Document frequencies by token, the number of documents and their mean length in tokens."""

    def __init__(self, df: np.ndarray, n: int, mean: float):
        self.df, self.n, self.mean = df, n, mean


def gains(tf: np.ndarray, df: np.ndarray, lens: np.ndarray, n: int, mean: float, k1: float = 1.2, b: float = 0.75) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens / max(mean, 1e-9)))


def _terms(tokens: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens but the documents' ends, and the offsets."""
    own = np.ones(len(tokens), bool)
    own[off[1:] - 1] = False
    return tokens[own], off - np.arange(len(off))


def postings(terms: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times), sorted."""
    kind = np.uint32 if len(off) <= 1 << 16 and terms.itemsize == 2 else np.int64
    bits = 16 if kind is np.uint32 else 32
    pair = np.repeat(np.arange(len(off) - 1, dtype=kind) << bits, np.diff(off)) | terms.astype(kind)
    pair.sort()
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    pair, tf = pair[first].astype(np.int64), np.diff(np.append(first, len(pair)))
    return pair >> bits, pair & (1 << bits) - 1, tf


def _encode(path: str, run_bytes: int):
    """(doc_id, text) -> a row per document with its compressed ids, and last a row with the task's document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = encoder_of(path), zstandard.ZstdCompressor(level=1)
        df, docs, total, size = np.zeros(encoder.size, np.int64), 0, 0, 0
        ids, texts = [], []

        def flush() -> pa.RecordBatch:
            nonlocal docs, total, size, ids, texts
            tokens, off = encoder.encode(*K.utf8(pa.chunked_array(texts)))
            df[:] += np.bincount(postings(*_terms(tokens, off))[1], minlength=len(df))
            docs, total = docs + len(off) - 1, total + len(tokens) - len(off) + 1
            raw, wide = tokens.tobytes(), tokens.itemsize
            packed = [press.compress(raw[wide * a : wide * b]) for a, b in zip(off, off[1:])]
            out = _rows({"doc_id": pa.chunked_array(ids).combine_chunks(), "ids": pa.array(packed, pa.binary())}, len(packed))
            ids, texts, size = [], [], 0
            K.release()
            return out

        for batch in batches:
            _, off = K.utf8(batch.column(1))
            for a, b in K.pieces(off, run_bytes // 4):
                ids.append(batch.column(0).slice(a, b - a))
                texts.append(batch.column(1).slice(a, b - a))
                size += int(off[b] - off[a])
                if size >= run_bytes:
                    yield flush()
        if ids:
            yield flush()
        terms = np.flatnonzero(df)
        yield _rows({"terms": pa.array([terms], pa.list_(pa.int32())), "docs": pa.array([df[terms]], pa.list_(pa.int64())), "n_docs": pa.array([docs]), "n_tokens": pa.array([total])}, 1)

    return run


def _rows(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "ids": pa.binary(), "terms": pa.list_(pa.int32()), "docs": pa.list_(pa.int64()), "n_docs": pa.int64(), "n_tokens": pa.int64()}
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, kind)) for c, kind in kinds.items()], list(kinds))


def corpus_of(encoded: DataFrame) -> Corpus:
    """Sums over all tasks; the driver gets a row for each token of the vocabulary at most."""
    sums = encoded.filter("ids is null")
    n, total = sums.agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    counts = sums.select(F.explode(F.arrays_zip("terms", "docs")).alias("x")).groupBy("x.terms").agg(F.sum("x.docs").alias("docs")).toPandas()
    df = np.zeros(int(counts["terms"].max()) + 1 if len(counts) else 1, np.int64)
    df[counts["terms"].to_numpy(np.int64)] = counts["docs"].to_numpy(np.int64)
    return Corpus(df, n or 0, (total or 0) / max(n or 0, 1))


def _ids(column: pa.Array, kind) -> list[np.ndarray]:
    unpress = zstandard.ZstdDecompressor()
    return [np.frombuffer(unpress.decompress(x), kind) for x in column.to_pylist()]


def routes(tokens: np.ndarray, off: np.ndarray, corpus: Corpus) -> np.ndarray:
    """The three weightiest terms of each document that another document has, too; the smaller one first where they tie."""
    terms, off = _terms(tokens, off)
    doc, term, tf = postings(terms, off)
    df = corpus.df[term]
    fine = df > 1
    doc, term, tf, df = doc[fine], term[fine], tf[fine], df[fine]
    gain = gains(tf, df, np.diff(off)[doc], corpus.n, corpus.mean)
    out = np.full((len(off) - 1, 3), NO_TERM, np.int64)
    for place in range(3):
        if not len(doc):
            break
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        top = np.repeat(np.maximum.reduceat(gain, first), np.diff(np.append(first, len(doc))))
        best = np.flatnonzero(gain == top)
        best = best[np.append(True, doc[best[1:]] != doc[best[:-1]])]
        out[doc[best], place] = term[best]
        rest = np.ones(len(doc), bool)
        rest[best] = False
        doc, term, gain = doc[rest], term[rest], gain[rest]
    return out[:, 0] << 2 * ROUTE_BITS | out[:, 1] << ROUTE_BITS | out[:, 2]


def _routes(shared, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids = _ids(batch.column(1), kind)
            off = np.append(0, np.cumsum([len(x) for x in ids]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(routes(np.concatenate(ids), off, shared.value))], ["doc_id", "ids", "route"])
        K.release()

    return run


class Index:
    """BM25 over a shard's documents; terms in one document only lead to no neighbour and are left out.

    frequencies, total, mean: of the whole corpus; without them the shard's own.
    """

    def __init__(self, terms: np.ndarray, off: np.ndarray, frequencies: np.ndarray | None = None, total: int | None = None, mean: float | None = None):
        n, lens = len(off) - 1, np.diff(off)
        doc, term, tf = postings(terms, off)
        width = int(term.max()) + 1 if len(term) else 1
        df = np.bincount(term, minlength=width)
        fine = df[term] > 1
        doc, term, tf = doc[fine], term[fine], tf[fine]
        df = df if frequencies is None else frequencies
        weight = gains(tf, df[term], lens[doc], n if total is None else total, lens.mean() if mean is None else mean)
        self.doc_off = np.searchsorted(doc, np.arange(n + 1))
        self.term, self.gain = term, weight
        order = np.argsort(term, kind="stable")
        self.posted, self.weight = doc[order], weight[order]
        self.post_off = np.searchsorted(term[order], np.arange(width + 1))
        self.n = n

    def neighbours(self, seed: int, used: np.ndarray, query_terms: int, most: int) -> np.ndarray:
        a, b = self.doc_off[seed], self.doc_off[seed + 1]
        terms = self.term[a:b]
        if query_terms and b - a > query_terms:
            terms = terms[np.argpartition(-self.gain[a:b], query_terms)[:query_terms]]
        spans = [(self.post_off[t], self.post_off[t + 1]) for t in terms]
        if not spans:
            return terms
        score = np.bincount(np.concatenate([self.posted[x:y] for x, y in spans]), np.concatenate([self.weight[x:y] for x, y in spans]), self.n)
        score[used] = 0
        best = np.argpartition(-score, most)[:most] if len(score) > most else np.arange(len(score))
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))]


def order_documents(sizes: np.ndarray, index: Index, window: int, query_terms: int, most: int) -> list[int]:
    """The order in which documents are laid end to end; terms: how many of the seed's the next question has, 0 for all, -1 for no question."""
    n, used, order, cursor, at = len(sizes), np.zeros(len(sizes), bool), [], 0, 0
    queue: list[int] = []
    seed, terms = -1, -1
    while len(order) < n:
        while queue and used[queue[0]]:
            queue.pop(0)
        while not queue and terms >= 0:
            queue = [int(x) for x in index.neighbours(seed, used, terms, most)]
            terms = 0 if queue or terms > 0 else -1
        if queue:
            doc = queue.pop(0)
        else:
            while used[cursor]:
                cursor += 1
            doc = cursor
        used[doc] = True
        order.append(doc)
        before, at = at // window, at + int(sizes[doc])
        if at // window > before or len(order) == 1 or seed < 0:
            seed, queue, terms = doc, [], query_terms
            if at % window == 0:
                seed, terms = -1, -1
    return order


def cuts(total: int, window: int) -> np.ndarray:
    """Ends of the sequences of a shard: full windows, then powers of two."""
    ends = list(range(window, total + 1, window))
    at, rest = (ends[-1] if ends else 0), total % window
    for power in range(window.bit_length(), -1, -1):
        if rest >> power & 1:
            at += 1 << power
            ends.append(at)
    return np.array(ends, np.int64)


def pack_shard(ids: pa.Array, tokens: np.ndarray, off: np.ndarray, corpus: Corpus, window: int, query_terms: int, most: int, base: int) -> tuple[pa.RecordBatch, int]:
    sizes = np.diff(off)
    index = Index(*_terms(tokens, off), corpus.df, corpus.n, corpus.mean)
    order = np.array(order_documents(sizes, index, window, query_terms, most), np.int64)
    laid = np.append(0, np.cumsum(sizes[order]))
    ends = cuts(int(laid[-1]), window)
    bounds = np.union1d(laid, ends)
    a, b = bounds[:-1], bounds[1:]
    which = np.searchsorted(laid, a, "right") - 1
    doc = order[which]
    start = a - laid[which]
    sequence = np.searchsorted(ends, a, "right")
    begins = np.append(0, ends[:-1])
    raw = memoryview(np.ascontiguousarray(tokens.astype("<u4"))).cast("B")
    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(off[doc] + start, off[doc] + start + b - a)]
    columns = [ids.take(pa.array(doc)), pa.array(start), pa.array(b - a), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(base + sequence), pa.array(a - begins[sequence])]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")]), len(ends)


def _pack(shared, kind, window: int, shard_tokens: int, query_terms: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, names, held, size = TaskContext.get().partitionId() << 32, [], [], 0

        def flush():
            nonlocal base, names, held, size
            off = np.append(0, np.cumsum([len(x) for x in held]))
            out, n = pack_shard(pa.concat_arrays(names), np.concatenate(held), off, shared.value, window, query_terms, most, base)
            base, names, held, size = base + n, [], [], 0
            K.release()
            return out

        for batch in batches:
            for k, ids in enumerate(_ids(batch.column(1), kind)):
                names.append(batch.column(0).slice(k, 1))
                held.append(ids)
                size += len(ids)
                if size >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, shard_tokens: int = 2_500_000, query_terms: int = 12, most: int = 16, run_bytes: int = 4_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    prepare(spark)
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    kind = encoder_of(str(tokenizer_path)).kind
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    encoded = materialize(rows.mapInArrow(_encode(str(tokenizer_path), run_bytes), ENCODED), "bm25-encoded")
    shared = spark.sparkContext.broadcast(corpus_of(encoded))
    routed = encoded.filter("ids is not null").select("doc_id", "ids").mapInArrow(_routes(shared, kind), "doc_id long, ids binary, route long")
    routed = materialize(routed.withColumn("digest", F.xxhash64("ids")), "bm25-routed")
    discard(encoded)
    # ids and digests let a route of many documents go to several tasks
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = routed.repartitionByRange(shards, "route", "doc_id", "digest").sortWithinPartitions("route", "doc_id", "digest").select("doc_id", "ids")
    return dealt.mapInArrow(_pack(shared, kind, window, shard_tokens, query_terms, most), SCHEMA)
