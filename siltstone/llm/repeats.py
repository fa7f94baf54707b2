"""Passages that repeat across a corpus, by the common-prefix intervals of an enhanced suffix array.

A repeat is a string of `length` bytes that starts in more than one place, of any documents or of the same.

* anchors: of each window of `length` bytes the grams of `gram` bytes are compared by a hash, and the least one's
  place is the window's anchor.  Equal windows have their anchor at the same offset, so that only suffixes that start at
  anchors, about one byte in 70, need be sorted.  An anchor's context, `length - gram` bytes before it and `length`
  after it, holds all windows that it stands for.  Equal contexts are one class; classes are counted for each
  gram, and grams that occur once go.
* suffix array: the contexts of the other classes, one representative each, are dealt by their gram and sorted by
  what follows the anchor.  A scan with a stack over the lengths of common prefixes of neighbours gives the tree
  of common-prefix intervals.  In each interval the members are ordered by what stands before the anchor; where they
  agree on so much of it that both sides make `length` bytes, and are not all in one narrower interval, they are a
  maximal repeat: their left extensions differ, and so do their right ones.  All its members are its occurrences.
* grams with more than `group_rows` classes are not sorted in one task: their windows themselves are counted,
  each by two 64-bit hashes, in partial aggregates; this is exact too and gives the same bytes.
* every occurrence gets the widest left and right extension of its repeats; the bytes between are removed.

Texts stay where they were scanned, as compressed blocks in a table bucketed by block; anchors are found again
where they are needed, and only hashes and contexts move.  Documents are read in tiles, so that long ones need no more
memory than their own text.  Classes are told apart by 128 bits of two hashes, grams by 64; beyond the gram the
bytes themselves are compared.

Semantics: texts are their UTF-8 bytes; a null text is empty.  Rows are documents of their own, also where they
repeat an id or have none: copies of a text of `length` bytes or more go whole, the first one too.  Matches never cross
documents.  Empty tables give an empty result.  Other columns are never looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .common import discard, materialize, prepare, scratch_path

U64 = np.uint64
BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("text", pa.binary())])
CLASS = pa.schema([("fp", pa.int64()), ("cls", pa.int64()), ("block", pa.int64()), ("place", pa.int32())])
CONTEXT = pa.schema([("fp", pa.int64()), ("cls", pa.int64()), ("before", pa.binary()), ("after", pa.binary())])
COVER = pa.schema([("fp", pa.int64()), ("cls", pa.int64()), ("left", pa.int32()), ("right", pa.int32())])
WINDOW = pa.schema([("fp", pa.int64()), ("cls", pa.int64()), ("at", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())])
#: Bytes of a tile of a document.
TILE = 1_000_000


def sql(schema: pa.Schema) -> str:
    names = {"int64": "long", "int32": "int", "binary": "binary", "string": "string"}
    return ", ".join(f"{f.name} array<long>" if pa.types.is_list(f.type) else f"{f.name} {names[str(f.type)]}" for f in schema)


class Anchors:
    """Anchors of a piece of text: place, hash of gram, hash of context, and the context's bytes before and after the place."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int, gram: int, first: int = 0, last: int | None = None):
        """first, last: windows that start before or from there on are left out."""
        n, w = len(data), length - gram + 1
        self.at = np.zeros(0, np.int64)
        self.fp = self.cls = np.zeros(0, U64)
        self.left = self.right = self.at
        if n < length:
            return
        total = np.zeros(n + 1, U64)
        np.cumsum(K.BYTE_CODE[data] * K.powers(n), out=total[1:])
        hashes = (total[gram:] - total[:-gram]) * K._negative(slice(0, n - gram + 1), n + 1)
        least = hashes ^ (hashes >> U64(32))
        least *= U64(0xFF51AFD7ED558CCD)
        least &= U64(0xFFFFFFFF00000000)
        least |= np.arange(len(least), dtype=U64)  # the first of equal ones
        size = 1
        while size * 2 <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: n - length + 1], least[w - size :])
        edge = np.zeros(n - length + 2, np.int8)
        long = np.flatnonzero(np.diff(off) >= length)
        edge[off[long]] += 1
        edge[off[long + 1] - length + 1] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        inside[:first] = False
        if last is not None:
            inside[last:] = False
        at = (least[inside] & U64(0xFFFFFFFF)).astype(np.int64)
        self.at = at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
        doc = np.searchsorted(off, at, "right") - 1
        low, high = np.maximum(off[doc], at - (length - gram)), np.minimum(off[doc + 1], at + length)
        self.left, self.right = at - low, high - at
        self.fp = K.fmix(hashes[at])
        context = (total[high] - total[low]) * K._negative(low, n + 1)
        self.cls = K.fmix(context ^ K.fmix((self.left << 32 | self.right).astype(U64)))


def tiles(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, Anchors]]:
    """(where it begins, its bytes, its anchors) of each piece of documents or tile of a long one; no place comes twice."""
    side = length - gram
    for a, b in K.pieces(off, TILE):
        start, end = int(off[a]), int(off[b])
        if end - start <= 2 * TILE:
            yield start, data[start:end], Anchors(data[start:end], off[a : b + 1] - start, length, gram)
            continue
        before = -1
        for t in range(start, end - length + 1, TILE):
            low, high = max(start, t - side), min(end, t + TILE + side + length)
            x = Anchors(data[low:high], np.array([0, high - low]), length, gram, t - low, t + TILE - low)
            if len(x.at) and low + x.at[0] == before:  # the last one of the tile before
                x.at, x.fp, x.cls, x.left, x.right = x.at[1:], x.fp[1:], x.cls[1:], x.left[1:], x.right[1:]
            before = low + int(x.at[-1]) if len(x.at) else before
            yield low, data[low:high], x


def same(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by all columns, and where in it each different row begins."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, lens, texts, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            text = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_pylist([{"block": part << 24 | number, "ids": ids, "lens": lens, "text": text}], schema=BLOCK)

        for batch in batches:
            data, off = K.utf8(batch.column(1))
            for a, b in K.pieces(off, block_bytes):
                ids += batch.column(0)[a:b].to_pylist()
                lens += np.diff(off[a : b + 1]).tolist()
                texts.append(data[off[a] : off[b]].tobytes())
                size += int(off[b] - off[a]) + b - a
                if size >= block_bytes:
                    yield row()
                    number, ids, lens, texts, size = number + 1, [], [], [], 0
                    K.release()
        if ids:
            yield row()

    return run


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Each row of blocks, its bytes and its documents' offsets."""
    for k in range(batch.num_rows):
        row = batch.slice(k, 1)
        lens = row.column("lens").flatten().to_numpy()
        off = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=off[1:])
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.column("text")[0].as_buffer()), np.uint8)
        yield row, data, off
        K.release()


def _joined(found: list[Anchors], column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(getattr(x, column) for x in found)])


def numbered(found: list[Anchors]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of a block's anchors by (fp, cls), where in it each class begins, and the class number of each anchor in its own order."""
    order, new = same(_joined(found, "fp", U64), _joined(found, "cls", U64))
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    return order, new, number


def _classes(length: int, gram: int):
    """Blocks -> (fp, cls, block, place): the different contexts of a block; place is twice the class' number in the block, and 1 more if the block has it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, off in _opened(batch):
                found = [x for _, _, x in tiles(data, off, length, gram)]
                order, new, _ = numbered(found)
                first, again = order[new], np.diff(np.append(new, len(order))) > 1
                hashes = [pa.array(_joined(found, c, U64)[first].view(np.int64)) for c in ("fp", "cls")]
                yield pa.RecordBatch.from_arrays([*hashes, pa.array(np.full(len(new), row.column("block")[0].as_py())), pa.array(2 * np.arange(len(new)) + again, pa.int32())], schema=CLASS)

    return run


def _asked(row: pa.RecordBatch) -> list[np.ndarray]:
    """The columns of a row's array of structs."""
    flat = row.column("asked").flatten()
    return [flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)]


def _contexts(length: int, gram: int):
    """Blocks with asked array<struct(place, fp, cls)> -> the contexts' bytes but for the gram; what stands before is reversed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, off in _opened(batch):
                place, fp, cls = _asked(row)
                pieces = list(tiles(data, off, length, gram))
                order, new, _ = numbered([x for _, _, x in pieces])
                wanted = order[new[place // 2]]  # the first anchor of each class asked for
                at = np.concatenate([np.zeros(0, np.int64), *(low + x.at for low, _, x in pieces)])[wanted]
                left, right = (_joined([x for _, _, x in pieces], c, np.int64)[wanted] for c in ("left", "right"))
                before = [data[p - l : p][::-1].tobytes() for p, l in zip(at, left)]
                after = [data[p + gram : p + r].tobytes() for p, r in zip(at, right)]
                for a in range(0, len(at), 10_000):
                    b = a + 10_000
                    yield pa.RecordBatch.from_arrays([pa.array(fp[a:b]), pa.array(cls[a:b]), pa.array(before[a:b], pa.binary()), pa.array(after[a:b], pa.binary())], schema=CONTEXT)

    return run


def padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the strings, filled up with zeros, and their lengths."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lens = np.diff(off)
    out = np.zeros((len(column), width), np.uint8)
    inside = np.arange(width) < lens[:, None]
    out[inside] = raw[off[0] : off[-1]]
    return out, lens


def common(rows: np.ndarray, lens: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the row before it; -1 at the beginning of a group."""
    out = np.full(len(rows), -1, np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[1:] = np.where(group[1:] == group[:-1], np.minimum(first, np.minimum(lens[1:], lens[:-1])), -1)
    return out


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of the common-prefix intervals of value `least` or more, inner ones first; lcp[i] is that of i - 1 and i, lcp[0] is not used."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now, first = lcp[i] if i < len(lcp) else -1, i - 1
        while stack and stack[-1][0] > now:
            value, first = stack.pop()
            yield value, first, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def gaps(lcs: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The common prefix of each two successive ranks of an order: the least of those between."""
    return np.minimum.reduceat(lcs[: ranks[-1] + 1], ranks[:-1] + 1) if len(ranks) > 1 else np.zeros(0, np.int64)


def maximal(lcp: np.ndarray, lcs: np.ndarray, rank: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(left, right, members) of the maximal repeats among contexts with one gram, in the order of what follows the anchor.

    lcp: of what follows, in this order; rank: each one's place in the order of what stands before; lcs: of that, in that order.
    """
    for right, first, last in intervals(lcp.tolist(), gram):
        here = rank[first : last + 1]
        order = np.argsort(here)
        near = gaps(lcs, here[order])
        for left, a, b in intervals([-1, *near.tolist()], length - right):
            members = first + order[a : b + 1]
            if lcp[members.min() + 1 : members.max() + 1].min() == right:  # else a narrower interval has them all
                yield left, right, members


def _repeats(batch: pa.Table | pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, left, right) of the repeats of contexts sorted by (fp, after), whole groups of fp: first pairs, then larger groups."""
    fp = batch.column("fp").to_numpy()
    after, after_len = padded(batch.column("after"), length - gram)
    before, before_len = padded(batch.column("before"), length - gram)
    group = np.append(0, np.cumsum(fp[1:] != fp[:-1]))
    lcp = common(after, after_len, group)
    lcp = np.where(lcp < 0, lcp, lcp + gram)  # all have the gram itself
    order = np.lexsort((before_len, before.view(f"S{length - gram}").ravel(), group))
    lcs = common(before[order], before_len[order], group[order])
    rank = np.empty(len(fp), np.int64)
    rank[order] = np.arange(len(fp))
    begin = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
    size = np.diff(np.append(begin, len(fp)))
    pair = begin[size == 2]
    left, right = lcs[pair + 1], lcp[pair + 1]
    whole = (left + right >= length) & (right >= gram)
    for k in (0, 1):
        yield pair[whole] + k, left[whole], right[whole]
    for a, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
        for left_, right_, members in maximal(lcp[a : a + n], lcs[a : a + n], rank[a : a + n] - a, length, gram):
            yield a + members, np.full(len(members), left_), np.full(len(members), right_)


def _widest(length: int, gram: int):
    """Contexts sorted by (fp, after) -> each one's widest extensions in maximal repeats; groups are never cut."""

    def widest(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        batch = table.to_batches()[0]
        left, right = np.full(len(batch), -1), np.full(len(batch), -1)
        for rows, l, r in _repeats(batch, length, gram):
            left[rows], right[rows] = np.maximum(left[rows], l), np.maximum(right[rows], r)
        some = pa.array(np.flatnonzero(left >= 0))
        K.release()
        return pa.RecordBatch.from_arrays([batch.column("fp").take(some), batch.column("cls").take(some), pa.array(left, pa.int32()).take(some), pa.array(right, pa.int32()).take(some)], schema=COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.select(["fp", "cls", "before", "after"])
            fp = batch.column("fp").to_numpy()
            last = int(np.flatnonzero(fp == fp[-1])[0])  # rows of one fp stand together
            if last == 0 and held and held[-1].column("fp")[-1].as_py() == fp[0]:
                held.append(batch)
                continue
            if last or held:
                yield widest(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield widest(pa.Table.from_batches(held))

    return run


def _windows(length: int, gram: int):
    """Contexts -> all their windows less the gram, each by its offset before the anchor and two hashes."""
    side = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                some = batch.slice(a, 500)
                before, before_len = padded(some.column("before"), side)
                after, after_len = padded(some.column("after"), side)
                text = np.concatenate([before[:, ::-1], after], axis=1)
                offsets = np.arange(side, -1, -1)  # so that windows begin in order
                row, k = np.nonzero((offsets <= before_len[:, None]) & (side - offsets <= after_len[:, None]))
                start, flat = row * text.shape[1] + k, text.ravel()
                hashes = [K.span_hashes(x, start, start + side) for x in (flat, 255 - flat)]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([some.column("fp").take(rows), some.column("cls").take(rows), pa.array(offsets[k], pa.int32()), *(pa.array(h.view(np.int64)) for h in hashes)], schema=WINDOW)

    return run


def _cut(length: int, gram: int, texts: bool):
    """Blocks with asked array<struct(place, left, right)>, or null -> a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, off in _opened(batch):
                mark = np.zeros(len(data) + 1, np.int32)
                if row.column("asked").null_count == 0:
                    place, left, right = _asked(row)
                    pieces = list(tiles(data, off, length, gram))
                    _, new, number = numbered([x for _, _, x in pieces])
                    wide = np.full((2, len(new)), -length)
                    wide[:, place // 2] = left, right
                    at = np.concatenate([low + x.at for low, _, x in pieces])
                    own = [_joined([x for _, _, x in pieces], c, np.int64) for c in ("left", "right")]
                    l, r = (np.minimum(w[number], o) for w, o in zip(wide, own))
                    hit = l + r >= length
                    np.add.at(mark, (at - l)[hit], 1)
                    np.add.at(mark, (at + r)[hit], -1)
                gone = np.cumsum(mark[:-1]) > 0
                edge = np.zeros(len(data) + 1, bool)
                edge[off] = True
                begins = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1])))
                ends = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], False))) + 1
                spans, removed = np.searchsorted(begins, off), np.append(0, np.cumsum(gone))[off]
                kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(off, off[1:])]
                base = np.repeat(off[:-1], np.diff(spans))
                listed = lambda x: pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.array(x - base))
                yield pa.RecordBatch.from_arrays(
                    [row.column("ids").flatten(), pa.array(np.diff(off)), pa.array(np.diff(removed)), pa.array(np.diff(spans)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                     listed(begins), listed(ends), pa.array(kept if texts else [None] * len(kept), pa.binary())], schema=CUT)

    return run


def repeated(classes: DataFrame) -> DataFrame:
    """Rows of grams that occur more than once: fp, cls, block, place, first of its class, again (there is more of the class), kinds of the gram.

    classes is dealt by fp, so that counting and joining need no shuffle.  One order serves all windows: of a gram's rows
    those of a class stand together.
    """
    more = classes.groupBy(F.col("fp").alias("more")).agg(F.sum(1 + F.col("place") % 2).alias("total")).filter("total > 1")
    classes = classes.join(more.hint("shuffle_hash"), F.col("fp") == F.col("more"), "left_semi")
    order = W.partitionBy("fp").orderBy("cls", "block")
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before, after = F.coalesce(F.lag("cls").over(order) == F.col("cls"), F.lit(False)), F.coalesce(F.lead("cls").over(order) == F.col("cls"), F.lit(False))
    rows = classes.select("fp", "cls", "block", "place", (~before).alias("first"), (before | after | (F.col("place") % 2 == 1)).alias("again"))
    return rows.withColumn("kinds", F.sum(F.col("first").cast("long")).over(every))


def cover_by_tree(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """(fp, cls, left, right) of the classes that share `length` bytes with another of their gram."""
    return contexts.repartition("fp").sortWithinPartitions("fp", "after").mapInArrow(_widest(length, gram), sql(COVER))


def cover_by_windows(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for any number of classes of a gram: each window is a row, and equal ones are counted."""
    windows, key = materialize(contexts.mapInArrow(_windows(length, gram), sql(WINDOW)), "rep-windows"), ["fp", "at", "h1", "h2"]
    shared = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    return windows.join(shared, key, "left_semi").groupBy("fp", "cls").agg(F.max("at").alias("left"), (length - F.min("at")).cast("int").alias("right"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 64, group_rows: int = 32_768, block_bytes: int = 1_000_000, texts: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts and ends of what is removed, and, with texts, the bytes kept."""
    if not 0 < gram < length:
        raise ValueError("a gram must be shorter than a repeat")
    spark = docs.sparkSession
    prepare(spark)
    buckets, names = int(spark.conf.get("spark.sql.shuffle.partitions")), []

    def bucketed(rows: DataFrame, key: str) -> DataFrame:
        names.append(f"rep_{key}_{uuid.uuid4().hex}")
        rows.write.bucketBy(buckets, key).option("path", scratch_path(spark, f"rep-{key}")).saveAsTable(names[-1])
        return spark.table(names[-1])

    try:
        rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(_blocks(block_bytes), sql(BLOCK))
        blocks = bucketed(rows, "block")
        every = bucketed(blocks.mapInArrow(_classes(length, gram), sql(CLASS)).repartition(buckets, "fp"), "fp")
        classes = bucketed(repeated(every), "fp")
        discard(every)
        asked = lambda rows, *cols: rows.groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct(*cols)).alias("asked"))

        def contexts(rows: DataFrame) -> DataFrame:
            ask = asked(rows, "place", "fp", "cls")
            return blocks.join(ask, F.col("block") == F.col("of")).select("block", "lens", "text", "asked").mapInArrow(_contexts(length, gram), sql(CONTEXT))

        reps = classes.filter("first and kinds > 1")
        wide, many = cover_by_tree(contexts(reps.filter(F.col("kinds") <= group_rows)), length, gram), reps.filter(F.col("kinds") > group_rows)
        if not many.isEmpty():
            wide = wide.unionByName(cover_by_windows(contexts(many), length, gram))
        # a context that occurs again is removed as far as it reaches
        cover = classes.join(wide, ["fp", "cls"], "left").filter("again or left is not null")
        cover = cover.select("block", "place", *(F.when(F.col("again"), length).otherwise(F.col(c)).cast("int").alias(c) for c in ("left", "right")))
        tell = asked(cover, "place", "left", "right")
        found = blocks.join(tell, F.col("block") == F.col("of"), "left").select("block", "ids", "lens", "text", "asked").mapInArrow(_cut(length, gram, texts), sql(CUT))
        return materialize(found if texts else found.drop("kept"), "rep-cut")
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id and the text that is left of each row of docs; bytes of cut characters are replaced."""
    return cut_repeats(docs, id_col, text_col, texts=True, **how).select("doc_id", F.decode("kept", "UTF-8").alias("text"))
