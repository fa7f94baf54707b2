"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie.

The piece table (pieces, log scores, types) is read from a model file of the format's public
definition.  Files of merge-built vocabularies hold ranks in place of log scores; these become log
probabilities by Zipf's law with Mandelbrot's shift, p ~ 1 / (rank + 2.7), normalised over the pieces.  Pieces go into a double-array trie over UTF-8 bytes.  A text becomes one marker
(U+2581) and itself, with each space replaced by the marker; the segmentation with the largest sum
of scores is found.  A character that no piece begins with alone may be taken at the least score
less 10 and is spelled by byte pieces.  Decoding joins pieces, turns runs of byte pieces into
bytes and markers into spaces, and drops the first marker.

No piece that could win has a marker after its first character (a file with one is refused), so a text falls into words before its markers and
each distinct word of a batch is segmented once, all words of a batch side by side: one trie step
and one relaxation is one numpy operation over all of them.

Semantics: a null or empty text has no pieces and decodes to the empty text.  Ties between
segmentations go to the longest last piece.  A literal marker in a text decodes to a space; such a
text is reported as not lossless.  Every row gives one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .common import prepare

MARK = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
SCHEMA = "doc_id long, n_pieces long, n_bytes long, log_score double, ids array<int>, text_crc32 long, lossless boolean"


def _fields(raw: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """Fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            value |= (raw[at] & 127) << shift
            at += 1
            if raw[at - 1] < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, 0, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, key & 7, raw[at : at + n]
            at += n


def read_pieces(path: str) -> list[tuple[bytes, float, int]]:
    """(piece, score, type) of a model file."""
    out = []
    for number, _, value in _fields(open(path, "rb").read()):
        if number == 1:
            piece, score, kind = b"", 0.0, NORMAL
            for n, _, v in _fields(value):
                if n == 1:
                    piece = v
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    kind = v
            out.append((piece, score, kind))
    return out


class DoubleArray:
    """base/check arrays; state s goes by byte c to base[s] + c if check there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        tree: list[dict[int, int]] = [{}]
        end: dict[int, int] = {}
        for key, value in zip(keys, values):
            node = 0
            for c in key:
                if c not in tree[node]:
                    tree[node][c] = len(tree)
                    tree.append({})
                node = tree[node][c]
            end[node] = value
        size = 4 * len(tree) + 1024
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        lowest, near, todo = 300, 300, [(0, 0)]
        while todo:
            node, state = todo.pop()
            self.value[state] = end.get(node, -1)
            codes = list(tree[node])
            if not codes:
                continue
            while used[lowest]:
                lowest += 1
            # single children fill the lowest gap; others go on from where such a node fitted last
            base, tries = max(1, (lowest if len(codes) == 1 else near) - codes[0]), 0
            while any(used[base + c] for c in codes):
                base, tries = base + 1, tries + 1
                if base + 256 >= len(used):
                    more = len(used)
                    used.extend(bytes(more))
                    self.base, self.check, self.value = (np.append(x, np.full(more, f, np.int32)) for x, f in ((self.base, 0), (self.check, -1), (self.value, -1)))
            if tries > 32:
                near = max(near, base)
            self.base[state] = base
            for c in codes:
                used[base + c], self.check[base + c] = 1, state
                todo.append((tree[node][c], base + c))
        last = int(np.flatnonzero(self.check >= 0).max(initial=0)) + 257
        self.base, self.check, self.value = self.base[:last], self.check[:last], self.value[:last]

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        to = np.minimum(self.base[state] + code, len(self.check) - 1)
        return np.where(self.check[to] == state, to, -1)


#: Scores from here down mean that a piece is never to be taken.
NEVER = -1e8


def log_scores(pieces: list[tuple[bytes, float, int]]) -> np.ndarray:
    """The scores, merge ranks made log probabilities; pieces that are never to be taken keep theirs."""
    score = np.array([s for _, s, _ in pieces])
    own = np.array([t == NORMAL and s > NEVER for _, s, t in pieces], bool)
    ranks = -score[own]
    if len(ranks) > 1 and (ranks == np.floor(ranks)).all() and len(np.unique(ranks)) == len(ranks) and ranks.max() >= len(ranks) - 1:
        weight = 1 / (ranks + 2.7)
        score[own] = np.log(weight / weight.sum())
    return score


class UnigramModel:
    def __init__(self, pieces: list[tuple[bytes, float, int]]):
        self.pieces = [p for p, _, _ in pieces]
        use = [i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER) and p]
        self.score = log_scores(pieces)
        if any(MARK in self.pieces[i][1:] and self.score[i] > NEVER for i in use):
            raise ValueError("a piece has a marker after its first character")
        self.trie = DoubleArray([self.pieces[i] for i in use], use)
        self.longest = max((len(self.pieces[i]) for i in use), default=1)
        self.unknown_score = min((self.score[i] for i in use if self.score[i] > NEVER), default=0.0) - 10
        self.byte_id = np.full(256, next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0), np.int32)
        for i, (p, _, t) in enumerate(pieces):
            if t == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
        self.is_byte = np.array([t == BYTE for _, _, t in pieces])
        self.byte_value = np.array([int(p[3:5], 16) if t == BYTE else 0 for p, _, t in pieces])

    def segment(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words one after another, their offsets, and each word's score."""
        n, size = len(start), end - start
        # words side by side, the longest first, so that the words that reach a column are a prefix
        rank = np.argsort(-size, kind="stable")
        s, L = start[rank], size[rank]
        first = np.cumsum(L) - L
        flat = data[np.repeat(s - first, L) + np.arange(int(L.sum()))].astype(np.int32)
        column = np.arange(len(flat)) - np.repeat(first, L)
        left = np.repeat(L, L) - column
        heads = (flat & 0xC0) != 0x80
        width = np.where(flat < 0x80, 1, np.where(flat < 0xE0, 2, np.where(flat < 0xF0, 3, 4)))
        # arcs (from, length, id, score): trie walks from all character starts at once
        at = np.flatnonzero(heads)
        state = np.zeros(len(at), np.int64)
        alone = np.zeros(len(flat), bool)
        arcs = []
        for k in range(self.longest):
            go = left[at] > k
            at, state = at[go], state[go]
            state = self.trie.step(state, flat[at + k])
            go = state >= 0
            at, state = at[go], state[go]
            if not len(at):
                break
            v = self.trie.value[state]
            hit = v >= 0
            arcs.append((at[hit], np.full(int(hit.sum()), k + 1), v[hit]))
            one = at[hit]
            alone[one[width[one] == k + 1]] = True
        lone = np.flatnonzero(heads & ~alone)
        arcs.append((lone, np.minimum(width[lone], left[lone]), np.full(len(lone), -1)))
        src, length, ids = (np.concatenate(x) for x in zip(*arcs))
        gain = np.where(ids >= 0, self.score[ids], self.unknown_score)
        # relax by end column; among arcs into a place the longest that attains the maximum stays
        best = np.full(len(flat) + n, -np.inf)
        place = lambda at: at + np.repeat(np.arange(n), L)[np.minimum(at, len(flat) - 1)]  # noqa: E731  a place more for each word's end
        src_at = place(src)
        best[first + np.arange(n)] = 0
        back_len, back_id = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        stop = column[src] + length
        order = np.lexsort((length, stop))
        src_at, length, ids, gain, stop = src_at[order], length[order], ids[order], gain[order], stop[order]
        group = np.flatnonzero(np.append(True, (np.diff(stop) != 0) | (np.diff(length) != 0))) if len(stop) else np.zeros(0, np.int64)
        for a, b in zip(group, np.append(group[1:], len(stop))):
            to = src_at[a:b] + length[a]
            value = best[src_at[a:b]] + gain[a:b]
            win = value >= best[to]
            w = to[win]
            best[w], back_len[w], back_id[w] = value[win], length[a], ids[a:b][win]
        total = best[first + np.arange(n) + L]
        # trace back, all words at once
        at, low, alive, steps = first + np.arange(n) + L, first + np.arange(n), np.arange(n), []
        while len(alive):
            here = at[alive]
            alive = alive[here > low[alive]]
            here = at[alive]
            steps.append((alive, back_id[here], here - back_len[here], back_len[here]))
            at[alive] = here - back_len[here]
        word, piece, src_at, length = (np.concatenate(x) for x in zip(*steps)) if steps else (np.zeros(0, np.int64),) * 4
        # spell unknown characters
        times = np.where(piece >= 0, 1, length)
        word2, piece2 = np.repeat(word, times), np.repeat(piece, times)
        inner = np.arange(len(word2)) - np.repeat(np.cumsum(times) - times, times)
        spot = np.repeat(src_at, times) + inner
        raw = flat[np.minimum(spot - word2, max(len(flat) - 1, 0))] if len(flat) else piece2
        out = np.where(piece2 >= 0, piece2, self.byte_id[raw])
        key = np.lexsort((spot, rank[word2]))
        out = out[key].astype(np.int32)
        counts = np.bincount(rank[word2], minlength=n)
        score = np.zeros(n)
        score[rank] = total
        return out, np.append(0, np.cumsum(counts)), score

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all documents, offsets, and scores, from UTF-8 bytes and offsets."""
        full = np.flatnonzero(np.diff(off))
        # one marker before each document that is not empty, spaces to markers
        grow = np.ones(len(data), np.int64)
        grow[data == 32] = 3
        lead = np.zeros(len(data), np.int64)
        lead[off[full]] = 3
        to = np.cumsum(grow + lead) - grow
        out = np.zeros(len(data) * 1 + int((grow - 1).sum() + lead.sum()), np.uint8)
        plain = data != 32
        out[to[plain]] = data[plain]
        for k, c in enumerate(MARK):
            out[to[~plain] + k] = c
            out[to[off[full]] - 3 + k] = c
        ends = np.append(0, np.cumsum(grow + lead))[off]
        # words begin at a marker that no marker precedes, and where documents begin
        mark = np.zeros(len(out), bool)
        if len(out) > 2:
            mark[:-2] = (out[:-2] == MARK[0]) & (out[1:-1] == MARK[1]) & (out[2:] == MARK[2])
        begin = mark.copy()
        begin[3:] &= ~mark[:-3]
        begin[ends[full]] = True
        start = np.flatnonzero(begin)
        stop = np.append(start[1:], len(out))
        _, first, at = np.unique(K.span_hashes(out, start, stop), return_index=True, return_inverse=True)
        ids, ioff, score = self.segment(out, start[first], stop[first])
        n = np.diff(ioff)[at]
        total = np.append(0, np.cumsum(n))
        flat = ids[np.repeat(ioff[at] - total[:-1], n) + np.arange(total[-1])]
        words = np.searchsorted(start, ends)
        sums = np.append(0.0, np.cumsum(score[at]))
        return flat, total[words], sums[words[1:]] - sums[words[:-1]]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        out = bytearray()
        for i in ids.tolist():
            out += bytes([self.byte_value[i]]) if self.is_byte[i] else self.pieces[i]
        text = out.decode(errors="replace").replace("▁", " ")
        return text[1:] if text.startswith(" ") else text

    def decode_flat(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of many documents and their offsets, without a Python step per piece."""
        if not hasattr(self, "_bytes"):
            spelled = [bytes([int(v)]) if b else p.replace(MARK, b" ") for p, b, v in zip(self.pieces, self.is_byte, self.byte_value)]
            self._size = np.array([len(p) for p in spelled], np.int64)
            self._from, self._bytes = np.cumsum(self._size) - self._size, np.frombuffer(b"".join(spelled), np.uint8)
        n = self._size[ids]
        total = np.append(0, np.cumsum(n))
        out = self._bytes[np.repeat(self._from[ids] - total[:-1], n) + np.arange(total[-1])]
        ends = total[off]
        keep = np.ones(len(out), bool)
        keep[ends[:-1][np.diff(ends) > 0]] = False  # the first marker
        return out[keep], np.append(0, np.cumsum(np.diff(ends) - (np.diff(ends) > 0)))


_MODELS: dict[str, UnigramModel] = {}


def model_of(path: str) -> UnigramModel:
    if path not in _MODELS:
        _MODELS[path] = UnigramModel(read_pieces(path))
    return _MODELS[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            data, off = K.utf8(batch.column(1))
            for a, b in K.pieces(off, 2_500_000):
                piece, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                ids, ioff, score = model.encode(piece, at)
                text, toff = model.decode_flat(ids, ioff)
                view = memoryview(np.ascontiguousarray(text)).cast("B")
                crc = [zlib.crc32(view[x:y]) for x, y in zip(toff, toff[1:])]
                raw = memoryview(np.ascontiguousarray(piece)).cast("B")
                same = [view[x:y] == raw[p:q] for x, y, p, q in zip(toff, toff[1:], at, at[1:])]
                spelled = np.append(0, np.cumsum(model.is_byte[ids]))[ioff]
                lists = pa.ListArray.from_arrays(pa.array(ioff.astype(np.int32)), pa.array(ids))
                K.release()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(ioff)), pa.array(np.diff(spelled)), pa.array(score), lists, pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], [f.split()[0] for f in SCHEMA.split(", ")])

    return run


def encode_documents(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, n_bytes, log_score, ids, and crc32 and fidelity of the decoded text."""
    prepare(docs.sparkSession)
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_encode(str(model_path)), SCHEMA)
