"""Vectorised numpy kernels over Arrow string columns: words, chunks, shingles and minhashes.

Texts stay UTF-8 bytes.  A null text is the empty text.  All hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_LIBC = ctypes.CDLL(None)
U64 = np.uint64
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: The separators of words: space, and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240611)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
BASE = U64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, U64)


def fmix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each bit over all 64."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 .. n - 1."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = _power_table(int(BASE), n)
    return _POWERS[:n]


def _power_table(base: int, n: int) -> np.ndarray:
    p = np.full(1 << max(0, n - 1).bit_length(), U64(base), U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def release() -> None:
    """Give freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, spans in order; equal bytes give equal hashes."""
    if len(data) <= most:
        return _span_hashes(data, start, end)
    out, a = np.zeros(len(start), U64), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + most, "right")))
        out[a:b] = _span_hashes(data[start[a] : end[b - 1]], start[a:b] - start[a], end[a:b] - start[a])
        a = b
    return out


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, U64)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * powers(len(data)), out=total[1:])
    h = (total[end] - total[start]) * _negative(start, len(data))
    return fmix(h ^ (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


_INVERSE = np.ones(1, U64)


def _negative(at: np.ndarray, n: int) -> np.ndarray:
    """BASE to the powers -at."""
    global _INVERSE
    if len(_INVERSE) < n:
        _INVERSE = _power_table(pow(int(BASE), -1, 2**64), n)
    return _INVERSE[at]


def pieces(off: np.ndarray, most: int = 2_000_000):
    """Ranges of documents of about `most` bytes each; a longer document is a range of its own."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, off: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts and ends of the words, and for each document the first of its words."""
    data = FOLD[data] if fold else data
    full = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    before = np.zeros(len(data), bool)
    before[1:] = full[:-1]
    before[first[:-1]] = False
    start = np.flatnonzero(full & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = full[1:]
    after[first[1:]] = False
    end = np.flatnonzero(full & ~after) + 1
    return data, start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each document the first of its words."""
    data, start, end, woff = words(data, off)
    return span_hashes(data, start, end), woff


SHINGLE = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], U64)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 5-word shingles of each document, and their offsets; fewer words make one shingle."""
    k = len(SHINGLE)
    out, sizes = [], []
    for a, b in pieces(off):
        h, woff = word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
        count = np.diff(woff)
        rolled = np.zeros(max(0, len(h) - k + 1), U64)
        for j in range(k):
            rolled += fmix(h[j : len(h) - k + 1 + j] + SHINGLE[j]) * SHINGLE[j] if len(h) >= k else U64(0)
        rolled = fmix(rolled)
        for d in range(b - a):
            n = int(count[d])
            if n >= k:
                one = np.unique(rolled[woff[d] : woff[d + 1] - k + 1])
            elif n:
                one = np.zeros(1, U64)
                for j in range(n):
                    one += fmix(h[woff[d] + j : woff[d] + j + 1] + SHINGLE[j]) * SHINGLE[j]
                one = fmix(one ^ U64(n))
            else:
                one = np.zeros(0, U64)
            out.append(one)
            sizes.append(len(one))
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return (np.concatenate(out) if out else np.zeros(0, U64)), offsets


def minhashes(shingles: np.ndarray, off: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """A documents x count matrix of minima; documents without shingles get the largest value."""
    factors = np.random.default_rng(seed).integers(1, 2**63, count, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    out = np.full((len(off) - 1, count), U64(2**64 - 1))
    for a, b in pieces(off * 8, 1_000_000):
        full = np.flatnonzero(np.diff(off[a : b + 1]))
        if not len(full):
            continue
        x = shingles[off[a] : off[b]]
        starts = off[a + full] - off[a]
        for r in range(count):
            y = x * factors[r]
            y ^= y >> U64(29)
            out[a + full, r] = np.minimum.reduceat(y, starts)
    return out


#: Bytes that begin characters among which there is white space; printing bytes; ASCII letters; stops.
_LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_PRINTING = (np.arange(256) > 32) & (np.arange(256) != 127)
_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_STOP = np.isin(np.arange(256), list(b".,;:!?"))


def chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut documents before single spaces between printing characters, and between a letter of ASCII and a stop.

    No pre-token of the byte-level BPE pattern crosses such places, so chunks can be encoded
    alone.  Next to characters that might be other white space no cut is made at a space.
    Returns starts, ends, and for each document its first chunk; empty documents have none.
    """
    n = len(data)
    place = np.zeros(n + 1, bool)
    if n > 2:
        lead, printing = _LEAD[data], _PRINTING[data]
        mid = (data[1:-1] == 32) & printing[:-2] & printing[2:] & ~lead[2:]
        mid[1:] &= ~lead[:-3]
        mid[2:] &= ~lead[: len(lead) - 4] if len(lead) > 4 else True
        place[1 : n - 1] = mid
        place[1:n] |= _LETTER[data[:-1]] & _STOP[data[1:]]
        # a space at the edge of a document has its neighbour in another document
        place[off[:-1]] = False
        last = off[1:] - 1
        place[last[last >= 0]] = False
    place[off[:-1][np.diff(off) > 0]] = True
    start = np.flatnonzero(place[:n])
    end = np.append(start[1:], n) if len(start) else start
    return start, end, np.searchsorted(start, off)
