"""Vectorised text primitives over UTF-8 bytes: words, word hashes, windows, segment sums.

All functions work on a *chunk*: the bytes of several whole texts one after the other (``buf``)
and the n + 1 places where they begin and end (``off``). Words are ``[^\\x20\\x09-\\x0D]+``; all
their separators are ASCII, so bytes can be split without decoding. No word or window crosses texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
#: One odd multiplier for each place in a window.
_PLACE = _RNG.integers(0, 1 << 63, 1024, dtype=np.uint64) * U(2) + U(1)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD_BYTE = ~SPACE


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.type != pa.string():
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(buf: np.ndarray, off: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, in place."""
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            p = np.full(max(n, CHUNK_BYTES + 65536), base, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p)
    return _POW[0][:n], _POW[1]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each text's place among them (n + 1 numbers)."""
    inside = WORD_BYTE[buf]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, finalised."""
    power, inverse = _powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]) if len(starts) else np.zeros(0, np.uint64)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words, whether of one text or not; empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1] * _PLACE[0]
    for j in range(1, n):
        out += h[j : len(h) - n + 1 + j] * _PLACE[j]
    return mix(out)


def window_starts(woff: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word places where windows of n words inside one text begin, and each text's place among them."""
    count = np.maximum(np.diff(woff) - n + 1, 0)
    place = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(place[-1], dtype=np.int64)
    at += np.repeat(woff[:-1] - place[:-1], count)
    return at, place


def segment_sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.float64 if x.dtype.kind == "f" else np.int64)
    np.cumsum(x, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words stand in a window of n words that begins at one of ``at``."""
    delta = np.zeros(total + 1, np.int32)
    np.add.at(delta, at, 1) if len(at) < 64 else np.add(delta[:-1], np.bincount(at, minlength=total)[:total], out=delta[:-1], casting="unsafe")
    ends = np.minimum(at + n, total)
    delta -= np.bincount(ends, minlength=total + 1)[: total + 1].astype(np.int32)
    return np.cumsum(delta[:-1]) > 0


def group_ids(woff: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(woff) - 1), np.diff(woff))
