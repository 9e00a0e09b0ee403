"""Vectorised word hashing for Arrow text columns.

A text is lower-cased over A-Z and cut into words of ``[^\\x20\\x09-\\x0D]+``.
Nothing here loops over words or characters in Python but for the rare words of more than 64 bytes, which xxhash takes one
by one: a word's 64-bit hash is a chain over its 8-byte pieces, each mixed by a bijection before the next comes in.  Words of up
to seven bytes can't collide with each other.  Operators that must not confuse two texts compare their bytes besides.
Memory is a small multiple of the largest Arrow batch; a single huge text is worked off in slices that end between words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SLICE = 1 << 19
_PIECES = 8  # longer spans than so many 8-byte pieces are hashed one by one
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_CHAIN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) byte positions of all words, and each text's first word index (n + 1 values)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    opens = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[opens] = inside[opens]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    closes = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[closes] = inside[closes]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _piece(windows: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The (up to) 8 bytes at each position as a number; left: bytes that belong to the span from there."""
    return windows[at].view("<u8").ravel() & _MASKS[np.minimum(left, 8)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each byte span; spans ascend and don't overlap. fold: a byte table applied first."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + _SLICE, "right")))
        part = np.zeros(int(ends[stop - 1] - low) + 8, np.uint8)
        part[:-8] = data[low : ends[stop - 1]] if fold is None else fold[data[low : ends[stop - 1]]]
        windows = sliding_window_view(part, 8)
        s, n = starts[at:stop] - low, ends[at:stop] - starts[at:stop]
        # up to 7 bytes: the bytes and their number side by side, so that the hash is a bijection of them
        h = _piece(windows, s, n)
        h = mix64(np.where(n < 8, h | n.astype(np.uint64) << np.uint64(56), mix64(h) + _CHAIN))
        for k in range(1, _PIECES):
            more = np.flatnonzero((n > 8 * k) & (n <= 8 * _PIECES))
            if len(more) == 0:
                break
            h[more] = mix64(h[more] * _CHAIN + _piece(windows, s[more] + 8 * k, n[more] - 8 * k))
        some = n >= 8
        h[some] = mix64(h[some] + n[some].astype(np.uint64))
        for i in np.flatnonzero(n > 8 * _PIECES).tolist():
            h[i] = xxhash.xxh3_64_intdigest(part[s[i] : s[i] + n[i]])
        out[at:stop] = h
        at = stop
    return out


def word_hashes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every lower-cased word in order, and each text's first word index (n + 1 values)."""
    data, offsets = text_buffer(column)
    starts, ends, index = word_bounds(data, offsets)
    return span_hashes(data, starts, ends, _LOWER), index


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1, run after run."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


_SPREAD = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], np.uint64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each position, over positions 0 .. len - n of the whole array."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = words[:size] * _SPREAD[0]
    for k in range(1, n):
        out = mix64(out) + words[k : k + size] * _SPREAD[k % 8]
    return mix64(out)
