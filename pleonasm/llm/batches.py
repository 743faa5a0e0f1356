"""Arrow batches as numpy arrays: bytes of a text column, its words, their hashes and window hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
#: Words longer than this are hashed one by one.
_LONG_WORD = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so that no power of it loses bits
_M64 = (1 << 64) - 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, eight zero bytes behind them, and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(8, np.uint8)]), offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word `[^\\x20\\x09-\\x0D]+`, and for each row the number of words before it."""
    size = int(offsets[-1])
    if not size:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    body = data[:size]
    inside = (body != 32) & ((body < 9) | (body > 13))
    cut = np.empty(size + 1, bool)  # a word cannot go on from the byte before
    cut[0] = True
    cut[1:] = ~inside
    cut[offsets] = True
    starts = np.flatnonzero(inside & cut[:size])
    after = np.empty(size, bool)
    after[:-1] = ~inside[1:]
    after[-1] = True
    edges = offsets[(offsets > 0)] - 1
    after[edges] = True
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word, eight bytes at a time."""
    lanes = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    length = ends - starts
    out = length.astype(np.uint64) * _ODD + np.uint64(seed)
    masks = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)
    live = np.arange(len(starts))
    at = 0
    while len(live):
        left = length[live] - at
        out[live] = _mix(out[live] ^ (lanes[starts[live] + at] & masks[np.minimum(left, 8)])) + _ODD
        at += 8
        live = live[left > 8]
        if at >= _LONG_WORD:
            break
    for i in live:
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=seed)
    return out


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp value of each run of `k` hashes: the sum of hash * base**(distance from the run's end), modulo 2**64.

    A run is put together from runs of a power of two, each from two of half its length.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, covered, part, width = None, 0, hashes, 1
    while True:
        if k & width:
            piece = part[covered : covered + n]
            total = piece.copy() if total is None else total * np.uint64(pow(_BASE, width, 1 << 64)) + piece
            covered += width
        if 2 * width > k:
            return _mix(total)
        part = part[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + part[width:]
        width *= 2
