"""Vectorised text primitives over Arrow string buffers: word spans and 64-bit span hashes.

A batch's texts are one UTF-8 byte array and an offset for each text; everything below works on whole
batches, so that no Python object is made for a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = np.uint64(int(_rng.integers(1, 2**63)) * 2 + 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_SEGMENT = 1 << 17
_powers: list[np.ndarray] = []


def texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin (length: texts + 1)."""
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _SEGMENT + 4096)
        one = np.full(size, _BASE, np.uint64)
        inv = np.full(size, _BASE_INV, np.uint64)
        one[0] = inv[0] = 1
        _powers[:] = [np.multiply.accumulate(one), np.multiply.accumulate(inv)]
    return _powers[0], _powers[1]


def hash_spans(buf: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes (A-Z lower-cased if asked). Spans ascend and don't overlap.

    Prefix sums of a random-table polynomial give each span's hash by one subtraction; work goes in
    segments of about 128 KB cut between spans, so memory doesn't grow with a text's length."""
    out = np.empty(len(s), np.uint64)
    value = _LOWER if lower else _BYTE
    k = 0
    while k < len(s):
        to = max(k + 1, int(np.searchsorted(e, s[k] + _SEGMENT, "right")))
        a, b = int(s[k]), int(e[to - 1])
        up, down = _power(b - a + 1)
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(value[buf[a:b]] * up[: b - a], out=sums[1:])
        out[k:to] = (sums[e[k:to] - a] - sums[s[k:to] - a]) * down[s[k:to] - a]
        k = to
    return mix(out)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... of each run in turn."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - length), length)


def rows_of(batches, limit: int = 2 << 20, text=lambda b: b.column(b.schema.get_field_index("text"))):
    """The batches, cut so that none has more than about ``limit`` bytes of text (one row at least). ``text``
    gives a batch's text column."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        _, off = texts(text(b))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield b.slice(at, to - at)
            at = to
