"""Numpy text kernels that run inside Arrow batches.

Words are the maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D`` after
A-Z are lower-cased; a shingle is five consecutive words, and a text with one to
four words has one shingle made of all of them.  Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE_WORDS = 5
BLOCK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that each output bit depends on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))[_LOWER]
_STEP = mix(np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64)) | _U(1)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, n of each at least."""
    if len(_POWERS["up"]) < n:
        size = max(n, BLOCK_BYTES)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the number of words before each row."""
    inside = ~_SEPARATOR[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word from its own bytes, about BLOCK_BYTES of text at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK_BYTES)))
        a, b = int(starts[at]), int(ends[to - 1])
        up, down = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def shingles(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order and the number of shingles before each row."""
    n = np.diff(rows)
    counts = np.where(n >= SHINGLE_WORDS, n - SHINGLE_WORDS + 1, (n > 0).astype(np.int64))
    out_rows = np.zeros(len(rows), np.int64)
    np.cumsum(counts, out=out_rows[1:])
    out = np.empty(int(out_rows[-1]), np.uint64)
    if len(words) >= SHINGLE_WORDS:
        whole = np.zeros(len(words) - SHINGLE_WORDS + 1, np.uint64)
        for j in range(SHINGLE_WORDS):
            whole += words[j : len(words) - SHINGLE_WORDS + 1 + j] * _STEP[j]
        keep = np.ones(len(whole), bool)
        for j in range(1, SHINGLE_WORDS):
            cut = rows[1:] - j
            cut = cut[(cut >= 0) & (cut < len(whole))]
            keep[cut] = False
        keep_at = np.flatnonzero(keep)
        full = np.repeat(n >= SHINGLE_WORDS, counts)
        out[full] = mix(whole[keep_at])
    for i in np.flatnonzero((n > 0) & (n < SHINGLE_WORDS)):
        mine = words[rows[i] : rows[i + 1]]
        with np.errstate(over="ignore"):
            out[out_rows[i]] = mix(np.array([(mine * _STEP[: len(mine)]).sum(dtype=np.uint64) + _U(len(mine))]))[0]
    return out, out_rows


def row_shingles(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes, offsets of the rows) for blocks of a string column."""
    data, offsets = utf8(column)
    for a, b in blocks(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, rows = word_spans(part, own)
        yield a, *shingles(word_hashes(part, starts, ends), rows)
