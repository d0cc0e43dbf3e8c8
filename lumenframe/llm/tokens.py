"""Words of Arrow string batches as numpy arrays: spans, 64-bit hashes and rolling hashes of word windows."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a group of its own.  The smaller size is for stages that share executors.
GROUP_BYTES, SHARED_BYTES = 1 << 22, 1 << 20
_PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW = 0xC2B2AE3D27D4EB4F | 1

_IDENTITY = np.arange(256, dtype=np.uint8)
_LOWER = _IDENTITY.copy()
_LOWER[65:91] += 32
#: A-Z lower-cased and digits made alike.
LOOSE = _LOWER.copy()
LOOSE[48:58] = 48
#: Word bytes of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing; bytes of non-ASCII characters are word bytes.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def groups(bounds: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts take up to `limit` bytes, or one row."""
    at, n = 0, len(bounds) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def pieces(texts: pa.Array, limit: int = SHARED_BYTES) -> Iterator[pa.Array]:
    """Slices of a column whose texts take up to `limit` bytes, or one row."""
    for a, b in groups(text_bytes(texts)[1], limit):
        yield texts.slice(a, b - a)


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, whose worker returns free memory to the system at the end, as idle workers stay beside those of the next stages."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # of glibc
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def spans(data: np.ndarray, bounds: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the number of words) of the words of the texts in data."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    is_word = word[data]
    start = is_word.copy()
    start[1:] &= ~is_word[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    start[heads] = is_word[heads]
    end = is_word.copy()
    end[:-1] &= ~is_word[1:]
    tails = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    end[tails] = is_word[tails]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: list[np.ndarray] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased if asked for, or folded by a table of bytes."""
    if not _tables:
        _tables.extend([_powers(_BASE, 2 * _PIECE), _powers(pow(_BASE, -1, 1 << 64), 2 * _PIECE)])
    up, down = _tables
    fold = fold if fold is not None else _LOWER if lower else _IDENTITY
    wide = fold.astype(np.uint64) + np.uint64(1)
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        s0 = int(starts[at])
        to = int(np.searchsorted(ends, s0 + _PIECE, "right"))
        if to <= at:  # a word of more than a piece
            h, e = 0, int(ends[at])
            for p in range(s0, e, _PIECE):
                x = wide[data[p : min(e, p + _PIECE)]]
                h += int((x * up[: len(x)]).sum(dtype=np.uint64)) * pow(_BASE, p - s0, 1 << 64)
            out[at] = h % (1 << 64)
            at += 1
            continue
        x = wide[data[s0 : int(ends[to - 1])]]
        x *= up[: len(x)]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        a, b = starts[at:to] - s0, ends[at:to] - s0
        out[at:to] = (sums[b] - sums[a]) * down[a]
        at = to
    return _mixed(out + (ends - starts).astype(np.uint64) * np.uint64(_WINDOW))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_WINDOW)
        out += h[j : j + n]
    return _mixed(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out
