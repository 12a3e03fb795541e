"""Vectorised text kernels over Arrow batches: words, word hashes, shingles."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)

#: Bytes of text handled at once; bounds the kernels' memory.
BLOCK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that end a word: ASCII white space.
BLANK_SPLIT = np.ones(256, bool)
BLANK_SPLIT[[0x20, 9, 10, 11, 12, 13]] = False

#: Word bytes: digits, letters and everything outside ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x41:0x5B] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters its input."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(29))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


#: What empties the caches that a worker keeps from one task to the next.
RELEASED: list = []


def give_back() -> None:
    """Give freed memory back to the system, where that is possible."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def trim() -> None:
    """Empty the worker's caches and give their memory back."""
    for empty in RELEASED:
        empty()
    give_back()


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n + 1:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n + 1024, _BASE))])
            _inverses = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n + 1024, _INVERSE))])
    return _powers[: n + 1], _inverses[: n + 1]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, row offsets) of runs of rows; null is empty.

    A text longer than `limit` is a block of its own, so texts stay whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = inside[data]
    begins = w.copy()
    begins[1:] &= ~w[:-1]
    ends = w.copy()
    ends[:-1] &= ~w[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = w[cuts]
    ends[cuts - 1] = w[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = LOWER) -> np.ndarray:
    """64-bit hashes of words; equal words (after folding) have equal hashes anywhere."""
    if not len(starts):
        return np.zeros(0, U64)
    powers, inverses = _tables(len(data))
    with np.errstate(over="ignore"):
        folded = (fold[data] if fold is not None else data).astype(U64) + U64(1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(folded * powers[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * inverses[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words inside texts, and the text index of each.

    A text of fewer than n words, but not none, has its whole sequence as one.
    """
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        m = len(words) - n + 1
        if m > 0:
            h = np.zeros(m, U64)
            for k in range(n):
                h = (h + words[k : k + m]) * U64(0xC2B2AE3D27D4EB4F) + U64(k + 1)
            h = mix(h)
            owner = np.repeat(np.arange(len(counts)), counts)
            fits = owner[:m] == owner[n - 1 :]
            h, own = h[fits], owner[:m][fits]
        else:
            h, own = np.zeros(0, U64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            extra = np.zeros(len(short), U64)
            for i, d in enumerate(short):
                x = U64(counts[d])
                for w in words[first[d] : first[d + 1]]:
                    x = (x + w) * U64(0xA0761D6478BD642F) + U64(7)
                extra[i] = x
            h, own = np.concatenate([h, mix(extra)]), np.concatenate([own, short])
            by = np.argsort(own, kind="stable")
            h, own = h[by], own[by]
    return h, own


#: Keys that a summary holds at once.
SUMMARY_KEYS = 1_000_000


class Summary:
    """Bounded counts of 64-bit keys: the rarest are forgotten when too many are held."""

    def __init__(self):
        self.keys, self.counts, self.new, self.size = np.zeros(0, U64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.size += len(keys)
        if self.size > SUMMARY_KEYS:
            self.fold()

    def fold(self) -> None:
        keys, counts = np.unique(np.concatenate([*self.new, np.zeros(0, U64)]), return_counts=True)
        keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([self.counts, counts]), minlength=len(keys)).astype(np.int64)
        least = 1
        while (counts >= least).sum() > SUMMARY_KEYS // 4:
            least += 1
        self.keys, self.counts, self.new, self.size = keys[counts >= least], counts[counts >= least], [], 0
