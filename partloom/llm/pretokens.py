"""Byte-level pre-tokens of whole texts as arrays, and the compact table of their lengths (operator 2)."""

from __future__ import annotations

import numpy as np

from .kernel import U64, _tables, mix

SPACE, LETTER, NUMBER, OTHER = range(4)
# The endings that the byte-level pattern cuts off behind an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points that have a class of their own; texts with others are left to the library.
PLANE = 1 << 16


def classes(model) -> np.ndarray:
    """The class of each code point of the first plane, as the library's own pre-tokenizer cuts it."""
    cut = model.pre_tokenizer.pre_tokenize_str
    out = np.full(PLANE, SPACE, np.uint8)
    left = [chr(c) for c in range(PLANE) if not 0xD800 <= c < 0xE000]
    for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
        rest = []
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            # a line feed between two samples is always a pre-token of its own
            pieces = {s for _, (a, b) in cut("\n".join(before + c + before for c in some)) for s in [(a, b)]}
            for k, c in enumerate(some):
                if (4 * k, 4 * k + 3) in pieces:
                    out[ord(c)] = kind
                else:
                    rest.append(c)
        left = rest
    return out


def starts_of(codes: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens of texts start, given code points, their classes and the texts' first places.

    Runs of a class are pre-tokens; of white space before a visible character the
    last is apart, and joins it if it is a blank; an apostrophe that starts a
    pre-token takes one of the endings with it.
    """
    n = len(codes)
    head = np.zeros(n + 4, bool)
    head[first] = True
    head[n:] = True
    begins = head[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    visible = np.flatnonzero(begins[1:] & ~head[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    begins[visible - 1] = True
    begins[visible[codes[visible - 1] == 32]] = False
    marks = np.flatnonzero(begins & (codes == 39))
    if len(marks):
        wide = np.append(codes, np.zeros(3, codes.dtype))
        free = ~head[marks + 1]
        one = free & np.isin(wide[marks + 1], [ord(e) for e in ENDINGS if len(e) == 1])
        two = free & ~head[marks + 2] & np.isin(wide[marks + 1].astype(np.int64) << 16 | wide[marks + 2], [ord(e[0]) << 16 | ord(e[1]) for e in ENDINGS if len(e) == 2])
        for taken, width in ((one, 2), (two & ~one, 3)):
            begins[marks[taken] + 1] = False
            after = marks[taken] + width
            begins[after[after < n]] = True
    return np.flatnonzero(begins)


class Cutter:
    """Pre-tokens of texts: their places in the joined texts, and hashes that equal pre-tokens share."""

    def __init__(self, kinds: np.ndarray):
        self.kinds = kinds

    def __call__(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(joined texts, starts, ends, index of each text's first pre-token, hashes); all texts within the first plane."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if not len(codes):
            nothing = np.zeros(0, np.int64)
            return joined, nothing, nothing, np.zeros(len(offsets), np.int64), np.zeros(0, U64)
        starts = starts_of(codes, self.kinds[codes], offsets[:-1][sizes > 0])
        ends = np.append(starts[1:], len(codes))
        powers, inverses = _tables(len(codes))
        with np.errstate(over="ignore"):
            total = np.zeros(len(codes) + 1, U64)
            np.cumsum((codes.astype(U64) + U64(1)) * powers[: len(codes)], out=total[1:])
            h = mix((total[ends] - total[starts]) * inverses[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
        return joined, starts, ends, np.searchsorted(starts, offsets), h


class Lengths:
    """Token counts of pre-tokens by hash: sorted hashes, a directory of their leading bits, and 16-bit counts."""

    BITS = 16

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        by = np.argsort(hashes)
        self.keys, self.counts = hashes[by], counts[by].astype(np.uint16)
        self.directory = np.searchsorted(self.keys >> U64(64 - self.BITS), np.arange((1 << self.BITS) + 1).astype(U64)).astype(np.int32)

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.counts.nbytes + self.directory.nbytes

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each hash, and which have none here."""
        out, lead = np.zeros(len(h), np.int64), (h >> U64(64 - self.BITS)).astype(np.int64)
        at, end = self.directory[lead], self.directory[lead + 1]
        left = np.flatnonzero(at < end)
        missing = np.ones(len(h), bool)
        at = at[left]
        while len(left):
            hit = self.keys[at] == h[left]
            out[left[hit]] = self.counts[at[hit]]
            missing[left[hit]] = False
            at = at + 1
            on = ~hit & (at < end[left])
            left, at = left[on], at[on]
        return out, missing
