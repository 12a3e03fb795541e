"""Removal of repeated 100-byte strings by suffix arrays of shards (operator 7)."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import U64, _tables, blocks, mix, trim
from .store import materialize, ship, sieve, table
from .store import sifted as sifted_by

LENGTH = 100
#: Bytes of a fingerprint; every string of LENGTH bytes holds one picked fingerprint.
GRAM = 40
#: Bytes of one suffix array.
SHARD_BYTES = 1 << 20
#: Distinct surroundings of a fingerprint beyond which they don't share a shard.
HOT_ROWS = 4_096
#: Parts that each 100-byte string of such a fingerprint is dealt over when its earliest place is joined back.
SALTS = 8
#: Fingerprints that a task holds before it settles equal surroundings.
FLUSH_ROWS = 300_000
NO_ID = -(1 << 63)


# Suffix arrays


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes: less than the suffix after them.  The last suffix is S."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(np.diff(text.astype(np.int64)))
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return step[nearest] > 0


def _deal(held: dict, positions: np.ndarray, letters: np.ndarray) -> None:
    """Append positions to the buckets of their letters, in order."""
    if not len(positions):
        return
    by = np.argsort(letters, kind="stable")
    positions, letters = positions[by], letters[by]
    cuts = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    for c, part in zip(letters[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
        held[c].append(part)


def _induce(text: np.ndarray, small: np.ndarray, leftmost: np.ndarray, letters: list[int]) -> np.ndarray:
    """All suffixes in the order that the given order of leftmost-smaller ones induces.

    L suffixes are dealt from left to right, S suffixes from right to left, a
    bucket at a time; within a bucket, runs of its own letter go in waves.
    """
    lows: dict = defaultdict(list)
    seeds: dict = defaultdict(list)
    highs: dict = defaultdict(list)
    _deal(seeds, leftmost, text[leftmost])
    done: dict[int, list] = defaultdict(list)
    for c in letters:
        wave = np.concatenate([*lows.pop(c, []), np.zeros(0, np.int32)])
        rest = np.concatenate([*seeds.get(c, []), np.zeros(0, np.int32)])
        while len(wave) or len(rest):
            if len(wave):
                done[c].append(wave)
                before = wave[wave > 0] - 1
            else:
                before, rest = rest[rest > 0] - 1, rest[:0]
            before = before[~small[before]]
            own = text[before]
            same = own == c
            wave = before[same]
            _deal(lows, before[~same], own[~same])
    out: list[np.ndarray] = []
    for c in reversed(letters):
        own_low = np.concatenate([*done.get(c, []), np.zeros(0, np.int32)])
        wave = np.concatenate([*highs.pop(c, []), np.zeros(0, np.int32)])
        if text[-1] == c:
            wave = np.array([len(text) - 1], np.int32)
        rest = own_low[::-1]
        placed = []
        while len(wave) or len(rest):
            if len(wave):
                placed.append(wave)
                before = wave[wave > 0] - 1
            else:
                before, rest = rest[rest > 0] - 1, rest[:0]
            before = before[small[before]]
            own = text[before]
            same = own == c
            wave = before[same]
            _deal(highs, before[~same], own[~same])
        out += [*placed, own_low[::-1]]
    return np.concatenate([*out, np.zeros(0, np.int32)])[::-1]


def _induce_counting(text: np.ndarray, small: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """As _induce for any integer alphabet: places by counting buckets, one suffix after another."""
    n = len(text)
    ends = np.cumsum(np.bincount(text))
    # the letter before each suffix if that is an L (or an S) letter; -1 otherwise, and for an empty place
    before = np.full((2, n + 1), -1, np.int64)
    before[small[:-1].astype(np.int8), np.arange(1, n)] = text[:-1]
    low, high = before.tolist()
    out = np.full(n, -1, np.int64)
    by = np.argsort(text[leftmost], kind="stable")  # a bucket's leftmost ones, in order, up to its end
    own = text[leftmost][by]
    last = np.append(own[1:] != own[:-1], True)
    after = np.arange(len(own)) - np.append(np.flatnonzero(last), 0)[np.cumsum(last) - last]
    out[ends[own] + after - 1] = leftmost[by]
    out, heads, tails = out.tolist(), np.append(0, ends[:-1]).tolist(), ends.tolist()
    for i in out:  # grows to the right of the place read
        c = low[i]
        if c >= 0:
            at = heads[c]
            out[at] = i - 1
            heads[c] = at + 1
    for at in range(n - 1, -1, -1):
        i = out[at]
        c = high[i]
        if c >= 0:
            tails[c] = to = tails[c] - 1
            out[to] = i - 1
    return np.array(out, np.int32)


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of the suffixes of `text` in order, by induced sorting.

    `text` holds small non-negative integers and ends with its only 0.  With `depth`, order is only promised by the
    first `depth` letters.  Leftmost-smaller substrings are sorted by inducing,
    named, and the string of names is sorted in turn by the same procedure, at
    every level, until all names differ (or each stands for `depth` letters).
    Bytes are induced a bucket at a time, names with counting buckets.
    """
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = _types(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    kinds = int(text.max()) + 1
    if kinds <= 256:
        letters = np.unique(text).tolist()
        induce = lambda order: _induce(text, small, order, letters)
    else:
        induce = lambda order: _induce_counting(text, small, order)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = induce(lms)
    ordered = rough[is_lms[rough]]
    if len(lms) > 1:
        ends = np.append(lms[1:] + 1, n)
        ids = np.zeros(n, np.int64)
        ids[lms] = np.arange(len(lms))
        powers, inverses = _tables(n)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, U64), np.cumsum((text.astype(U64) * U64(2) + small.astype(U64) + U64(1)) * powers[:n])])
            marks = mix((total[ends] - total[lms]) * inverses[lms] + (ends - lms).astype(U64) * U64(0xD6E8FEB86659FD93))
        line = marks[ids[ordered]]
        names = np.zeros(len(lms), np.int64)
        names[ids[ordered]] = np.concatenate([[0], np.cumsum(line[1:] != line[:-1])])
        # every substring but the last has two letters of its own at least
        left = None if depth is None else -(-depth // 2)
        if names.max() + 1 < len(lms) and left != 1:
            ordered = lms[suffix_array(names, left)]
    return induce(ordered)


def permuted_lcp(text: np.ndarray, order: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """For each start, the letters, at most `depth`, that its suffix shares with the one before it in order.

    Letters are below 256 and the last is the only 0.  Eight letters are compared
    at a time.  Where `wanted` is False, 0 is given.
    """
    n = len(text)
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    wide = np.zeros(n + depth + 16, U64)
    wide[:n] = text
    for k in (1, 2, 4):
        wide = (wide[:-k] << U64(8 * k)) | wide[k:]
    shared = np.zeros(n, np.int16)
    live = np.flatnonzero(before >= 0 if wanted is None else (before >= 0) & wanted).astype(order.dtype)
    other = before[live]
    for reach in range(0, depth, 8):
        differ = wide[live + reach] ^ wide[other + reach]
        ended = differ != 0
        if ended.any():
            d = differ[ended]
            same = np.zeros(len(d), np.int16)
            for k in range(1, 8):
                same += d < (U64(1) << U64(64 - 8 * k))
            shared[live[ended]] = np.minimum(reach + same, depth)
            live, other = live[~ended], other[~ended]
        if not len(live):
            break
    shared[live] = depth
    return shared


def repeats_of(pieces: list[bytes], ids: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(id, start, end) of the bytes of pieces covered by a string of `length` that some piece holds earlier.

    A piece is a stretch of document `ids[i]` from `starts[i]`; earlier is by id,
    then start.  The same place in two pieces is one place.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    raw = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8).astype(np.int16) + 2  # UTF-8 has no byte above 244
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    raw[begins + sizes] = 1
    raw[-1] = 0
    order = suffix_array(raw, length)
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes + 1)
    inside = np.arange(len(raw)) - begins[piece] <= sizes[piece] - length
    shared = permuted_lcp(raw, order, length, inside)
    fits = order[inside[order]]
    # suffixes too short to hold the string never stand between two that share it
    new = shared[fits] < length
    new[:1] = True
    group = np.flatnonzero(new)
    own, at = ids[piece[fits]], starts[piece[fits]] + fits - begins[piece[fits]]
    if not len(fits):
        return []
    span = np.diff(np.append(group, len(fits)))
    first_id = np.repeat(np.minimum.reduceat(own, group), span)
    first_at = np.repeat(np.minimum.reduceat(np.where(own == first_id, at, 1 << 60), group), span)
    late = (own != first_id) | (at != first_at)
    own, at = own[late], at[late]
    by = np.lexsort((at, own))
    return merged(own[by], at[by], at[by] + length)


def merged(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """Unions of sorted (id, start, end) stretches that overlap or touch."""
    out: list[list[int]] = []
    for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
        if out and out[-1][0] == i and a <= out[-1][2]:
            if b > out[-1][2]:
                out[-1][2] = b
        else:
            out.append([i, a, b])
    return [(i, a, b) for i, a, b in out]


# Fingerprints


def picks(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the fingerprints that every string of `length` bytes picks: its rightmost least one."""
    n, window = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    with np.errstate(over="ignore"):
        parts, width = {1: mix(data.astype(U64) + U64(0x1234567))}, 1
        while width * 2 <= gram:
            h = parts[width]
            parts[width * 2] = h[:-width] * U64(0xC2B2AE3D27D4EB4F) + h[width:]
            width *= 2
        full, have = parts[width], width
        while have < gram:
            step = max(w for w in parts if w <= gram - have)
            m = n - have - step + 1
            full = full[:m] * U64(0xA0761D6478BD642F) + parts[step][have : have + m]
            have += step
        full = mix(full)
    value = (full >> U64(32)).astype(np.uint32)
    index = np.arange(len(value), dtype=np.int32)
    width = 1
    while width * 2 <= window:
        right = value[width:] <= value[:-width]
        index = np.where(right, index[width:], index[:-width])
        value = np.where(right, value[width:], value[:-width])
        width *= 2
    if width < window:
        gap = window - width
        right = value[gap:] <= value[:-gap]
        index = np.where(right, index[gap:], index[:-gap])
    starts = np.arange(len(index))
    holder = np.searchsorted(offsets, starts, "right") - 1
    chosen = np.zeros(len(full), bool)
    chosen[index[starts + length <= offsets[holder + 1]]] = True
    found = np.flatnonzero(chosen)
    return found, full[found]


class _Local:
    """Fingerprints of one partition; of equal surroundings only the earliest goes on."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.rows.append(columns)
        self.size += len(columns[0])

    def flush(self):
        fp, around, ids, starts, ends = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        self.rows, self.size = [], 0
        by = np.lexsort((starts, ids, around, fp))
        fp, around, ids, starts, ends = fp[by], around[by], ids[by], starts[by], ends[by]
        new = np.ones(len(fp), bool)
        new[1:] = (fp[1:] != fp[:-1]) | (around[1:] != around[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(fp)), 0))
        late = (ids != ids[head]) | (starts != starts[head])
        own = np.flatnonzero(late)
        own = own[np.lexsort((starts[own], ids[own]))]
        return (fp[new], around[new], ids[new], starts[new], ends[new]), merged(ids[own], starts[own], ends[own])


#: What a row says: surroundings of a fingerprint, a stretch of repeated bytes, or a fingerprint with too many surroundings.
HELD, FOUND, HOT = 0, 1, 2
_ROW = "fp long, around long, doc_id long, start long, stop long, kind int"


def _rows(fp, around, ids, starts, ends, kind: int) -> pa.RecordBatch:
    as_long = lambda x: pa.array(np.asarray(x).view(np.int64) if np.asarray(x).dtype == U64 else np.asarray(x, np.int64))
    return pa.RecordBatch.from_arrays([*map(as_long, (fp, around, ids, starts, ends)), pa.array(np.full(len(ids), kind, np.int32))], names=["fp", "around", "doc_id", "start", "stop", "kind"])


def _found(spans: list[tuple[int, int, int]]) -> pa.RecordBatch:
    ids, starts, ends = (np.array(c, np.int64) for c in (zip(*spans, strict=True) if spans else ([], [], [])))
    spread = mix(ids.view(U64)) if len(ids) else np.zeros(0, U64)
    return _rows(spread, np.zeros(len(ids), np.int64), ids, starts, ends, FOUND)


def _fingerprints(length: int, gram: int):
    def run(batches):
        held = _Local()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, data, offsets in blocks(batch.column(1), 1 << 19):
                at, fp = picks(data, offsets, length, gram)
                if not len(at):
                    continue
                holder = np.searchsorted(offsets, at, "right") - 1
                a = np.maximum(offsets[holder], at - (length - gram))
                b = np.minimum(offsets[holder + 1], at + length)
                powers, inverses = _tables(len(data))
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * powers[: len(data)])])
                    around = mix((total[b] - total[a]) * inverses[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93) + (at - a).astype(U64) * U64(0x9E3779B97F4A7C15))
                held.add(fp, around, keys[first + holder], a - offsets[holder], b - offsets[holder])
                if held.size > FLUSH_ROWS:
                    rows, spans = held.flush()
                    yield _rows(*rows, HELD)
                    yield _found(spans)
        if held.size:
            rows, spans = held.flush()
            yield _rows(*rows, HELD)
            yield _found(spans)
        trim()

    return run


def _sift(limit: int):
    """From rows sorted by (fp, around, doc_id, start): repeats of whole surroundings, first rows of fingerprints with several, and those with more than `limit`.

    State is one row and one count, whatever a fingerprint's rows.
    """

    def run(batches):
        last = None  # fp, around, id, start, stop of the first row of the surroundings
        waiting, seen = False, 0  # whether that row is held back; distinct surroundings of its fingerprint so far
        for batch in batches:
            found = batch.column(5).to_numpy() == FOUND
            if found.any():
                yield batch.filter(pa.array(found))
            if found.all():
                continue
            cols = [batch.column(i).to_numpy()[~found] for i in range(5)]
            if last is not None:
                cols = [np.concatenate([[v], c]) for v, c in zip(last, cols, strict=True)]
            fp, around, ids, starts, ends = cols
            new_fp = np.ones(len(fp), bool)
            new_fp[1:] = fp[1:] != fp[:-1]
            new = new_fp.copy()
            new[1:] |= around[1:] != around[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(fp)), 0))
            late = (ids != ids[head]) | (starts != starts[head])
            if late.any():
                own = np.flatnonzero(late)
                own = own[np.lexsort((starts[own], ids[own]))]
                yield _found(merged(ids[own], starts[own], ends[own]))
            firsts = np.flatnonzero(new)
            group = np.cumsum(new_fp)[firsts] - 1
            total = np.bincount(group)
            several = total[group] > 1
            if last is not None:
                before = seen
                total[0] += seen - 1
            else:
                before = 0
            if last is not None and not waiting:  # the row before was sent, so its fingerprint has several
                several[group == 0] = True
                several[0] = False
            send = firsts[several]
            if len(send):
                yield _rows(fp[send], around[send], ids[send], starts[send], ends[send], HELD)
            over = total > limit
            over[0] &= before <= limit
            if over.any():
                hot = fp[new_fp][over]
                yield _rows(hot, hot, hot, hot, hot, HOT)
            tail = firsts[-1]
            waiting = not several[-1] if not (last is not None and not waiting and len(firsts) == 1) else False
            last, seen = [c[tail] for c in cols], int(total[-1])

    return run


def _shards(length: int, limit: int):
    """Suffix arrays of runs of whole fingerprints, in order, of about `limit` bytes."""

    def run(batches):
        pieces, ids, starts, size, last = [], [], [], 0, None
        for batch in batches:
            for fp, i, a, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size >= limit and fp != last:
                    yield _found(repeats_of(pieces, np.array(ids), np.array(starts), length))
                    pieces, ids, starts, size = [], [], [], 0
                pieces.append(body)
                ids.append(i)
                starts.append(a)
                size += len(body) + 1
                last = fp
        if pieces:
            yield _found(repeats_of(pieces, np.array(ids), np.array(starts), length))
        trim()

    return run


def _windows(length: int):
    """From (doc_id, text, cuts): two hashes, document and start of every string of `length` in the cuts."""

    def run(batches):
        for batch in batches:
            ids, at, parts = [], [], []
            for i, text, cuts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                if not len(raw):
                    continue
                spans = merged(np.zeros(len(cuts), np.int64), *(np.array(c) for c in zip(*sorted((c["start"], c["stop"]) for c in cuts), strict=True)))
                for _, a, b in spans:
                    piece, n = raw[a:b].astype(U64), b - a - length + 1
                    powers, inverses = _tables(len(piece))
                    with np.errstate(over="ignore"):
                        keys = []
                        for letters in (piece + U64(1), mix(piece + U64(0x51))):
                            total = np.concatenate([np.zeros(1, U64), np.cumsum(letters * powers[: len(piece)])])
                            keys.append(mix((total[length:] - total[:n]) * inverses[:n]))
                    parts.append(keys)
                    ids.append(np.full(n, i, np.int64))
                    at.append(np.arange(a, a + n))
            if ids:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([p[k] for p in parts]).view(np.int64)) for k in (0, 1)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(at))], names=["k1", "k2", "doc_id", "start"])
        trim()

    return run


def _hot_repeats(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, start, stop) of later strings of `length` in the surroundings `rows` of hot fingerprints.

    Each string is a key of its own: its earliest place is the least by a
    combining aggregate, and comes back to the others in SALTS parts.
    """
    cuts = materialize(rows.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("cuts")), "hot")
    strings = materialize(sifted_by(docs, "doc_id", sieve(cuts, "doc_id")).join(cuts, "doc_id").select("doc_id", "text", "cuts").mapInArrow(_windows(length), "k1 long, k2 long, doc_id long, start long"), "strings")
    firsts = strings.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select("k1", "k2", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = strings.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
    late = dealt.join(firsts, ["k1", "k2", "salt"]).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
    return late.select("doc_id", "start", (F.col("start") + length).alias("stop"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Stretches (doc_id, start, stop) of bytes covered by a string of `length` bytes that starts earlier.

    `docs` has doc_id (never null) and text.  Every such string picks one of its
    fingerprints, the same wherever it occurs, so all its occurrences meet under
    that fingerprint.  Where the surroundings that any such string can reach are
    equal, all but the earliest are repeats as a whole.  Distinct surroundings of
    a fingerprint come together in one shard, whose suffix array and permuted
    common prefixes show the repeats; those of a fingerprint with more than
    `hot_rows` of them are spread by their strings instead.
    """
    spark = docs.sparkSession
    marked = docs.mapInArrow(_fingerprints(length, gram), _ROW)
    sifted = materialize(marked.repartition("fp").sortWithinPartitions("fp", "around", "doc_id", "start").mapInArrow(_sift(hot_rows), _ROW), "sifted")
    columns = ["doc_id", "start", "stop"]
    found, held = sifted.where(F.col("kind") == FOUND).select(*columns), sifted.where(F.col("kind") == HELD)
    hot = sifted.where(F.col("kind") == HOT).select("fp")
    if not hot.isEmpty():
        hot = hot.distinct()
        found = found.unionByName(_hot_repeats(docs, held.join(hot, "fp", "left_semi"), length))
        held = held.join(hot, "fp", "left_anti")
    wanted = held.groupBy("doc_id").agg(F.collect_list(F.struct("fp", "start", "stop")).alias("cuts"))

    def cut(batches):
        for batch in batches:
            out = []
            for i, text, cuts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = (text or "").encode()
                out += [(c["fp"], i, c["start"], raw[c["start"] : c["stop"]]) for c in cuts]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 4, kinds, strict=True)], names=["fp", "doc_id", "start", "body"])

    wanted = materialize(wanted, "cuts")
    bodies = sifted_by(docs, "doc_id", sieve(wanted, "doc_id")).join(wanted, "doc_id").select("doc_id", "text", "cuts").mapInArrow(cut, "fp long, doc_id long, start long, body binary")
    sorted_out = bodies.repartition("fp").sortWithinPartitions("fp").mapInArrow(_shards(length, shard_bytes), _ROW)
    return found.unionByName(sorted_out.select(*columns))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document without its repeated strings.

    A null text is empty, and what is left of it has the digest of nothing; long
    texts are read whole.  A null doc_id comes before all others and is one
    document; rows that share an id share their places, so copies under one id
    don't remove each other, and of different texts under one id each loses what
    the id loses at its places.  Of equal strings the one of the least (doc_id,
    start) stays.  An empty table gives no rows; other columns are not read.
    `keep_text` adds what is left as `kept` bytes.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    spans = materialize(repeats(docs, length, gram).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def strip(batches):
        for batch in batches:
            out = []
            for i, t, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = (t or "").encode()
                cuts = sorted((s["start"], min(s["stop"], len(raw))) for s in own or () if s["start"] < len(raw))
                joined: list[list[int]] = []
                for a, b in cuts:
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                at, left = 0, []
                for a, b in joined:
                    left.append(raw[at:a])
                    at = b
                kept = b"".join([*left, raw[at:]])
                out.append((None if i == NO_ID else i, len(raw), len(raw) - len(kept), len(joined), hashlib.sha256(kept).hexdigest(), *[kept] * keep_text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * (5 + keep_text), kinds, strict=False)], names=[c.split()[0] for c in schema.split(", ")])

    bitmap = sieve(spans, "doc_id")
    whole = sifted_by(docs, "doc_id", bitmap, False).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    cut = sifted_by(docs, "doc_id", bitmap).join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return whole.unionByName(cut).mapInArrow(strip, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
