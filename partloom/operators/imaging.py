"""Bilevel pictures: group-4 codec, components, nesting depth, resampling, digit grouping and candidate gates."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def neighbours(df: DataFrame, key: str, group: str, x: str, y: str, reach: float) -> DataFrame:
    """(key, near): how many others of the group lie within `reach` along both axes.

    Points join by grid cells of that size and the cells around them, so a group is never paired as a whole.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    shift = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = df.select(F.col(key).alias("_k"), F.col(group).alias("_g"), F.col(x).alias("_x"), F.col(y).alias("_y"), cell(x).alias("_cx"), F.explode(shift).alias("_dx"), cell(y).alias("_cy"))
    a = a.select("_k", "_g", "_x", "_y", (F.col("_cx") + F.col("_dx")).alias("_cx"), F.explode(F.transform(shift, lambda d: F.col("_cy") + d)).alias("_cy"))
    b = df.select(F.col(key).alias("_k2"), F.col(group).alias("_g"), F.col(x).alias("_x2"), F.col(y).alias("_y2"), cell(x).alias("_cx"), cell(y).alias("_cy"))
    near = a.join(b, ["_g", "_cx", "_cy"]).where((F.col("_k") != F.col("_k2")) & (F.abs(F.col("_x") - F.col("_x2")) <= reach) & (F.abs(F.col("_y") - F.col("_y2")) <= reach))
    counted = near.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    return df.select(key).join(counted, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("_n", F.lit(0)).alias("near"))


# Group-4 codec (ITU-T T.6).  Fixed values: the standard's run codes, as bit strings by run length.
WHITE = dict(enumerate("00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100".split()))
WHITE |= {64 * (i + 1): c for i, c in enumerate("11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011".split())}
BLACK = dict(enumerate("0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111".split()))
BLACK |= {64 * (i + 1): c for i, c in enumerate("0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101".split())}
LONG = {1792 + 64 * i: c for i, c in enumerate("00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split())}
RUNS = (WHITE | LONG, BLACK | LONG)
MODES = {"pass": "0001", "across": "001", 0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
END = "000000000001" * 2


def _changes(row: np.ndarray) -> list[int]:
    return (np.flatnonzero(np.diff(np.concatenate([[0], (row != 0).astype(np.int8)])))).tolist()


def _reference(above: list[int], at: int, colour: int, width: int) -> tuple[int, int]:
    """The first change above, right of `at`, to the other colour than `colour`, and the one after it."""
    i = bisect.bisect_right(above, at)
    i += i % 2 != colour
    return (above[i] if i < len(above) else width), (above[i + 1] if i + 1 < len(above) else width)


def _run_code(length: int, colour: int) -> str:
    codes, out = RUNS[colour], []
    while length >= 64:
        step = min(2560, length // 64 * 64)
        out.append(codes[step])
        length -= step
    return "".join([*out, codes[length]])


def g4_encode(pixels: np.ndarray) -> bytes:
    """Group-4 bytes of a picture (rows, columns), non-zero is ink, closed by the end mark."""
    height, width = pixels.shape
    bits, above = [], []
    for y in range(height):
        own = _changes(pixels[y])
        at, colour = -1, 0
        while at < width:
            k = bisect.bisect_right(own, at)
            a1 = own[k] if k < len(own) else width
            b1, b2 = _reference(above, at, colour, width)
            if b2 < a1:
                bits.append(MODES["pass"])
                at = b2
            elif abs(a1 - b1) <= 3:
                bits.append(MODES[a1 - b1])
                at, colour = a1, 1 - colour
            else:
                a2 = own[k + 1] if k + 1 < len(own) else width
                bits += [MODES["across"], _run_code(a1 - max(at, 0), colour), _run_code(a2 - a1, 1 - colour)]
                at = a2
        above = own
    stream = "".join([*bits, END])
    stream += "0" * (-len(stream) % 8)
    return int(stream, 2).to_bytes(len(stream) // 8, "big") if stream else b""


_BACK = tuple({c: n for n, c in codes.items()} for codes in RUNS), {c: m for m, c in MODES.items()}


class _Bits:
    def __init__(self, data: bytes):
        self.text, self.at = "".join(f"{b:08b}" for b in data), 0

    def code(self, table: dict[str, object]):
        """The next code of the table; None at the end or where none fits."""
        for n in range(1, 15):
            value = table.get(self.text[self.at : self.at + n])
            if value is not None and self.at + n <= len(self.text):
                self.at += n
                return value
        return None

    def run(self, colour: int) -> int | None:
        total = 0
        while (n := self.code(_BACK[0][colour])) is not None:
            total += n
            if n < 64:
                return total
        return None


def g4_decode(data: bytes, width: int, height: int) -> np.ndarray:
    """The picture (rows, columns) of 0 and 1; rows that are missing or cut off stay white from there."""
    bits, out, above = _Bits(data), np.zeros((height, width), np.uint8), []
    for y in range(height):
        own: list[int] = []
        at, colour = -1, 0
        while at < width:
            mode = bits.code(_BACK[1])
            if mode is None:
                break
            b1, b2 = _reference(above, at, colour, width)
            if mode == "pass":
                at = b2
            elif mode == "across":
                first, second = bits.run(colour), bits.run(1 - colour)
                if first is None or second is None:
                    break
                a1 = max(at, 0) + first
                at = a1 + second
                own += [x for x in (a1, at) if x < width]
            else:
                at, colour = b1 + mode, 1 - colour
                if at < width:
                    own.append(max(at, 0))
        for a, b in zip(own[::2], [*own[1::2], width], strict=False):
            out[y, a:b] = 1
        above = own
    return out


# Regions


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected components of a mask: labels from 1 (0 outside), numbered by first pixel, and their count.

    Runs of rows are joined by union-find, then painted.
    """
    height, width = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ry, rs = np.nonzero(edge == 1)
    re_ = np.nonzero(edge == -1)[1]
    parent = list(range(len(ry)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(ry, np.arange(height + 1))
    for y in range(1, height):
        i, j = int(first[y - 1]), int(first[y])
        while i < first[y] and j < first[y + 1]:
            if rs[i] < re_[j] and rs[j] < re_[i]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if re_[i] <= re_[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(parent))], np.int64)
    kinds, number = np.unique(roots, return_inverse=True)
    out = np.zeros((height, width), np.int32)
    for y, a, b, n in zip(ry.tolist(), rs.tolist(), re_.tolist(), (number + 1).tolist(), strict=True):
        out[y, a:b] = n
    return out, len(kinds)


def boxes_of(labels: np.ndarray, n: int) -> np.ndarray:
    """(x0, y0, x1, y1, area) of each label, ends exclusive."""
    y, x = np.nonzero(labels)
    own = labels[y, x] - 1
    out = np.zeros((n, 5), np.int64)
    out[:, :2] = max(labels.shape) + 1
    for col, v in ((0, x), (1, y)):
        np.minimum.at(out[:, col], own, v)
        np.maximum.at(out[:, col + 2], own, v + 1)
    out[:, 4] = np.bincount(own, minlength=n)
    return out


def nesting_depth(ink: np.ndarray) -> np.ndarray:
    """For ink pixels how many outlines enclose them, counted in alternating regions from the border's white; -1 for white."""
    il, n = components(ink != 0)
    wl, m = components(ink == 0)
    label = np.where(ink != 0, il + m, wl)  # white 1..m, ink m+1..m+n
    pairs = np.concatenate([np.stack([a[a != b], b[a != b]], 1) for a, b in ((label[:, :-1], label[:, 1:]), (label[:-1], label[1:]))])
    links: dict[int, set] = {}
    for a, b in np.unique(pairs, axis=0).tolist():
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    rim = np.concatenate([label[0], label[-1], label[:, 0], label[:, -1]])
    depth = np.full(n + m + 1, -1, np.int32)
    wave = [int(r) for r in np.unique(rim) if r <= m]
    depth[wave] = 0
    while wave:
        reached = {b for a in wave for b in links.get(a, ()) if depth[b] < 0}
        level = depth[wave[0]] + 1
        wave = sorted(reached)
        depth[wave] = level
    return np.where(ink != 0, np.where(depth[label] > 0, depth[label], 1), -1)


def binarized(rgb: np.ndarray, threshold: float = 128) -> np.ndarray:
    """Ink where the luminance of (rows, columns, 3) is below the threshold."""
    return (rgb[..., :3] @ np.array([0.299, 0.587, 0.114]) < threshold).astype(np.uint8)


def continuous_tone(rgb: np.ndarray, share: float = 0.03) -> bool:
    """Whether more than `share` of about 200,000 sampled pixels are neither paper nor ink."""
    light = (rgb[..., :3] @ np.array([0.299, 0.587, 0.114])).ravel()
    some = light[:: max(1, len(light) // 200_000)]
    return bool(len(some)) and float(((some > 40) & (some < 215)).mean()) > share


def rgba(ink: np.ndarray) -> np.ndarray:
    value = np.where(ink != 0, 0, 255).astype(np.uint8)
    return np.stack([value, value, value, np.full_like(value, 255)], -1)


def area_weights(size: int, out: int) -> np.ndarray:
    """(out, size): how much each source pixel counts in each target pixel, by covered area."""
    scale = size / out
    low = np.arange(out)[:, None] * scale
    high = np.minimum(low + scale, size)
    cover = np.clip(np.minimum(high, np.arange(size)[None, :] + 1) - np.maximum(low, np.arange(size)[None, :]), 0, None)
    return cover / cover.sum(1, keepdims=True)


def patch(grey: np.ndarray, box: tuple[int, int, int, int], context: float = 1.6, side: int = 48) -> np.ndarray:
    """A square window around a box, white outside the picture, as side x side values from 0 to 1."""
    x0, y0, x1, y1 = box
    cx, cy, half = (x0 + x1) / 2, (y0 + y1) / 2, context * max(x1 - x0, y1 - y0) / 2
    a, b, c, d = round(cx - half), round(cy - half), round(cx + half), round(cy + half)  # half to even
    window = np.full((d - b, c - a), 255.0)
    sx, sy, ex, ey = max(a, 0), max(b, 0), min(c, grey.shape[1]), min(d, grey.shape[0])
    if sx < ex and sy < ey:
        window[sy - b : ey - b, sx - a : ex - a] = grey[sy:ey, sx:ex]
    small = area_weights(d - b, side) @ window @ area_weights(c - a, side).T
    return np.floor(small + 0.5) / 255


def candidates(boxes: np.ndarray, height: int, width: int, least_height: int = 8, most: float = 0.06, least_area: int = 12) -> np.ndarray:
    """Boxes (x0, y0, x1, y1, area) of the size of a printed digit."""
    w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    return boxes[(h >= least_height) & (h <= most * height) & (w <= most * width) & (boxes[:, 4] >= least_area)]


def read_choice(first: tuple[str, int], second: tuple[str, int], aspect: float, thin: tuple[float, float] = (0.1, 0.45), least: int = 0) -> tuple[str, int] | None:
    """The surer of two one-digit reads (text, confidence), the first at a tie; an unread thin mark is a 1, others none."""
    reads = [r for r in (first, second) if len(r[0]) == 1 and r[0] in "0123456789"]
    if reads:
        return max(reads, key=lambda r: r[1])
    return ("1", least) if thin[0] <= aspect <= thin[1] else None


def grouped_digits(digits: list[dict], most: int = 99) -> list[dict]:
    """One- and two-digit numbers from digits (text, x0, y0, x1, y1, prob), read from left to right.

    A digit joins the first number on its row whose end is near enough, if the
    value stays within `most`; a number is as sure as its weakest digit.
    """
    out: list[dict] = []
    for d in sorted(digits, key=lambda d: d["x0"]):
        mid, tall = (d["y0"] + d["y1"]) / 2, d["y1"] - d["y0"]
        for g in out:
            last = g["last"]
            h = (last["y1"] - last["y0"] + tall) / 2
            on_row = abs(mid - (last["y0"] + last["y1"]) / 2) < 0.12 * h and d["x0"] - g["x1"] < 0.6 * h
            if on_row and len(g["num"]) < 2 and int(g["num"] + d["text"]) <= most:
                g |= {"num": g["num"] + d["text"], "last": d, "x1": max(g["x1"], d["x1"]), "y0": min(g["y0"], d["y0"]), "y1": max(g["y1"], d["y1"]), "prob": min(g["prob"], d["prob"])}
                break
        else:
            out.append({"num": d["text"], "last": d, **{k: d[k] for k in ("x0", "y0", "x1", "y1", "prob")}})
    return [{k: v for k, v in g.items() if k != "last"} for g in out]


def gated(groups: list[dict], one: float = 0.2, marginal: float = 0.5, radius: float = 6.0, crowd: int = 2) -> list[dict]:
    """Numbers without unsure lone ones and without unsure ones in a crowd of unsure ones."""
    heights = sorted(g["y1"] - g["y0"] for g in groups)
    reach = radius * (heights[len(heights) // 2] if heights else 1)
    mid = lambda g: ((g["x0"] + g["x1"]) / 2, (g["y0"] + g["y1"]) / 2)
    weak = [g for g in groups if g["prob"] < marginal]

    def stays(g: dict) -> bool:
        if g["num"] == "1" and g["prob"] < one:
            return False
        near = sum(q is not g and all(abs(a - b) < reach for a, b in zip(mid(g), mid(q), strict=True)) for q in weak)
        return g["prob"] >= marginal or near < crowd

    return [g for g in groups if stays(g)]


def compound_spans(groups: list[dict], gap: float = 1.2, row: float = 0.3, aspect: tuple[float, float] = (1.0, 5.0)) -> list[tuple[int, int]]:
    """Pairs (positions in x order) of neighbouring numbers with room for a slash between them."""
    by_x = sorted(groups, key=lambda g: g["x0"])
    out = []
    for i, a in enumerate(by_x):
        for j in range(i + 1, len(by_x)):
            b = by_x[j]
            h, space = (a["y1"] - a["y0"] + b["y1"] - b["y0"]) / 2, b["x0"] - a["x1"]
            if space > gap * h:
                break
            tall = max(a["y1"], b["y1"]) - min(a["y0"], b["y0"])
            wide = (max(a["x1"], b["x1"]) - a["x0"]) / max(1, tall)
            if space >= -0.1 * h and abs(a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2 <= row * h and aspect[0] <= wide <= aspect[1]:
                out.append((i, j))
    return out


def snapped(ink: np.ndarray, box: tuple[int, int, int, int], reach: int = 3) -> tuple[int, int, int, int] | None:
    """The box of the marks a drawn box means: the component it overlaps most, and those within `reach` of the growing box."""
    labels, n = components(ink != 0)
    if not n:
        return None
    found = boxes_of(labels, n)
    x0, y0, x1, y1 = box
    over = np.clip(np.minimum(found[:, 2], x1) - np.maximum(found[:, 0], x0), 0, None) * np.clip(np.minimum(found[:, 3], y1) - np.maximum(found[:, 1], y0), 0, None)
    if not over.any():
        return None
    own = found[over.argmax(), :4].copy()
    inside = (over > 0) & (found[:, 2] - found[:, 0] <= 2 * (x1 - x0)) & (found[:, 3] - found[:, 1] <= 2 * (y1 - y0))
    while True:
        near = inside & (found[:, 0] <= own[2] + reach) & (found[:, 2] >= own[0] - reach) & (found[:, 1] <= own[3] + reach) & (found[:, 3] >= own[1] - reach)
        grown = np.concatenate([np.minimum(own[:2], found[near, :2].min(0)), np.maximum(own[2:], found[near, 2:4].max(0))]) if near.any() else own
        if (grown == own).all():
            return tuple(int(v) for v in own)
        own = grown


def image_boxes(operations: list[tuple[str, tuple]]) -> list[tuple[float, float, float, float]]:
    """Rectangles of images drawn by a list of (save | restore | transform | image, matrix) operations."""
    state, kept, out = np.eye(3), [], []
    for name, args in operations:
        if name == "save":
            kept.append(state)
        elif name == "restore":
            state = kept.pop() if kept else np.eye(3)
        elif name == "transform":
            a, b, c, d, e, f = args
            state = state @ np.array([[a, c, e], [b, d, f], [0, 0, 1.0]])
        elif name == "image":
            corners = state @ np.array([[0, 1, 0, 1], [0, 0, 1, 1], [1, 1, 1, 1.0]])
            out.append((corners[0].min(), corners[1].min(), corners[0].max(), corners[1].max()))
    return out


# Columns


@F.pandas_udf(T.BinaryType())
def decode_picture(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Row-major 0/1 bytes of group-4 pictures; null for null."""
    return pd.Series([None if d is None else g4_decode(bytes(d), int(w), int(h)).tobytes() for d, w, h in zip(data, width, height, strict=True)])


@F.pandas_udf(T.BinaryType())
def encode_picture(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else g4_encode(np.frombuffer(bytes(p), np.uint8).reshape(int(h), int(w))) for p, w, h in zip(pixels, width, height, strict=True)])


def round_trips(pictures: DataFrame, key: str) -> DataFrame:
    """(key, bytes, same) of pictures (key, pixels, w, h): the length of each one's group-4 form, and whether that reads back as the pixels.

    Null pixels have null bytes, and null again when read back.  One worker of a
    task codes and reads back, from the batch's own memory; of the pictures
    only these figures leave it.
    """

    def judged(batches):
        for batch in batches:
            sizes, same = [], []
            for pixels, w, h in zip(batch["pixels"], batch["w"].to_pylist(), batch["h"].to_pylist(), strict=True):
                if not pixels.is_valid:
                    sizes.append(None)
                    same.append(True)
                    continue
                own = np.frombuffer(pixels.as_buffer(), np.uint8).reshape(h, w)
                coded = g4_encode(own)
                sizes.append(len(coded))
                same.append(bool(np.array_equal(g4_decode(coded, w, h), own)))
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())], names=[key, "bytes", "same"])

    out = T.StructType([pictures.schema[key], T.StructField("bytes", T.LongType()), T.StructField("same", T.BooleanType())])
    return pictures.select(key, "pixels", "w", "h").mapInArrow(judged, out)


CANDIDATES = "section_id long, x0 int, y0 int, x1 int, y1 int, area int, depth int, patch binary"


def candidate_boxes(diagrams: DataFrame) -> DataFrame:
    """Digit-sized components of each diagram (section_id, diagram, width, height) with upper-median depth and patch."""

    def find(batches):
        for pdf in batches:
            out = []
            for s, data, w, h in zip(pdf["section_id"], pdf["diagram"], pdf["width"], pdf["height"], strict=True):
                if data is None:
                    continue
                ink = g4_decode(bytes(data), int(w), int(h))
                labels, n = components(ink != 0)
                depth = nesting_depth(ink)
                for x0, y0, x1, y1, area in candidates(boxes_of(labels, n), int(h), int(w)).tolist():
                    own = np.sort(depth[y0:y1, x0:x1][ink[y0:y1, x0:x1] != 0])
                    out.append((s, x0, y0, x1, y1, area, int(own[len(own) // 2]), patch(np.where(ink, 0, 255), (x0, y0, x1, y1)).astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CANDIDATES.split(", ")])

    return diagrams.select("section_id", "diagram", "width", "height").mapInPandas(find, CANDIDATES)


def onnx_scorer(path: str):
    """A scorer for model_scores(): one inference session for each partition."""

    def make():
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        name = session.get_inputs()[0].name
        return lambda x: session.run(None, {name: x})[0].ravel()

    return make


def model_scores(boxes: DataFrame, scorer, threshold: float = 0.35) -> DataFrame:
    """Candidates with a classifier's probability, fed in batches.

    `scorer` makes, once for each partition, a function from patches (n, 1, 48,
    48) to n probabilities; see onnx_scorer().
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema.fields) + ", prob double, accepted boolean"

    def run(batches):
        score = scorer()
        for pdf in batches:
            x = np.stack([np.frombuffer(p, np.float32).reshape(1, 48, 48) for p in pdf["patch"]]) if len(pdf) else np.zeros((0, 1, 48, 48), np.float32)
            prob = np.asarray(score(x), float) if len(pdf) else np.zeros(0)
            yield pdf.assign(prob=prob, accepted=prob >= threshold)

    return boxes.mapInPandas(run, schema)


NUMBERS = "section_id long, num string, x0 int, y0 int, x1 int, y1 int, prob double"


def numbers_of(digits: DataFrame) -> DataFrame:
    """Callouts of diagrams from accepted candidates with two reads each.

    `digits`: section_id, width, height, x0..y1, prob, and text and confidence of
    two reads (text_a, conf_a, text_b, conf_b).  Digits are grouped, unsure ones
    gated, numbers of zeros dropped; boxes come in ten-thousandths of the diagram.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        own = []
        for r in pdf.sort_values(["x0", "y0", "x1", "y1"]).itertuples():
            read = read_choice((r.text_a or "", r.conf_a or 0), (r.text_b or "", r.conf_b or 0), (r.x1 - r.x0) / max(1, r.y1 - r.y0))
            if read:
                own.append({"text": read[0], "x0": r.x0, "y0": r.y0, "x1": r.x1, "y1": r.y1, "prob": r.prob})
        w, h = float(pdf["width"].iloc[0]), float(pdf["height"].iloc[0])
        rows = [(pdf["section_id"].iloc[0], g["num"], *(int(np.floor(g[k] / side * 10_000 + 0.5)) for k, side in (("x0", w), ("y0", h), ("x1", w), ("y1", h))), float(g["prob"])) for g in gated(grouped_digits(own)) if g["num"].strip("0")]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in NUMBERS.split(", ")])

    return digits.groupBy("section_id").applyInPandas(fold, NUMBERS)


def detected(diagrams: DataFrame, reads: DataFrame, scorer, threshold: float = 0.35, debug: bool = False) -> DataFrame:
    """Callouts of diagrams: components of a digit's size, the classifier's gate, reads of what passes, numbers.

    `reads` (section_id, x0..y1 and both readers' text and confidence) come from
    a recogniser outside.  With `debug` the scored candidates are given instead,
    each with its depth, probability and whether it passed.
    """
    scored = model_scores(candidate_boxes(diagrams), scorer, threshold)
    if debug:
        return scored.drop("patch")
    kept = scored.where("accepted").drop("patch", "area", "depth", "accepted").join(diagrams.select("section_id", "width", "height"), "section_id")
    return numbers_of(kept.join(reads, ["section_id", "x0", "y0", "x1", "y1"], "left"))


def native_rgba(data: bytes, width: int, height: int, kind: str) -> np.ndarray:
    """(height, width, 4) of a picture's own pixels: 1bpp rows padded to bytes with dark bits 0, RGB, or RGBA."""
    raw = np.frombuffer(data, np.uint8)
    if kind == "1bpp":
        bits = np.unpackbits(raw.reshape(height, -1), axis=1)[:, :width]
        grey = np.where(bits, 255, 0).astype(np.uint8)
        return np.dstack([grey, grey, grey, np.full_like(grey, 255)])
    if kind == "rgb":
        rgb = raw.reshape(height, width, 3)
        return np.dstack([rgb, np.full((height, width), 255, np.uint8)])
    if kind == "rgba":
        return raw.reshape(height, width, 4)
    raise ValueError(f"pixels of kind {kind}")


def resampled(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """A grey picture at another size, each new pixel the mean of the area it covers."""
    out = area_weights(grey.shape[0], height) @ grey.astype(float) @ area_weights(grey.shape[1], width).T
    return np.floor(out + 0.5).astype(np.uint8)


def region(grey: np.ndarray, box: tuple[int, int, int, int], margin: int = 0, paper: int = 255) -> np.ndarray:
    """A box of a picture with a margin of paper around it; outside the picture is paper too."""
    x0, y0, x1, y1 = box[0] - margin, box[1] - margin, box[2] + margin, box[3] + margin
    out = np.full((y1 - y0, x1 - x0), paper, grey.dtype)
    a, b, c, d = max(0, box[0]), max(0, box[1]), min(grey.shape[1], box[2]), min(grey.shape[0], box[3])
    if a < c and b < d:
        out[b - y0 : d - y0, a - x0 : c - x0] = grey[b:d, a:c]
    return out


def picture_codec(rgb: np.ndarray) -> str:
    """`g4` for line art, `raster` for pictures with tones between."""
    return "raster" if continuous_tone(rgb) else "g4"


def with_pictures(sections: DataFrame, diagrams: DataFrame) -> DataFrame:
    """Sections that have a diagram, by number; the pictures themselves are not read."""
    return sections.join(diagrams.where("diagram IS NOT NULL").select(diagrams.section_id.alias("id")).distinct(), "id", "left_semi").orderBy("number")


def store_patches(labelled: DataFrame, path: str) -> None:
    """Write labelled patches as a Parquet dataset by catalogue, for training elsewhere."""
    labelled.write.mode("overwrite").partitionBy("catalog").parquet(path)
