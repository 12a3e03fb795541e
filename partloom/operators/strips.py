"""Connected components of large pictures: runs as rows, joined within strips of lines, then over the strips' edges.

A strip is a task's work whatever the picture's size.  What meets in one task for
each picture is the links between strips, at most the runs of one line in ROWS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .imaging import g4_decode
from .ranges import box_pairs

#: Lines of a strip, and columns of the cells in which runs of neighbouring lines meet.
ROWS, REACH = 64, 256

RUNS = "section_id long, y int, x0 int, x1 int"
PARTS = "section_id long, part long, x0 int, y0 int, x1 int, y1 int, area long, line int"


def picture_runs(diagrams: DataFrame) -> DataFrame:
    """(section_id, y, x0, x1): dark runs of group-4 pictures (section_id, diagram, width, height, and top: the line its first row is).

    A picture may come in bands, each coded by itself, with their `top`s; a null
    picture has none.
    """
    own = diagrams if "top" in diagrams.columns else diagrams.withColumn("top", F.lit(0))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, data, w, h, top in zip(pdf["section_id"], pdf["diagram"], pdf["width"], pdf["height"], pdf["top"], strict=True):
                if data is None:
                    continue
                edge = np.diff(np.pad(g4_decode(bytes(data), int(w), int(h)).astype(np.int8), ((0, 0), (1, 1))), axis=1)
                y, x0 = np.nonzero(edge == 1)
                yield pd.DataFrame({"section_id": s, "y": (y + int(top)).astype(np.int32), "x0": x0.astype(np.int32), "x1": np.nonzero(edge == -1)[1].astype(np.int32)})

    return own.select("section_id", "diagram", "width", "height", "top").mapInPandas(find, RUNS)


def joined(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is linked with, by the links (first, second)."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in zip(first.tolist(), second.tolist(), strict=True):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)], np.int64)


def strip_parts(rows: int):
    """A function of a strip's runs that gives its parts: box and area of each, and again each run of the first and last line with its part.

    Part numbers are unique in a picture: the strip, then the part's first run.
    """

    def find(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x0"], ignore_index=True)
        y, x0, x1 = (pdf[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
        # runs of the line below that begin before a run ends and end behind its beginning
        wide = int(x1.max()) + 1
        starts, ends = y * wide + x0, y * wide + x1
        low, high = np.searchsorted(ends, starts + wide, "right"), np.searchsorted(starts, ends + wide, "left")
        n = np.maximum(high - low, 0)
        first = np.repeat(np.arange(len(y)), n)
        second = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        part = joined(first, second, len(y)) + (int(key[1]) << 32)
        runs = pd.DataFrame({"part": part, "x0": x0, "y0": y, "x1": x1, "y1": y + 1, "area": x1 - x0})
        whole = runs.groupby("part", as_index=False).agg({"x0": "min", "y0": "min", "x1": "max", "y1": "max", "area": "sum"}).assign(line=-1)
        edge = runs[(y % rows == 0) | (y % rows == rows - 1)]
        out = pd.concat([whole, edge.assign(line=edge["y0"])], ignore_index=True)
        out.insert(0, "section_id", key[0])
        return out

    return find


def component_boxes(runs: DataFrame, rows: int = ROWS) -> DataFrame:
    """(section_id, x0, y0, x1, y1, area) of each 4-connected component of pictures' runs, ends exclusive."""
    parts = runs.withColumn("strip", F.floor(F.col("y") / rows)).groupBy("section_id", "strip").applyInPandas(strip_parts(rows), PARTS)
    lines = parts.where("line >= 0").select(F.struct("section_id", "line").alias("place"), "section_id", "line", "part", "x0", F.lit(0).alias("y0"), "x1", F.lit(1).alias("y1"))
    above = lines.where(F.col("line") % rows == rows - 1).withColumn("place", F.struct("section_id", (F.col("line") + 1).alias("line")))
    met = box_pairs(above, lines.where(F.col("line") % rows == 0), "place", REACH).select("a.section_id", F.col("a.part").alias("first"), F.col("b.part").alias("second")).distinct()

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(pdf[["first", "second"]].to_numpy(np.int64), return_inverse=True)
        at = at.reshape(-1, 2)
        return pd.DataFrame({"section_id": pdf["section_id"].iloc[0], "part": names, "whole": names[joined(at[:, 0], at[:, 1], len(names))]})

    united = met.groupBy("section_id").applyInPandas(unite, "section_id long, part long, whole long")
    own = parts.where("line < 0").join(united, ["section_id", "part"], "left")
    return own.groupBy("section_id", F.coalesce("whole", "part").alias("_whole")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("area").alias("area")).drop("_whole")


def digit_sized(boxes: DataFrame, pictures: DataFrame, least_height: int = 8, most: float = 0.06, least_area: int = 12) -> DataFrame:
    """Boxes of the size of a printed digit, by the size of their picture (section_id, width, height)."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sized = boxes.join(pictures.groupBy("section_id").agg(F.max("width").alias("width"), F.max("height").alias("height")), "section_id")
    return sized.where((h >= least_height) & (h <= most * F.col("height")) & (w <= most * F.col("width")) & (F.col("area") >= least_area)).drop("width", "height")
