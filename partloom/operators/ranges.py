"""Range, as-of and containment joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.serials import serial_key
from ..functions.text import blank


#: Bin widths of ranges, as powers of two: a range takes the least that is no shorter than it, and two bins at most.
BIN_BITS = (8, 12, 16, 20, 24, 32, 40, 62)


def serial_range_join(serials: DataFrame, ranges: DataFrame, serial: str = "serial", low: str = "vin_from", high: str = "vin_to") -> DataFrame:
    """Every range that holds each serial: prefix and serial bin hash, the bounds are a residual.

    An empty end is open; an end of another prefix leaves the start alone.  Each
    range stands in the one or two bins of its own width that it touches, each
    serial in its bin of every width that occurs, so a prefix with many ranges is
    spread over its bins and no pair meets twice.
    """
    left = serials.withColumn("_k", serial_key(F.col(serial))).where("_k IS NOT NULL").withColumn("_prefix", F.col("_k.prefix"))
    lo, hi = serial_key(F.col(low)), serial_key(F.col(high))
    top = F.when(hi["prefix"] == lo["prefix"], hi["serial"]).when(blank(F.trim(F.coalesce(F.col(high), F.lit("")))).isNull(), F.lit(2**62 - 1)).otherwise(lo["serial"])
    right = ranges.withColumn("_lo", lo).where("_lo IS NOT NULL").withColumn("_p", F.col("_lo.prefix")).withColumn("_top", top)
    length = F.col("_top") - F.col("_lo.serial")
    width = F.coalesce(*[F.when(length < 2**b, F.lit(b)) for b in BIN_BITS[:-1]], F.lit(BIN_BITS[-1]))
    right = right.withColumn("_w", width)
    widths = sorted(r._w for r in right.select("_w").distinct().collect())  # at most one for each of BIN_BITS
    bin_of = lambda v: reduce(lambda chain, b: chain.when(F.col("_w") == b, F.shiftright(v, b)), BIN_BITS[1:], F.when(F.col("_w") == BIN_BITS[0], F.shiftright(v, BIN_BITS[0])))
    right = right.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(F.col("_lo.serial")), bin_of(F.col("_top")))))).withColumnRenamed("_w", "_rw").withColumnRenamed("_bin", "_rb")
    left = left.withColumn("_w", F.explode(F.array(*map(F.lit, widths)).cast("array<int>"))).withColumn("_bin", bin_of(F.col("_k.serial")))
    hit = (F.col("_prefix") == F.col("_p")) & (F.col("_w") == F.col("_rw")) & (F.col("_bin") == F.col("_rb")) & F.col("_k.serial").between(F.col("_lo.serial"), F.col("_top"))
    return left.join(right, hit).drop("_k", "_prefix", "_lo", "_p", "_top", "_w", "_rw", "_bin", "_rb")


def assigned_column(x: Column, origins: Column, slack: float = 5.0) -> Column:
    """The name of the rightmost origin (x, name), sorted by x, at or left of x + slack; else the first."""
    left = F.filter(origins, lambda o: o["x"] <= x + slack)
    return F.when(F.size(left) > 0, F.element_at(left, -1)["name"]).otherwise(F.get(origins, 0)["name"])


#: Edge of the cells that boxes are dealt over; a page is 10,000 units wide and high.
CELL = 512


def box_pairs(left: DataFrame, right: DataFrame, key: str, cell: int = CELL, tasks: int | None = None) -> DataFrame:
    """(a, b): rows of both sides, as structs, whose boxes x0..y1 share an area within the same `key`, each pair once.

    A box stands in every cell of a grid that it touches, and a pair meets in
    each cell that both touch; it counts in the one that has the corner where
    their common area begins.  So a diagram is never paired with itself as a whole,
    and one with very many boxes is spread over its cells.  Boxes without an area
    or with a null meet nothing.  `tasks` is how many tasks the cells are dealt
    over, the session's number by default.  Columns stay flat until pairs are
    there, so what nobody reads isn't shuffled.
    """

    def placed(df: DataFrame, name: str) -> DataFrame:
        first, last = (lambda c: F.floor(F.col(c) / cell).cast("int")), (lambda c: F.ceil(F.col(c) / cell).cast("int") - 1)
        own = [f"_{name}_{c}" for c in df.columns]
        solid = df.where("x1 > x0 AND y1 > y0").select(*[F.col(c).alias(o) for c, o in zip(df.columns, own, strict=True)], F.sequence(first("x0"), last("x1")).alias("_xs"), F.sequence(first("y0"), last("y1")).alias("_ys"))
        out = solid.withColumn("_x", F.explode("_xs")).withColumn("_y", F.explode("_ys")).select(*own, F.col(f"_{name}_{key}").alias("_key"), "_x", "_y")
        return out.repartition(tasks, "_key", "_x", "_y") if tasks else out

    corner = lambda c: F.greatest(f"_a_{c}0", f"_b_{c}0")
    met = placed(left, "a").join(placed(right, "b"), ["_key", "_x", "_y"])
    shared = (corner("x") < F.least("_a_x1", "_b_x1")) & (corner("y") < F.least("_a_y1", "_b_y1"))
    sides = [F.struct(*[F.col(f"_{name}_{c}").alias(c) for c in df.columns]).alias(name) for df, name in ((left, "a"), (right, "b"))]
    return met.where(shared & (F.floor(corner("x") / cell) == F.col("_x")) & (F.floor(corner("y") / cell) == F.col("_y"))).select(*sides)


def best_containment(candidates: DataFrame, boxes: DataFrame, key: str, least: float = 0.6) -> DataFrame:
    """The box of each candidate that holds the largest fraction of it, at least `least` (over 0), and its centre.

    Both have `key`, x0, y0, x1, y1; candidates candidate_id, boxes box_id.
    """
    w = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    h = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    fraction = w * h / ((F.col("a.x1") - F.col("a.x0")) * (F.col("a.y1") - F.col("a.y0")))
    mid = lambda c: (F.col(f"a.{c}0") + F.col(f"a.{c}1")) / 2
    inside = mid("x").between(F.col("b.x0"), F.col("b.x1")) & mid("y").between(F.col("b.y0"), F.col("b.y1"))
    hits = box_pairs(candidates, boxes, key).withColumn("fraction", fraction).where(inside & (F.col("fraction") >= least))
    return hits.groupBy(F.col(f"a.{key}").alias(key), F.col("a.candidate_id").alias("candidate_id")).agg(F.max(F.struct("fraction", (-F.col("b.box_id")).alias("_o"), F.col("b.box_id").alias("box_id"))).alias("m")).select(key, "candidate_id", "m.box_id", "m.fraction")
