"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize


def _both(edges: DataFrame) -> DataFrame:
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.explode(ways).alias("e")).select("e.a", "e.b")


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours of every node to the least of them and it."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")) if large else pairs.groupBy("a").agg(F.min("b").alias("m"))
    linked = pairs.join(least, "a")
    if large:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    both = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
    return linked.select(F.explode(both).alias("e")).select("e.a", "e.b").where("a != b").distinct()


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of every node with an edge (a, b); the component is its least node.

    Rounds go on until one changes nothing; RuntimeError if `rounds` are given and
    run out before.

    All state is the edge table, written to the shared folder each round; a round
    never adds edges, and hubs are reduced by aggregates before they are joined.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    told = None
    for turn in count():
        if turn == rounds:
            discard(now)
            raise RuntimeError(f"components are not finished after {rounds} rounds")
        wide = _star(_both(now), True)
        new = materialize(_star(wide.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False), "edges")
        sums = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
        discard(now)
        now = new
        if told == sums:
            break
        told = sums
    return now.groupBy("a").agg(F.min("b").alias("c")).select(F.col("a").alias("node"), F.col("c").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
