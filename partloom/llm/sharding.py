"""Sharding by balanced label propagation (operator 3)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import discard, materialize, ranked, table

#: Cells over which the documents of one group are dealt, so no group is one key.
CELLS = 64
GROUP = ["h", "text_crc32", "size"]


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1)


def quotas(wanted: np.ndarray, loads: np.ndarray, most: float) -> np.ndarray:
    """The share of each wanted flow (from, to) that keeps every shard at `most` rows or fewer.

    A shard that would be too full takes its inflow in proportion; what stays
    where it was may fill other shards, so this repeats until all fit.
    """
    share = np.ones_like(wanted, float)
    for _ in range(200):
        flow = wanted * share
        after = loads - flow.sum(1) + flow.sum(0)
        over = np.flatnonzero((after > most + 1e-6) & (flow.sum(0) > 0))
        if not len(over):
            break
        for t in over:
            share[:, t] *= max(0.0, 1 - (after[t] - most) / flow[:, t].sum())
    return share


def propagate(docs: DataFrame, shards: int, rounds: int) -> DataFrame:
    """Labels of linked documents: (group, cell, origin) -> shard, and the rows of that table.

    Linked documents (equal texts) start where a hash of their id puts them.  In
    every round each part of a group wants to be where most of it is, as far as
    the shards' quotas allow.  Documents of one group, cell and origin move
    alike, so rounds work on counts.  A group of more than half a shard is cut
    into parts first, by cells, which start in a shard each.
    """
    total = docs.count()
    capacity = max(1.0, total / shards)
    cells = docs.groupBy(*GROUP, "cell", "origin").agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy(*GROUP).agg(F.sum("n").alias("members")).where("members > 1")
    parts = F.least(F.lit(CELLS), F.ceil(F.col("members") / max(1.0, capacity / 2))).cast("int")
    part = F.pmod("cell", parts)
    start = F.when(parts > 1, F.pmod(F.col("h") + part, F.lit(shards)).cast("int")).otherwise(F.col("origin"))
    state = materialize(cells.join(sizes, GROUP).select(*GROUP, "cell", "origin", "n", part.alias("part"), start.alias("shard")), "labels")
    for turn in range(rounds):
        homes = state.groupBy(*GROUP, "part", "shard").agg(F.sum("n").alias("n"))
        best = homes.groupBy(*GROUP, "part").agg(F.max(F.struct("n", (-F.pmod(F.xxhash64("h", "part", "shard"), F.lit(1 << 20))).alias("tie"), "shard"))["shard"].alias("target"))
        moving = state.join(best, [*GROUP, "part"])
        wanted = np.zeros((shards, shards))
        for r in moving.where("shard != target").groupBy("shard", "target").agg(F.sum("n").alias("n")).collect():
            wanted[r.shard, r.target] = r.n
        if not wanted.sum():
            break
        share = quotas(wanted, linked_loads(state, shards), total // shards)
        admit = _pick([int(x * 1_000_000) for x in share.ravel()], F.col("shard") * shards + F.col("target"))
        luck = F.pmod(F.xxhash64("h", "part", "cell", "origin", F.lit(turn)), F.lit(1_000_000))
        new = materialize(moving.select(*GROUP, "cell", "origin", "n", "part", F.when(luck < admit, F.col("target")).otherwise(F.col("shard")).alias("shard")), "labels")
        discard(state)
        state = new
    return state


def linked_loads(state: DataFrame, shards: int) -> np.ndarray:
    """Linked rows of each shard now; unlinked rows cut no edge wherever they fill up."""
    loads = np.zeros(shards)
    for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        loads[r.shard] = r.n
    return loads


def shard(docs: DataFrame, shards: int = 24, rounds: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into one of `shards` shards, counts at most one apart (law `rows`).

    (doc_id, size, text_crc32, law, shard, slot, grown_shard).  Links join equal
    texts; label propagation gathers them under quotas, then the rows by which
    shards are too full go where rows lack, unlinked ones first, which makes the
    counts exact.  Slots are gapless from 0 in each shard.  A null text has size
    8 and the checksum of an empty one, and null and empty texts are one group; a
    null doc_id is kept; repeated rows are linked rows; long texts count by their
    whole size; equal (doc_id, checksum, size) go in any order; an empty table
    gives no rows; other columns are not read.  Native DataFrame operations only.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = materialize(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("h")).select(
            "*", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int").alias("origin"), F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(CELLS)).cast("int").alias("cell")
        ),
        "rows",
    )
    labels = propagate(base, shards, rounds)
    spot = [*GROUP, "cell", "origin"]
    placed = materialize(base.join(labels.select(*spot, F.col("shard").alias("label")), spot, "left").select("doc_id", "size", "text_crc32", F.coalesce("label", "origin").alias("shard"), F.col("label").isNotNull().cast("int").alias("linked")), "placed")
    free, load = np.zeros(shards, int), np.zeros(shards, int)
    for r in placed.groupBy("shard", "linked").count().collect():
        load[r.shard] += r["count"]
        free[r.shard] += r["count"] * (not r.linked)
    goal = np.full(shards, load.sum() // shards)
    goal[np.argsort(-load, kind="stable")[: load.sum() % shards]] += 1
    surplus, lack = np.maximum(load - goal, 0), np.maximum(goal - load, 0)
    before, filled = np.cumsum(surplus) - surplus, np.cumsum(lack)
    order = ["doc_id", "text_crc32", "size"]
    numbered = ranked(placed, ["shard", "linked"], order, ["doc_id", "text_crc32"], "_r").withColumn("_r", F.col("_r") + F.col("linked") * _pick(free.tolist(), F.col("shard")))
    at = _pick(before.tolist(), F.col("shard")) + F.col("_r")
    target = sum(((at >= F.lit(int(f))).cast("int") for f in filled), F.lit(0))
    moved = F.when(F.col("_r") < _pick(surplus.tolist(), F.col("shard")), target).otherwise(F.col("shard")).cast("int")
    final = materialize(numbered.select("doc_id", "size", "text_crc32", moved.alias("shard")), "final")
    return ranked(final, ["shard"], order, ["doc_id", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
