"""Packing by shortest-pack-first over the length histogram (operator 4)."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import give_back
from .pretokens import classes
from .store import materialize, ranked, ship, table
from .tokens import Encoder, Ids, text_runs, worker_encoder

PIECES = "doc_id long, part int, start long, length long, ids_crc32 long, doc_tokens long"


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a pattern, number of its packs), for a histogram length -> count.

    Lengths are placed longest first.  Each goes into the pattern with the most
    room left, the shortest pack, that holds it; a pattern with more packs than
    documents left is split, and documents left over open new packs.  All work
    is on counts: at most `capacity` lengths, however many documents there are.
    """
    open_packs: dict[int, list[list]] = defaultdict(list)  # room left -> [lengths, packs]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = capacity - 1
        while left > 0:
            while room >= length and not open_packs[room]:
                room -= 1
            if room < length:
                open_packs[capacity - length].append([[length], left])
                break
            lengths, packs = open_packs[room].pop()
            used = min(packs, left)
            if packs > used:
                open_packs[room].append([lengths, packs - used])
            open_packs[room - length].append([[*lengths, length], used])
            left -= used
    return [(lengths, packs) for room in sorted(open_packs) for lengths, packs in open_packs[room]]


def placements(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): the ranks of a length that fill one place of a pattern."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, packs in patterns:
        offset = 0
        for n in lengths:
            out.append((n, taken[n], taken[n] + packs - 1, sequence, offset))
            taken[n] += packs
            offset += n
        sequence += packs
    return out


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's ids and `end_id`, cut into full pieces of `capacity` and a rest."""

    own = Encoder(path)
    shared = docs.sparkSession.sparkContext.broadcast(classes(own.model) if own.split else None)

    def cut(batches):
        give_back()
        encoder = worker_encoder(path, "ids")
        if encoder.split and encoder.ider is None:
            encoder.ider = Ids(encoder, shared.value)
        ids_of = encoder.ider or encoder.ids
        closing = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for at, run in text_runs(batch.column(1).to_pylist()):
                for k, ids in zip(keys[at : at + len(run)], ids_of(run), strict=True):
                    ids = ids.astype("<u4").tobytes() + closing
                    n = len(ids) // 4
                    for part, start in enumerate(range(0, n, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        rows.append((k, part, start, len(own) // 4, zlib.crc32(own), n))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "part", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack every document into sequences of at most `capacity` tokens.

    One row a piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset).  Sequence ids are gapless from 0.  Full pieces are patterns of their
    own; the rests' length histogram, at most `capacity` rows, is packed on the
    driver and the patterns are joined back by each piece's rank among pieces of
    its length.  A null text counts as empty (its end id alone); long texts are
    cut into several pieces; a null doc_id is kept; repeated rows are packed once
    each; equal lengths go by (doc_id, start, ids_crc32); an empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    cut = materialize(pieces(docs, path, capacity, end_id, doc_id, text), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = placements(shortest_pack_first(histogram, capacity))
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    numbered = ranked(cut, ["length"], order, ["doc_id", "start"], "rank")
    # at most about two places for each length and pattern: bounded by `capacity`, not by the corpus
    grid = spark.createDataFrame(places or [(0, 0, -1, 0, 0)], "length long, low long, high long, sequence long, offset long").withColumnRenamed("length", "own")
    fits = (F.col("length") == F.col("own")) & F.col("rank").between(F.col("low"), F.col("high"))
    return numbered.join(F.broadcast(grid), fits).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
