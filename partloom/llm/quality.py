"""Importance resampling with hashed n-gram models (operator 1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernel import BLANK_SPLIT, U64, blocks, mix, word_hashes, word_spans
from .store import materialize, ship, table

BUCKETS = 1 << 14
#: Labelled target rows whose texts make the target model, at most, chosen by a hash of their id.
TARGET_ROWS = 20_000


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and pair of neighbouring words, case and marks kept."""
    starts, ends, first = word_spans(data, offsets, BLANK_SPLIT)
    words = word_hashes(data, starts, ends, None)
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    with np.errstate(over="ignore"):
        pairs = mix(words[:-1] * U64(0xC2B2AE3D27D4EB4F) + words[1:]) if len(words) > 1 else words[:0]
    same = own[:-1] == own[1:]
    both = np.concatenate([words, pairs[same] if len(pairs) else pairs])
    return np.concatenate([own, own[:-1][same]]), (both >> U64(40)).astype(np.int64) % buckets


def log_ratios(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, smooth: float = 1.0) -> np.ndarray:
    """log(target / raw) of each bucket: raw counts over all of `docs`, target counts over its rows in `target` (doc_id)."""
    ship(docs.sparkSession)
    # at most TARGET_ROWS ids: a bounded broadcast
    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(target.select("doc_id", F.lit(True).alias("target"))), "doc_id", "left").select(F.coalesce("target", F.lit(False)).alias("target"), "text")

    def count(batches):
        raw, aim = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            flags = batch.column(0).to_numpy(zero_copy_only=False)
            for first, end, data, offsets in blocks(batch.column(1)):
                own, bucket = grams(data, offsets, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                aim += np.bincount(bucket[flags[first:end][own]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(aim[used])], names=["bucket", "raw", "aim"])

    raw, aim = np.full(buckets, smooth), np.full(buckets, smooth)
    for r in flagged.mapInArrow(count, "bucket long, raw long, aim long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("aim").alias("aim")).collect():
        raw[r.bucket] += r.raw
        aim[r.bucket] += r.aim
    return np.log(aim / aim.sum()) - np.log(raw / raw.sum())


def weighed(docs: DataFrame, ratios: np.ndarray, seed: int = 0) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key) of every row; the key is the weight and Gumbel noise from the id."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def apply(batches):
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column(1)):
                own, bucket = grams(data, offsets, len(shared.value))
                n = np.bincount(own, minlength=end - first)
                w = np.bincount(own, weights=shared.value[bucket], minlength=end - first).astype(float)
                noise = batch.column(2).slice(first, end - first).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n.astype(np.int64)), pa.array(w), pa.array(w - np.log(-np.log(noise)))], names=["doc_id", "n_grams", "log_weight", "gumbel_key"])

    luck = (F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), F.lit((1 << 52) - 1)) + 1) / float(1 << 52)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", luck.cast("double").alias("luck")).mapInArrow(apply, "doc_id long, n_grams long, log_weight double, gumbel_key double")


def band_floors(df: DataFrame, k: DataFrame) -> DataFrame:
    """(band, floor): the k-th largest `gumbel_key` of each band, exactly, where `k` has (band, k) with k of 1 or more.

    Histograms of at most 1024 bins a band narrow the floors down on the
    executors; the driver sees bins alone, of at most 64 bands.
    """
    spark, left, done = df.sparkSession, {}, []
    wanted = {r.band: r.k for r in k.collect()}
    ends = df.groupBy("band").agg(F.min("gumbel_key").alias("low"), F.max("gumbel_key").alias("high")).collect()
    for r in ends:
        if r.band in wanted:
            left[r.band] = (float(r.low), float(r.high), wanted[r.band])
    while left:
        for band, (low, high, _) in list(left.items()):
            width = (high - low) / 1024
            if low >= high or low + width <= low:
                done.append((band, low))
                del left[band]
        if not left:
            break
        # at most 64 rows: a bounded broadcast
        now = F.broadcast(spark.createDataFrame([(b, lo, hi, (hi - lo) / 1024) for b, (lo, hi, _) in left.items()], "band int, low double, high double, width double"))
        inside = df.select("band", "gumbel_key").join(now, "band").where(F.col("gumbel_key").between(F.col("low"), F.col("high")))
        bins = inside.groupBy("band", F.least(F.floor((F.col("gumbel_key") - F.col("low")) / F.col("width")), F.lit(1023)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("gumbel_key").alias("lo"), F.max("gumbel_key").alias("hi")).collect()
        for band, (low, high, need) in list(left.items()):
            for r in sorted((r for r in bins if r.band == band), key=lambda r: -r.bin):
                if need <= r.n:
                    if (r.lo, r.hi) == (low, high):
                        done.append((band, r.lo if r.n == need or r.lo == r.hi else _within(df, band, low, high, need)))
                        del left[band]
                    else:
                        left[band] = (r.lo, r.hi, need)
                    break
                need -= r.n
    return spark.createDataFrame(done, "band int, floor double")


def _within(df: DataFrame, band: int, low: float, high: float, need: int) -> float:
    """The need-th largest key where one bin holds all that are left: by halving."""
    own = df.where((F.col("band") == band) & F.col("gumbel_key").between(low, high))
    while low < high:
        middle = low + (high - low) / 2
        above = own.where(F.col("gumbel_key") > middle).agg(F.count(F.lit(1)).alias("n"), F.min("gumbel_key").alias("lo")).first()
        if above.n >= need:
            low = above.lo
            if own.where(F.col("gumbel_key") >= low).count() == need or low == high:
                return low
        else:
            high = own.where(F.col("gumbel_key") <= middle).agg(F.max("gumbel_key").alias("hi")).first().hi
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 0, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Gumbel top-k sample of documents by their importance for the target, within bands of length.

    The target is labels' rows of quality 1, at most `target_rows` of them; the
    raw model counts every document.  A document's log weight is a sum over its
    n-grams, so it grows with the text: documents compete within bands of the
    binary logarithm of their n-grams, and each band keeps `share` of its rows, by
    default the labelled rows' share of quality 1 (rounded so that the bands'
    sum is the share of all).  Rows: (doc_id, n_grams, log_weight, gumbel_key,
    band, keep = true), all with a key of their band's k-th largest or more, so
    rows of equal keys are treated alike: repeated rows stay or go together.  A
    null or empty text has weight 0 and band 0; long texts are read whole; a null
    doc_id has the noise of its own; without labelled target rows every weight is
    0 and every document is kept; an empty table gives no rows; other columns are
    not read.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    n, good = (known.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") == 1).cast("long")).alias("g")).first())
    share = (good / n if n and good else 1.0) if share is None else share
    target = known.where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows)
    ratios = log_ratios(docs, target) if good else np.zeros(BUCKETS)
    banded = weighed(docs, ratios, seed).withColumn("band", F.ceil(F.log2(F.col("n_grams") + 1)).cast("int"))
    all_rows = materialize(banded, "weights")
    # at most 64 bands: running sums of the shares are rounded, so the parts add up
    upto = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    sizes = all_rows.groupBy("band").agg(F.count(F.lit(1)).alias("rows")).withColumn("upto", F.round(F.sum("rows").over(upto) * F.lit(float(share))).cast("long"))
    quotas = sizes.select("band", (F.col("upto") - F.lag("upto", 1, 0).over(Window.orderBy("band"))).alias("k")).where("k > 0")
    floors = F.broadcast(band_floors(all_rows, quotas))
    return all_rows.join(floors, "band").where("gumbel_key >= floor").select("doc_id", "n_grams", "log_weight", "gumbel_key", "band", F.lit(True).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
