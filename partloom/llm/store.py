"""Shared-folder tables, code shipping and small session helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent.parent


#: Rows and bytes of an Arrow batch: a worker holds a few at once, whatever the texts' lengths.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor (once for each context)."""
    sc = spark.sparkContext
    for name, most in BATCH.items():
        spark.conf.set(name, most)
    if getattr(sc, "_partloom_shipped", False):
        return
    zipped = os.path.join(tempfile.mkdtemp(), "partloom.zip")
    with zipfile.ZipFile(zipped, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, Path(_PACKAGE.name) / p.relative_to(_PACKAGE))
    sc.addPyFile(zipped)
    sc._partloom_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where a local session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='partloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held, held.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write `df` to the shared folder and read it back.

    The table is deleted by discard(), or else when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held, system = _hadoop_path(spark, path)
    system.deleteOnExit(held)
    back = spark.read.schema(df.schema).parquet(path)
    back._partloom_path = path
    return back


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that no later read needs."""
    spark = df.sparkSession
    path, system = _hadoop_path(spark, df._partloom_path)
    system.delete(path, True)
    # shuffle files go once nothing on the driver refers to them
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: list[str], order: list[str], spread: list[str], out: str, cells: int | None = None) -> DataFrame:
    """Gapless 0-based rank `out` within `group`, whatever the size of a group.

    Rows of a group are dealt over `cells` cells by a hash of `spread`; a window
    numbers each cell and the cells' sizes, at most `cells` rows a group, give
    the offsets.  No task sees a whole group.
    """
    from pyspark.sql import Window as W

    cells = cells or max(64, shuffle_width(df.sparkSession))
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(*spread), F.lit(cells)).cast("int"))
    sizes = dealt.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*group).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_cell").alias("_c"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    same = F.col("_cell") == F.col("_c")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = F.row_number().over(W.partitionBy(*group, "_cell").orderBy(*order)) - 1
    return dealt.withColumn("_within", within).join(starts, same, "left").withColumn(out, (F.col("_start") + F.col("_within")).cast("long")).drop("_cell", "_c", "_start", "_within", *[f"_g{i}" for i in range(len(group))])


def most_counted(counted: DataFrame, most: int, n: str = "n", key: str = "key") -> DataFrame:
    """Rows of the highest counts `n`, about `most` of them, without sorting or a top list of every task.

    A histogram of counts gives the bound; of the counts at the bound, which are
    alike to within a sixteenth of a power of two, a hash of `key` takes a share.
    """
    bin_ = F.floor(F.log2(F.col(n)) * 16).cast("int")
    bins = sorted(((r.b, r.c) for r in counted.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    room, low, share = most, None, 1.0
    for b, c in bins:
        low = b
        if c > room:
            share = room / c
            break
        room -= c
    if low is None:
        return counted
    lucky = F.pmod(F.xxhash64(F.lit(77), F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20))
    return counted.where((bin_ > low) | ((bin_ == low) & lucky))


#: Words of 64 bits in a sieve, at most, and bits for each of its keys.
SIEVE_WORDS, SIEVE_BITS = 1 << 20, 16


class Sieve:
    """A bitmap of hashed keys: `words` rows (w, bits) at most, so its broadcast has a fixed bound; None lets all pass."""

    def __init__(self, rows: DataFrame | None, words: int):
        self.rows, self.words = rows, words


def sieve(keys: DataFrame, key: str) -> Sieve:
    """A sieve sized by the number of `keys`, for sifted(); none where they are too many for a small broadcast."""
    n, words = keys.count(), 1 << 10
    while words * 64 < n * SIEVE_BITS:
        words *= 2
    if words > SIEVE_WORDS:
        return Sieve(None, 0)
    bit = F.pmod(F.xxhash64(key), F.lit(words * 64))
    marked = keys.select(F.shiftright(bit, 6).alias("w"), (bit % 64).cast("int").alias("b"))
    return Sieve(materialize(marked.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits")), "sieve"), words)


def sifted(df: DataFrame, key: str, held: Sieve, inside: bool = True) -> DataFrame:
    """Rows whose key may be in the sieve, or with inside=False those whose key surely isn't.

    An exact join must follow where keys inside matter; only its work depends on
    the sieve.
    """
    if held.rows is None:
        return df if inside else df.where(F.lit(False))
    w, bits = fresh(df.columns, "w", "bits")
    bit = F.pmod(F.xxhash64(key), F.lit(held.words * 64))
    hit = (F.shiftright(bit, 6) == F.col(w)) & (F.getbit(F.col(bits), (bit % 64).cast("int")) == 1)
    return df.join(F.broadcast(held.rows.toDF(w, bits)), hit, "left_semi" if inside else "left_anti")
