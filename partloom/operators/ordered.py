"""Ordered folds as windows: latches, carry-down, records with continuations, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scanned(df: DataFrame, states: dict[str, tuple[str, Column]], partition: list[str], order: list[str], segment: str, own: bool = True) -> DataFrame:
    """Running states of a partition's rows, without a task that sees the whole partition.

    `states` gives each new column's kind and value: `sum`, `max`, or `last` (the
    last value that isn't null).  `segment` is a column that never falls in the
    order, as a page or a block of positions.  A window folds each segment, one
    over the segments' ends, a row for each, folds what comes before it, and the
    two are put together.  With own=False a row's own value is left out.  Where
    nothing came before, sums are 0 and the others null.
    """
    keys = [*partition, segment]
    valued = df.withColumns({f"_v_{n}": v for n, (_, v) in states.items()})
    at_end = {"sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))}
    so_far = {"sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "last": lambda c: F.last(c, ignorenulls=True)}
    together = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(b, a)}
    ends = valued.groupBy(*keys).agg(*[at_end[kind](f"_v_{n}").alias(f"_e_{n}") for n, (kind, _) in states.items()])
    earlier = Window.partitionBy(*partition).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[so_far[kind](f"_e_{n}").over(earlier).alias(f"_b_{n}") for n, (kind, _) in states.items()])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    local = valued.withColumns({f"_l_{n}": so_far[kind](f"_v_{n}").over(inside) for n, (kind, _) in states.items()})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(before, same).select(*df.columns, *[together[kind](F.col(f"_b_{n}"), F.col(f"_l_{n}")).alias(n) for n, (kind, _) in states.items()])


def _before(partition: list[str], order: list[str]):
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _upto(partition: list[str], order: list[str]):
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def latched(df: DataFrame, opens: Column, partition: list[str], order: list[str], out: str = "in_data", segment: str | None = None) -> DataFrame:
    """Whether some earlier row opened the table.  With a `segment` column (see scanned) a partition is spread over its segments."""
    if segment:
        return scanned(df, {out: ("max", opens.cast("int"))}, partition, order, segment, own=False).withColumn(out, F.coalesce(out, F.lit(0)) == 1)
    return df.withColumn(out, F.coalesce(F.max(opens.cast("int")).over(_before(partition, order)), F.lit(0)) == 1)


def carried(df: DataFrame, value: Column, partition: list[str], order: list[str], out: str, segment: str | None = None) -> DataFrame:
    """The last value that was not null, this row's included."""
    if segment:
        return scanned(df, {out: ("last", value)}, partition, order, segment)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(_upto(partition, order)))


def records(df: DataFrame, starts: Column, text: Column, partition: list[str], order: list[str], sep: str = " ", segment: str | None = None) -> DataFrame:
    """(partition, record, text): rows joined to the record that the last starting row opened; rows before one are dropped."""
    number = starts.cast("long")
    numbered = (scanned(df, {"record": ("sum", number)}, partition, order, segment) if segment else df.withColumn("record", F.sum(number).over(_upto(partition, order)))).where("record > 0")
    lines = F.array_sort(F.collect_list(F.struct(*order, text.alias("_text"))))
    return numbered.groupBy(*partition, "record").agg(F.array_join(F.transform(lines, lambda x: x["_text"]), sep).alias("text"))


def runs(df: DataFrame, value: str, partition: list[str], order: str) -> DataFrame:
    """(partition, run, value, length): maximal runs of equal values."""
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(Window.partitionBy(*partition).orderBy(order)))).cast("long"), F.lit(1))
    marked = df.withColumn("_new", F.when(F.row_number().over(Window.partitionBy(*partition).orderBy(order)) == 1, F.lit(1)).otherwise(changed))
    return marked.withColumn("run", F.sum("_new").over(_upto(partition, [order]))).groupBy(*partition, "run", value).agg(F.count(F.lit(1)).alias("length"))


def active_handler(df: DataFrame, handler: Column, partition: list[str], order: list[str], out: str = "handler") -> DataFrame:
    """The handler a page names, or the last one named before: pages without a heading continue the open table."""
    return carried(df, handler, partition, order, out)
