"""Table browser: labels, blob-safe projections, filters over all columns, pages, counts, trees and ad-hoc SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank

FIRST_ROWS, PAGE = 10_000, 200


def catalog_label(title: Column, model: Column, key: Column) -> Column:
    return F.coalesce(blank(F.concat_ws(" - ", blank(title), blank(model))), key, F.lit(""))


def blob_safe(df: DataFrame) -> DataFrame:
    """Binary columns as `<n bytes>`; null stays null."""
    shown = [F.when(F.col(n).isNotNull(), F.concat(F.lit("<"), F.octet_length(n).cast("string"), F.lit(" bytes>"))).alias(n) if t == "binary" else F.col(n) for n, t in df.dtypes]
    return df.select(*shown)


def any_column_contains(df: DataFrame, query: str, order: list[str], rows: int = FIRST_ROWS) -> DataFrame:
    """Rows among the first `rows` in which some column's text contains the query, whatever the case."""
    first = df.orderBy(*order).limit(rows)
    hits = [F.lower(F.col(c).cast("string")).contains(query.lower()) for c, t in df.dtypes if t != "binary"]
    return first.where(reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), hits, F.lit(False)))


def page(df: DataFrame, number: int, order: list[str], size: int = PAGE) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n, t in tables.items()))


def percent(part: Column, whole: Column) -> Column:
    """Integer percent; an empty whole counts as one."""
    return F.floor(100 * part / F.greatest(whole, F.lit(1))).cast("long")


def tree(sections: DataFrame, groups: DataFrame) -> DataFrame:
    """Sections under their main groups, numbered ones first in numeric order."""
    own = groups.select(F.col("id").alias("main_group_id"), F.col("number").alias("group_number"), F.col("title").alias("group_title"))
    return sections.join(own, "main_group_id").orderBy(F.col("group_number").try_cast("int").asc_nulls_last(), F.col("number").try_cast("int").asc_nulls_last(), "number")


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(*keys, "_first.*")


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A query text over named tables, as an ad-hoc console runs it."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)
