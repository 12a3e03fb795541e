"""Catalogue directory: listing, shadowing, manifests, re-ingest, deletion, shape fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shadowed_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of `first`, and of `second` what `first` doesn't have by key."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def manifest(catalogs: DataFrame, ranges: DataFrame, key: str = "catalog_id") -> DataFrame:
    """One row a catalogue with its ranges as an ordered list."""
    held = ranges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in ranges.columns if c != key]))).alias("vin_ranges"))
    return catalogs.join(held, key, "left").orderBy(key)


def missing(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    return wanted.join(held.select(key), key, "left_anti")


def replaced_sections(held: DataFrame, fresh: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Held rows with some keys re-read: fresh rows take over, with `carried` columns kept from the held row where fresh has none."""
    old = held.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in carried])
    new = fresh.join(old, keys, "left").select(*[F.coalesce(c, f"_old_{c}").alias(c) if c in carried else F.col(c) for c in held.columns])
    return held.join(fresh.select(*keys), keys, "left_anti").unionByName(new)


def main_groups(rows: DataFrame) -> DataFrame:
    """(catalog_id, id, number, title): a group's id follows its first appearance, its title is the first."""
    first = rows.groupBy("catalog_id", "number").agg(F.min("seq").alias("first"), F.min_by("title", "seq").alias("title"))
    return first.withColumn("id", F.row_number().over(Window.partitionBy("catalog_id").orderBy("first"))).drop("first")


def shape(tables: dict[str, list[str]]) -> str:
    """Names of tables and columns in order: two catalogues of one shape can be read alike."""
    return ";".join(f"{t}({','.join(sorted(c))})" for t, c in sorted(tables.items()))


def same_shape(tables: dict[str, DataFrame], declared: dict[str, list[str]]) -> bool:
    return shape({n: df.columns for n, df in tables.items()}) == shape(declared)


def page_spans(sections: DataFrame, pages: Column, partition: list[str], order: str = "diagram_page") -> DataFrame:
    """One row for each parts page: those after a section's diagram up to the next section's, the last up to `pages`."""
    after = F.lead("diagram_page").over(Window.partitionBy(*partition).orderBy(order))
    first, last = F.col("diagram_page") + 1, F.coalesce(F.col("_next") - 1, pages)
    return sections.withColumn("_next", after).where(first <= last).withColumn("page", F.explode(F.sequence(first, last))).drop("_next")
