"""Queries over stored tables: vehicle documents in versions, catalogue files, search indexes in segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search
from ..operators.garage import META
from ..sources import sqlite
from ..sources.postings import Index
from ..sources.tables import shared_folder
from ..sources.versions import Versions
from .registry import query

_CHANGES = """
WITH v0 AS (SELECT 'c' || c_custkey AS id, c_name AS nickname, 0 AS marks, 'v0' AS created, 'v0' AS updated, c_mktsegment, c_nationkey, c_acctbal FROM customer),
v1 AS (SELECT id, CASE WHEN c_acctbal < 0 THEN nickname || ' in debt' ELSE nickname END AS nickname, marks, created, CASE WHEN c_acctbal < 0 THEN 'v1' ELSE updated END AS updated, c_mktsegment, c_nationkey FROM v0
       UNION ALL SELECT 's' || s_suppkey, s_name, 0, 'v1', 'v1', NULL, NULL FROM supplier),
v2 AS (SELECT id, nickname, CASE WHEN c_nationkey % 5 = 2 THEN 1 ELSE marks END AS marks, created, CASE WHEN c_nationkey % 5 = 2 THEN 'v2' ELSE updated END AS updated, c_mktsegment FROM v1),
v3 AS (SELECT id, nickname, marks, created, updated FROM v2 WHERE c_mktsegment IS DISTINCT FROM 'MACHINERY')
"""


def changed_garage(t) -> Versions:
    """Four versions of a garage: customers; debtors renamed and suppliers added; marks on some; a market segment gone."""
    c, text = F.col, lambda x: x.cast("string")
    own = t("customer").select(F.concat(F.lit("c"), text(c("c_custkey"))).alias("id"), c("c_name").alias("nickname"), "c_mktsegment", "c_nationkey", "c_acctbal")
    empty = [F.create_map().cast(META).alias("partMeta"), F.array().cast("array<string>").alias("savedParts"), F.lit("v0").alias("createdAt"), F.lit("v0").alias("updatedAt")]
    held = Versions.create(own.select("id", "nickname", *empty), shared_folder(own.sparkSession, "garage"), buckets=8)
    debt = own.where("c_acctbal < 0").select("id", F.concat("nickname", F.lit(" in debt")).alias("nickname"))
    held.upsert(debt.unionByName(t("supplier").select(F.concat(F.lit("s"), text(c("s_suppkey"))).alias("id"), c("s_name").alias("nickname"))), F.lit("v1"))
    mark = F.create_map(F.lit("k"), F.struct(F.lit(True).alias("ok"), F.lit("seen").alias("notes"))).cast(META)
    held.patch_meta(own.where("c_nationkey % 5 = 2").select("id", mark.alias("patch")), F.lit("v2"))
    held.remove(own.where("c_mktsegment = 'MACHINERY'").select("id"))
    return held


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", "nickname", F.size("partMeta").cast("int").alias("marks"), F.col("createdAt").alias("created"), F.col("updatedAt").alias("updated"))


@query("t74_garage_versions", _CHANGES + "SELECT id, nickname, CAST(marks AS INTEGER) AS marks, created, updated FROM v3")
def garage_versions(t):
    return _shown(changed_garage(t).read())


@query("t75_time_travel", _CHANGES + " UNION ALL ".join(f"SELECT {k} AS version, updated, count(*) AS n, CAST(sum(marks) AS BIGINT) AS marks FROM v{k} GROUP BY updated" for k in range(4)))
def time_travel(t):
    held = changed_garage(t)
    each = [_shown(held.read(k)).groupBy("updated").agg(F.count(F.lit(1)).alias("n"), F.sum("marks").alias("marks")).select(F.lit(k).alias("version"), "updated", "n", "marks") for k in range(4)]
    return reduce(DataFrame.unionByName, each)


@query("t76_sqlite_parts", "SELECT p_brand AS catalog_id, p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 10 AND 30 AND contains(p_type, 'ONOM') AND p_brand <> 'Brand#33' UNION ALL SELECT p_brand, p_partkey, p_name, p_size FROM part WHERE starts_with(p_type, 'SMALL') AND p_brand <> 'Brand#33'")
def sqlite_parts(t):
    """Parts in a SQLite file for each brand, written by tasks, one brand replaced by nothing; read back with tests that SQLite tries."""
    part = t("part").select("p_brand", "p_partkey", "p_name", "p_type", "p_size")
    spark, folder = part.sparkSession, shared_folder(part.sparkSession, "catalogs").removeprefix("file://")
    sqlite.write_catalogs(part, folder, "part", "p_brand")
    sqlite.write_catalogs(part.where("p_brand = 'Brand#33'").withColumn("p_type", F.lit("")), folder, "part", "p_brand", "overwrite")
    files = sorted(f"{folder}/{r.p_brand}/catalog.sqlite" for r in part.select("p_brand").distinct().collect())
    named = F.regexp_extract("_file", "([^/]+)/catalog.sqlite$", 1).alias("catalog_id")
    read = lambda tests: sqlite.read_table(spark, files, "part", ["_file", "p_partkey", "p_name", "p_size"], tests).select(named, "p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"))
    return read([("p_size", ">=", 10), ("p_size", "<=", 30), ("p_type", "contains", "ONOM")]).unionByName(read([("p_type", "starts", "SMALL")]))


_PARTS_NOW = """
WITH p AS (SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN p_name || ', special edition' ELSE p_name END AS name, lower(p_type) AS kind, p_size, p_brand FROM part WHERE p_size <= 40),
w AS (SELECT p_partkey, ' ' || array_to_string([x FOR x IN regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+') IF x <> ''], ' ') || ' | ' || array_to_string([x FOR x IN regexp_split_to_array(kind, '[^\\p{L}\\p{N}]+') IF x <> ''], ' ') || ' ' AS s FROM p)
"""


def changed_index(t, kind: str) -> Index:
    """Parts in four inserts, merged; sizes over 40 deleted, one brand's names changed."""
    part = t("part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    held = Index.create(part.sparkSession, shared_folder(part.sparkSession, kind), kind, parts=16)
    for k in range(4):
        held.insert(part.where(F.pmod(F.xxhash64("p_partkey"), F.lit(4)) == k), "p_partkey", ["p_name", "p_type"])
    held.merge()
    held.delete(part.where("p_size > 40"), "p_partkey")
    held.insert(part.where("p_brand = 'Brand#11' AND p_size <= 40").withColumn("p_name", F.concat("p_name", F.lit(", special edition"))), "p_partkey", ["p_name", "p_type"])
    return held


@query("t77_index_updates", _PARTS_NOW + "SELECT 'words' AS asked, p_partkey FROM w WHERE contains(s, ' special ') AND contains(s, ' ring ') UNION ALL SELECT 'phrase', p_partkey FROM w WHERE contains(s, ' special edition ') UNION ALL SELECT 'name', p_partkey FROM w WHERE contains(s, ' small ring ') UNION ALL SELECT 'across', p_partkey FROM w WHERE contains(s, ' ring economy ')")
def index_updates(t):
    held = changed_index(t, "words")
    found = {"words": search.match_words(held, "Ring SPECIAL"), "phrase": search.match_phrase(held, "special edition"), "name": search.match_phrase(held, "small ring"), "across": search.match_phrase(held, "ring economy")}
    return reduce(DataFrame.unionByName, [df.select(F.lit(asked).alias("asked"), F.col("key").alias("p_partkey")) for asked, df in found.items()])


@query("t78_gram_like", _PARTS_NOW + "SELECT q AS asked, p_partkey, name FROM p, (SELECT unnest(['re', 'olish', 'L, SP', '%']) AS q) WHERE contains(lower(name), lower(q)) OR contains(kind, lower(q))")
def gram_like(t):
    held = changed_index(t, "grams")
    now = t("part").where("p_size <= 40").select("p_partkey", F.when(F.col("p_brand") == "Brand#11", F.concat("p_name", F.lit(", special edition"))).otherwise(F.col("p_name")).alias("name"), "p_type")
    return reduce(DataFrame.unionByName, [search.like_stored(now, held, "p_partkey", q, ["name", "p_type"]).select(F.lit(q).alias("asked"), "p_partkey", "name") for q in ("re", "olish", "L, SP", "%")])
