"""Token index and substring search over part numbers and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.postings import GRAMS, Index


def token_index(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(token, key): distinct lower-case words of the columns."""
    words = F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}]+")
    return df.select(F.explode(F.array_distinct(F.filter(words, lambda w: w != ""))).alias("token"), F.col(key).alias("key"))


#: Folders of a stored index; a term is in one of them.
INDEX_PARTS = 64


def terms_of(query: str) -> list[str]:
    return sorted({w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()})


def matching(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows whose columns hold every word of the query, without an index: only the query's words of a row are kept."""
    terms = terms_of(query)
    words = F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}]+")
    return df.where(F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))) == len(terms)) if terms else df.limit(0)


def _part(token) -> object:
    return F.pmod(F.xxhash64(token), F.lit(INDEX_PARTS)).cast("int")


def store_index(index: DataFrame, path: str) -> None:
    """Write an index in INDEX_PARTS folders by token, each sorted, over what was there."""
    index.withColumn("part", _part(F.col("token"))).repartition("part").sortWithinPartitions("part", "token").write.mode("overwrite").partitionBy("part").parquet(path)


def match_stored(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Keys that hold every word of the query; only the folders of its words are read."""
    terms = terms_of(query)
    held = spark.read.parquet(path)
    parts = [r.p for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_part(F.col("t")).alias("p")).collect()] if terms else []
    return match_all(held.where(F.col("part").isin(parts)), query)


def match_all(index: DataFrame, query: str) -> DataFrame:
    """Keys that hold every word of the query; none for a query without words."""
    terms = terms_of(query)
    return index.where(F.col("token").isin(terms)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms)).select("key") if terms else index.select("key").limit(0)


def match_words(index: Index, query: str) -> DataFrame:
    """Keys that hold every word of the query, by a stored index; none for a query without words."""
    terms = terms_of(query)
    return index.live(terms).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms)).select("key")


def match_phrase(index: Index, query: str) -> DataFrame:
    """Keys that hold the query's words one after another in one column.

    Each posting names the places where the phrase would have to begin; a phrase
    begins where all its words say so.
    """
    words = "".join(c if c.isalnum() else " " for c in query.lower()).split()
    if not words:
        return index.live([]).select("key")
    turns: dict[str, list[int]] = {}
    for k, w in enumerate(words):
        turns.setdefault(w, []).append(k)
    turn = F.element_at(F.create_map(*[x for w, ks in turns.items() for x in (F.lit(w), F.array(*map(F.lit, ks)))]), F.col("token"))
    begins = index.live(sorted(turns)).select("key", F.explode("places").alias("place"), turn.alias("turns")).select("key", F.col("place"), F.explode("turns").alias("turn"))
    return begins.groupBy("key", (F.col("place") - F.col("turn")).alias("begin")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(words)).select("key").distinct()


def like_stored(df: DataFrame, index: Index, key: str, query: str, columns: list[str]) -> DataFrame:
    """like() over an index of grams: rows with all grams of the query are tried, others never; a query of one character is tried on all.

    The index has the grams of the same columns.
    """
    low = query.lower()
    size = max((n for n in GRAMS if n <= len(low)), default=0)
    if not size:
        return like(df, query, columns)
    grams = sorted({low[i : i + size] for i in range(len(low) - size + 1)})
    found = index.live(grams).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select(F.col("key").alias(key))
    return like(df.join(found, key, "left_semi"), query, columns)


def like(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with the query inside one of the columns, whatever the case; its wildcards are literal."""
    pattern = "%" + query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return df.where(hit)


def search(df: DataFrame, index: DataFrame, key: str, query: str, columns: list[str]) -> DataFrame:
    """Index matches, or substring matches where the index has none."""
    found = df.join(match_all(index, query).withColumnRenamed("key", key), key, "left_semi")
    return found if not found.isEmpty() else like(df, query, columns)


def probe(df: DataFrame, query: str, columns: list[str], most: int = 5) -> DataFrame:
    """The first rows that hold the query in a column, to see that a catalogue can be searched."""
    return like(df, query, columns).orderBy(*df.columns[:1]).limit(most)
