"""A stored search index that grows by segments: inserts and deletes add one, merges join them, nothing is rebuilt.

A posting says where a token stands in a row's text.  Each insert writes the
postings of its rows as a segment, in folders by a hash of the token; updated and
deleted keys are written beside them and hide what older segments say of them.
Which segments there are is committed by one file for each version, as in
versions.py.  Segments of a level are merged once there are `fanout` of them, so a
query reads a number of segments that grows with the logarithm of the inserts.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Conflict, _Folder

WORD_BREAK = r"[^\p{L}\p{N}]+"
#: Lengths of the grams that are kept: a query of one character is tried on every row.
GRAMS = (2, 3)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def grams_of(text: Column, sizes: tuple[int, ...] = GRAMS) -> Column:
    """Distinct runs of characters of a text in lower case."""
    low = F.lower(text)

    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))
        return F.when(F.length(low) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(runs, sizes)))


class Index:
    """Words with their places (`words`) or runs of characters (`grams`) of rows' texts, by a key.

    A key names one row: rows of an insert that share one count as one text, rows of
    a null key are left out, null texts have no tokens.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, _Folder(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, kind: str = "words", key: str = "long", parts: int = 64) -> Index:
        """An empty index of keys of the type `key`, in `parts` folders by token."""
        self = cls(spark, path)
        if not self._commit({"version": 0, "kind": kind, "key": key, "parts": parts, "segments": []}):
            raise ValueError(f"{path} is an index already")
        return self

    def _commit(self, told: dict) -> bool:
        return self.folder.write_new(f"versions/{told['version']:020d}.json", json.dumps(told))

    def told(self) -> dict:
        """The newest version: kind, key, parts, and segments from old to new."""
        return json.loads(self.folder.read(f"versions/{max(self.folder.names('versions'))}"))

    def _part(self, token: Column, told: dict) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(told["parts"])).cast("int")

    def _tokens(self, rows: DataFrame, key: str, columns: list[str], kind: str) -> DataFrame:
        """(key, token, places); places of different columns never meet in a phrase."""
        own = rows.where(F.col(key).isNotNull())
        if kind == "grams":
            grams = F.array_distinct(F.flatten(F.array(*[F.coalesce(grams_of(F.col(c)), F.array().cast("array<string>")) for c in columns])))
            return own.select(F.col(key).alias("key"), F.explode(grams).alias("token")).distinct().withColumn("places", F.array().cast("array<int>"))
        gap = F.array(F.lit(""))
        words = reduce(lambda a, b: F.concat(a, gap, b), [F.coalesce(words_of(F.col(c)), F.array().cast("array<string>")) for c in columns])
        told = own.select(F.col(key).alias("key"), F.posexplode(words).alias("place", "token")).where("token <> ''")
        return told.groupBy("key", "token").agg(F.sort_array(F.collect_list("place")).alias("places"))

    def _write(self, run: str, postings: DataFrame, gone: DataFrame, told: dict) -> None:
        path = f"{self.folder.path}/data/{run}"
        own = postings.select(F.col("key").cast(told["key"]).alias("key"), "token", "places").withColumn("part", self._part(F.col("token"), told))
        # a part of many postings is dealt over several tasks, each a file of its folder
        own.hint("rebalance", "part").sortWithinPartitions("part", "token").write.partitionBy("part").parquet(f"{path}/postings")
        gone.select(F.col("key").cast(told["key"]).alias("key")).distinct().write.parquet(f"{path}/gone")

    def _append(self, postings: DataFrame, gone: DataFrame) -> int:
        run = uuid.uuid4().hex
        self._write(run, postings, gone, self.told())
        while True:
            last = self.told()
            newest = last["segments"][-1]["seq"] if last["segments"] else 0
            segment = {"run": run, "seq": newest + 1, "level": 0, "parts": self._parts_of(run)}
            told = {**last, "version": last["version"] + 1, "segments": [*last["segments"], segment]}
            if self._commit(told):
                return told["version"]

    def _parts_of(self, run: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.folder.names(f"data/{run}/postings") if n.startswith("part="))

    def insert(self, rows: DataFrame, key: str, columns: list[str]) -> int:
        """Add rows; what the index held of their keys is replaced."""
        return self._append(self._tokens(rows, key, columns, self.told()["kind"]), rows.select(F.col(key).alias("key")).dropna())

    def delete(self, keys: DataFrame, key: str) -> int:
        none = self.spark.createDataFrame([], f"key {self.told()['key']}, token string, places array<int>")
        return self._append(none, keys.select(F.col(key).alias("key")).dropna())

    def _postings(self, told: dict, segments: list[dict], parts: set[int] | None) -> DataFrame:
        """(key, token, places, seq) of segments, from the folders of some parts or of all."""
        schema = f"key {told['key']}, token string, places array<int>"
        found = []
        for s in segments:
            paths = [f"{self.folder.path}/data/{s['run']}/postings/part={p}" for p in s["parts"] if parts is None or p in parts]
            if paths:
                found.append(self.spark.read.schema(schema).parquet(*paths).withColumn("seq", F.lit(s["seq"]).cast("long")))
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], f"{schema}, seq long")

    def _gone(self, told: dict, segments: list[dict]) -> DataFrame:
        """(key, gone): the newest segment that replaces or deletes each key."""
        found = [self.spark.read.schema(f"key {told['key']}").parquet(f"{self.folder.path}/data/{s['run']}/gone").withColumn("gone", F.lit(s["seq"]).cast("long")) for s in segments]
        return reduce(DataFrame.unionByName, found).groupBy("key").agg(F.max("gone").alias("gone"))

    def _live(self, told: dict, segments: list[dict], parts: set[int] | None, tokens: list[str] | None = None) -> DataFrame:
        held = self._postings(told, segments, parts)
        held = held if tokens is None else held.where(F.col("token").isin(tokens))
        return held.join(self._gone(told, segments), "key", "left").where("gone IS NULL OR gone <= seq").select("key", "token", "places")

    def live(self, tokens: list[str]) -> DataFrame:
        """(key, token, places) of tokens as the newest version has them; only the folders of these tokens are read."""
        told = self.told()
        if not tokens or not told["segments"]:
            return self.spark.createDataFrame([], f"key {told['key']}, token string, places array<int>")
        named = self.spark.createDataFrame([(t,) for t in tokens], "t string").select(self._part(F.col("t"), told).alias("p")).distinct().collect()
        return self._live(told, told["segments"], {r.p for r in named}, tokens)

    def merge(self, fanout: int = 4) -> int:
        """Merge the segments of every level that has `fanout` of them into one of the next level; the number of merges made."""
        made = 0
        while True:
            told = self.told()
            levels = sorted({s["level"] for s in told["segments"]})
            full = next((x for x in levels if sum(s["level"] == x for s in told["segments"]) >= fanout), None)
            if full is None:
                return made
            self._merged(told, [s for s in told["segments"] if s["level"] == full])
            made += 1

    def _merged(self, told: dict, own: list[dict]) -> None:
        """Put one segment in the place of neighbours; keys that are gone still hide older segments, if there are any."""
        oldest = own[0]["seq"] == told["segments"][0]["seq"]
        run = uuid.uuid4().hex
        gone = self._gone(told, own).select("key")
        self._write(run, self._live(told, own, None), gone.limit(0) if oldest else gone, told)
        whole = {"run": run, "seq": own[-1]["seq"], "level": own[0]["level"] + 1, "parts": self._parts_of(run)}
        while True:
            last = self.told()
            runs = [s["run"] for s in last["segments"]]
            if any(s["run"] not in runs for s in own):
                raise Conflict("another writer merged these segments")
            at = runs.index(own[0]["run"])
            if self._commit({**last, "version": last["version"] + 1, "segments": [*last["segments"][:at], whole, *last["segments"][at + len(own) :]]}):
                return

    def vacuum(self) -> int:
        """Delete all but the newest version, and data that it doesn't name; for when nobody reads or writes."""
        kept = {s["run"] for s in self.told()["segments"]}
        gone = [f"data/{n}" for n in self.folder.names("data") if n not in kept] + [f"versions/{n}" for n in sorted(self.folder.names("versions"))[:-1]]
        for part in gone:
            self.folder.delete(part)
        return len(gone)
