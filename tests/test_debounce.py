"""Edits of a document become one write after a pause."""

import json
import time

from pyspark.sql import functions as F

from partloom.sources.versions import Versions
from partloom.streaming import debounce

KIND = "key string, seq long, document string"
FIELDS = "id string, nickname string"


def until(test, seconds=90):
    end = time.time() + seconds
    while not test():
        assert time.time() < end
        time.sleep(0.2)


def test_a_pause_writes_once(spark, tmp_path):
    held = Versions.create(spark.createDataFrame([("b", "old", "then", "then")], f"{FIELDS}, createdAt string, updatedAt string"), f"file://{tmp_path}/garage", buckets=2)
    source = str(tmp_path / "edits")

    def edit(*rows):
        spark.createDataFrame([(k, n, json.dumps({"id": k, "nickname": name})) for k, n, name in rows], KIND).coalesce(1).write.mode("append").parquet(source)

    edit(("a", 1, "one"), ("a", 3, "three"), ("a", 2, "two"), (None, 9, "nobody"))
    stream = spark.readStream.schema(KIND).parquet(source)
    query = debounce.write_pauses(stream, held, FIELDS, F.lit("now"), str(tmp_path / "c"), gap=1500)
    try:
        until(lambda: held.version() == 1)
        assert [(r.id, r.nickname) for r in held.read().orderBy("id").collect()] == [("a", "three"), ("b", "old")]
        # edits in two batches without a pause between them are one write of the newest
        edit(("b", 1, "first"), ("a", 9, "nine"))
        done = query.lastProgress["batchId"]
        until(lambda: query.lastProgress["batchId"] > done)
        edit(("b", 2, "second"))
        until(lambda: {r.id: r.nickname for r in held.read().collect()} == {"a": "nine", "b": "second"})
        time.sleep(3)
        assert held.version() <= 3 and held.history().where("operation = 'upsert'").count() == held.version()
        assert query.exception() is None
    finally:
        query.stop()
    assert {r.updatedAt for r in held.read().collect()} == {"now"}


def test_state_outlives_the_query(spark, tmp_path):
    """An edit that was held when the query stopped is written after it starts again."""
    source = str(tmp_path / "edits")
    spark.createDataFrame([("a", 1, "{}")], KIND).write.parquet(source)

    def start(gap):
        return debounce.debounced(spark.readStream.schema(KIND).parquet(source), gap).writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()

    out: list = []
    first = start(6000)
    until(lambda: first.lastProgress is not None and any(s["numRowsTotal"] for s in first.lastProgress["stateOperators"]))
    first.stop()
    assert out == []
    second = start(6000)
    try:
        until(lambda: out)
        assert out == [("a", "{}", 1)]
    finally:
        second.stop()
