"""The segmented index against a scan: inserts, updates, deletes, merges, phrases, substrings, concurrent writers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from partloom.operators import search
from partloom.sources.postings import Index

WORDS = ["bolt", "nut", "nut", "Ring", "zur", "Düse", "漢字", "m8", "a_b", "100%"]
COLUMNS = ["name", "note"]


def rows_of(r, ids):
    text = lambda: None if r.random() < 0.1 else " ".join(r.choices(WORDS, k=r.randint(0, 7))) + r.choice(["", ", ", "--x"])
    return {k: (text(), text()) for k in ids}


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], "id long, name string, note string")


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def with_phrase(rows, phrase):
    p = words(phrase)
    return {k for k, v in rows.items() if any(words(t)[i : i + len(p)] == p for t in v for i in range(len(words(t))))}


def with_words(rows, query):
    return {k for k, v in rows.items() if set(words(query)) <= {w for t in v for w in words(t)}}


def keys(df):
    out = [r.key for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


def agree(index, rows):
    for q in ("nut nut", "bolt nut", "ring", "nut, NUT nut", "düse 漢字", "a b", "zur zur zur zur"):
        assert keys(search.match_phrase(index, q)) == with_phrase(rows, q), q
    for q in ("nut bolt", "ring 漢字 m8", "x"):
        assert keys(search.match_words(index, q)) == with_words(rows, q), q


def test_inserts_updates_deletes_and_merges(spark, tmp_path):
    r = random.Random(3)
    index = Index.create(spark, f"file://{tmp_path}/words", parts=4)
    rows = rows_of(r, range(60))
    index.insert(frame(spark, rows), "id", COLUMNS)
    agree(index, rows)
    new = rows_of(r, range(40, 80))
    index.insert(frame(spark, new), "id", COLUMNS)
    rows |= new
    index.delete(spark.range(10), "id")
    rows = {k: v for k, v in rows.items() if k >= 10}
    agree(index, rows)
    again = rows_of(r, range(5))
    index.insert(frame(spark, again), "id", COLUMNS)
    rows |= again
    agree(index, rows)
    # four segments become one, whose dead postings are gone; deletes hide older segments only
    assert index.merge(4) == 1 and [s["level"] for s in index.told()["segments"]] == [1]
    agree(index, rows)
    index.delete(spark.range(40, 45), "id")
    index.insert(frame(spark, {41: ("back again", None)}), "id", COLUMNS)
    rows = {k: v for k, v in rows.items() if not 40 <= k < 45} | {41: ("back again", None)}
    assert index.merge(2) == 2 and index.merge(2) == 0 and len(index.told()["segments"]) == 1
    agree(index, rows)
    assert keys(search.match_phrase(index, "back again")) == {41} and keys(search.match_phrase(index, " - ")) == set()
    assert index.vacuum() > 0
    agree(index, rows)


def test_merged_deletes_still_hide_older_segments(spark, tmp_path):
    index = Index.create(spark, f"file://{tmp_path}/words", parts=2)
    index.insert(frame(spark, {1: ("bolt", ""), 2: ("bolt", "")}), "id", COLUMNS)
    index.delete(spark.range(1, 2), "id")
    index.insert(frame(spark, {3: ("bolt", "")}), "id", COLUMNS)
    told = index.told()
    index._merged(told, told["segments"][1:])
    assert keys(search.match_words(index, "bolt")) == {2, 3}


def test_only_the_folders_of_the_words_are_read(spark, tmp_path):
    index = Index.create(spark, f"file://{tmp_path}/words", parts=32)
    index.insert(frame(spark, rows_of(random.Random(1), range(50))), "id", COLUMNS)
    folders = {re.search("part=([0-9]+)", f)[1] for f in index.live(["bolt", "nut"]).inputFiles() if "/postings/" in f}
    assert 1 <= len(folders) <= 2 < len(index.told()["segments"][0]["parts"])


@pytest.mark.parametrize("query", ["ut", "NUT n", "ü", "%", "_b", "漢字 ", "t, ", "nothing", "", "bolt nut"])
def test_substrings(spark, tmp_path, query):
    rows = rows_of(random.Random(7), range(80)) | {99: (None, None)}
    index = Index.create(spark, f"file://{tmp_path}/grams", "grams", parts=4)
    df = frame(spark, rows)
    index.insert(df, "id", COLUMNS)
    found = search.like_stored(df, index, "id", query, COLUMNS)
    assert {r.id for r in found.collect()} == {k for k, v in rows.items() if any(t is not None and query.lower() in t.lower() for t in v)}


def test_two_inserts_at_once_both_stay(spark, tmp_path):
    index = Index.create(spark, f"file://{tmp_path}/words", parts=2)
    other = Index(spark, f"file://{tmp_path}/words")
    write = index._write

    def overtaken(*args):
        write(*args)
        index._write = write
        other.insert(frame(spark, {2: ("nut", "")}), "id", COLUMNS)

    index._write = overtaken
    index.insert(frame(spark, {1: ("nut", "")}), "id", COLUMNS)
    assert keys(search.match_words(index, "nut")) == {1, 2} and [s["seq"] for s in index.told()["segments"]] == [1, 2]
    with pytest.raises(ValueError):
        Index.create(spark, f"file://{tmp_path}/words")


def test_empty_index(spark, tmp_path):
    index = Index.create(spark, f"file://{tmp_path}/words", key="string")
    assert index.merge() == 0 and keys(search.match_words(index, "nut")) == set() and keys(search.match_phrase(index, "a b")) == set()
    index.insert(spark.createDataFrame([(None, "nut"), ("k", None)], "id string, name string"), "id", ["name"])
    assert keys(search.match_words(index, "nut")) == set()
    index.insert(spark.createDataFrame([("k", "nut")], "id string, name string").withColumn("other", F.lit(None).cast("string")), "id", ["name", "other"])
    assert keys(search.match_words(index, "nut")) == {"k"}


def test_a_part_of_many_postings_is_dealt_over_tasks(spark, tmp_path):
    """A part's postings are sorted by several tasks once they are many, and all of them are found."""
    index = Index.create(spark, f"file://{tmp_path}/index", "words", parts=1)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        index.insert(spark.range(0, 60_000, 1, 4).select(F.col("id").alias("k"), F.concat_ws(" ", F.md5(F.col("id").cast("string")), F.lit("all")).alias("t")), "k", ["t"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    run = index.told()["segments"][0]["run"]
    assert len(list((tmp_path / "index" / "data" / run / "postings" / "part=0").glob("*.parquet"))) > 1
    assert index.live(["all"]).select("key").distinct().count() == 60_000
