import json
import sqlite3

from pyspark.sql import functions as F

from partloom.sources import documents, sqlite
from partloom.streaming import stages


def test_sqlite_there_and_back(spark, tmp_path):
    path = tmp_path / "a" / "catalog.sqlite"
    path.parent.mkdir()
    sqlite.write_tables({"catalog": spark.createDataFrame([("a", "T", None)], "id string, title string, model string"), "part": spark.range(250).select(F.col("id"), F.lit("x").alias("number"))}, str(path))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "catalog.sqlite").write_text("no database")
    df = sqlite.read_table(spark, [str(path)], "part")
    assert df.count() == 250 and df.agg(F.sum("id")).first()[0] == 250 * 249 // 2
    assert [tuple(r) for r in sqlite.list_catalogs(spark, str(tmp_path)).collect()] == [("a", "T", None), ("broken", None, None)]
    assert sqlite3.connect(path).execute("SELECT count(*) FROM part").fetchone() == (250,)


def test_archives(tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "catalog.sqlite").write_text("1")
    (tmp_path / "in" / "a" / "deep").mkdir()
    (tmp_path / "in" / "a" / "deep" / "catalog.sqlite").write_text("2")
    documents.export_archive(str(tmp_path / "in"), str(tmp_path / "all.zip"))
    assert documents.import_archive(str(tmp_path / "all.zip"), str(tmp_path / "out")) == ["a"]
    assert not (tmp_path / "out" / "a" / "deep").exists()


def test_manifest(spark, tmp_path):
    assert documents.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "id string, bytes long")
    for _ in range(2):
        documents.write_manifest(rows, str(tmp_path / "m.json"))
    assert [r.id for r in documents.read_manifest(spark, str(tmp_path / "m.json")).collect()] == ["a", "b"] and (tmp_path / "m.json.bak").exists()


def test_salvage(spark):
    df = spark.createDataFrame([('{"a": 1}', None), ("{broken", '{"a": 2}'), ("{", "}")], "t string, b string")
    got = df.select(documents.salvaged(F.col("t"), F.col("b"), "a int", F.struct(F.lit(9).alias("a")))["a"].alias("a")).collect()
    assert [r.a for r in got] == [1, 2, 9] and documents.leading_object('{"a": 1} rubbish') == {"a": 1} and documents.leading_object("rubbish") is None


def test_outline_and_truth(spark):
    outline = [{"title": "1 Engine", "page": 2, "items": [{"title": "101-000 Block", "page": 3, "items": []}, {"title": "101-005 Lost", "page": None, "items": []}]}]
    df = spark.createDataFrame([(json.dumps({"catalog_id": "c", "outline": outline}),)], "j string").select(F.from_json("j", documents.OUTLINE).alias("o")).select("o.*")
    (row,) = documents.outline_sections(df).collect()
    assert (row.group_number, row.group_title, row.number, row.title, row.diagram_page) == ("1", "Engine", "101-000", "Block", 3)
    truth = {"7": {"number": "101-000", "tier": "partial", "verified": True, "callouts": [{"num": "2/1", "x0": 1, "y0": 2, "x1": 3, "y1": 4}]}, "x": {}}
    (row,) = documents.truth_rows(spark.createDataFrame([(json.dumps(truth),)], "json string")).collect()
    assert (row.section_id, row.tier, row.num) == ("7", "gold", "2/1")


def test_catalog_partitions(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "catalog_id string, n int")
    documents.write_catalog({"t": rows}, root)
    documents.write_catalog({"t": rows.where("catalog_id = 'a'").withColumn("n", F.lit(5))}, root)
    assert sorted(r.n for r in spark.read.parquet(f"{root}/t").collect()) == [2, 5]
    documents.delete_catalog(spark, root, "b", ["t"])
    assert [r.n for r in spark.read.parquet(f"{root}/t").collect()] == [5]


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    run(stages.sliding_counts(source), "slide", "complete")
    assert spark.table("slide").agg(F.sum("n")).first()[0] == 2 * events.count()
    run(stages.first_events(source), "once", "append")
    assert spark.table("once").count() == events.count()


def test_page_carry_over_batches(spark, tmp_path):
    kind = "key string, seq int, starts boolean, text string"
    for n, rows in enumerate(([("k", 1, True, "a")], [("k", 2, False, "b"), ("k", 3, True, "c")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))
    run(stages.continued_records(source), "records", "append")
    assert [r.text for r in spark.table("records").collect()] == ["a b"]


def test_databases_are_built_by_tasks(spark, tmp_path):

    parts = spark.createDataFrame([("a", 1, "bolt", bytearray(b"\x00\xff")), ("b", 2, None, None), ("a", 3, "nut", None), (None, 4, "x", None)], "catalog_id string, id long, description string, picture binary")
    codes = spark.createDataFrame([("a", "567", ["x", "y"])], "catalog_id string, code string, words array<string>")
    got = {r.catalog_id: bytes(r.database) for r in sqlite.database_files({"part": parts, "pr_code": codes}).collect()}
    assert set(got) == {"a", "b"}
    (tmp_path / "a.sqlite").write_bytes(got["a"])
    with sqlite3.connect(tmp_path / "a.sqlite") as db:
        assert sorted(db.execute("SELECT id, description, picture FROM part")) == [(1, "bolt", b"\x00\xff"), (3, "nut", None)]
        assert db.execute("SELECT code, words FROM pr_code").fetchall() == [("567", '["x", "y"]')]
