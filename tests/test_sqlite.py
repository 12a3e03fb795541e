"""SQLite source and sink: tests tried by SQLite against Spark's own, pruned columns, commits and aborts of tasks."""

import os
import sqlite3
from contextlib import closing

import pytest
from pyspark.sql import functions as F

from partloom.sources import sqlite

ROWS = [(1, "A 1", "bolt", 1.5), (2, "b", "", None), (3, None, "Bolt with nut", float("inf")), (4, "a%", "é漢🙂 bolt", -0.0), (5, "a_", None, 2.0), (-7, "B", "100%_", 7.25)]


@pytest.fixture
def files(tmp_path):
    out = []
    for k in range(2):
        path = str(tmp_path / f"c#{k}%?.sqlite")
        with closing(sqlite3.connect(path)) as db:
            db.execute("CREATE TABLE part (id INTEGER, number TEXT COLLATE NOCASE, description TEXT, weight REAL, picture BLOB)")
            db.executemany("INSERT INTO part VALUES (?, ?, ?, ?, x'00ff')", [(i + 10 * k, *r) for i, *r in ROWS])
            db.execute("CREATE TABLE bare (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
            db.execute("INSERT INTO bare VALUES ('x', 1)")
            db.execute("CREATE TABLE none (k TEXT)")
            db.commit()
        out.append(path)
    return out


TESTS = [
    ("id", "=", 3), ("id", "<>", 3), ("id", "in", [1, 2, 14]), ("id", "in", []), ("id", ">", 2), ("id", ">=", -7), ("id", "<", 4), ("id", "<=", 12), ("id", "null", None), ("id", "in", list(range(600))), ("number", "filled", None), ("number", "=", "b"),
    ("number", "<>", "b"), ("number", ">", "a"), ("number", "<", "a%"), ("number", "in", ["a%", "B"]), ("number", "starts", "a"), ("number", "starts", ""), ("description", "contains", "bolt"), ("description", "ends", "bolt"), ("description", "starts", "Bolt"), ("description", "starts", "é漢"),
    ("description", "ends", "🙂 bolt"), ("description", "contains", "%"), ("description", "contains", "_"), ("description", "=", ""), ("weight", ">", 1.0), ("weight", "=", 0.0), ("weight", "null", None), ("_file", "contains", "c#1"),
]


def test_tests_give_sparks_rows(spark, files):
    df = sqlite.read_table(spark, files, "part")
    plain = spark.createDataFrame(df.collect(), df.schema).cache()
    for t in TESTS:
        assert sorted(map(str, sqlite.read_table(spark, files, "part", tests=[t]).collect())) == sorted(map(str, plain.where(sqlite.tested(t)).collect())), t
    two = [("id", ">", 2), ("description", "contains", "bolt")]
    assert {r.id for r in sqlite.read_table(spark, files, "part", ["id"], two).collect()} == {4, 11, 14}


def test_tests_are_tried_by_sqlite():
    kind = sqlite.T.StructType([sqlite.T.StructField("id", sqlite.T.LongType()), sqlite.T.StructField("w", sqlite.T.DoubleType()), sqlite.T.StructField("n", sqlite.T.StringType()), sqlite.T.StructField("_file", sqlite.T.StringType())])
    reader = sqlite.Reader(["a"], "part", kind, 10, [("id", ">", 3), ("w", "=", 1.0), ("n", "contains", "x"), ("_file", "=", "b"), ("id", "=", 1 << 70), ("id", "in", list(range(1000)))])
    assert reader.where == ['("id" > ?)', '(instr("n", ?) > 0)'] and reader.values == [3, "x"]


def test_only_asked_rows_and_columns_leave_sqlite(spark, files):
    df = sqlite.read_table(spark, files, "part", ["description", "_file"], [("id", ">", 12)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    (scan,) = [x for x in plan.splitlines() if "BatchScan" in x]
    assert df.columns == ["description", "_file"] and "number" not in scan and "picture" not in scan
    reader = sqlite.SqliteCatalog({"files": files[0], "table": "part", "tests": '[["id", ">", 3]]'})
    kind = sqlite.T.StructType([f for f in reader.schema().fields if f.name in ("id", "_file")])
    read = reader.reader(kind)
    assert [r[0] for p in read.partitions() for r in read.read(p)] == [4, 5]


def test_two_reads_of_one_table_keep_their_own_rows(spark, files):
    """Filters on top of a loaded table stay with their scan."""
    df = sqlite.read_table(spark, files, "part", ["id", "_file"])
    one, two = df.where("id = 1"), df.where("id = 2")
    assert sorted(r.id for r in one.union(two).collect()) == [1, 2] and one.join(two, "_file").count() == 1
    a, b = (sqlite.read_table(spark, files, "part", ["id", "_file"], [("id", "=", k)]) for k in (1, 2))
    assert sorted(r.id for r in a.union(b).collect()) == [1, 2]


def test_tables_without_row_ids_and_without_rows(spark, files):
    assert [tuple(r)[:2] for r in sqlite.read_table(spark, files[:1], "bare").collect()] == [("x", 1)]
    assert sqlite.read_table(spark, files, "none").count() == 0


def held(path, sql="SELECT * FROM part ORDER BY 1"):
    with closing(sqlite3.connect(path)) as db:
        return db.execute(sql).fetchall()


KIND = "catalog_id string, id long, words array<string>, picture binary, at date"


def test_catalogues_are_written_by_tasks(spark, tmp_path):
    folder = str(tmp_path / "all")
    rows = spark.createDataFrame([(f"c{k % 3}", k, ["x", str(k)], bytearray(b"\x00"), None) for k in range(30)] + [(None, 99, None, None, None)], KIND)
    sqlite.write_catalogs(rows, folder, "part")
    assert sorted(os.listdir(folder)) == ["c0", "c1", "c2"] and len(held(f"{folder}/c1/catalog.sqlite")) == 10
    assert held(f"{folder}/c1/catalog.sqlite")[0] == (1, '["x", "1"]', b"\x00", None)
    # rows of one catalogue in several tasks, added to the table; another table beside it
    more = rows.where("id < 6").withColumn("id", F.col("id") + 100).repartition(5)
    spark.dataSource.register(sqlite.SqliteCatalog)
    more.write.format("sqlite_catalog").options(folder=folder, table="part", key="catalog_id").mode("append").save()
    sqlite.write_catalogs(rows.select("catalog_id", F.col("id").alias("code")), folder, "code")
    assert len(held(f"{folder}/c2/catalog.sqlite")) == 12 and held(f"{folder}/c2/catalog.sqlite", "SELECT count(*) FROM code") == [(10,)]
    sqlite.write_catalogs(rows.where("id = 4"), folder, "part", mode="overwrite")
    assert held(f"{folder}/c1/catalog.sqlite")[0][0] == 4 and len(held(f"{folder}/c1/catalog.sqlite")) == 1 and len(held(f"{folder}/c2/catalog.sqlite")) == 12
    assert held(f"{folder}/c1/catalog.sqlite", "SELECT count(*) FROM code") == [(10,)] and not [n for n in os.listdir(folder) if n.startswith(".")]


def test_failed_task_leaves_no_file(spark, tmp_path):
    folder = str(tmp_path / "all")
    rows = spark.range(100).select((F.col("id") % 5).cast("string").alias("catalog_id"), "id")
    sqlite.write_catalogs(rows, folder, "part")
    broken = rows.withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id") + 1000))
    with pytest.raises(Exception, match="broken"):
        sqlite.write_catalogs(broken, folder, "part")
    with pytest.raises(Exception, match="folder"):
        sqlite.write_catalogs(rows.withColumn("catalog_id", F.lit("../out")), folder, "part")
    assert sorted(os.listdir(folder)) == list("01234") and all(len(held(f"{folder}/{k}/catalog.sqlite")) == 20 for k in range(5))
    with pytest.raises(Exception, match="broken"):
        sqlite.write_tables({"part": broken.select("id"), "more": rows}, str(tmp_path / "one.sqlite"))
    assert os.listdir(tmp_path) == ["all"]


def test_one_file_of_several_tables(spark, tmp_path):
    path = str(tmp_path / "one.sqlite")
    for n in (7, 3):
        sqlite.write_tables({"part": spark.range(n), "none": spark.range(0), "pair": spark.range(2).withColumn("x", F.lit(1.5))}, path)
        assert len(held(path)) == n and held(path, "SELECT * FROM none") == [] and held(path, "SELECT sum(x) FROM pair") == [(3.0,)]
    assert os.listdir(tmp_path) == ["one.sqlite"]
