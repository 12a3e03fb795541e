"""SQLite catalogue files as a Spark data source (`sqlite_catalog`) and back."""

from __future__ import annotations

import base64
import json
import os
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_KINDS = {"INTEGER": T.LongType(), "TEXT": T.StringType(), "BLOB": T.BinaryType(), "REAL": T.DoubleType()}


#: Values of an IN list that goes to SQLite at most.
IN_MOST = 500


def opened(path: str) -> sqlite3.Connection:
    """A connection that can't write."""
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


class Slice(InputPartition):
    """Rows of one file with `low` <= rowid < `high`; all of them where `low` is null."""

    def __init__(self, path: str, low: int | None, high: int | None):
        self.path, self.low, self.high = path, low, high


def draft_database(path: str) -> sqlite3.Connection:
    """A connection to a file that is thrown away if anything fails, so it needs no journal and waits for no disk."""
    db = sqlite3.connect(path)
    db.execute("PRAGMA journal_mode = OFF")
    db.execute("PRAGMA synchronous = OFF")
    return db


class SqliteCatalog(DataSource):
    """SQLite files of catalogues.

    To read: `files` (one, or several as a JSON list), `table`, `slice` rows a
    partition (by row id), `tests` as a JSON list of (column, operator, value) that
    SQLite tries.  A schema of fewer columns reads these alone.  There is no
    pushFilters(): Spark 4.1 keeps what it pushed with the loaded table and not
    with the scan, so the union of two filtered reads of one table gives the last
    one's rows twice.

    To write: `table`, and `file`, or `folder` with `key`, the column whose values
    name the catalogues: their rows go to `<folder>/<value>/catalog.sqlite`.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_catalog"

    def _files(self) -> list[str]:
        told = self.options["files"]
        return json.loads(told) if told.startswith("[") else [told]

    def schema(self) -> T.StructType:
        with closing(opened(self._files()[0])) as db:
            found = db.execute("SELECT name, type FROM pragma_table_info(?)", (self.options["table"],)).fetchall()
        return T.StructType([T.StructField(name, _KINDS.get(kind.upper(), T.StringType())) for name, kind in found] + [T.StructField(FILE, T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(self._files(), self.options["table"], schema, int(self.options.get("slice", "100000")), [tuple(t) for t in json.loads(self.options.get("tests", "[]"))])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(dict(self.options), schema, overwrite)


#: The column that names a row's file.
FILE = "_file"


#: (column, operator, value): `=`, `<>`, `<`, `<=`, `>`, `>=`, `in`, `contains`, `starts`, `ends`; `null` and `filled` take no value.
Test = tuple[str, str, object]


def tested(test: Test) -> Column:
    """A test as Spark tries it."""
    name, sign, value = test
    c = F.col(f"`{name}`")
    return {
        "=": lambda: c == value, "<>": lambda: c != value, "<": lambda: c < value, "<=": lambda: c <= value, ">": lambda: c > value, ">=": lambda: c >= value, "in": lambda: c.isin(list(value)),
        "contains": lambda: c.contains(value), "starts": lambda: c.startswith(value), "ends": lambda: c.endswith(value), "null": c.isNull, "filled": c.isNotNull,
    }[sign]()


def condition(test: Test, kinds: dict[str, T.DataType]) -> tuple[str, list] | None:
    """A test in SQLite's words with its values, where both systems agree on every row; else None.

    Texts are compared by their bytes, whatever the column's collation; LIKE isn't
    used, as SQLite's has no regard for case.
    """
    name, sign, value = test
    if name == FILE or name not in kinds:
        return None
    kind, c = kinds[name], f'"{name}"'
    if sign in ("null", "filled"):
        return f"{c} IS {'NOT ' * (sign == 'filled')}NULL", []
    text = isinstance(kind, T.StringType)
    plain = (lambda v: isinstance(v, str)) if text else (lambda v: isinstance(v, int) and not isinstance(v, bool) and -(1 << 63) <= v < 1 << 63)
    if not text and not isinstance(kind, (T.LongType, T.IntegerType)):
        return None
    own = f"{c} COLLATE BINARY" if text else c
    if sign == "in":
        return (f"{own} IN ({', '.join('?' * len(value))})", list(value)) if 0 < len(value) <= IN_MOST and all(map(plain, value)) else None
    if not plain(value):
        return None
    if sign in ("=", "<>", "<", "<=", ">", ">="):
        return f"{own} {sign} ?", [value]
    if "\0" in value or not value:
        return None
    return {"contains": f"instr({c}, ?) > 0", "starts": f"substr({c}, 1, {len(value)}) = ?", "ends": f"substr({c}, -{len(value)}) = ?"}[sign], [value]


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], table: str, schema: T.StructType, size: int, tests: list[Test]):
        self.paths, self.table, self.columns, self.size = paths, table, schema.names, size
        told = [c for t in tests if (c := condition(t, {f.name: f.dataType for f in schema.fields}))]
        self.where, self.values = [f"({sql})" for sql, _ in told], [v for _, values in told for v in values]

    def partitions(self) -> list[Slice]:
        out = []
        for path in self.paths:
            with closing(opened(path)) as db:
                try:
                    low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
                except sqlite3.OperationalError as e:  # a table without row ids
                    if "rowid" not in str(e):
                        raise
                    out.append(Slice(path, None, None))
                    continue
            if low is not None:
                out += [Slice(path, at, at + self.size) for at in range(low, high + 1, self.size)]
        return out or [Slice("", None, None)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if not partition.path:
            return
        names = ", ".join("?" if c == FILE else f'"{c}"' for c in self.columns) or "NULL"
        where, values = list(self.where), [partition.path for c in self.columns if c == FILE] + self.values
        if partition.low is not None:
            where.append("rowid >= ? AND rowid < ?")
            values += [partition.low, partition.high]
        with closing(opened(partition.path)) as db:
            for row in db.execute(f'SELECT {names} FROM "{self.table}"{" WHERE " * bool(where)}{" AND ".join(where)}', values):
                yield row if self.columns else ()


@dataclass
class Drafts(WriterCommitMessage):
    """What a task wrote: (catalogue, file)."""

    files: list[tuple[str, str]]


_STORED = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "binary": "BLOB", "double": "REAL"}


class Writer(DataSourceWriter):
    """Each task writes files of its own, one for each catalogue it has rows of; the commit joins them and puts them in place.

    Drafts lie in a folder of the run beside the targets, which must be a disk
    that driver and executors share.  Commit and abort remove that folder, with
    what lost tasks left in it, so a failed job leaves the catalogues as they were.
    Appending adds to the table of a file that is there; overwriting replaces this
    table in the files of the catalogues written, and nothing else.  Each file
    changes at once; files of several catalogues change one after another.
    """

    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.table, self.key, self.overwrite = options["table"], options.get("key"), overwrite
        self.target = options["folder"] if self.key else options["file"]
        self.columns = [c for c in schema.names if c != self.key]
        self.kinds = [_STORED.get(schema[c].dataType.simpleString(), "TEXT") for c in self.columns]
        self.at = schema.names.index(self.key) if self.key else None
        self.drafts = os.path.join(self.target if self.key else os.path.dirname(self.target) or ".", f".drafts-{uuid.uuid4().hex}")

    def _created(self, db: sqlite3.Connection) -> None:
        db.execute(f'CREATE TABLE IF NOT EXISTS "{self.table}" ({", ".join(f"{chr(34)}{c}{chr(34)} {k}" for c, k in zip(self.columns, self.kinds, strict=True))})')

    def _place(self, catalogue: str) -> str:
        if not self.key:
            return self.target
        if catalogue in ("", ".", "..") or "/" in catalogue or catalogue.startswith(".drafts-"):
            raise ValueError(f"{catalogue!r} can't name a folder")
        return os.path.join(self.target, catalogue, "catalog.sqlite")

    def write(self, iterator: Iterator[T.Row]) -> WriterCommitMessage:
        os.makedirs(self.drafts, exist_ok=True)
        insert = f'INSERT INTO "{self.table}" VALUES ({", ".join("?" * len(self.columns))})'
        done: list[tuple[str, str]] = []
        db, held = None, None
        try:
            for row in iterator:
                catalogue = "" if self.at is None else None if row[self.at] is None else str(row[self.at])
                if catalogue is None:
                    continue
                if db is None or catalogue != held:
                    self._place(catalogue)
                    if db is not None:
                        db.commit()
                        db.close()
                    held, path = catalogue, os.path.join(self.drafts, f"{uuid.uuid4().hex}.sqlite")
                    done.append((catalogue, path))
                    db = draft_database(path)
                    self._created(db)
                db.execute(insert, [_storable(v) for i, v in enumerate(row) if i != self.at])
            if db is not None:
                db.commit()
        except BaseException:
            for _, path in done:
                if os.path.exists(path):
                    os.remove(path)
            raise
        finally:
            if db is not None:
                db.close()
        return Drafts(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        of: dict[str, list[str]] = {}
        for catalogue, path in (f for m in messages if m for f in m.files):
            of.setdefault(catalogue, []).append(path)
        if not self.key:
            of.setdefault("", [])
        os.makedirs(self.drafts, exist_ok=True)
        try:
            for catalogue, paths in of.items():
                target, draft = self._place(catalogue), os.path.join(self.drafts, "whole.sqlite")
                if os.path.exists(target):
                    shutil.copyfile(target, draft)
                with closing(draft_database(draft)) as db:
                    if self.overwrite:
                        db.execute(f'DROP TABLE IF EXISTS "{self.table}"')
                    self._created(db)
                    names = ", ".join(f'"{c}"' for c in self.columns)
                    for path in paths:
                        db.execute("ATTACH ? AS draft", (path,))
                        db.execute(f'INSERT INTO main."{self.table}" ({names}) SELECT {names} FROM draft."{self.table}"')
                        db.commit()
                        db.execute("DETACH draft")
                os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
                os.replace(draft, target)
        finally:
            shutil.rmtree(self.drafts, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.drafts, ignore_errors=True)


def _storable(value):
    """A value of a row as SQLite holds it: lists and structs as their JSON, dates as text."""
    if isinstance(value, bytearray):
        return bytes(value)
    if isinstance(value, T.Row):
        return json.dumps(value.asDict(True), default=str)
    if isinstance(value, (list, dict)):
        return json.dumps(value, default=lambda v: v.asDict(True) if isinstance(v, T.Row) else str(v))
    return value if value is None or isinstance(value, (int, float, str, bytes)) else str(value)


def read_table(spark: SparkSession, paths: list[str], table: str, columns: list[str] | None = None, tests: Sequence[Test] = ()) -> DataFrame:
    """Rows of a table of several files that pass all tests, with the file of each in `_file`; only the named columns, where any are named.

    Only these columns and those of the tests are read.  SQLite tries the tests on
    which it agrees with Spark, so other rows never leave it; Spark tries all.
    """
    spark.dataSource.register(SqliteCatalog)
    told = {"files": json.dumps(paths), "table": table}
    kinds = {f.name: f for f in SqliteCatalog(told).schema().fields}
    wanted = list(kinds) if columns is None else columns
    read = list(dict.fromkeys([*wanted, *(name for name, *_ in tests)]))
    df = spark.read.format("sqlite_catalog").options(**told, tests=json.dumps([list(t) for t in tests])).schema(T.StructType([kinds[c] for c in read])).load()
    for t in tests:
        df = df.where(tested(t))
    return df.select(*[f"`{c}`" for c in wanted])


def write_catalogs(df: DataFrame, folder: str, table: str, key: str = "catalog_id", mode: str = "append") -> None:
    """Rows of many catalogues into their files, one task for each; rows of a null key are left out."""
    df.sparkSession.dataSource.register(SqliteCatalog)
    df.repartition(key).sortWithinPartitions(key).write.format("sqlite_catalog").options(folder=folder, table=table, key=key).mode(mode).save()


def list_catalogs(spark: SparkSession, folder: str) -> DataFrame:
    """(id, title, model) of each `<id>/catalog.sqlite` below a folder; one that can't be read is listed by its folder."""
    out = []
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name, "catalog.sqlite")
        if not os.path.isfile(path):
            continue
        try:
            with closing(opened(path)) as db:
                row = db.execute("SELECT id, title, model FROM catalog LIMIT 1").fetchone()
        except sqlite3.Error:
            row = None
        out.append(row or (name, None, None))
    return spark.createDataFrame(out, "id string, title string, model string")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One catalogue as a SQLite file, written by tasks; the file appears whole, with all its tables, in the place of any other."""
    draft = f"{path}.{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.sparkSession.dataSource.register(SqliteCatalog)
            df.write.format("sqlite_catalog").options(file=draft, table=name).mode("append").save()
        os.replace(draft, path)
    finally:
        if os.path.exists(draft):
            os.remove(draft)


def _stored(value, kind: str):
    """A JSON value as SQLite holds it: blobs as bytes, lists and structs as their JSON."""
    if kind == "BLOB" and value is not None:
        return base64.b64decode(value)
    return json.dumps(value) if isinstance(value, (list, dict)) else value


def database_files(tables: dict[str, DataFrame], key: str = "catalog_id") -> DataFrame:
    """(catalog_id, database): every catalogue's tables as the bytes of a SQLite file, each built by the task that has its rows.

    Rows stream through the tasks, sorted by catalogue and table, so a task holds
    one catalogue's file on its disk at a time; rows with a null key are left out.
    """
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "binary": "BLOB"}
    shapes = {name: [(c, kinds.get(t, "TEXT")) for c, t in df.dtypes if c != key] for name, df in tables.items()}
    parts = []
    for name, df in tables.items():
        columns = [F.col(f"`{c}`") if t != "binary" else F.base64(F.col(f"`{c}`")).alias(c) for c, t in df.dtypes if c != key]
        parts.append(df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("catalog_id"), F.lit(name).alias("name"), F.to_json(F.struct(*columns)).alias("row")))
    rows = reduce(DataFrame.unionByName, parts).repartition("catalog_id").sortWithinPartitions("catalog_id", "name", "row")

    def build(batches):
        held, db, path = None, None, None

        def closed():
            db.commit()
            db.close()
            with open(path, "rb") as f:
                data = f.read()
            os.remove(path)
            return pd.DataFrame({"catalog_id": [held], "database": [data]})

        try:
            for pdf in batches:
                for catalog, name, row in pdf.itertuples(index=False):
                    if catalog != held:
                        if held is not None:
                            yield closed()
                        held, path = catalog, tempfile.mkstemp(suffix=".sqlite")[1]
                        db = sqlite3.connect(path)
                        for table, shape in shapes.items():
                            db.execute(f'CREATE TABLE "{table}" ({", ".join(f"{chr(34)}{c}{chr(34)} {k}" for c, k in shape)})')
                    told = json.loads(row)
                    values = [_stored(told.get(c), kind) for c, kind in shapes[name]]
                    db.execute(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(values))})', values)
            if held is not None:
                yield closed()
        finally:
            if path and os.path.exists(path):
                os.remove(path)

    return rows.mapInPandas(build, "catalog_id string, database binary")
