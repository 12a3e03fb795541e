"""Outlines as a table function: any depth, odd entries, columns by argument."""

import json

import pytest
from pyspark.sql import functions as F

from partloom.sources import outline


def test_entries_in_print_order(spark):
    told = [{"title": "1 Engine", "page": 2, "items": [{"title": "101-000", "page": 3, "items": [{"title": "deep", "page": "x"}]}, {"title": "101-005"}]}, 7, {"title": None, "items": "none"}, {"page": True}]
    df = spark.createDataFrame([("a", json.dumps(told)), ("b", "{broken"), ("c", None), ("d", '{"title": "no list"}'), ("e", "[]")], "id string, outline string")
    got = [tuple(r) for r in outline.outline_rows(df).orderBy("id", "place").collect()]
    assert got == [
        ("a", 1, 1, "1 Engine", 2, "1 Engine", None), ("a", 2, 2, "101-000", 3, "1 Engine", "101-000"), ("a", 3, 3, "deep", None, "1 Engine", "101-000"), ("a", 4, 2, "101-005", None, "1 Engine", "101-005"),
        ("a", 5, 1, None, None, None, None), ("a", 6, 1, None, None, None, None),
    ]
    assert outline.outline_rows(df, levels=()).columns == ["id", "place", "depth", "title", "page"]


def test_depth_costs_no_calls(spark):
    """As deep as JSON itself is read, and wide."""
    text = "[" + ",".join('{"title":"w"}' for _ in range(5000)) + "]"
    for _ in range(300):
        text = '[{"title":"d","items":' + text + "}]"
    rows = outline.outline_rows(spark.createDataFrame([(text,)], "outline string"))
    assert rows.count() == 5300 and rows.agg(F.max("depth")).first()[0] == 301


def test_columns_follow_the_arguments(spark):
    outline.register(spark)
    assert spark.sql("SELECT * FROM parse_outline('[]', 'x,y,z')").columns == ["place", "depth", "title", "page", "x", "y", "z"]
    for bad in ("parse_outline(1, 'a')", "parse_outline('[]', 'title')", "parse_outline('[]', 'a,a')"):
        with pytest.raises(Exception, match="parse_outline"):
            spark.sql(f"SELECT * FROM {bad}").collect()
