"""Outlines of any depth as rows, by a table function whose columns follow its arguments."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

#: Columns of every outline: place in print order (from 1), depth (from 1), title, page.
FIXED = (("place", T.IntegerType()), ("depth", T.IntegerType()), ("title", T.StringType()), ("page", T.IntegerType()))


class ParseOutline:
    """parse_outline(json, 'a,b,..'): every entry of an outline of any depth, with the titles it stands under.

    The second argument, a constant, names the levels: the titles above an entry and
    its own stand in columns of these names, deeper levels in none.  Text that is no
    list of entries has no rows; a page that is no number is null.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, levels: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, T.StringType):
            raise ValueError("parse_outline: the outline must be a string")
        if not levels.isConstantExpression or not isinstance(levels.value, str):
            raise ValueError("parse_outline: the names of levels must be a constant string")
        names = [n for n in levels.value.split(",") if n]
        taken = [n for n, _ in FIXED]
        if len({*names, *taken}) < len(names) + len(taken):
            raise ValueError("parse_outline: a level has the name of another column")
        fields = [T.StructField(n, t) for n, t in FIXED] + [T.StructField(n, T.StringType()) for n in names]
        return AnalyzeResult(T.StructType(fields))

    def eval(self, text: str, levels: str) -> Iterator[tuple]:
        wanted = sum(bool(n) for n in levels.split(","))
        try:
            top = json.loads(text) if text else []
        except ValueError:
            return
        # lists that are being read lie on a stack, so depth costs no calls
        waiting = [(iter(top if isinstance(top, list) else []), ())]
        place = 0
        while waiting:
            entries, above = waiting[-1]
            entry = next(entries, waiting)
            if entry is waiting:
                waiting.pop()
                continue
            if not isinstance(entry, dict):
                continue
            place += 1
            title = entry.get("title")
            title = None if title is None else str(title)
            path = (*above, title)
            page = entry.get("page")
            yield (place, len(path), title, page if isinstance(page, int) and not isinstance(page, bool) else None, *path[:wanted], *[None] * max(0, wanted - len(path)))
            below = entry.get("items")
            waiting.append((iter(below if isinstance(below, list) else []), path))


def register(spark: SparkSession) -> None:
    """Make parse_outline known to SQL."""
    spark.udtf.register("parse_outline", udtf(ParseOutline))


def outline_rows(df: DataFrame, column: str = "outline", levels: tuple[str, ...] = ("main_group", "section")) -> DataFrame:
    """Rows of `df`, without the outline, with the entries of their outlines."""
    register(df.sparkSession)
    kept = "".join(f"t.`{c}`, " for c in df.columns if c != column)
    return df.sparkSession.sql(f"SELECT {kept}o.* FROM {{t}} t, LATERAL parse_outline(t.`{column}`, '{','.join(levels)}') o", t=df)
