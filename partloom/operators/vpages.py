"""Reference tables printed in front of a catalogue, read by windows and array expressions over its rows.

Each layout is a line of layouts(): the heading that names its pages, the row that
begins it, and how its rows become records.  Pages without a heading continue
the open table, and rows without a start continue the open record; what is
carried from row to row is folded page by page, and then over the pages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, expand_two_digit, leading_int, range_end, tech_data, undotted
from ..sources.tables import settled, tasks_for
from .ordered import scanned

OUT = "catalog_id string, table_name string, seq int, fields map<string,string>"
# How the layouts print dates, periods, codes and ranges of numbers.
DATE = r"^\d{2}\.\d{2}\.\d{4}"
PERIOD = r"^\d{2}/\d{2}-\d{2}/\d{2}\z"
RANGE = r"^[A-Z0-9]*\d*>[A-Z0-9]*\d*\z"
DIGITED_RANGE = r"^(?=.*\d)[A-Z0-9]*>[A-Z0-9]*\z"
OPTION_CODE = r"^(?:\d{3}|[A-Z][A-Z0-9]{2,3})\z"
ENGINE = r"^[A-Z]\d{2}\.[0-9A-Z]{2,3}\z"
GEARBOX = r"^[GA]\d{2}\.\d{2}\z"
GEARBOX_PLAIN = r"^[GA]\d{4}\z"
GEARBOX_SHORT = r"^\d{3}(?:/\d)?\z"
CHASSIS_RANGE = r"^[A-Z]*\d\w*>(?:[A-Z]*\d\w*)?\z"
CHASSIS_SHAPE = r"^\d\d[A-Z0-9]S\d\z"
OPEN_TYPE = r"^(.+?)\s+(\d{2})\s+\d\s+(\d{4,6})\s+(\d{3,})\s*[>»]+\s*(\d{3}\.\d{2})\z"
OPEN_CODE = r"^(.+?)\s+(\d{3}\.\d{2})\s+(\d{2})\s+\d\s+(\d{3,6})\s+(\d{3,})\s*[>»]+\s*(.+)\z"
BODY_WORD = r"^(?:SPEEDSTER|CONVERTIBLE|CABRIO(?:LET)?|COUPE|HARDTOP|ROADSTER|\([A-Z]{1,4}\))\z"


def _tokens() -> Column:
    return F.col("tokens")


def _line() -> Column:
    return F.col("line")


def _none() -> Column:
    return F.lit(None).cast("string")


def some(test: Callable[[Column], Column]) -> Column:
    return F.exists(_tokens(), test)


def place(test: Callable[[Column], Column], after: Column | int = 0) -> Column:
    """Place (from 1) of the first token behind place `after` that fits; null if none does."""
    at = F.transform(_tokens(), lambda t, i: F.when(test(t) & (i >= after), i + 1))
    return F.array_min(at)


def words(low: Column | int, high: Column | None = None) -> Column:
    """Tokens from place `low` up to and without `high`, joined."""
    low = F.lit(low) if isinstance(low, int) else low
    return F.array_join(F.slice(_tokens(), low, F.greatest((F.size(_tokens()) + 1 if high is None else high) - low, F.lit(0))), " ")


def token(at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(at != 0, F.try_element_at(_tokens(), at))


def _dated() -> Column:
    return some(lambda t: t.rlike(DATE))


def _model_line() -> Column:
    return some(lambda t: t.startswith("Model:"))


def carried(df: DataFrame, **values: Column) -> DataFrame:
    """Add the last value of each that was not null, this row's included; a task sees a page at a time."""
    return scanned(df, {n: ("last", v) for n, v in values.items()}, ["catalog_id"], ["page", "row_idx"], "page")


def period(at: Column) -> dict[str, Column]:
    ends = F.split(token(at), "-")
    return {"mount_from": ends[0], "mount_to": ends[1], "remark": blank(words(at + 1))}


def described(df: DataFrame, name: str, values: dict[str, Column]) -> DataFrame:
    """Rows of the table `name` in print order."""
    fields = [F.lit(x) if isinstance(x, str) else x.cast("string") for pair in values.items() for x in pair]
    return df.select("catalog_id", F.lit(name).alias("table_name"), "page", "row_idx", F.create_map(*fields).alias("fields"))


def with_continuations(df: DataFrame, starts: Column, text: Column) -> DataFrame:
    """Starting rows, each with `more`: the texts of the rows up to the next one, in order."""
    marked = df.withColumn("_start", F.coalesce(starts, F.lit(False)))
    numbered = carried(marked, _record=F.when(F.col("_start"), F.struct("page", "row_idx"))).where("_record IS NOT NULL")
    own = F.max(F.when(F.col("_start"), F.struct("page", "row_idx", *[c for c in df.columns if c not in ("catalog_id", "page", "row_idx")])))
    more = F.array_sort(F.collect_list(F.when(~F.col("_start"), F.struct("page", "row_idx", text.alias("text")))))
    return numbered.groupBy("catalog_id", "_record").agg(own.alias("_own"), F.transform(more, lambda r: r["text"]).alias("more")).select("catalog_id", "_own.*", "more")


# Records of each layout; every reader takes the rows below its beginning


def options(df: DataFrame) -> list[DataFrame]:
    own = df.where(~(_line().startswith("Optional Equipment") | _model_line() | _dated() | (_tokens()[0] == "*")))
    held = with_continuations(own, _tokens()[0].rlike(OPTION_CODE), _line())
    return [described(held, "pr_code", {"code": _tokens()[0], "description": F.trim(F.concat_ws(" ", words(2), F.array_join("more", " ")))})]


def sales(df: DataFrame) -> list[DataFrame]:
    at = place(lambda t: t.rlike(PERIOD), 1)
    own = df.where(at.isNotNull() & _tokens()[0].rlike(r"^\d{5,6}\z") & ~_model_line() & (place(lambda t: t.rlike(PERIOD)) > 1))
    return [described(own, "sales_type", {"sales_term": _tokens()[0], "description": words(2, at), **period(at)})]


def chassis(df: DataFrame) -> list[DataFrame]:
    own = df.where(~_model_line() & ~((F.size(_tokens()) == 1) & (_tokens()[0] == "V-Pages")))
    starts = _tokens()[0].rlike(r"^\d{4}\z")
    held = with_continuations(own.where(starts | ~_dated()), starts, F.trim(_line()))
    at = F.coalesce(place(lambda t: t.startswith(">"), 3), F.lit(4))
    remark = blank(F.concat_ws(" ", blank(words(at + 1)), blank(F.array_join("more", " "))))
    return [described(held, "vin_range", {"model_year": _tokens()[0], "start_date": token(2), "vin_from": token(3), "vin_to": blank(F.regexp_replace(F.coalesce(token(at), F.lit("")), "^>", "")), "remark": remark})]


def mounted(df: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with a mounting period behind their first token, and its place."""
    at = place(lambda t: t.rlike(PERIOD))
    return df.where((at > 1) & ~_model_line() & ~_dated()), at


def engines(df: DataFrame) -> list[DataFrame]:
    own, at = mounted(df)
    from_right = lambda k: F.when(at - k > 1, F.try_element_at(_tokens(), F.greatest(at - k, F.lit(1))))
    return [described(own, "engine_code", {"ec": _tokens()[0], "displacement_l": blank(from_right(4)), "power_kw": leading_int(from_right(3)), "power_hp": leading_int(from_right(2)), "cylinders": leading_int(from_right(1)), **period(at)})]


def gearboxes(df: DataFrame) -> list[DataFrame]:
    own, at = mounted(df)
    return [described(own, "transmission_code", {"tc": _tokens()[0], "type_code": F.when(at > 2, F.try_element_at(_tokens(), F.greatest(at - 1, F.lit(1)))), **period(at)})]


def numbers(table: str, kind: str) -> Callable[[DataFrame], list[DataFrame]]:
    def read(df: DataFrame) -> list[DataFrame]:
        at = place(lambda t: t.rlike(r"^20\d{2}\z"))
        printed = words(1, at)
        low, high = F.trim(F.substring_index(printed, ">", 1)), F.trim(F.regexp_replace(printed, "^[^>]*>?", ""))
        both = printed.contains(">") & (low != "") & (high != "")
        values = {"number_from": F.when(both, low).otherwise(printed), "number_to": F.when(both, range_end(low, high)), "model_year": token(at), "vehicle_type": words(at + 1, F.size(_tokens())), kind: F.element_at(_tokens(), -1)}
        return [described(df.where((at > 1) & ~_dated()), table, values)]

    return read


def two_digit_year(value: Column) -> Column:
    return expand_two_digit(F.regexp_extract(value, r"^\s*(\d+)", 1), F.col("pivot"))


def old_types(df: DataFrame) -> list[DataFrame]:
    own = df.where(~(F.array_contains(_tokens(), "SUMMARY") & F.array_contains(_tokens(), "TYPES")) & ~F.array_contains(_tokens(), "PLEASE") & ~_line().contains("NOTE THE LAST"))
    own = own.withColumn("tokens", F.when(_tokens()[0] == "*", F.slice(_tokens(), F.lit(2), F.size(_tokens()))).otherwise(_tokens())).withColumn("line", F.array_join("tokens", " "))
    own = own.withColumn("at", place(lambda t: t.rlike(CHASSIS_RANGE))).where(F.col("at").isNotNull() | _line().rlike(OPEN_TYPE))
    part = lambda k: F.regexp_extract(_line(), OPEN_TYPE, k)
    opened, at = F.col("at").isNull(), F.col("at")
    years = F.array_max(F.transform(_tokens(), lambda t, i: F.when(t.rlike(r"^\d{2}\z") & (i + 1 < at), i + 1)))
    own = own.withColumn("at_year", years)
    year = F.col("at_year")
    own = carried(own, vehicle=F.when(opened, part(1)).otherwise(blank(words(1, year))), year=F.when(opened, part(2)).otherwise(token(year)))
    lead = F.when(year.isNotNull(), F.slice(_tokens(), year + 1, F.greatest(at - year - 1, F.lit(0))))
    shaped, lettered = (F.filter(lead, _fits(p)) for p in (CHASSIS_SHAPE, "[A-Z]"))
    low, high = F.substring_index(token(at), ">", 1), F.regexp_replace(token(at), "^[^>]*>", "")
    inner = F.regexp_extract(low, r"^(.*[A-Z])\d+\z", 1)
    prefix = F.coalesce(blank(inner), F.try_element_at(shaped, F.lit(1)), F.try_element_at(lettered, F.lit(1)), F.lit(""))
    ranged = {
        "vin_from": blank(F.when(inner != "", low).otherwise(F.concat(prefix, low))), "vin_to": blank(F.when(high.rlike(r"^\d+\z"), F.concat(prefix, high)).otherwise(high)),
        "remark": blank(F.concat_ws(" — ", F.col("vehicle"), blank(words(at + 1)))),
    }
    open_ended = {"vin_from": F.concat_ws(" ", part(3), part(4)), "vin_to": _none(), "remark": F.concat_ws(" — ", part(1), part(5))}
    values = {k: F.when(opened, open_ended[k]).otherwise(ranged[k]) for k in ranged}
    return [described(own, "vin_range", {"model_year": F.col("year").try_cast("int"), "start_date": _none(), **values})]


def _fits(pattern: str) -> Callable[[Column], Column]:
    return lambda t: t.rlike(pattern)


def summary_rows(df: DataFrame, code: str) -> DataFrame:
    """Rows of an old summary by shape: `open` (a whole line), `coded` (a code of the family), `short` (a year between code and range), or `other`."""
    own = df.withColumn("at_code", place(_fits(code)))
    middle = F.array_min(F.transform(_tokens(), lambda t, i: F.when((i > 0) & (i + 1 < F.size(_tokens())) & t.rlike(r"^\d{2}\z") & F.try_element_at(_tokens(), i + 2).rlike(r"^(?=.*\d)(?=.*[>/])"), i + 1)))
    own = own.withColumn("at_year", middle).withColumn("at_range", F.when(F.col("at_code").isNotNull(), place(_fits(DIGITED_RANGE), F.col("at_code"))))
    shape = F.when(_line().rlike(OPEN_CODE), "open").when(F.col("at_code").isNotNull(), "coded").when(F.col("at_year").isNotNull(), "short").otherwise("other")
    return own.withColumn("shape", shape)


def _open(k: int) -> Column:
    return F.regexp_extract(_line(), OPEN_CODE, k)


def _by_shape(**cases: Column) -> Column:
    return reduce(lambda chain, c: chain.when(F.col("shape") == c[0], c[1]), cases.items(), F.when(F.lit(False), _none()))


def first_of_code(df: DataFrame, table: str, key: str, values: dict[str, Column]) -> DataFrame:
    """The first row of each code."""
    own = df.withColumn("_turn", F.row_number().over(Window.partitionBy("catalog_id", "code").orderBy("page", "row_idx"))).where("_turn = 1")
    return described(own, table, {key: F.col("code"), **values, "mount_from": _none(), "mount_to": _none(), "remark": _none()})


def old_engines(df: DataFrame) -> list[DataFrame]:
    own = summary_rows(df.where(~(F.array_contains(_tokens(), "SUMMARY") & F.array_contains(_tokens(), "ENGINES"))), ENGINE)
    code, at, year = F.col("at_code"), F.col("at_range"), F.col("at_year")
    lone = (F.col("shape") == "other") & (F.size(_tokens()) == 1) & _tokens()[0].rlike(DIGITED_RANGE)
    own = own.where(((F.col("shape") == "coded") & (at > 1)) | F.col("shape").isin("open", "short") | lone)
    low = lambda c: F.substring_index(c, ">", 1)
    high = lambda c: F.regexp_replace(c, "^[^>]*>", "")
    sides = F.split(token(year + 1), "[>/]")
    start = F.concat_ws(" ", token(at - 1), blank(low(token(at))))
    own = own.withColumn("code", _by_shape(open=_open(2), coded=token(code), short=token(year - 1)))
    own = own.withColumn("tech", _by_shape(open=_open(6), coded=words(at + 1), short=words(year + 2)))
    own = own.withColumn("from", _by_shape(open=F.concat_ws(" ", _open(4), _open(5)), coded=start, short=sides[0], other=low(_tokens()[0])))
    own = own.withColumn("to", _by_shape(open=_none(), coded=range_end(start, high(token(at))), short=F.try_element_at(sides, F.lit(2)), other=high(_tokens()[0])))
    told = F.struct(
        two_digit_year(_by_shape(open=_open(3), coded=token(code + 1), short=token(year))).alias("year"), _by_shape(open=_open(1), coded=words(1, code), short=words(1, year - 1)).alias("vehicle"),
        F.when(F.col("shape") == "coded", undotted(F.col("code"))).otherwise(F.col("code")).alias("kind"),
    )
    own = carried(own, held=F.when(F.col("code").isNotNull(), told)).where(F.col("held").isNotNull())
    tech = tech_data(F.col("tech"))
    codes = first_of_code(own.where("code IS NOT NULL"), "engine_code", "ec", {"displacement_l": tech["displacement_l"], "power_kw": tech["power_kw"], "power_hp": _none(), "cylinders": tech["cylinders"]})
    return [codes, described(own, "engine_number_range", {"number_from": blank(F.col("from")), "number_to": blank(F.col("to")), "model_year": F.col("held.year"), "vehicle_type": F.col("held.vehicle"), "engine_type": F.col("held.kind")})]


def old_gearboxes(df: DataFrame) -> list[DataFrame]:
    own = summary_rows(df.where(~F.array_contains(_tokens(), "SUMM.TRANSMISS.") & ~(F.array_contains(_tokens(), "SUMMARY") & F.array_contains(_tokens(), "TRANSMISS"))), GEARBOX)
    code, at, year = F.col("at_code"), F.col("at_range"), F.col("at_year")
    plain = place(_fits(GEARBOX_PLAIN), code)
    short = (F.col("shape") == "short") & token(year - 1).rlike(GEARBOX_SHORT) & token(year + 1).rlike(RANGE)
    body = (F.size(_tokens()) == 1) & _tokens()[0].rlike(BODY_WORD) & (F.col("shape") == "other")
    own = own.where(((F.col("shape") == "coded") & at.isNotNull() & plain.isNotNull()) | (F.col("shape") == "open") | short | body)
    low, high = F.substring_index(token(at), ">", 1), F.regexp_replace(token(at), "^[^>]*>", "")
    start = F.regexp_replace(F.trim(F.concat_ws(" ", token(plain), token(at - 1), blank(low))), r"\s+", " ")
    # a lone body word belongs to the vehicle of the row before it, unless that has a code of the newer family
    own = with_continuations(own, F.col("shape") != "other", _line())
    own = own.withColumn("code", _by_shape(open=_open(2), coded=token(code), short=token(year - 1)))
    own = own.withColumn("type", _by_shape(open=F.trim(_open(6)), coded=blank(words(at + 1)), short=blank(words(year + 2))))
    ends = F.split(token(year + 1), ">")
    vehicle = _by_shape(open=_open(1), coded=words(1, code), short=words(1, year - 1))
    values = {
        "number_from": blank(_by_shape(open=F.concat_ws(" ", _open(4), _open(5)), coded=start, short=ends[0])), "number_to": blank(_by_shape(coded=range_end(start, high), short=F.try_element_at(ends, F.lit(2)))),
        "model_year": two_digit_year(_by_shape(open=_open(3), coded=token(code + 1), short=token(year))), "vehicle_type": F.when(F.col("shape") == "coded", vehicle).otherwise(F.trim(F.concat_ws(" ", vehicle, F.array_join("more", " ")))),
        "gearbox_type": F.when(F.col("shape") == "coded", token(plain)).otherwise(F.col("code")),
    }
    return [first_of_code(own, "transmission_code", "tc", {"type_code": F.col("type")}), described(own, "transmission_number_range", values)]


@dataclass(frozen=True)
class Layout:
    """A printed table: what names its pages, what begins it, and its reader."""

    heading: str
    begins: Column
    read: Callable[[DataFrame], list[DataFrame]]
    latch: str
    plain: Column | None = None  # rows that are looked at; all by default


def layouts() -> tuple[Layout, ...]:
    """All layouts, in the order in which their headings are looked for on a page."""
    return (
        Layout("Optional Equipment", _line().rlike(r"\bNR\b") & _line().contains("Description"), options, "pr"),
        Layout("Model Overview Sales Type", _line().contains("Sales term"), sales, "sales"),
        Layout("Model Overview EC", _tokens()[0] == "EC", engines, "ec"),
        Layout("Model Overview TC", _tokens()[0] == "TC", gearboxes, "tc"),
        Layout("VIN-Numbers Overview", _line().contains("Model year"), chassis, "vin"),
        Layout("SUMMARY TYPES", some(lambda t: (t == "VIN") | t.startswith("IDENT")), old_types, "types", ~(_dated() | _model_line() | ((F.size(_tokens()) == 1) & (_tokens()[0] == "V-Pages")))),
        Layout("SUMMARY ENGINES", F.array_contains(_tokens(), "MY"), old_engines, "eng", ~((_tokens()[0] == "V-Pages") | _model_line() | _dated())),
        Layout("SUMM.TRANSMISS", F.array_contains(_tokens(), "MY"), old_gearboxes, "gear", ~((_tokens()[0] == "V-Pages") | _model_line() | _dated())),
        Layout("Engine type", _line().contains("Engine number"), numbers("engine_number_range", "engine_type"), "en"),
        Layout("Gearbox type", _line().contains("Gearbox type"), numbers("transmission_number_range", "gearbox_type"), "gn"),
    )


OLD_HEADINGS = "SUMMARY ENGINES|SUMM\\.TRANSMISS|SUMMARY TYPES"
MODEL = r"Model:\s*(.+?)\s+Model life"
LIFE = r"Model life\s+(\d{4})\s*>>\s*(\d{4})"


def page_texts(rows: DataFrame) -> DataFrame:
    """(catalog_id, page, text, n, active): each page's text, the number of its rows, and the layout that they belong to."""
    lines = F.array_sort(F.collect_list(F.struct("row_idx", F.array_join("tokens", " ").alias("line"))))
    pages = rows.groupBy("catalog_id", "page").agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("text"), F.count(F.lit(1)).alias("n"))
    headings = [layout.heading for layout in layouts()]
    named = reduce(lambda chain, k: chain.when(F.col("text").contains(headings[k]), k), range(1, len(headings)), F.when(F.col("text").contains(headings[0]), 0))
    upto = Window.partitionBy("catalog_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("active", F.last(named, ignorenulls=True).over(upto))


def catalog_facts(pages: DataFrame) -> DataFrame:
    """(catalog_id, model, dialect, pivot, life_end) from the first page that prints each."""
    first = lambda pattern, k: F.min_by(F.regexp_extract("text", pattern, k), F.when(F.col("text").rlike(pattern), F.col("page")))
    old = F.max(F.col("text").rlike(OLD_HEADINGS))
    return pages.groupBy("catalog_id").agg(F.coalesce(first(MODEL, 1), F.lit("")).alias("model"), F.when(old, "old").otherwise("modern").alias("dialect"), first(LIFE, 1).cast("int").alias("pivot"), first(LIFE, 2).cast("int").alias("life_end"))


def parse(rows: DataFrame) -> DataFrame:
    """Rows of all reference tables from front-page rows (catalog_id, page, row_idx, tokens).

    Each catalogue also gets one row of table `catalog`: model, dialect, pivot, life_end.
    """
    clean = F.filter(F.transform("tokens", lambda t: F.regexp_replace(t, r"^\s+|\s+\z", "")), lambda t: t != "")
    rows = rows.select("catalog_id", "page", "row_idx", clean.alias("tokens"))
    pages = settled(page_texts(rows), "front_pages")
    facts = catalog_facts(pages)
    told = rows.where(F.size("tokens") > 0).withColumn("line", F.array_join("tokens", " ")).join(pages.select("catalog_id", "page", "active"), ["catalog_id", "page"]).join(facts.select("catalog_id", "pivot"), "catalog_id")
    # a table begins behind the first of its rows that does: the least place, so no task walks through a catalogue
    kinds = list(enumerate(layouts()))
    by_layout = lambda value: reduce(lambda chain, k: chain.when(F.col("active") == k[0], value(k[1])), kinds[1:], F.when(F.col("active") == 0, value(kinds[0][1])))
    seen = told.where(by_layout(lambda x: F.lit(True) if x.plain is None else x.plain))
    at = F.struct("page", "row_idx")
    first = seen.where(by_layout(lambda x: x.begins)).groupBy("catalog_id", "active").agg(F.min(at).alias("_first"))
    begun = seen.join(first, ["catalog_id", "active"]).where(at > F.col("_first")).drop("_first")
    # the readers' tests are dear and each file is a task of theirs, so rows are dealt whatever files or pages they came from
    n = tasks_for(rows.sparkSession, pages.agg(F.sum("n")).first()[0] or 0)
    begun = settled(begun.repartition(n, "catalog_id", "page", "row_idx"), "front_rows")
    found = [facts.select("catalog_id", F.lit("catalog").alias("table_name"), F.lit(0).alias("page"), F.lit(0).alias("row_idx"), F.create_map(*[x for c in ("model", "dialect", "pivot", "life_end") for x in (F.lit(c), F.col(c).cast("string"))]).alias("fields"))]
    for k, layout in kinds:
        found += layout.read(begun.where(F.col("active") == k).drop("active"))
    out = reduce(DataFrame.unionByName, found)
    seq = F.row_number().over(Window.partitionBy("catalog_id", "table_name").orderBy("page", "row_idx"))
    return out.select("catalog_id", "table_name", seq.alias("seq"), "fields")


def table_of(parsed: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    """One reference table with typed columns."""
    return parsed.where(F.col("table_name") == name).select("catalog_id", "seq", *[F.col("fields")[c].try_cast(t).alias(c) for c, t in columns.items()])
