"""Parts pages to part rows, in windows and array expressions over positioned text.

Printed rows are classed by what stands in their columns.  A running sum over a
section's rows numbers the blocks that some classes open, another one the
variants inside a block; what a row adds to its part is then an ordered
aggregate.  Everything is dealt by (catalogue, section), also over page ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scope import is_scope, with_scope
from ..functions.text import blank
from ..sources.tables import settled
from . import applicability as scopes

# Fixed values of the printed layout: headings, where colour codes begin, and texts that mark a row.
HEADINGS = ("Pos", "Part Number", "Description", "Remark", "Qty", "Model")
HEADINGS_LEAST = 4
COLOUR_X = 130
ROW_REACH = 3
ORIGIN_REACH = 5
POSITION = r"^(?:\d{1,3}(?:/\d{1,3})?|\(\d{1,3}(?:/\d{1,3})?\))\z"
NOTE = r"(?i)^(?:with:|without:|also use:|use if required:|only in conj\. with:|see illustration|comprising:|we take back:|group:)"
FLAG = r"(?i)^Discontinued part\z"
FOOTER = r"^\d{2}\.\d{2}\.\d{4}"
CUT_LENGTH = r"(?i)^shorten to:"
SCOPE_LABEL = r"(?i)^(?:valid up to:|valid from:)"
VALUE_LABEL = r"(?i)^relay location/code no\.:"
EXCLUSION = r"(?i)^not for:"
COUNTRY_CODES = {"AUSTRALIEN": "AUS"}

SECTION = ["catalog_id", "section_id"]
PAGE = [*SECTION, "page"]
ROWS = "catalog_id string, section_id string, kind string, block int, child int, position string, part_number string, colour_code string, description string, quantity string, remarks string, model string, model_scope string, applicability string"


def text_rows(items: DataFrame, reach: int = ROW_REACH) -> DataFrame:
    """(catalog_id, section_id, page, at, tokens): printed rows from top to bottom, tokens of (x, idx, str) from left to right.

    An item belongs to the first row opened within `reach` of its height, in the
    order of the items, or opens one.  A page with an unplaced item gives no rows.
    """
    height = F.floor(F.col("page_height") - F.col("y") + 0.5)
    placed = F.col("x").isNotNull() & height.isNotNull() & ~F.isnan("x") & ~F.isnan(F.col("page_height") - F.col("y"))
    visible = items.where(F.trim(F.regexp_replace("str", r"\s+", " ")) != "")
    told = F.struct("item_idx", height.cast("int").alias("at"), "x", F.regexp_replace("str", r"^\s+|\s+\z", "").alias("str"))
    pages = visible.groupBy(*PAGE).agg(F.array_sort(F.collect_list(told)).alias("items"), F.min(placed).alias("whole")).where("whole")
    near = lambda at: lambda row: F.abs(row - at) <= reach
    opened = F.aggregate("items", F.array().cast("array<int>"), lambda rows, i: F.when(F.exists(rows, near(i["at"])), rows).otherwise(F.concat(rows, F.array(i["at"]))))
    dealt = pages.withColumn("rows", opened).select(*PAGE, F.explode(F.transform("items", lambda i: F.struct(F.filter("rows", near(i["at"]))[0].alias("at"), i["x"].alias("x"), i["item_idx"].alias("idx"), i["str"].alias("str")))).alias("i"))
    return dealt.groupBy(*PAGE, F.col("i.at").alias("at")).agg(F.array_sort(F.collect_list(F.struct("i.x", "i.idx", "i.str"))).alias("tokens"))


def table_rows(rows: DataFrame) -> DataFrame:
    """Rows below the headings of their page, with the text of each column, and the part number apart from the colour code."""
    texts = F.transform("tokens", lambda t: t["str"])
    chrome = ((F.size("tokens") == 1) & texts[0].startswith("Illustration:")) | F.exists(texts, lambda t: t.startswith("Model:")) | texts[0].rlike(FOOTER)
    heads = F.size(F.filter(texts, lambda t: t.isin(*HEADINGS))) >= HEADINGS_LEAST
    page = Window.partitionBy(*PAGE)
    headed = rows.where(~chrome).withColumn("_head", F.when(heads, F.struct("at", "tokens"))).withColumn("_head", F.min("_head").over(page)).where(F.col("at") > F.col("_head.at"))
    # the rightmost heading that starts no further right, else the first
    home = lambda t: F.coalesce(F.try_element_at(F.filter("_head.tokens", lambda h: h["x"] <= t["x"] + ORIGIN_REACH), F.lit(-1)), F.col("_head.tokens")[0])["str"]
    placed = headed.withColumn("_cells", F.transform("tokens", lambda t: F.struct(home(t).alias("home"), t["x"].alias("x"), t["str"].alias("str"))))
    said = lambda test: F.array_join(F.transform(F.filter("_cells", test), lambda c: c["str"]), " ")
    under = lambda heading: lambda c: c["home"] == heading
    columns = {"pos": "Pos", "desc": "Description", "remark": "Remark", "qty": "Qty", "model": "Model"}
    number = under("Part Number")
    cells = [said(under(h)).alias(n) for n, h in columns.items()]
    return placed.select(*PAGE, "at", *cells, said(lambda c: number(c) & (c["x"] < COLOUR_X)).alias("number"), said(lambda c: number(c) & (c["x"] >= COLOUR_X)).alias("colour"))


#: Classes of rows by the first test that holds; the first three open a block, `stop` closes it.
OPENING = ("placed", "stock", "loose")


def row_class() -> Column:
    pos, number, note = F.col("pos"), F.col("number"), F.col("desc").rlike(NOTE)
    hyphen = pos == "-"
    return (
        F.when(pos.rlike(POSITION), "placed").when(hyphen & (number != ""), "stock").when(hyphen & (F.col("qty") != "") & ~note, "loose").when(pos != "", "stop")
        .when(number.rlike("[0-9A-Za-z]"), "variant").when(note, "note").otherwise("text")
    )


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with their class, block (0 where none is open) and number of the variant they belong to."""
    order = Window.partitionBy(*SECTION).orderBy("page", "at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens, cls = F.col("class").isin(*OPENING), F.col("class")
    out = rows.withColumn("class", row_class()).withColumn("_count", F.sum(opens.cast("int")).over(upto))
    out = out.withColumn("_open", F.last(F.when(opens, True).when(cls == "stop", False), ignorenulls=True).over(upto))
    out = out.withColumn("block", F.when(F.coalesce("_open", F.lit(False)), F.col("_count")).otherwise(0))
    # a title stands on the first page, before any row of another class
    out = out.withColumn("title", (F.col("page") == F.col("first_page")) & (cls == "text") & ~F.coalesce(F.max(cls != "text").over(before), F.lit(False)))
    inside = Window.partitionBy(*SECTION, "block").orderBy("page", "at").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("child", F.when(F.col("block") > 0, F.sum((cls == "variant").cast("int")).over(inside)).otherwise(0))
    # the stock that a cut length comes from: the last block before it with a number of its own
    full = F.concat_ws(" ", blank(F.col("number")), blank(F.col("colour")))
    stock = F.last(F.when(cls.isin("placed", "stock") & (full != ""), F.col("_count")), ignorenulls=True).over(before)
    cut = (cls == "placed") & (full == "") & F.col("desc").rlike(CUT_LENGTH)
    return out.withColumn("full", full).withColumn("cut_from", F.when(cut, stock)).drop("_open", "_count")


def with_reading(rows: DataFrame) -> DataFrame:
    """Add `reads`: whether the Model text of a variant is scope as a whole; else it is a remark."""
    asked = (F.col("class") == "variant") & (F.col("model") != "")
    read = with_scope(rows.where(asked), "model", "_read").withColumn("reads", is_scope(F.col("_read"))).drop("_read")
    return read.unionByName(rows.where(~asked).withColumn("reads", F.lit(False)))


def pieces(rows: DataFrame) -> DataFrame:
    """What each row of a block adds: `say` to the description, `tell` to the remark, `scope` segments, and `gate` of the Model column.

    Each goes to the row's part or variant, but for the Model text of rows
    without a number, which extends the part.
    """
    inside = Window.partitionBy(*SECTION, "block").orderBy("page", "at")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    desc, cls = F.col("desc"), F.col("class")
    country = F.element_at(F.create_map(*[F.lit(x) for pair in COUNTRY_CODES.items() for x in pair]), F.upper(desc))
    kind = (
        F.when(cls.isin(*OPENING, "variant"), "head").when(cls == "note", "note").when(desc.rlike(SCOPE_LABEL), "label")
        .when(desc.rlike(VALUE_LABEL), "value").when(desc.rlike(EXCLUSION), "exclusion").when(desc != "", "words").otherwise("rest")
    )
    df = rows.where("block > 0").withColumn("kind", kind)
    df = df.withColumn("_noted", F.coalesce(F.max(F.col("kind") == "note").over(before), F.lit(False)))
    df = df.withColumn("_armed", F.coalesce(F.last(F.when(F.col("kind") == "exclusion", True).when(F.col("kind") == "words", False), ignorenulls=True).over(before), F.lit(False)))
    kind, noted = F.col("kind"), F.col("_noted")
    barred = (kind == "words") & F.col("_armed") & country.isNotNull()
    scoping = (kind == "words") & ~barred & scopes.printed_scope(desc)
    plain = (kind == "words") & ~barred & ~scoping
    both = F.concat_ws(" ", blank(desc), blank(F.col("remark")))
    aside = plain & noted & ~desc.rlike(FLAG)
    cut = F.col("cut_from").isNotNull()
    say = F.when((kind == "head") & ~cut, desc).when(plain & ~aside, desc)
    tell = (
        F.when((kind == "head") & cut, both).when(kind == "head", F.concat_ws(" ", blank(F.col("remark")), F.when((cls == "variant") & ~F.col("reads"), blank(F.col("model"))))).when((kind == "note") | ((kind == "value") & ~noted), both)
        .when(aside, both).when(((kind == "words") & ~barred) | (kind == "rest"), F.col("remark"))
    )
    scope = F.when(barred, F.concat(F.lit('-"'), country, F.lit('"'))).when(scoping, desc)
    model = F.when((cls != "variant") | F.col("reads"), F.col("model"))
    return df.withColumn("say", blank(say)).withColumn("tell", blank(tell)).withColumn("scope", blank(scope)).withColumn("gate", blank(model))


def _in_order(column: str) -> Column:
    """Values of rows in print order, without nulls."""
    rows = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("page", "at", column))))
    return F.transform(rows, lambda r: r[column])


def part_rows(rows: DataFrame) -> DataFrame:
    """Parts and their variants (kind `part`) from rows in blocks."""
    key = [*SECTION, "block"]
    told = pieces(rows)
    head = lambda c: F.max(F.when(F.col("kind") == "head", F.col(c))).alias(c)
    own_gate = F.when(F.col("class") == "variant", F.col("gate"))
    part_gate = F.when(F.col("class") != "variant", F.col("gate"))
    known = ("dialect", "pivot", "life_end")
    lines = told.withColumn("own_gate", own_gate).groupBy(*key, "child").agg(*[head(c) for c in ("class", "pos", "full", "colour", "qty", "cut_from", "own_gate")], *[_in_order(c).alias(c) for c in ("say", "tell", "scope")], *[F.first(c).alias(c) for c in known])
    gates = told.withColumn("gate", part_gate).groupBy(*key).agg(scopes.glued_list(_in_order("gate")).alias("part_gate"))
    stock = lines.where("child = 0").select(*[F.col(c).alias(f"_{c}") for c in key], F.col("full").alias("_full"), F.col("colour").alias("_colour"), F.col("say").alias("_say"))
    same = (F.col("catalog_id") == F.col("_catalog_id")) & (F.col("section_id") == F.col("_section_id")) & (F.col("cut_from") == F.col("_block"))
    lines = lines.join(gates, key).join(stock, same & (F.col("child") == 0), "left")
    cut, loose, first = F.col("_full").isNotNull(), F.col("class") == "loose", F.col("child") == 0
    remarks = F.array_join("tell", " ")
    extra = scopes.remark_scope_tokens(remarks, F.col("pivot"), F.col("life_end"), F.coalesce("dialect", F.lit("modern")))
    gate = F.when(first, F.col("part_gate")).otherwise(F.coalesce("own_gate", F.lit("")))
    own = F.filter(F.concat(F.array(gate), F.col("scope"), extra), lambda s: s != "")
    out = lines.select(
        *key, "child", F.when(first, F.col("pos")).alias("position"), F.when(cut, F.col("_full")).when(loose, "").otherwise(F.col("full")).alias("part_number"),
        F.when(cut, blank(F.col("_colour"))).when(~loose, blank(F.col("colour"))).alias("colour_code"), F.array_join(F.when(cut, F.concat("_say", "say")).otherwise(F.col("say")), " ").alias("description"),
        F.when(first, F.col("qty")).otherwise("").alias("quantity"), remarks.alias("remarks"), F.array_join(own, scopes.SEPARATOR).alias("own"),
    )
    above = F.max(F.when(first, F.col("own"))).over(Window.partitionBy(*key))
    none = F.lit(None).cast("string")
    return out.withColumn("above", above).select(
        *SECTION, F.lit("part").alias("kind"), F.dense_rank().over(Window.partitionBy(*SECTION).orderBy("block")).alias("block"), F.col("child").cast("int").alias("child"), "position", "part_number", "colour_code", "description", "quantity", "remarks",
        none.alias("model"), none.alias("model_scope"), F.when(first, F.col("own")).otherwise(scopes.child_scope(F.col("own"), F.col("above"))).alias("applicability"),
    )


def title_rows(rows: DataFrame) -> DataFrame:
    """One row (kind `title`) of each section that prints a title."""
    words = F.when(scopes.printed_scope(F.col("desc")), None).otherwise(blank(F.col("desc")))
    order = Window.partitionBy(*SECTION).orderBy("page", "at").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.where("title").withColumn("words", words).withColumn("scope", F.when(words.isNull(), blank(F.col("desc")))).withColumn("remark", blank(F.col("remark"))).withColumn("model", blank(F.col("model")))
    own = own.withColumn("_lines", F.count("words").over(order))
    at_model = F.min(F.when(F.col("model").isNotNull(), F.struct("page", "at", "_lines")))["_lines"]
    told = own.groupBy(*SECTION).agg(*[_in_order(c).alias(c) for c in ("words", "scope", "remark", "model")], at_model.alias("lines"))
    told = told.where(F.size(F.concat("words", "scope", "remark", "model")) > 0)
    # a token after a trailing comma continues the list before it
    glue = lambda acc, t: F.when((F.size(acc) > 0) & F.coalesce(F.try_element_at(acc, F.lit(-1)).endswith(","), F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), t)))).otherwise(F.concat(acc, F.array(t)))
    told = told.withColumn("tokens", F.aggregate("model", F.array().cast("array<string>"), glue))
    # Model text that begins beside the third line or later is shown, but gates nothing
    gates = F.when(F.col("lines") <= 2, F.col("tokens")).otherwise(F.array().cast("array<string>"))
    shown = F.array_distinct(F.filter("tokens", lambda t: ~scopes.printed_model_scope(t)))
    text = lambda a: F.array_join(a, " ")
    none = F.lit(None).cast("string")
    return told.select(
        *SECTION, F.lit("title").alias("kind"), F.lit(0).alias("block"), F.lit(0).alias("child"), none.alias("position"), none.alias("part_number"), none.alias("colour_code"), text("words").alias("description"), none.alias("quantity"),
        text("remark").alias("remarks"), text(shown).alias("model"), text(F.array_distinct(gates)).alias("model_scope"), F.array_join(F.concat(F.filter(gates, scopes.printed_model_scope), F.col("scope")), scopes.SEPARATOR).alias("applicability"),
    )


def extract(items: DataFrame) -> DataFrame:
    """Title and part rows of sections from positioned items.

    `items`: catalog_id, section_id, page, page_height, item_idx, str, x, y, and
    dialect, pivot, life_end of the catalogue (repeated, may be null).  A page
    that can't be read is left out and the open block stays open.
    """
    told = items.groupBy(*SECTION).agg(F.min("page").alias("first_page"), F.first("dialect", True).alias("dialect"), F.first("pivot", True).cast("int").alias("pivot"), F.first("life_end", True).cast("int").alias("life_end"))
    placed = settled(table_rows(settled(text_rows(items), "text_rows")), "table_rows")
    rows = settled(with_reading(settled(in_blocks(placed.join(told, SECTION)), "block_rows")), "read_rows")
    return part_rows(rows).unionByName(title_rows(rows)).to(_schema())


def _schema():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ROWS)
