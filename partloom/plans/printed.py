"""Queries over printed pages: parts pages, titles and front pages set from the tables, read back and compared with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled
from .registry import query

#: Where columns of a parts page begin.
ORIGINS = {"Pos": 14.0, "Part Number": 57.0, "Description": 162.0, "Remark": 346.0, "Qty": 445.0, "Model": 488.0}
#: Parts on a printed page.
PAGE_PARTS = 10


def _row(line: Column, *cells: tuple[str, Column | str, float]) -> Column:
    """Items of one printed row: (text, x) by column, right of its origin by the given shift; blank texts aren't printed."""
    return F.array(*[F.struct(line.alias("line"), F.lit(ORIGINS[c] + shift).alias("x"), (F.lit(v) if isinstance(v, str) else v).alias("str")) for c, v, shift in cells])


def parts_items(part: DataFrame) -> DataFrame:
    """Positioned items of a section for each p_size: a title, then every part with a variant, a footer or a note in places."""
    c = F.col
    turn = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey"))
    p = part.withColumn("turn", turn.cast("int")).withColumn("page", F.floor((c("turn") - 1) / PAGE_PARTS).cast("int") + 1).withColumn("slot", (c("turn") - 1) % PAGE_PARTS)
    line = c("slot") * 5 + 5
    key = c("p_partkey").cast("string")
    rows = [
        _row(line, ("Pos", (c("turn") % 1000).cast("string"), 0), ("Part Number", key, 0), ("Description", c("p_name"), 0), ("Remark", c("p_type"), 1), ("Qty", "2", 0), ("Model", F.concat(F.lit("PR:"), c("p_size") + 100, F.lit(",")), 0)),
        _row(line + 1, ("Description", "continued", 2), ("Model", (c("p_partkey") % 900 + 100).cast("string"), 0)),
        F.when(c("p_partkey") % 2 == 0, _row(line + 2, ("Part Number", key, 0), ("Part Number", "FSA", 80), ("Description", c("p_brand"), 0), ("Model", F.when(c("p_partkey") % 4 == 0, "A 1").otherwise("COUPE"), 0))),
        F.when(c("p_partkey") % 3 == 0, _row(line + 3, ("Description", F.concat(F.lit("D - MJ "), c("p_partkey") % 30 + 2000, F.lit(">>")), 0))),
        F.when(c("p_partkey") % 5 == 0, _row(line + 4, ("Description", "also use:", 0), ("Remark", key, 0))),
    ]
    cells = F.flatten(F.filter(F.array(*rows), lambda r: r.isNotNull()))
    body = p.select("p_size", "page", F.explode(cells).alias("i")).select("p_size", "page", "i.*")
    pages = p.select("p_size", "page").distinct()
    head = pages.select("p_size", "page", F.explode(_row(F.lit(2), *[(n, n, 0) for n in ORIGINS])).alias("i")).select("p_size", "page", "i.*")
    title = pages.where("page = 1").select("p_size", "page", F.explode(_row(F.lit(3), ("Description", F.concat(F.lit("Section "), c("p_size")), 0), ("Model", "TURBO", 0))).alias("i")).select("p_size", "page", "i.*")
    items = body.unionByName(head).unionByName(title)
    none = F.lit(None)
    return items.select(
        F.lit("c").alias("catalog_id"), c("p_size").cast("string").alias("section_id"), "page", F.lit(800.0).alias("page_height"), (c("line") * 1000 + c("x")).cast("int").alias("item_idx"), "str", c("x").cast("double").alias("x"),
        (F.lit(780.0) - 10 * c("line") + c("x") % 3 / 2).alias("y"), none.cast("string").alias("dialect"), none.cast("int").alias("pivot"), none.cast("int").alias("life_end"),
    )


_PARTS_SQL = """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS turn FROM part),
q AS (SELECT *, 'PR:' || (p_size + 100) || ',' || (p_partkey % 900 + 100) AS gate, CASE WHEN p_partkey % 3 = 0 THEN 'D - MJ ' || (p_partkey % 30 + 2000) || '>>' END AS years, CASE WHEN p_partkey % 5 = 0 THEN ' also use: ' || p_partkey ELSE '' END AS note FROM p),
r AS (SELECT p_size, turn, 0 AS child, CAST(turn % 1000 AS VARCHAR) AS position, CAST(p_partkey AS VARCHAR) AS part_number, CAST(NULL AS VARCHAR) AS colour_code, p_name || ' continued' AS description, '2' AS quantity,
    p_type || CASE WHEN p_partkey % 2 = 1 THEN note ELSE '' END AS remarks, gate || CASE WHEN p_partkey % 2 = 1 AND years IS NOT NULL THEN ' | ' || years ELSE '' END AS applicability FROM q
  UNION ALL SELECT p_size, turn, 1, NULL, p_partkey || ' FSA', 'FSA', p_brand, '', trim(CASE WHEN p_partkey % 4 = 0 THEN 'A 1' ELSE '' END || note),
    CASE WHEN p_partkey % 4 = 0 AND years IS NULL THEN '' ELSE concat_ws(' | ', gate, CASE WHEN p_partkey % 4 <> 0 THEN 'COUPE' END, years) END FROM q WHERE p_partkey % 2 = 0)
SELECT CAST(p_size AS VARCHAR) AS section_id, CAST(turn AS INTEGER) AS block, CAST(child AS INTEGER) AS child, position, part_number, colour_code, description, quantity, remarks, applicability FROM r
"""


@query("t57_parts_pages", _PARTS_SQL)
def parts_pages(t):
    from ..operators import parts

    return parts.extract(settled(parts_items(t("part")), "items")).where("kind = 'part'").select("section_id", "block", "child", "position", "part_number", "colour_code", "description", "quantity", "remarks", "applicability")


@query("t58_section_titles", "SELECT DISTINCT CAST(p_size AS VARCHAR) AS section_id, 'Section ' || p_size AS description, 'TURBO' AS model, 'TURBO' AS model_scope, '' AS applicability FROM part")
def section_titles(t):
    from ..operators import parts

    return parts.extract(settled(parts_items(t("part")), "items")).where("kind = 'title'").select("section_id", "description", "model", "model_scope", "applicability")


@query("t59_text_rows", "SELECT CAST(p_size AS VARCHAR) AS section_id, CAST(count(*) AS BIGINT) AS printed FROM (SELECT p_size, unnest([1, 1] || CASE WHEN p_partkey % 2 = 0 THEN [1] ELSE [] END || CASE WHEN p_partkey % 3 = 0 THEN [1] ELSE [] END || CASE WHEN p_partkey % 5 = 0 THEN [1] ELSE [] END) FROM part UNION ALL SELECT DISTINCT p_size, 1 FROM part UNION ALL SELECT p_size, 1 FROM (SELECT DISTINCT p_size, (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1) // 10 AS page FROM part)) GROUP BY 1")
def printed_rows(t):
    from ..operators import parts

    return parts.text_rows(parts_items(t("part"))).groupBy("section_id").agg(F.count(F.lit(1)).alias("printed"))


def front_rows(customer: DataFrame, supplier: DataFrame, part: DataFrame) -> DataFrame:
    """Front pages of a catalogue for each nation: options of customers, sales types and codes of suppliers, number ranges of parts."""
    c = F.col
    text = lambda x: x.cast("string")
    rows = lambda *r: F.array(*[F.array(*[F.lit(x) if isinstance(x, str) else x for x in one]) for one in r])
    period = F.concat(F.lit("0"), c("k") % 9 + 1, F.lit("/05-12/0"), c("k") % 9)

    def pages(df: DataFrame, first: int, key: str, nation: Column, titles: list[list[str]], body: Column) -> DataFrame:
        """The titles on page `first`, the records on the pages behind it, 20 a page."""
        told = df.select(nation.cast("string").alias("catalog_id"), c(key).alias("k"), body.alias("rows"))
        turn = F.row_number().over(Window.partitionBy("catalog_id").orderBy("k"))
        own = told.withColumn("turn", turn).select("catalog_id", (F.floor((c("turn") - 1) / 20) + first + 1).cast("int").alias("page"), "turn", F.posexplode("rows").alias("at", "tokens")).select("catalog_id", "page", (c("turn") * 10 + c("at")).cast("int").alias("row_idx"), "tokens")
        head = told.select("catalog_id").distinct().select("catalog_id", F.lit(first).alias("page"), F.posexplode(rows(*titles)).alias("row_idx", "tokens"))
        return own.unionByName(head)

    key = lambda df, name: df.withColumn("k", c(name))
    customers, suppliers, parts = key(customer, "c_custkey"), key(supplier, "s_suppkey"), key(part, "p_partkey")
    code = F.lpad(text(c("k") % 1000), 3, "0")
    options = F.when(c("k") % 3 == 0, F.concat(rows([code, c("c_name")]), rows([F.lower("c_mktsegment"), F.lit("kind")]))).otherwise(rows([code, c("c_name")]))
    sales = rows([text(c("k") % 90000 + 10000), c("s_name"), period, F.lit("left")])
    engine = rows([F.concat(F.lit("E"), text(c("k"))), F.lit("3.6"), text(c("k") % 300), text(c("k") % 400), F.lit("6"), period])
    box = rows([F.concat(F.lit("G"), text(c("k"))), F.lit("six"), F.concat(F.lit("T"), text(c("k") % 7)), period, F.lit("front")])
    numbers = rows([text(c("k") % 900 + 100), F.concat(F.lpad(text(c("k")), 5, "0"), F.lit(">"), F.lpad(text(c("k") + 9), 5, "0")), F.lit("2007"), c("p_brand"), F.lit("Turbo"), F.concat(F.lit("E"), c("p_size"))])
    ranges = rows([text(c("k") % 20 + 1990), F.lit("01.05"), F.concat(F.lit("99S"), text(c("k"))), F.concat(F.lit(">99S"), text(c("k") + 5)), c("p_brand")], [F.lit("and"), c("p_type")])
    nation = c("k") % 25
    front = [
        pages(customers, 1, "k", c("c_nationkey"), [["Model: 997 Model life 2007>>2009"], ["Optional Equipment"], ["NR", "Description"]], options),
        pages(suppliers, 100_000, "k", c("s_nationkey"), [["Model Overview Sales Type"], ["Sales term"]], sales),
        pages(suppliers, 200_000, "k", c("s_nationkey"), [["Model Overview EC"], ["EC", "Ltr"]], engine),
        pages(suppliers, 300_000, "k", c("s_nationkey"), [["Model Overview TC"], ["TC"]], box),
        pages(parts, 400_000, "k", nation, [["Engine type"], ["Engine number"]], numbers),
        pages(parts, 500_000, "k", nation, [["VIN-Numbers Overview"], ["Model year"]], ranges),
    ]
    out = front[0]
    for df in front[1:]:
        out = out.unionByName(df)
    return out


_FRONT_SQL = """
WITH s AS (SELECT *, '0' || (s_suppkey % 9 + 1) || '/05' AS m1, '12/0' || (s_suppkey % 9) AS m2 FROM supplier),
r AS (SELECT CAST(c_nationkey AS VARCHAR) AS catalog_id, 'pr_code' AS table_name, c_custkey AS k, 'code=' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ';description=' || c_name || CASE WHEN c_custkey % 3 = 0 THEN ' ' || lower(c_mktsegment) || ' kind' ELSE '' END AS fields FROM customer
UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 'sales_type', s_suppkey, 'description=' || s_name || ';mount_from=' || m1 || ';mount_to=' || m2 || ';remark=left;sales_term=' || (s_suppkey % 90000 + 10000) FROM s
UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 'engine_code', s_suppkey, 'cylinders=6;displacement_l=3.6;ec=E' || s_suppkey || ';mount_from=' || m1 || ';mount_to=' || m2 || CASE WHEN s_suppkey % 400 > 0 THEN ';power_hp=' || (s_suppkey % 400) ELSE '' END || CASE WHEN s_suppkey % 300 > 0 THEN ';power_kw=' || (s_suppkey % 300) ELSE '' END FROM s
UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 'transmission_code', s_suppkey, 'mount_from=' || m1 || ';mount_to=' || m2 || ';remark=front;tc=G' || s_suppkey || ';type_code=T' || (s_suppkey % 7) FROM s
UNION ALL SELECT CAST(p_partkey % 25 AS VARCHAR), 'engine_number_range', p_partkey, 'engine_type=E' || p_size || ';model_year=2007;number_from=' || (p_partkey % 900 + 100) || ' ' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || ';number_to=' || (p_partkey % 900 + 100) || ' ' || lpad(CAST(p_partkey + 9 AS VARCHAR), 5, '0') || ';vehicle_type=' || p_brand || ' Turbo' FROM part
UNION ALL SELECT CAST(p_partkey % 25 AS VARCHAR), 'vin_range', p_partkey, 'model_year=' || (p_partkey % 20 + 1990) || ';remark=' || p_brand || ' and ' || p_type || ';start_date=01.05;vin_from=99S' || p_partkey || ';vin_to=99S' || (p_partkey + 5) FROM part)
SELECT catalog_id, table_name, CAST(row_number() OVER (PARTITION BY catalog_id, table_name ORDER BY k) AS INTEGER) AS seq, fields FROM r
"""


@query("t60_front_pages", _FRONT_SQL)
def front_pages(t):
    from ..operators import vpages

    found = vpages.parse(settled(front_rows(t("customer"), t("supplier"), t("part")), "printed")).where("table_name <> 'catalog'")
    told = F.transform(F.array_sort(F.map_entries(F.map_filter("fields", lambda k, v: v.isNotNull()))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select("catalog_id", "table_name", "seq", F.array_join(told, ";").alias("fields"))


_OLD_SQL = """
WITH p AS (SELECT CAST(p_partkey % 25 AS VARCHAR) AS catalog_id, p_partkey AS k, upper(split_part(p_name, ' ', 1)) AS v, lpad(CAST(60 + p_size % 20 AS VARCHAR), 2, '0') AS yy FROM part),
e AS (SELECT *, 'M' || lpad(CAST(k % 90 + 10 AS VARCHAR), 2, '0') || '.' || lpad(CAST(k % 7 + 10 AS VARCHAR), 2, '0') AS code, 1950 + (CAST(yy AS INTEGER) - 50) AS year FROM p),
n AS (SELECT catalog_id, 2 * k AS k, 'engine_number_range' AS table_name, 'engine_type=' || replace(substr(code, 2), '.', '') || ';model_year=' || year || ';number_from=661 ' || lpad(CAST(k AS VARCHAR), 5, '0') || ';number_to=661 ' || lpad(CAST(k + 4 AS VARCHAR), 5, '0') || ';vehicle_type=' || v AS fields FROM e
UNION ALL SELECT catalog_id, 2 * k + 1, 'engine_number_range', 'engine_type=' || replace(substr(code, 2), '.', '') || ';model_year=' || year || ';number_from=7' || k || ';number_to=8' || k || ';vehicle_type=' || v FROM e WHERE k % 3 = 0
UNION ALL SELECT catalog_id, min(2 * k), 'engine_code', 'cylinders=' || arg_min(4 + k % 3 * 2, k) || ';displacement_l=2.' || arg_min(k % 9, k) || ';ec=' || code || ';power_kw=' || arg_min(100 + k % 50, k) FROM e GROUP BY catalog_id, code)
SELECT catalog_id, table_name, CAST(row_number() OVER (PARTITION BY catalog_id, table_name ORDER BY k) AS INTEGER) AS seq, fields FROM n
"""


@query("t61_old_summaries", _OLD_SQL)
def old_summaries(t):
    from ..operators import vpages

    c, text = F.col, lambda x: x.cast("string")
    p = t("part").select((c("p_partkey") % 25).cast("string").alias("catalog_id"), c("p_partkey").alias("k"), F.upper(F.split("p_name", " ")[0]).alias("v"), F.lpad(text(c("p_size") % 20 + 60), 2, "0").alias("yy"))
    code = F.concat(F.lit("M"), F.lpad(text(c("k") % 90 + 10), 2, "0"), F.lit("."), F.lpad(text(c("k") % 7 + 10), 2, "0"))
    five = lambda x: F.lpad(text(x), 5, "0")
    full = F.array("v", code, "yy", F.lit("9"), F.lit("661"), F.concat(five(c("k")), F.lit(">"), five(c("k") + 4)), F.concat(text(c("k") % 3 * 2 + 4), F.lit("ZYL/2,"), text(c("k") % 9), F.lit("L")), F.concat(F.lit("/"), text(c("k") % 50 + 100), F.lit(" KW")))
    more = F.array(F.concat(F.lit("7"), text(c("k")), F.lit(">8"), text(c("k"))))
    body = p.select("catalog_id", F.posexplode(F.when(c("k") % 3 == 0, F.array(full, more)).otherwise(F.array(full))).alias("at", "tokens"), "k")
    own = body.select("catalog_id", F.lit(2).alias("page"), (c("k") * 2 + c("at")).cast("int").alias("row_idx"), "tokens")
    heads = [["Model: 911 Model life 1950>>1989"], ["SUMMARY ENGINES"], ["MY"]]
    head = p.select("catalog_id").distinct().select("catalog_id", F.lit(1).alias("page"), F.posexplode(F.array(*[F.array(*map(F.lit, h)) for h in heads])).alias("row_idx", "tokens"))
    found = vpages.parse(settled(own.unionByName(head), "printed")).where("table_name <> 'catalog'")
    told = F.transform(F.array_sort(F.map_entries(F.map_filter("fields", lambda k, v: v.isNotNull()))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select("catalog_id", "table_name", "seq", F.array_join(told, ";").alias("fields"))


def routed_items(part: DataFrame) -> DataFrame:
    """Positioned items of a section for each p_size, a record of one of six shapes for each part, between headings, marks and footers that belong to none."""
    c = F.col
    turn = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey"))
    p = part.withColumn("turn", turn.cast("int")).withColumn("page", F.floor((c("turn") - 1) / PAGE_PARTS).cast("int") + 1).withColumn("slot", (c("turn") - 1) % PAGE_PARTS)
    line, key, k = c("slot") * 6 + 5, c("p_partkey").cast("string"), c("turn") % 6
    own = (c("turn") % 1000).cast("string")
    row = lambda at, *cells: _row(line + at, *[(column, value, 0) for column, value in cells])
    shapes = [
        # stock that isn't drawn, and a length cut from it
        [row(0, ("Pos", "-"), ("Part Number", key), ("Description", c("p_name")), ("Remark", c("p_brand")), ("Qty", "1")), row(1, ("Pos", own), ("Description", "shorten to: 500 mm"), ("Qty", "2"))],
        # a line item without a number
        [row(0, ("Pos", "-"), ("Description", c("p_name")), ("Qty", "4")), row(1, ("Description", "goes on"))],
        # a letter of a legend closes what is open, so nothing below has a part
        [row(0, ("Pos", "A"), ("Description", "legend")), row(1, ("Description", "orphan"), ("Remark", "lost")), row(2, ("Part Number", key), ("Description", "nobody's variant"))],
        # labels, and an exclusion whose country stands in the next row
        [row(0, ("Pos", "(7)"), ("Part Number", key), ("Description", c("p_name")), ("Qty", "1")), row(1, ("Description", "Valid from:")), row(2, ("Description", "Relay location/code no.:"), ("Remark", key)), row(3, ("Description", "Not for:")), row(4, ("Description", "Australien"))],
        # a note takes what follows, but for the flag; labels behind it go
        [row(0, ("Pos", own), ("Part Number", key), ("Description", c("p_name")), ("Qty", "1")), row(1, ("Description", "also use:"), ("Remark", key)), row(2, ("Description", "Discontinued part")), row(3, ("Description", "more of it")), row(4, ("Description", "Relay location/code no.:"), ("Remark", "never"))],
        # a heading behind a dash closes too; a position may have no number
        [row(0, ("Pos", "-"), ("Description", "Signs/notices")), row(1, ("Description", "read them")), row(2, ("Pos", "12/3"), ("Description", c("p_name")), ("Qty", "9"))],
    ]
    cells = F.coalesce(*[F.when(k == n, F.flatten(F.array(*rows))) for n, rows in enumerate(shapes)])
    body = p.select("p_size", "page", F.explode(cells).alias("i")).select("p_size", "page", "i.*")
    chrome = [_row(F.lit(1), ("Description", "Illustration: 101-000", 0)), _row(F.lit(2), ("Description", "Model: 997", 0), ("Remark", "Model life 2007>>2009", 0)), _row(F.lit(3), *[(n, n, 0) for n in ORIGINS]), _row(F.lit(77), ("Description", "19.07.2018", 0), ("Model", "P30", 0))]
    head = p.select("p_size", "page").distinct().select("p_size", "page", F.explode(F.flatten(F.array(*chrome))).alias("i")).select("p_size", "page", "i.*")
    items, none = body.unionByName(head), F.lit(None)
    return items.select(
        F.lit("c").alias("catalog_id"), c("p_size").cast("string").alias("section_id"), "page", F.lit(800.0).alias("page_height"), (c("line") * 1000 + c("x")).cast("int").alias("item_idx"), "str", c("x").cast("double").alias("x"),
        (F.lit(780.0) - 10 * c("line")).alias("y"), none.cast("string").alias("dialect"), none.cast("int").alias("pivot"), none.cast("int").alias("life_end"),
    )


_ROUTED_SQL = """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS turn, CAST(p_partkey AS VARCHAR) AS key FROM part),
r AS (SELECT p_size, turn, 0 AS half, '-' AS position, key AS part_number, p_name AS description, '1' AS quantity, p_brand AS remarks, '' AS applicability FROM p WHERE turn % 6 = 0
  UNION ALL SELECT p_size, turn, 1, CAST(turn % 1000 AS VARCHAR), key, p_name, '2', 'shorten to: 500 mm', '' FROM p WHERE turn % 6 = 0
  UNION ALL SELECT p_size, turn, 0, '-', '', p_name || ' goes on', '4', '', '' FROM p WHERE turn % 6 = 1
  UNION ALL SELECT p_size, turn, 0, '(7)', key, p_name, '1', 'Relay location/code no.: ' || key, '-"AUS"' FROM p WHERE turn % 6 = 3
  UNION ALL SELECT p_size, turn, 0, CAST(turn % 1000 AS VARCHAR), key, p_name || ' Discontinued part', '1', 'also use: ' || key || ' more of it', '' FROM p WHERE turn % 6 = 4
  UNION ALL SELECT p_size, turn, 0, '12/3', '', p_name, '9', '', '' FROM p WHERE turn % 6 = 5)
SELECT CAST(p_size AS VARCHAR) AS section_id, CAST(row_number() OVER (PARTITION BY p_size ORDER BY turn, half) AS INTEGER) AS block, CAST(0 AS INTEGER) AS child, position, part_number, CAST(NULL AS VARCHAR) AS colour_code, description, quantity, remarks, applicability FROM r
"""


@query("t83_routed_rows", _ROUTED_SQL)
def routed_rows(t):
    from ..operators import parts

    return parts.extract(settled(routed_items(t("part")), "items")).where("kind = 'part'").select("section_id", "block", "child", "position", "part_number", "colour_code", "description", "quantity", "remarks", "applicability")


_OLD_SCOPES_SQL = """
WITH p AS (SELECT p_partkey, upper(split_part(p_name, ' ', 1)) AS line, p_size % 3 AS a, p_size % 2 AS b, p_partkey % 4 AS w, p_partkey % 5 AS o, CAST(p_partkey % 100 AS INTEGER) AS yy FROM part),
s AS (SELECT *, lpad(CAST(yy AS VARCHAR), 2, '0') AS y2, CASE WHEN yy >= 65 THEN 1900 + yy ELSE 2000 + yy END AS year FROM p)
SELECT p_partkey, concat_ws(' ', line, CASE a WHEN 0 THEN 'RS4.0' WHEN 1 THEN 'GT2-RS' ELSE 'C2/4' END, CASE b WHEN 0 THEN '(J)' ELSE '-(CN.)' END, CASE w WHEN 0 THEN y2 || '-' || y2 WHEN 1 THEN '-' || y2 WHEN 2 THEN y2 || '-' END,
    CASE o WHEN 0 THEN 'M491' WHEN 1 THEN '-M491' WHEN 2 THEN 'G5000' WHEN 3 THEN '9305+' ELSE '-9305,M491' END) AS printed,
  line || CASE WHEN a = 1 THEN ',GT2' ELSE '' END AS lines, CASE a WHEN 0 THEN 'RS 4.0' WHEN 1 THEN 'RS' ELSE '' END AS trim, CASE WHEN a = 2 THEN '2,4' ELSE '' END AS drive,
  CASE WHEN b = 0 THEN 'J' ELSE '' END AS markets, CASE WHEN b = 1 THEN 'CN' ELSE '' END AS not_markets, CASE WHEN w IN (0, 2) THEN year END AS year_from, CASE WHEN w IN (0, 1) THEN year END AS year_to,
  CASE WHEN o = 0 THEN 'M491' ELSE '' END AS options, CASE WHEN o IN (1, 4) THEN 'M491' ELSE '' END AS barred, CASE WHEN o = 3 THEN '9305' ELSE '' END AS engines, CASE WHEN o = 4 THEN '9305' ELSE '' END AS not_engines, CASE WHEN o = 2 THEN 'G5000' ELSE '' END AS gearboxes, '' AS unknown
FROM s
"""


@query("t84_old_scopes", _OLD_SCOPES_SQL)
def old_scopes(t):
    """Scopes of old books: bracketed markets, years of two digits, options without a lead, engines and gearboxes that the book's tables know."""
    from ..functions.scope import Vocabulary, with_scope

    c, part, size = F.col, F.col("p_partkey"), F.col("p_size")
    pick = lambda n, *values: F.coalesce(*[F.when(n == k, F.lit(v) if isinstance(v, str) else v) for k, v in enumerate(values)])
    yy = F.lpad((part % 100).cast("string"), 2, "0")
    printed = F.concat_ws(
        " ", F.upper(F.split("p_name", " ")[0]), pick(size % 3, "RS4.0", "GT2-RS", "C2/4"), pick(size % 2, "(J)", "-(CN.)"), pick(part % 4, F.concat(yy, F.lit("-"), yy), F.concat(F.lit("-"), yy), F.concat(yy, F.lit("-"))), pick(part % 5, "M491", "-M491", "G5000", "9305+", "-9305,M491")
    )
    words = Vocabulary.of(engines=["9305"], gearboxes=["G5000"], options=["M491"], dialect="old", pivot=1965)
    s, said = c("scope"), lambda a: F.array_join(a, ",")
    slots = lambda side: said(F.flatten(F.transform(s["prGroups"], lambda g: g[side])))
    window = F.try_element_at(s["mjRanges"], F.lit(1))
    return with_scope(t("part").select("p_partkey", printed.alias("printed")), "printed", words=words).select(
        "p_partkey", "printed", *[said(s[g]["any"]).alias(g) for g in ("lines", "trim", "drive", "markets", "engines", "gearboxes")], said(s["markets"]["not"]).alias("not_markets"), said(s["engines"]["not"]).alias("not_engines"),
        window["from"].alias("year_from"), window["to"].alias("year_to"), slots("any").alias("options"), slots("not").alias("barred"), said(s["unknown"]).alias("unknown"),
    )
