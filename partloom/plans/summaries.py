"""Queries over printed summaries of the old books, modern gearbox ranges, and outlines, set from the tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled
from .registry import query

#: Rows that stand on such pages and belong to no table.
CHROME = (["V-Pages"], ["Model:", "911"], ["12.03.2004", "page"])


def _pages(rows: DataFrame, heads: list[list[str]]) -> DataFrame:
    """Front pages of a catalogue for each catalog_id: `heads` on page 1, then the rows (catalog_id, k, rows) in the order of k, 30 records a page, each page under chrome."""
    body = rows.select("catalog_id", (F.floor(F.col("k") / 750) + 2).cast("int").alias("page"), "k", F.posexplode("rows").alias("at", "tokens")).select("catalog_id", "page", (F.col("k") * 10 + F.col("at")).cast("int").alias("row_idx"), "tokens")
    printed = lambda lines: F.array(*[F.array(*map(F.lit, x)) for x in lines])
    head = rows.select("catalog_id").distinct().select("catalog_id", F.lit(1).alias("page"), F.posexplode(printed([["Model: 911 Model life 1950>>1989"], *heads])).alias("row_idx", "tokens"))
    chrome = body.select("catalog_id", "page").distinct().select("catalog_id", "page", F.posexplode(printed(CHROME)).alias("row_idx", "tokens")).withColumn("row_idx", F.col("row_idx") - 100)
    return body.unionByName(head).unionByName(chrome)


def _read(pages: DataFrame) -> DataFrame:
    from ..operators import vpages

    found = vpages.parse(settled(pages, "printed")).where("table_name <> 'catalog'")
    told = F.transform(F.array_sort(F.map_entries(F.map_filter("fields", lambda k, v: v.isNotNull()))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select("catalog_id", "table_name", "seq", F.array_join(told, ";").alias("fields"))


def _parts(part: DataFrame) -> DataFrame:
    c = F.col
    return part.select((c("p_partkey") % 25).cast("string").alias("catalog_id"), c("p_partkey").alias("k"), F.upper(F.split("p_name", " ")[0]).alias("v"), F.lpad((c("p_size") % 20 + 60).cast("string"), 2, "0").alias("yy"))


def _lines(*rows: list) -> Column:
    return F.array(*[F.array(*[F.lit(x) if isinstance(x, str) else x for x in r]) for r in rows])


_P = "p AS (SELECT CAST(p_partkey % 25 AS VARCHAR) AS catalog_id, p_partkey AS k, upper(split_part(p_name, ' ', 1)) AS v, lpad(CAST(60 + p_size % 20 AS VARCHAR), 2, '0') AS yy FROM part)"

_TYPES_SQL = f"""
WITH {_P},
c AS (SELECT *, last_value(CASE WHEN k % 4 <> 1 THEN v || ' COUPE' END IGNORE NULLS) OVER w AS vehicle, last_value(CASE WHEN k % 4 <> 1 THEN yy END IGNORE NULLS) OVER w AS my FROM p WINDOW w AS (PARTITION BY catalog_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
r AS (SELECT catalog_id, k, CAST(CAST(my AS INTEGER) AS VARCHAR) AS my,
  CASE k % 4 WHEN 0 THEN '99XS6' || (k + 100) WHEN 1 THEN CAST(k + 100 AS VARCHAR) WHEN 2 THEN '9300 ' || (k + 1000) ELSE '9P6LA' || (k + 100) END AS f,
  CASE k % 4 WHEN 0 THEN '99XS6' || (k + 900) WHEN 1 THEN CAST(k + 900 AS VARCHAR) WHEN 3 THEN '9P6LA' || (k + 900) END AS t,
  concat_ws(' — ', vehicle, CASE k % 4 WHEN 2 THEN '930.50' ELSE 'M96.0' || k % 9 END) AS remark FROM c)
SELECT catalog_id, 'vin_range' AS table_name, CAST(row_number() OVER (PARTITION BY catalog_id ORDER BY k) AS INTEGER) AS seq,
  array_to_string([x FOR x IN ['model_year=' || my, 'remark=' || remark, 'vin_from=' || f, 'vin_to=' || t] IF x IS NOT NULL], ';') AS fields FROM r
"""


@query("t79_old_types", _TYPES_SQL)
def old_types(t):
    """Chassis ranges of old books: with a prefix of its own, continued without vehicle and year, open-ended, and with the prefix in the range."""
    c, text = F.col, lambda x: x.cast("string")
    p = _parts(t("part"))
    span = F.concat(text(c("k") + 100), F.lit(">"), text(c("k") + 900))
    engine = F.concat(F.lit("M96.0"), text(c("k") % 9))
    rows = (
        F.when(c("k") % 4 == 0, _lines([c("v"), "COUPE", c("yy"), "X", "99XS6", span, engine]))
        .when(c("k") % 4 == 1, _lines([span, engine], ["PLEASE", "NOTE THE LAST", "PAGE"]))
        .when(c("k") % 4 == 2, _lines([c("v"), "COUPE", c("yy"), "5", "9300", F.concat(text(c("k") + 1000), F.lit(">>")), "930.50"]))
        .otherwise(_lines(["*", c("v"), "COUPE", c("yy"), "9", F.concat(F.lit("9P6LA"), span), engine]))
    )
    return _read(_pages(p.select("catalog_id", "k", rows.alias("rows")), [["SUMMARY TYPES"], ["VEHICLE", "IDENT.NR."]]))


_BOXES_SQL = f"""
WITH {_P},
e AS (SELECT *, 'G' || lpad(CAST(k % 90 + 10 AS VARCHAR), 2, '0') || '.' || lpad(CAST(k % 7 + 10 AS VARCHAR), 2, '0') AS dotted, 1900 + CAST(yy AS INTEGER) AS year, '7' || lpad(CAST(k % 40 AS VARCHAR), 2, '0') AS short, '9' || lpad(CAST(k % 30 AS VARCHAR), 2, '0') || '.50' AS open FROM p),
n AS (SELECT catalog_id, k, year, CASE k % 3 WHEN 0 THEN v || ' TURBO' WHEN 1 THEN v || CASE WHEN k % 2 = 0 THEN ' SPEEDSTER' ELSE '' END ELSE v || CASE WHEN k % 2 = 0 THEN ' (CDN)' ELSE '' END END AS vehicle,
  CASE k % 3 WHEN 0 THEN 'A' || lpad(CAST(k % 9000 AS VARCHAR), 4, '0') || ' 1 ' || lpad(CAST(k AS VARCHAR), 5, '0') WHEN 1 THEN CAST(k + 1000 AS VARCHAR) ELSE '7' || lpad(CAST(k % 900 AS VARCHAR), 3, '0') || ' ' || (k + 10000) END AS f,
  CASE k % 3 WHEN 0 THEN 'A' || lpad(CAST(k % 9000 AS VARCHAR), 4, '0') || ' 1 ' || lpad(CAST(k + 9 AS VARCHAR), 5, '0') WHEN 1 THEN CAST(k + 2000 AS VARCHAR) END AS t,
  CASE k % 3 WHEN 0 THEN 'A' || lpad(CAST(k % 9000 AS VARCHAR), 4, '0') WHEN 1 THEN short ELSE open END AS kind, CASE k % 3 WHEN 0 THEN dotted WHEN 1 THEN short ELSE open END AS code,
  CASE k % 3 WHEN 0 THEN 'six speed' WHEN 1 THEN 'four' ELSE 'gang ' || k % 5 END AS type FROM e),
r AS (SELECT catalog_id, 'transmission_number_range' AS table_name, k, array_to_string([x FOR x IN ['gearbox_type=' || kind, 'model_year=' || year, 'number_from=' || f, 'number_to=' || t, 'vehicle_type=' || vehicle] IF x IS NOT NULL], ';') AS fields FROM n
  UNION ALL SELECT catalog_id, 'transmission_code', min(k), 'tc=' || code || ';type_code=' || arg_min(type, k) FROM n GROUP BY catalog_id, code)
SELECT catalog_id, table_name, CAST(row_number() OVER (PARTITION BY catalog_id, table_name ORDER BY k) AS INTEGER) AS seq, fields FROM r
"""


@query("t80_old_gearboxes", _BOXES_SQL)
def old_gearboxes(t):
    """Gearboxes of old books in their three prints, with body words and markets that go on in the next row."""
    c, text = F.col, lambda x: x.cast("string")
    p = _parts(t("part"))
    k = c("k")
    padded = lambda x, n: F.lpad(text(x), n, "0")
    coded = [c("v"), "TURBO", F.concat(F.lit("G"), padded(k % 90 + 10, 2), F.lit("."), padded(k % 7 + 10, 2)), c("yy"), F.concat(F.lit("A"), padded(k % 9000, 4)), "1", F.concat(padded(k, 5), F.lit(">"), padded(k + 9, 5)), "six", "speed"]
    short = [c("v"), F.concat(F.lit("7"), padded(k % 40, 2)), c("yy"), F.concat(text(k + 1000), F.lit(">"), text(k + 2000)), "four"]
    opened = [c("v"), F.concat(F.lit("9"), padded(k % 30, 2), F.lit(".50")), c("yy"), "4", F.concat(F.lit("7"), padded(k % 900, 3)), F.concat(text(k + 10000), F.lit(">>")), "gang", text(k % 5)]
    more = lambda row, word: F.when(k % 2 == 0, _lines(row, [word])).otherwise(_lines(row))
    # a lone word behind a row of the newer family belongs to nothing
    rows = F.when(k % 3 == 0, F.when(k % 2 == 0, _lines(coded, ["COUPE"])).otherwise(_lines(coded))).when(k % 3 == 1, more(short, "SPEEDSTER")).otherwise(more(opened, "(CDN)"))
    return _read(_pages(p.select("catalog_id", "k", rows.alias("rows")), [["SUMM.TRANSMISS."], ["MY"]]))


@query(
    "t81_gearbox_ranges",
    "SELECT CAST(p_partkey % 25 AS VARCHAR) AS catalog_id, 'transmission_number_range' AS table_name, CAST(row_number() OVER (PARTITION BY p_partkey % 25 ORDER BY p_partkey) AS INTEGER) AS seq, "
    "'gearbox_type=G' || p_size || ';model_year=20' || lpad(CAST(p_partkey % 20 AS VARCHAR), 2, '0') || ';number_from=' || CASE WHEN p_partkey % 3 = 0 THEN 'G' || p_partkey ELSE 'A' || (p_partkey % 900 + 100) || ' 1 ' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || ';number_to=A' || (p_partkey % 900 + 100) || ' 1 ' || lpad(CAST(p_partkey + 9 AS VARCHAR), 6, '0') END || ';vehicle_type=' || p_brand || ' Turbo' AS fields FROM part",
)
def gearbox_ranges(t):
    """Gearbox numbers of modern books: a range whose end is printed short, or a single number."""
    c, text = F.col, lambda x: x.cast("string")
    k = c("p_partkey")
    number = lambda x: F.lpad(text(x), 6, "0")
    year = F.concat(F.lit("20"), F.lpad(text(k % 20), 2, "0"))
    rest = [year, c("p_brand"), "Turbo", F.concat(F.lit("G"), text(c("p_size")))]
    rows = F.when(k % 3 == 0, _lines([F.concat(F.lit("G"), text(k)), *rest])).otherwise(_lines([F.concat(F.lit("A"), text(k % 900 + 100)), "1", F.concat(number(k), F.lit(">"), number(k + 9)), *rest]))
    return _read(_pages(t("part").select((k % 25).cast("string").alias("catalog_id"), k.alias("k"), rows.alias("rows")), [["Gearbox type"], ["Gearbox type", "number"]]))


_OUTLINE_SQL = """
WITH s AS (SELECT r_regionkey, r_name, n_nationkey, n_name, s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT r_regionkey, 1 AS depth, r_name AS title, CAST(NULL AS INTEGER) AS page, r_name AS region, CAST(NULL AS VARCHAR) AS nation FROM s
UNION ALL SELECT DISTINCT r_regionkey, 2, n_name, CAST(n_nationkey AS INTEGER), r_name, n_name FROM s
UNION ALL SELECT DISTINCT r_regionkey, 3, side, NULL, r_name, n_name FROM s
UNION ALL SELECT r_regionkey, 4, s_name, CAST(s_suppkey AS INTEGER), r_name, n_name FROM s
"""


@query("t82_outlines", _OUTLINE_SQL)
def outlines(t):
    """An outline four levels deep for each region: nations, sides of the ledger, suppliers."""
    from ..sources.outline import outline_rows

    c = F.col
    s = t("supplier").join(t("nation"), c("s_nationkey") == c("n_nationkey")).join(t("region"), c("n_regionkey") == c("r_regionkey")).withColumn("side", F.when(c("s_acctbal") < 0, "debt").otherwise("credit"))
    listed = lambda df, keys, title, page, items: df.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(title.alias("title"), page.cast("int").alias("page"), *items)))), ","), F.lit("]")).alias("items"))
    entry = lambda df, keys, title, page=None: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.concat(F.lit('{"title":'), F.to_json(F.array(title)).substr(F.lit(2), F.length(F.to_json(F.array(title))) - 2), F.lit(',"page":'), F.coalesce(page.cast("string"), F.lit("null")) if page is not None else F.lit("null"), F.lit(',"items":'), c("items"), F.lit("}")))).alias("_e")).select(*keys, F.concat(F.lit("["), F.array_join("_e", ","), F.lit("]")).alias("items"))
    top = ["r_regionkey", "r_name"]
    sides = listed(s, [*top, "n_nationkey", "n_name", "side"], c("s_name"), c("s_suppkey"), [])
    nations = entry(sides, [*top, "n_nationkey", "n_name"], c("side"))
    regions = entry(nations, top, c("n_name"), c("n_nationkey"))
    whole = entry(regions, ["r_regionkey"], c("r_name")).select("r_regionkey", c("items").alias("outline"))
    return outline_rows(whole, levels=("region", "nation")).select("r_regionkey", "depth", "title", "page", "region", "nation")


@query(
    "t87_title_facets",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN '' WHEN 4 THEN p_brand_line ELSE p_brand_line || ',GT2' END AS body_line, CASE p_partkey % 5 WHEN 0 THEN 'COUPE' WHEN 4 THEN '' ELSE '' END AS body_style, CASE p_partkey % 5 WHEN 1 THEN '9700,9701' ELSE '' END AS engine_code, "
    "CASE p_partkey % 5 WHEN 3 THEN '4' ELSE '' END AS drive_code, CASE p_partkey % 5 WHEN 3 THEN 'S' ELSE '' END AS trim_code, CASE p_partkey % 5 WHEN 4 THEN 'G5000' ELSE '' END AS gearbox_code FROM (SELECT p_partkey, upper(split_part(p_name, ' ', 1)) AS p_brand_line FROM part)",
)
def title_facets(t):
    """Facets that every variant of a title states: a variant begins at each line or body, and one that is silent leaves the facet open."""
    from . import ingest

    c, part = F.col, F.col("p_partkey") % 5
    line = F.upper(F.split("p_name", " ")[0])
    said = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    scope = F.when(part == 0, said(line, "/COUPE GT2/COUPE")).when(part == 1, said(line, " 9700 GT2 9700,9701 PR:480")).when(part == 2, said(line, " 9700 GT2")).when(part == 3, "4S").otherwise(said(line, " G5000 -CABRIO"))
    titles = t("part").select(F.lit("c").alias("catalog_id"), c("p_partkey").cast("string").alias("section_id"), scope.alias("model_scope"))
    spark = titles.sparkSession
    lines = t("part").select(F.lit("c").alias("catalog_id"), F.lit("lines").alias("kind"), line.alias("word")).distinct()
    words = lines.unionByName(spark.createDataFrame([("c", "engines", "9700"), ("c", "engines", "9701"), ("c", "gearboxes", "G5000"), ("c", "lines", "GT2")], "catalog_id string, kind string, word string"))
    found = ingest.title_facets(titles, words, spark.createDataFrame([("c", "modern", 2007)], "catalog_id string, dialect string, pivot int"))
    facets = ("body_line", "body_style", "engine_code", "drive_code", "trim_code", "gearbox_code")
    return found.select(c("section_id").cast("long").alias("p_partkey"), *[F.coalesce(F.array_join(f, ","), F.lit("")).alias(f) for f in facets])
