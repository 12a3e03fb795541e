"""Named queries of the catalogue engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import serials, text
from ..operators import applicability, browse, directory, evaluation, fitment, garage, ordered, ranges, search
from ..sources.tables import settled, tasks_for

FLAGSHIP = "t10_range_join"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: load(spark, sf_dir, table))
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


@query("t01_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part")))
def counts(t):
    return browse.counts({n: t(n) for n in ("region", "nation", "customer", "supplier", "part")})


@query("t02_conf_summary", "SELECT l_returnflag, round(avg(l_quantity), 6) AS avg_q, min(l_quantity) AS min_q, max(l_quantity) AS max_q FROM lineitem GROUP BY 1")
def conf_summary(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("avg_q"), F.min("l_quantity").alias("min_q"), F.max("l_quantity").alias("max_q"))


@query("t03_share_pct", "SELECT source, CAST(100 * count(*) FILTER (lang = 'en') // greatest(count(*), 1) AS BIGINT) AS pct FROM documents GROUP BY 1")
def share_pct(t):
    return t("documents").groupBy("source").agg(browse.percent(F.count_if(F.col("lang") == "en"), F.count(F.lit(1))).alias("pct"))


@query("t04_tree", "SELECT n_nationkey, n_name, r_name, TRY_CAST(CAST(r_regionkey AS VARCHAR) AS INTEGER) AS sort_key FROM nation JOIN region ON n_regionkey = r_regionkey")
def tree(t):
    groups = t("region").select(F.col("r_regionkey").alias("id"), F.col("r_regionkey").cast("string").alias("number"), F.col("r_name").alias("title"))
    sections = t("nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("main_group_id"), F.col("n_nationkey").cast("string").alias("number"))
    return browse.tree(sections, groups).select("n_nationkey", "n_name", F.col("group_title").alias("r_name"), F.col("group_number").try_cast("int").alias("sort_key"))


@query("t05_inherit", "WITH p AS (SELECT p_partkey AS id, p_partkey - p_partkey % 5 AS parent, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS scope FROM part) SELECT c.id, coalesce(nullif(c.scope, ''), nullif(q.scope, '')) AS effective_scope FROM p c LEFT JOIN p q ON c.parent = q.id")
def inherit(t):
    p = t("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - F.col("p_partkey") % 5).alias("parent_id"), F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_type")).alias("applicability"))
    return applicability.with_inherited_scope(p).select("id", "effective_scope")


@query("t06_facet", "SELECT p_partkey, upper(p_brand) IN ('BRAND#11', 'BRAND#12', 'BRAND#23') AND upper(p_type) NOT IN ('PROMO') AS admits FROM part")
def facet(t):
    group = lambda a, n: F.struct(a.alias("any"), n.alias("not"))
    none = F.array().cast("array<string>")
    ok = fitment.facet_admits(group(strings("BRAND#11", "BRAND#12", "BRAND#23"), none), F.col("p_brand")) & fitment.facet_admits(group(none, strings("PROMO")), F.col("p_type"))
    return t("part").select("p_partkey", ok.alias("admits"))


@query("t07_option_groups", "WITH o AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS r, list(DISTINCT l_linestatus) AS s FROM lineitem GROUP BY 1) SELECT o_orderkey, r IS NULL OR (NOT list_contains(r, 'A') AND (list_contains(r, 'N') OR list_contains(r, 'R')) AND list_contains(s, 'O')) AS admits FROM orders LEFT JOIN o ON o_orderkey = k")
def option_groups(t):
    codes = t("lineitem").groupBy("l_orderkey").agg(F.array_union(F.collect_set("l_returnflag"), F.collect_set("l_linestatus")).alias("codes"))
    none = F.array().cast("array<string>")
    slots = F.array(F.struct(strings("N", "R").alias("any"), strings("A").alias("not")), F.struct(strings("O").alias("any"), none.alias("not")))
    return t("orders").join(codes, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", fitment.options_admit(slots, F.col("codes")).alias("admits"))


@query("t08_year_windows", "SELECT o_orderkey, year(o_orderdate) <= 1996 OR (year(o_orderdate) BETWEEN 1998 AND 1999) OR year(o_orderdate) >= 2001 AS admits FROM orders")
def year_windows(t):
    window = lambda a, b: F.struct(F.lit(a).cast("int").alias("from"), F.lit(b).cast("int").alias("to"))
    return t("orders").select("o_orderkey", fitment.years_admit(F.array(window(None, 1996), window(1998, 1999), window(2001, None)), F.year("o_orderdate")).alias("admits"))


_NAMES = "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier"
_KEYED = f"SELECT name, upper(regexp_extract(name, '^(.*?)([0-9]+)$', 1)) AS prefix, CAST(regexp_extract(name, '^(.*?)([0-9]+)$', 2) AS BIGINT) AS serial FROM ({_NAMES})"


def _names(t) -> DataFrame:
    return t("customer").select(F.col("c_name").alias("name")).unionByName(t("supplier").select(F.col("s_name").alias("name")))


@query("t09_serial_key", _KEYED)
def serial_key(t):
    k = serials.serial_key(F.col("name"))
    return _names(t).select("name", k["prefix"].alias("prefix"), k["serial"].alias("serial"))


@query(
    "t10_range_join",
    f"WITH k AS ({_KEYED}), b AS (SELECT n_name, p, n_nationkey * 60 AS lo, CASE WHEN n_nationkey = 24 THEN 9223372036854775807 ELSE n_nationkey * 60 + 80 END AS hi FROM nation, (VALUES ('CUSTOMER#'), ('SUPPLIER#')) v(p)) "
    "SELECT prefix, n_name, count(*) AS n, min(serial) AS first_serial, max(serial) AS last_serial FROM k JOIN b ON prefix = p AND serial BETWEEN lo AND hi GROUP BY 1, 2",
)
def range_join(t):
    prefix = F.explode(strings("Customer#", "Supplier#"))
    blocks = t("nation").select("n_name", "n_nationkey", prefix.alias("p")).select("n_name", F.concat("p", (F.col("n_nationkey") * 60).cast("string")).alias("vin_from"), F.when(F.col("n_nationkey") < 24, F.concat("p", (F.col("n_nationkey") * 60 + 80).cast("string"))).alias("vin_to"))
    key = serials.serial_key(F.col("name"))
    return ranges.serial_range_join(_names(t), blocks, "name").select(key["prefix"].alias("prefix"), "n_name", key["serial"].alias("serial")).groupBy("prefix", "n_name").agg(F.count(F.lit(1)).alias("n"), F.min("serial").alias("first_serial"), F.max("serial").alias("last_serial"))


@query("t11_serial_admits", "SELECT c_name, CASE WHEN c_custkey <= 100 THEN NOT (c_custkey > 50) WHEN c_custkey <= 200 THEN c_custkey >= 150 ELSE true END AS admits FROM customer")
def serial_admits(t):
    key = serials.serial_key(F.col("c_name"))
    bound = lambda p, n: F.struct(F.lit(p).alias("prefix"), F.lit(n).cast("bigint").alias("serial"))
    none = F.lit(None).cast("struct<prefix:string,serial:bigint>")
    breaks = F.array(F.struct(none.alias("from"), bound("CUSTOMER#", 50).alias("to")), F.struct(bound("CUSTOMER#", 150).alias("from"), none.alias("to")), F.struct(bound("OTHER#", 5).alias("from"), none.alias("to")))
    low = F.when(F.col("c_custkey") <= 100, bound("CUSTOMER#", 1)).when(F.col("c_custkey") <= 200, bound("CUSTOMER#", 101)).otherwise(bound("CUSTOMER#", 201))
    high = F.when(F.col("c_custkey") <= 100, bound("CUSTOMER#", 100)).when(F.col("c_custkey") <= 200, bound("CUSTOMER#", 200)).otherwise(bound("CUSTOMER#", 10**9))
    return t("customer").select("c_name", serials.serial_admits(breaks, key, low, high).alias("admits"))


@query("t12_trim", "WITH v AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'RS 4.0' WHEN 1 THEN 'RS' WHEN 2 THEN 'S' ELSE '' END AS trim FROM part) SELECT p_partkey, trim = '' OR trim IN ('RS', 'RS 4.0') AS rs, trim = '' OR trim = 'RS 4.0' AS rs40, trim = '' OR trim NOT IN ('RS', 'RS 4.0') AS not_rs FROM v")
def trim(t):
    v = F.element_at(strings("RS 4.0", "RS", "S", ""), F.col("p_size") % 4 + 1)
    none = F.array().cast("array<string>")
    test = lambda a, n: fitment.trim_admits(F.struct(a.alias("any"), n.alias("not")), v)
    return t("part").select("p_partkey", test(strings("RS"), none).alias("rs"), test(strings("RS 4.0"), none).alias("rs40"), test(none, strings("RS")).alias("not_rs"))


@query("t13_vocab", "SELECT DISTINCT w AS word FROM (SELECT upper(unnest(regexp_split_to_array(p_name, '[\\s,/]+'))) AS w FROM part) WHERE regexp_matches(w, '^[A-Z][A-Z0-9]+$') AND w NOT IN ('COUPE', 'CABRIO', 'TARGA', 'ROADSTER', 'SPYDER', 'GTS', 'RS', 'TIPTRONIC', 'MANUAL', 'AUTOMATIC', 'PDK', 'GANG', 'SPEED', 'ZYL', 'KW', 'PS', 'HP', 'MJ', 'PR', 'FL', 'FACELIFT', 'KAT')")
def vocab(t):
    from ..functions.scope import line_words

    return line_words(t("part").withColumn("catalog_id", F.lit("c")), "p_name").select("word")


@query("t14_market_parse", "SELECT page_id, list_count(m) AS n_markets, array_to_string(m, ',') AS markets FROM (SELECT page_id, [x for x in regexp_split_to_array(upper(CASE WHEN page_id % 3 = 0 THEN 'usa, cdn' WHEN page_id % 3 = 1 THEN 'MEX XX BR' ELSE '' END), '[,\\s]+') if list_contains(['USA', 'CDN', 'MEX', 'BR', 'CN', 'KOR', 'ROW'], x)] AS m FROM pages)")
def market_parse(t):
    printed = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(" (usa, cdn)"))).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit(" (MEX XX BR) (CN)"))).otherwise(F.col("url"))
    markets = text.market_list(printed)
    return t("pages").select("page_id", F.size(markets).cast("long").alias("n_markets"), F.array_join(markets, ",").alias("markets"))


@query("t15_year_expand", "WITH y AS (SELECT o_orderkey, CAST(o_orderkey % 100 AS INTEGER) AS yy FROM orders) SELECT o_orderkey, CASE WHEN 1900 + yy < 1998 THEN 2000 + yy ELSE 1900 + yy END AS strict_year, CASE WHEN 1900 + yy < 1998 THEN 2000 + yy ELSE 1900 + yy END AS loose_year, yy AS no_pivot FROM y")
def year_expand(t):
    yy, pivot = F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit(1998)
    return t("orders").select("o_orderkey", text.expand_two_digit(yy, pivot).alias("strict_year"), text.expand_year(yy, pivot).alias("loose_year"), text.expand_year(yy, F.lit(None).cast("int")).alias("no_pivot"))


@query("t16_range_end", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey || ' ' || l_suppkey || ' ' || '999' WHEN l_linenumber % 3 = 1 THEN l_partkey || ' ' || '77' || ' ' || '888' END AS range_end FROM lineitem")
def range_end(t):
    start = F.concat_ws(" ", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.lit("001"))
    end = F.when(F.col("l_linenumber") % 3 == 0, F.lit("999")).when(F.col("l_linenumber") % 3 == 1, F.lit("77 888"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.range_end(start, end).alias("range_end"))


@query(
    "t17_page_span",
    "WITH s AS (SELECT o_custkey, o_orderkey, 7 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + o_orderkey % 7 AS diagram_page FROM orders), "
    "n AS (SELECT *, lead(diagram_page) OVER (PARTITION BY o_custkey ORDER BY diagram_page) AS nxt FROM s) SELECT o_custkey, o_orderkey AS section, unnest(range(diagram_page + 1, coalesce(nxt, diagram_page + 5))) AS page FROM n",
)
def page_span(t):
    # each customer's orders are sections, about seven pages apart
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = t("orders").select("o_custkey", F.col("o_orderkey").alias("section"), (turn * 7 + F.col("o_orderkey") % 7).alias("diagram_page"))
    return directory.page_spans(o, F.col("diagram_page") + 4, ["o_custkey"]).select("o_custkey", "section", "page")


@query("t18_latch", "SELECT event_id, coalesce(bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_data FROM events")
def latch(t):
    events = t("events").withColumn("day", F.to_date("ts"))
    return ordered.latched(events, F.col("event_type") == "purchase", ["user_id"], ["ts", "event_id"], segment="day").select("event_id", "in_data")


@query("t19_continuation", "WITH r AS (SELECT conv_id, turn, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS rec FROM conversations) SELECT conv_id, CAST(rec AS BIGINT) AS record, string_agg(text, ' ' ORDER BY turn, text) AS text FROM r WHERE rec > 0 GROUP BY 1, 2")
def continuation(t):
    turns = t("conversations").withColumn("stretch", F.floor(F.col("turn") / 256))
    return ordered.records(turns, F.col("role") == "user", F.col("text"), ["conv_id"], ["turn"], segment="stretch")


@query("t20_carry_down", "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_view FROM events")
def carry_down(t):
    events = t("events").withColumn("day", F.to_date("ts"))
    return ordered.carried(events, F.when(F.col("event_type") == "view", F.col("value")), ["user_id"], ["ts", "event_id"], "last_view", segment="day").select("event_id", "last_view")


# Where the columns of a parts page begin.
ORIGINS = (("Pos", 14.0), ("Part Number", 57.0), ("Description", 162.0), ("Remark", 346.0), ("Qty", 445.0), ("Model", 488.0))


@query("t21_column_assign", "SELECT col, count(*) AS n FROM (SELECT CASE WHEN x + 5 >= 488 THEN 'Model' WHEN x + 5 >= 445 THEN 'Qty' WHEN x + 5 >= 346 THEN 'Remark' WHEN x + 5 >= 162 THEN 'Description' WHEN x + 5 >= 57 THEN 'Part Number' ELSE 'Pos' END AS col FROM (SELECT l_quantity * 10 AS x FROM lineitem)) GROUP BY 1")
def column_assign(t):
    origins = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(n).alias("name")) for n, x in ORIGINS])
    return t("lineitem").select(ranges.assigned_column(F.col("l_quantity") * 10, origins).alias("col")).groupBy("col").agg(F.count(F.lit(1)).alias("n"))


@query("t22_first_seen", "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def first_seen(t):
    return browse.first_seen(t("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"])


_KIND = "CASE WHEN regexp_matches(s, '\\bMJ\\s*[0-9]{4}') THEN 'year' WHEN regexp_matches(s, '^F(\\s|>>)') THEN 'chassis' WHEN regexp_matches(s, '^M(\\s|>>)') THEN 'engineNum' ELSE 'facet' END"


@query(
    "t23_child_scope",
    "WITH p AS (SELECT p_partkey, 'PR:480 | D - MJ 2008>> | F >> ' || p_partkey AS parent, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'D >> - MJ 2007' WHEN 2 THEN 'F 12>> | COUPE' ELSE 'TURBO' END AS own FROM part), "
    f"s AS (SELECT p_partkey, own, unnest(string_split(parent, ' | ')) AS s, unnest([1, 2, 3]) AS i FROM p), k AS (SELECT p_partkey, own, s, i, {_KIND} AS kind FROM s), "
    f"o AS (SELECT p_partkey, {_KIND} AS kind FROM (SELECT p_partkey, unnest(string_split(own, ' | ')) AS s FROM p)) "
    "SELECT p_partkey, CASE WHEN own = '' THEN '' ELSE coalesce(string_agg(s, ' | ' ORDER BY i) FILTER (kind = 'facet' OR NOT EXISTS (SELECT 1 FROM o WHERE o.p_partkey = k.p_partkey AND o.kind = k.kind)) || ' | ', '') || own END AS scope FROM k GROUP BY p_partkey, own",
)
def child_scope(t):
    parent = F.concat(F.lit("PR:480 | D - MJ 2008>> | F >> "), F.col("p_partkey").cast("string"))
    own = F.element_at(strings("", "D >> - MJ 2007", "F 12>> | COUPE", "TURBO"), F.col("p_size") % 4 + 1)
    return t("part").select("p_partkey", applicability.child_scope(own, parent).alias("scope"))


@query("t24_invariant", "SELECT l_orderkey, CASE WHEN count(*) = count(*) FILTER (l_returnflag <> 'A') THEN string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) END AS value FROM lineitem GROUP BY 1")
def invariant(t):
    own = F.when(F.col("l_returnflag") != "A", F.array("l_returnflag")).otherwise(F.array().cast("array<string>"))
    return t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(own)).alias("v")).select("l_orderkey", applicability.invariant_values(F.col("v")).alias("value"))


@query("t25_search_and", "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM documents) SELECT doc_id FROM w WHERE w IN ('the', 'license', 'under') GROUP BY 1 HAVING count(*) = 3")
def search_and(t):
    return search.matching(t("documents"), "The LICENSE, under", ["text"]).select("doc_id").distinct()


@query("t26_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%'")
def like(t):
    return search.like(t("part"), "RE", ["p_name"]).select("p_partkey", "p_name")


@query("t27_any_col_page", "SELECT * FROM (SELECT * FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 10000) WHERE contains(lower(CAST(n_nationkey AS VARCHAR)), 'a') OR contains(lower(n_name), 'a') OR contains(lower(CAST(n_regionkey AS VARCHAR)), 'a')) ORDER BY n_nationkey LIMIT 5 OFFSET 5")
def any_col_page(t):
    return browse.page(browse.any_column_contains(t("nation"), "A", ["n_nationkey"]), 1, ["n_nationkey"], 5)


@query("t28_blob_summary", "SELECT page_id, url, '<' || strlen(html) || ' bytes>' AS html FROM pages")
def blob_summary(t):
    return browse.blob_safe(t("pages").withColumn("html", F.col("html").cast("binary")))


@query("t29_shadow_union", "SELECT o_custkey AS custkey, 'orders' AS origin FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def shadow_union(t):
    first = t("orders").select(F.col("o_custkey").alias("custkey")).distinct().withColumn("origin", F.lit("orders"))
    return directory.shadowed_union(first, t("customer").select(F.col("c_custkey").alias("custkey"), F.lit("customer").alias("origin")), "custkey")


@query("t30_manifest", "SELECT r_regionkey, r_name, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) AS vin_ranges FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1, 2")
def manifest(t):
    held = t("nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", "n_name")
    shown = F.array_join(F.transform("vin_ranges", lambda r: F.concat_ws(":", r["n_nationkey"].cast("string"), r["n_name"])), ",")
    return directory.manifest(t("region"), held, "r_regionkey").select("r_regionkey", "r_name", shown.alias("vin_ranges"))


# Boxes from line items: one diagram an order, one truth and one prediction a line.
_BOXES = """
WITH l AS (SELECT l_orderkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, CAST(l_partkey % 7 AS VARCHAR) AS num,
  CAST(l_partkey % 60 AS INTEGER) AS x, CAST(l_suppkey % 60 AS INTEGER) AS y, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
g AS (SELECT d, i AS idx, num, x AS x0, y AS y0, x + 20 AS x1, y + 20 AS y1 FROM l),
p AS (SELECT d, i AS idx, CASE WHEN q % 5 = 0 THEN '9' ELSE num END AS num, x + q % 11 AS x0, y + q % 7 AS y0, x + q % 11 + 20 AS x1, y + q % 7 + 20 AS y1 FROM l WHERE q % 9 <> 0),
o AS (SELECT g.d, g.idx AS gi, p.idx AS pi, g.num = p.num AS same, greatest(0, least(g.x1, p.x1) - greatest(g.x0, p.x0)) * greatest(0, least(g.y1, p.y1) - greatest(g.y0, p.y0)) AS inter FROM g JOIN p ON g.d = p.d),
v AS (SELECT d, gi, pi, same, CASE WHEN inter > 0 THEN inter / (800.0::DOUBLE - inter) ELSE 0.0::DOUBLE END AS v FROM o)
"""


def _boxes(t) -> tuple[DataFrame, DataFrame]:
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    # dealt over more tasks when there are more rows, numbered once and kept: both sides and every later step read rows
    lines = t("lineitem").repartition(tasks_for(t("lineitem").sparkSession, t("lineitem").count()), "l_orderkey")
    lines = lines.select(F.col("l_orderkey").alias("d"), i.alias("idx"), (F.col("l_partkey") % 7).cast("string").alias("num"), (F.col("l_partkey") % 60).cast("int").alias("x"), (F.col("l_suppkey") % 60).cast("int").alias("y"), F.col("l_quantity").cast("int").alias("q"))
    lines = settled(lines, "boxes")
    box = lambda df, x, y: df.select("d", "idx", "num", x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 20).alias("y1"))
    wrong = lines.where("q % 9 <> 0").withColumn("num", F.when(F.col("q") % 5 == 0, F.lit("9")).otherwise(F.col("num")))
    return box(lines, F.col("x"), F.col("y")), box(wrong, F.col("x") + F.col("q") % 11, F.col("y") + F.col("q") % 7)


def _pairs(t) -> DataFrame:
    return evaluation.near_pairs(*_boxes(t), "d", 0.0)


@query("t31_iou", _BOXES + "SELECT d, gi, pi, round(v, 6) AS v FROM v WHERE v > 0")
def iou(t):
    return _pairs(t).where("v > 0").select("d", "gi", "pi", F.round("v", 6).alias("v"))


_GREEDY = """, c AS (SELECT d, list(struct_pack(v := v, gi := gi, pi := pi) ORDER BY v DESC, gi DESC, pi DESC) AS l FROM v WHERE v >= 0.3 AND same GROUP BY d),
m AS (SELECT d, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len([y for y in a if y.gi = x[1].gi OR y.pi = x[1].pi]) > 0 THEN a ELSE list_concat(a, x) END) AS k FROM c),
w AS (SELECT d, unnest(k) AS x FROM m)
"""


def _matches(t) -> DataFrame:
    return evaluation.greedy_matches(_pairs(t).where("v >= 0.3 AND same"), ["d"])


@query("t32_greedy", _BOXES + _GREEDY + "SELECT d, x.gi AS gi, x.pi AS pi, round(x.v, 6) AS v FROM w")
def greedy(t):
    return _matches(t).select("d", "gi", "pi", F.round("v", 6).alias("v"))


@query("t33_prf", _BOXES + _GREEDY + ", n AS (SELECT (SELECT count(*) FROM w) AS tp, (SELECT count(*) FROM p) AS n_pred, (SELECT count(*) FROM g) AS n_true) SELECT tp, n_pred, n_true, round(tp / n_pred, 9) AS precision, round(tp / n_true, 9) AS recall, round(2.0 * tp / (n_pred + n_true), 9) AS f1 FROM n")
def prf(t):
    g, p = _boxes(t)
    rows = [(_matches(t), 1, 0, 0), (p, 0, 1, 0), (g, 0, 0, 1)]
    parts = [df.select(F.lit(a).alias("tp"), F.lit(b).alias("n_pred"), F.lit(c).alias("n_true")) for df, a, b, c in rows]
    out = evaluation.precision_recall(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return out.select("tp", "n_pred", "n_true", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "t34_error_taxonomy",
    _BOXES + ", ng AS (SELECT d, gi, bool_or(same) AS same FROM v WHERE v >= 0.3 GROUP BY 1, 2), np AS (SELECT DISTINCT d, pi FROM v WHERE v >= 0.3), "
    "a AS (SELECT g.d, count(*) FILTER (same) AS hit, count(*) FILTER (NOT same) AS misread, count(*) FILTER (same IS NULL) AS missed FROM g LEFT JOIN ng ON g.d = ng.d AND g.idx = ng.gi GROUP BY 1), "
    "s AS (SELECT p.d, count(*) FILTER (np.pi IS NULL) AS spurious FROM p LEFT JOIN np ON p.d = np.d AND p.idx = np.pi GROUP BY 1) SELECT a.d, hit, misread, missed, coalesce(spurious, 0) AS spurious FROM a LEFT JOIN s ON a.d = s.d",
)
def error_taxonomy(t):
    return evaluation.error_kinds(*_boxes(t), "d")


_CURVE = """WITH s AS (SELECT n_chars // 100 AS score, quality AS label FROM labels JOIN documents USING (doc_id)), a AS (SELECT score, sum(label) AS p, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n - p) OVER w AS BIGINT) AS fp, sum(p) OVER () AS pos FROM a WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
u AS (SELECT score, tp, fp, tp / (tp + fp) AS precision, tp / pos AS recall FROM c), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM u)
"""


def _curve(t) -> DataFrame:
    rows = t("labels").join(t("documents"), "doc_id").select(F.expr("n_chars div 100").alias("score"), F.col("quality").alias("label"))
    return evaluation.pr_curve(rows)


@query("t35_pr_curve", _CURVE + "SELECT score, tp, fp, round(precision, 9) AS precision, round(recall, 9) AS recall FROM u")
def pr_curve(t):
    return _curve(t).select("score", "tp", "fp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("t35b_average_precision", _CURVE + "SELECT round(sum((recall - before) * precision), 9) AS average_precision FROM (SELECT *, coalesce(lag(recall) OVER (ORDER BY score DESC), 0) AS before FROM u)")
def average_precision(t):
    return evaluation.average_precision(_curve(t)).select(F.round("average_precision", 9).alias("average_precision"))


@query("t36_best_f1", _CURVE + "SELECT score, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall FROM f ORDER BY f.f1 DESC, score DESC LIMIT 1")
def best_f1(t):
    return evaluation.best_f1(_curve(t)).select("score", *[F.round(c, 9).alias(c) for c in ("f1", "precision", "recall")])


@query("t37_operating_points", _CURVE + "SELECT r.floor, max(score) AS score, round(arg_max(precision, score), 9) AS precision, round(arg_max(recall, score), 9) AS recall FROM u JOIN (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) r(floor) ON recall >= r.floor GROUP BY 1")
def operating_points(t):
    return evaluation.operating_points(_curve(t), [0.5, 0.8, 0.9, 0.95, 0.99]).select("floor", "score", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(
    "t38_reconcile",
    "WITH f AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_returnflag)) AS f FROM lineitem GROUP BY 1), w AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN ['A', 'R'] WHEN 'O' THEN ['N'] ELSE CAST([] AS VARCHAR[]) END AS w FROM orders), "
    "b AS (SELECT coalesce(f.k, w.k) AS k, coalesce(f, CAST([] AS VARCHAR[])) AS f, coalesce(w, CAST([] AS VARCHAR[])) AS w FROM f FULL JOIN w ON f.k = w.k) "
    "SELECT k, CASE WHEN len(w) = 0 THEN 'NO-EXPECT' WHEN f = w THEN 'CLEAN' ELSE 'HUMAN' END AS status, array_to_string([x for x in w if NOT list_contains(f, x)], ',') AS missing, array_to_string([x for x in f if NOT list_contains(w, x)], ',') AS extra FROM b",
)
def reconcile(t):
    found = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("tokens"))
    want = F.when(F.col("o_orderstatus") == "F", strings("A", "R")).when(F.col("o_orderstatus") == "O", strings("N")).otherwise(F.array().cast("array<string>"))
    out = evaluation.reconciled(found, t("orders").select(F.col("o_orderkey").alias("k"), want.alias("tokens")), "k")
    return out.select("k", "status", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


_IOU2 = "(greatest(0, least(y.x1, x[1].x1) - greatest(y.x0, x[1].x0)) * greatest(0, least(y.y1, x[1].y1) - greatest(y.y0, x[1].y0)))"


@query(
    "t39_nms",
    _BOXES + f", c AS (SELECT d, list(struct_pack(r := -(idx % 3), idx := idx, num := num, x0 := x0, y0 := y0, x1 := x1, y1 := y1) ORDER BY -(idx % 3), idx) AS l FROM p GROUP BY d), "
    f"m AS (SELECT d, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len([y for y in a if {_IOU2} / (800.0 - {_IOU2}) > CASE WHEN y.num = x[1].num THEN 0.3 ELSE 0.5 END]) > 0 THEN a ELSE list_concat(a, x) END) AS k FROM c) SELECT d, x.idx AS idx, x.num AS num FROM (SELECT d, unnest(k) AS x FROM m)",
)
def nms(t):
    return evaluation.suppressed(_boxes(t)[1].withColumn("rank", F.col("idx") % 3), ["d"]).select("d", "idx", "num")


_POINTS = "SELECT vec_id, label, embedding[1] AS x, embedding[2] AS y FROM embeddings"


@query("t40_neighbour_gate", f"WITH e AS ({_POINTS}) SELECT a.vec_id, count(b.vec_id) AS near FROM e a LEFT JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND abs(a.x - b.x) <= 0.1 AND abs(a.y - b.y) <= 0.1 GROUP BY 1 HAVING count(b.vec_id) < 2")
def neighbour_gate(t):
    from ..operators.imaging import neighbours

    e = t("embeddings").select("vec_id", "label", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return neighbours(e, "vec_id", "label", "x", "y", 0.1).where("near < 2")


@query(
    "t41_split",
    "SELECT doc_id, source, CASE WHEN CAST('0x' || left(md5(source || '/1998'), 8) AS BIGINT) % 10000 < 1500 THEN 'val' ELSE 'train' END AS split FROM documents",
)
def split(t):
    return evaluation.split_groups(t("documents").select("doc_id", "source"), "source", 0.15, 1998)


@query("t42_upper_median", "SELECT l_returnflag, list_sort(list(l_quantity))[count(*) // 2 + 1] AS m FROM lineitem GROUP BY 1, l_linestatus")
def upper_median(t):
    return evaluation.grouped_upper_median(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "m").select("l_returnflag", "m")


@query(
    "t43_patch_map",
    "WITH o AS (SELECT event_id, value > 50 AS ok, CASE WHEN event_id % 2 = 0 THEN ' ' ELSE 'seen' END AS notes FROM events), p AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN false END AS ok FROM events) "
    "SELECT o.event_id, CASE WHEN coalesce(p.ok, o.ok) OR trim(notes) <> '' THEN 'k=' || coalesce(p.ok, o.ok) || '/' || trim(notes) ELSE '' END AS marks FROM o JOIN p USING (event_id)",
)
def patch_map(t):
    mark = F.struct((F.col("value") > 50).alias("ok"), F.when(F.col("event_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("seen")).alias("notes"))
    patch = F.struct(F.when(F.col("event_id") % 3 == 0, F.lit(False)).alias("ok"), F.lit(None).cast("string").alias("notes"))
    out = garage.patched_meta(F.create_map(F.lit("k"), mark), F.create_map(F.lit("k"), patch))
    shown = F.array_join(F.transform(F.map_entries(out), lambda e: F.concat(e["key"], F.lit("="), e["value"]["ok"].cast("string"), F.lit("/"), e["value"]["notes"])), ",")
    return t("events").select("event_id", shown.alias("marks"))


@query("t44_upsert", "WITH n AS (SELECT c_custkey + 10 AS id, 'new ' || c_name AS nickname FROM customer WHERE c_custkey % 5 = 0) SELECT coalesce(c_custkey, id) AS id, coalesce(nickname, c_name) AS nickname, CASE WHEN id IS NULL THEN 'old' ELSE 'now' END AS updated, CASE WHEN c_custkey IS NULL THEN 'now' ELSE 'old' END AS created FROM customer FULL JOIN n ON c_custkey = id")
def upsert(t):
    held = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nickname"), F.lit("old").alias("createdAt"), F.lit("old").alias("updatedAt"))
    new = t("customer").where("c_custkey % 5 = 0").select((F.col("c_custkey") + 10).alias("id"), F.concat(F.lit("new "), "c_name").alias("nickname"))
    return garage.upsert(held, new, F.lit("now")).select("id", "nickname", F.col("updatedAt").alias("updated"), F.col("createdAt").alias("created"))


@query(
    "t45_rle",
    "WITH a AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), "
    "b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS length FROM b GROUP BY 1, 2, 3",
)
def rle(t):
    return ordered.runs(t("events"), "event_type", ["user_id"], "event_id").withColumn("run", F.col("run").cast("long"))


_PRINTED_SQL = """
WITH p AS (SELECT p_partkey, upper(split_part(p_name, ' ', 1)) || CASE WHEN p_size % 3 = 0 THEN '/COUPE,-' WHEN p_size % 3 = 1 THEN ' 4S' ELSE '' END AS head,
  CASE WHEN p_size % 2 = 0 THEN ' PR:' || (100 + p_size) || ',-' || (200 + p_partkey % 50) ELSE ' -"' || upper(left(p_type, 3)) || '."' END AS mid, p_size, p_partkey % 4 AS k FROM part),
s AS (SELECT p_partkey, head || mid || CASE k WHEN 0 THEN ' | D - MJ ' || (2000 + p_size % 10) || '>>' WHEN 1 THEN ' | F >> 99-8S' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') WHEN 2 THEN ' | D >> - 31.07.' || (2000 + p_size % 10) ELSE ' Z97.00' END AS printed FROM p),
w AS (SELECT *, regexp_split_to_array(split_part(printed, ' | ', 1), ' ') AS words, split_part(printed, ' | ', 2) AS tail FROM s)
SELECT p_partkey, printed, split_part(words[1], '/', 1) AS lines, CASE WHEN words[1] LIKE '%/COUPE%' THEN 'COUPE' ELSE '' END AS bodies, CASE WHEN list_contains(words, '4S') THEN '4' ELSE '' END AS drive, CASE WHEN list_contains(words, '4S') THEN 'S' ELSE '' END AS trim,
  regexp_extract(printed, 'PR:(\\d+)', 1) AS options, regexp_extract(printed, 'PR:\\d+,-(\\d+)', 1) AS barred, regexp_extract(printed, '-"([A-Z]+)\\."', 1) AS not_markets,
  TRY_CAST(nullif(regexp_extract(tail, 'MJ (\\d{4})>>', 1), '') AS INTEGER) AS year_from, TRY_CAST(nullif(regexp_extract(tail, '>> - \\d\\d\\.\\d\\d\\.(\\d{4})', 1), '') AS INTEGER) AS year_to,
  TRY_CAST(nullif(regexp_extract(tail, '^F >> 99-8S(\\d+)$', 1), '') AS BIGINT) AS chassis_to,
  array_to_string([x for x in [CASE WHEN words[1] LIKE '%,-' THEN '-' END, CASE WHEN list_contains(words, 'Z97.00') THEN 'Z97.00' END] if x IS NOT NULL], ',') AS unknown
FROM w
"""


@query("t46_parse_scope", _PRINTED_SQL)
def parse_scope(t):
    from ..functions.scope import with_scope

    c, k = F.col, F.col("p_partkey") % 4
    head = F.concat(F.upper(F.split("p_name", " ")[0]), F.when(c("p_size") % 3 == 0, "/COUPE,-").when(c("p_size") % 3 == 1, " 4S").otherwise(""))
    middle = F.when(c("p_size") % 2 == 0, F.concat(F.lit(" PR:"), c("p_size") + 100, F.lit(",-"), c("p_partkey") % 50 + 200)).otherwise(F.concat(F.lit(' -"'), F.upper(F.substring("p_type", 1, 3)), F.lit('."')))
    year = c("p_size") % 10 + 2000
    tail = F.when(k == 0, F.concat(F.lit(" | D - MJ "), year, F.lit(">>"))).when(k == 1, F.concat(F.lit(" | F >> 99-8S"), F.lpad(c("p_partkey").cast("string"), 6, "0"))).when(k == 2, F.concat(F.lit(" | D >> - 31.07."), year)).otherwise(" Z97.00")
    parsed = with_scope(t("part").select("p_partkey", F.concat(head, middle, tail).alias("printed")), "printed")
    s = c("scope")
    said = lambda a: F.array_join(a, ",")
    slots = lambda side: said(F.flatten(F.transform(s["prGroups"], lambda g: g[side])))
    facets = [said(s[g]["any"]).alias(g) for g in ("lines", "bodies", "drive", "trim")]
    first = lambda a: F.try_element_at(a, F.lit(1))
    return parsed.select("p_partkey", "printed", *facets, slots("any").alias("options"), slots("not").alias("barred"), said(s["markets"]["not"]).alias("not_markets"), first(s["mjRanges"])["from"].alias("year_from"), first(s["mjRanges"])["to"].alias("year_to"), first(s["chassis"])["to"]["serial"].alias("chassis_to"), said(s["unknown"]).alias("unknown"))


@query("t47_g4_roundtrip")
def g4_roundtrip(t):
    from ..operators.imaging import round_trips

    # all characters' codes as a picture of 48 columns, dark where they are odd, the last row filled up with blanks;
    # an empty page has a picture without rows, a null page none: null bytes, and null again when read back
    rows = F.ceil(F.length("html") / 48).cast("int")
    bits = F.transform(F.split(F.rpad("html", rows * 48, " "), ""), lambda c: F.ascii(c) % 2)
    pixels = F.unhex(F.when(rows > 0, F.array_join(F.transform(bits, lambda b: F.concat(F.lit("0"), b.cast("string"))), "")).when(rows == 0, F.lit("")))
    wide = t("pages").select("page_id", pixels.alias("pixels"), F.lit(48).alias("w"), F.coalesce(rows, F.lit(0)).alias("h"))
    return round_trips(wide, "page_id")


@query("t48_decode_vin", "SELECT c_custkey, family, CASE WHEN family = 'cayenne' THEN '9P8' || s ELSE '99-8' || s END AS chassis FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'cayenne' ELSE '997' END AS family, 'S' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') AS s FROM customer)")
def decode_vin(t):
    from ..functions.vin import decode_vin as decoded

    kind = F.when(F.col("c_custkey") % 2 == 0, F.lit("9P")).otherwise(F.lit("99"))
    vin = F.concat(F.lit("WP0ZZZ"), kind, F.lit("Z8S"), F.lpad((F.col("c_custkey") % 1000000).cast("string"), 6, "0"))
    v = decoded(vin)
    return t("customer").select("c_custkey", v["family"].alias("family"), v["chassis"].alias("chassis"))


@query("t50_main_groups", "SELECT CAST(o_orderpriority AS VARCHAR) AS number, CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS id, title FROM (SELECT o_orderpriority, min(o_orderkey) AS f, arg_min(o_orderstatus, o_orderkey) AS title FROM orders GROUP BY 1)")
def main_groups(t):
    rows = t("orders").select(F.lit("c").alias("catalog_id"), F.col("o_orderpriority").alias("number"), F.col("o_orderstatus").alias("title"), F.col("o_orderkey").alias("seq"))
    return directory.main_groups(rows).select("number", "id", "title")


@query("t51_callout_part", "SELECT p_partkey, o_orderkey FROM part LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = CAST(p_partkey * 3 AS VARCHAR)")
def callout_part(t):
    printed = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("("), (F.col("p_partkey") * 3).cast("string"), F.lit(")"))).otherwise((F.col("p_partkey") * 3).cast("string"))
    parts = t("part").select("p_partkey", text.position_token(printed).alias("_p"))
    return parts.join(t("orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("_n")), F.col("_p") == F.col("_n"), "left").select("p_partkey", "o_orderkey")


@query(
    "t52_remark_scope",
    "SELECT p_partkey, array_to_string([x for x in ['(J)', '-(CN)', '-02', '98-', '00-01'] if p_size % 5 <> 0 OR x <> '-02'], ' ') AS tokens FROM part",
)
def remark_scope(t):
    printed = F.when(F.col("p_size") % 5 != 0, F.lit("for (J) -(CN) -02 98- 00-01 - 45-46 x")).otherwise(F.lit("(J) -(CN) 98- 00-01"))
    tokens = applicability.remark_scope_tokens(printed, F.lit(1998), F.lit(2005), F.lit("old"))
    return t("part").select("p_partkey", F.array_join(tokens, " ").alias("tokens"))


@query("t53_number_ranges", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 6 WHEN 1 THEN 8 END AS cylinders, CASE p_size % 3 WHEN 0 THEN '3.4' WHEN 1 THEN '4' END AS displacement_l, CASE p_size % 3 WHEN 0 THEN 220 END AS power_kw FROM part")
def number_ranges(t):
    printed = F.element_at(strings("6ZYL/3,4L /220 KW", "8 ZYL 4 L", "-"), (F.col("p_size") % 3 + 1).cast("int"))
    d = text.tech_data(printed)
    return t("part").select("p_partkey", d["cylinders"].alias("cylinders"), d["displacement_l"].alias("displacement_l"), d["power_kw"].alias("power_kw"))


@query("t54_label_status", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 4 = 0 THEN 'ok' WHEN l_partkey % 4 = 1 THEN 'unread' WHEN l_partkey % 4 = 2 THEN 'partial' ELSE 'mismatch' END AS status FROM lineitem")
def label_status(t):
    own = F.lit("17")
    k = (F.col("l_partkey") % 4 + 1).cast("int")
    status = evaluation.label_status(own, F.element_at(strings("17", "", "1", "9"), k), F.element_at(strings("x", "", "", "8"), k))
    return t("lineitem").select("l_orderkey", "l_linenumber", status.alias("status"))


@query("t55_replace_sections", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'new' ELSE n_name END AS title, n_regionkey AS picture FROM nation")
def replace_sections(t):
    held = t("nation").select("n_nationkey", F.col("n_name").alias("title"), F.col("n_regionkey").alias("picture"))
    fresh = held.where("n_nationkey % 4 = 0").select("n_nationkey", F.lit("new").alias("title"), F.lit(None).cast("int").alias("picture"))
    return directory.replaced_sections(held, fresh, ["n_nationkey"], ["picture"])


@query("t56_best_containment", _BOXES + ", h AS (SELECT g.d, g.idx AS c, p.idx AS b, inter / 400.0::DOUBLE AS f, (g.x0 + g.x1) / 2.0 BETWEEN p.x0 AND p.x1 AND (g.y0 + g.y1) / 2.0 BETWEEN p.y0 AND p.y1 AS inside FROM g JOIN p ON g.d = p.d JOIN o ON o.d = g.d AND o.gi = g.idx AND o.pi = p.idx) SELECT d, c AS candidate_id, arg_max(b, f * 1000000 - b / 1000.0) AS box_id, round(max(f), 6) AS fraction FROM h WHERE inside AND f >= 0.6 GROUP BY 1, 2")
def best_containment(t):
    g, p = _boxes(t)
    out = ranges.best_containment(g.withColumnRenamed("idx", "candidate_id"), p.withColumnRenamed("idx", "box_id"), "d")
    return out.select("d", "candidate_id", "box_id", F.round("fraction", 6).alias("fraction"))
