"""Queries of evaluation, vehicle documents, stored search, fitment over data-derived scopes, and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vin
from ..functions.scope import with_scope
from ..operators import evaluation, garage, profiles, search
from ..sources.tables import shared_folder
from ..streaming import stages
from .registry import _BOXES, _GREEDY, _boxes, query

_FREE = _GREEDY.replace(" AND same", "").replace("c AS", "c2 AS").replace("FROM c)", "FROM c2)").replace("m AS", "m2 AS").replace("FROM m)", "FROM m2)").replace("w AS", "w2 AS")


@query(
    "t62_detection",
    _BOXES + _GREEDY + _FREE + ", n AS (SELECT (SELECT count(*) FROM w) AS tp, (SELECT count(*) FROM w2) AS found, (SELECT avg(x.v) FROM w) AS mean_iou, (SELECT count(*) FROM p) AS n_pred, (SELECT count(*) FROM g) AS n_true) "
    "SELECT tp, n_pred, n_true, round(tp / n_pred, 9) AS precision, round(tp / n_true, 9) AS recall, round(2.0 * tp / (n_pred + n_true), 9) AS f1, round(found / n_true, 9) AS detection_recall, round(mean_iou, 6) AS mean_iou FROM n",
)
def detection(t):
    out = evaluation.detection_metrics(*_boxes(t), "d")
    return out.select("tp", "n_pred", "n_true", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "detection_recall")], F.round("mean_iou", 6).alias("mean_iou"))


@query("t63_number_counts", "WITH c AS (SELECT l_orderkey AS d, l_partkey % 7 AS k, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT d, coalesce(string_agg(CASE WHEN n > 1 THEN CAST(k AS VARCHAR) END, ',' ORDER BY k), '') AS repeats, coalesce(string_agg(CASE WHEN k > 4 THEN CAST(k AS VARCHAR) END, ',' ORDER BY k), '') AS extras FROM c GROUP BY 1")
def number_counts(t):
    found = _boxes(t)[0]
    expected = found.select("d").distinct().select("d", F.array(*[F.lit(str(k)) for k in range(5)]).alias("tokens"))
    return evaluation.number_counts(found, expected, "d").select("d", F.array_join("repeats", ",").alias("repeats"), F.array_join("extras", ",").alias("extras"))


@query("t64_confusions", _BOXES + "SELECT g.num AS true_num, p.num AS read_num, count(*) AS n FROM v JOIN g ON g.d = v.d AND g.idx = v.gi JOIN p ON p.d = v.d AND p.idx = v.pi WHERE v >= 0.3 AND NOT same GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def confusions(t):
    return evaluation.top_confusions(*_boxes(t), "d")


_CAUSES_SQL = (
    _BOXES + _GREEDY + _FREE + ", k AS (SELECT d, q % 3 <> 0 AS accepted, x + 15 AS x0, y + 15 AS y0, x + 25 AS x1, y + 25 AS y1 FROM l WHERE q % 4 <> 0), "
    "t AS (SELECT g.d, g.idx, bool_or(k.accepted) AS accepted FROM g JOIN k ON g.d = k.d AND least(g.x1, k.x1) > greatest(g.x0, k.x0) AND least(g.y1, k.y1) > greatest(g.y0, k.y0) GROUP BY 1, 2), "
    "seen AS (SELECT d FROM p UNION SELECT d FROM k), "
    "z AS (SELECT CASE WHEN g.d NOT IN (SELECT d FROM seen) THEN 'NODBG' WHEN a.gi IS NOT NULL THEN 'TP' WHEN b.gi IS NOT NULL THEN 'D' WHEN t.accepted IS NULL THEN 'A' WHEN t.accepted THEN 'C' ELSE 'B' END AS cause "
    "FROM g LEFT JOIN (SELECT d, x.gi AS gi FROM w) a ON a.d = g.d AND a.gi = g.idx LEFT JOIN (SELECT d, x.gi AS gi FROM w2) b ON b.d = g.d AND b.gi = g.idx LEFT JOIN t ON t.d = g.d AND t.idx = g.idx), "
    "e AS (SELECT cause, count(*) AS n FROM z GROUP BY 1) SELECT cause, n, coalesce(cause = (SELECT cause FROM e WHERE cause IN ('A', 'B', 'C') ORDER BY n DESC, cause LIMIT 1), false) AS dominant FROM e"
)


@query("t85_causes", _CAUSES_SQL)
def detection_causes(t):
    g, p = _boxes(t)
    q = F.col("l_quantity").cast("int")
    shift = lambda c: (F.col(c) % 60 + 15).cast("int")
    found = t("lineitem").where(q % 4 != 0).select(F.col("l_orderkey").alias("d"), (q % 3 != 0).alias("accepted"), shift("l_partkey").alias("x0"), shift("l_suppkey").alias("y0"), (shift("l_partkey") + 10).alias("x1"), (shift("l_suppkey") + 10).alias("y1"))
    return evaluation.cause_counts(evaluation.causes(g, p, found, "d"))


_TOUCH = "least(g.x1, p.x1) > greatest(g.x0, p.x0) AND least(g.y1, p.y1) > greatest(g.y0, p.y0)"


@query(
    "t86_examples",
    _BOXES + _GREEDY + f", n AS (SELECT g.d, g.idx, arg_min(p.num, p.idx) AS read_num FROM g JOIN p ON g.d = p.d AND {_TOUCH} GROUP BY 1, 2), "
    "f AS (SELECT g.d, g.idx, g.num, n.read_num FROM g LEFT JOIN n ON n.d = g.d AND n.idx = g.idx WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.d = g.d AND w.x.gi = g.idx)), "
    f"s AS (SELECT p.d, p.idx, p.num FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.d = p.d AND {_TOUCH})) "
    "SELECT * FROM (SELECT 'missed' AS kind, d, idx, num, read_num FROM f WHERE read_num IS NULL ORDER BY d, idx LIMIT 40) UNION ALL SELECT * FROM (SELECT 'misread', d, idx, num, read_num FROM f WHERE read_num IS NOT NULL ORDER BY d, idx LIMIT 40) "
    "UNION ALL SELECT * FROM (SELECT 'spurious', d, idx, num, NULL FROM s ORDER BY d, idx LIMIT 40)",
)
def examples(t):
    return evaluation.first_examples(*_boxes(t), "d")


_GARAGE_SQL = """
SELECT CAST(c_nationkey AS VARCHAR) AS owner, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS place,
  CASE WHEN c_custkey % 4 = 0 THEN sha256(c_nationkey || '/' || (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)) ELSE 'v' || c_custkey END AS id, c_name AS nickname, CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS marks
FROM customer WHERE c_nationkey <> 7
"""


@query("t65_garage", _GARAGE_SQL)
def garage_documents(t):
    c = F.col
    own = t("customer").select(c("c_nationkey").cast("string").alias("owner"), "c_custkey", F.when(c("c_custkey") % 4 != 0, F.concat(F.lit("v"), c("c_custkey").cast("string"))).alias("id"), c("c_name").alias("nickname"))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy("c_custkey")))
    mark = F.struct(F.lit(True).alias("ok"), F.lit("seen").alias("notes"))
    own = own.withColumn("partMeta", F.when(c("c_custkey") % 3 == 0, F.create_map(F.lit("k"), mark)))
    texts = garage.save(own.select("owner", "place", "id", "nickname", "partMeta"))
    # one garage's file is cut off in the middle and reads as empty
    broken = texts.withColumn("text", F.when(c("owner") == "7", F.substring("text", 1, 40)).otherwise(c("text")))
    return garage.listed(garage.load(broken))


@query("t66_stored_index", "WITH w AS (SELECT DISTINCT p_partkey, unnest(regexp_split_to_array(lower(p_name || ' ' || p_brand), '[^\\p{L}\\p{N}]+')) AS w FROM part) SELECT a.p_partkey FROM w a JOIN w b USING (p_partkey) WHERE a.w = 'brand' AND b.w = '11'")
def stored_index(t):
    part = t("part")
    spark = part.sparkSession
    path = shared_folder(spark, "index")
    search.store_index(search.token_index(part, "p_partkey", ["p_name", "p_brand"]), path)
    return search.match_stored(spark, path, "Brand#11").withColumnRenamed("key", "p_partkey")


@query("t67_event_windows", "WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM w GROUP BY 1, 2")
def event_windows(t):
    return stages.sliding_counts(t("events")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("t68_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(t):
    return stages.sessions(t("events")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("first"), "n")


@query("t69_furthest_stage", "SELECT user_id AS job, max(CAST(event_id % 6 AS INTEGER)) AS stage FROM events GROUP BY 1")
def furthest_stage(t):
    return stages.furthest_stage(t("events").select(F.col("user_id").alias("job"), (F.col("event_id") % 6).cast("int").alias("stage")))


_LINES = ("TURBO", "GT2", "CARRERA")


@query(
    "t70_variant_facets",
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'GT2' WHEN 1 THEN 'CARRERA' WHEN 2 THEN 'TURBO' ELSE '' END AS line, CASE c_custkey % 4 WHEN 2 THEN 'CABRIO' ELSE 'COUPE' END AS body, "
    "CASE WHEN c_nationkey % 3 = 0 THEN 'USA' WHEN c_nationkey % 3 = 1 THEN '' ELSE '' END AS market FROM customer",
)
def variant_facets(t):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, "997 Turbo GT2").when(k == 1, "Carrera").when(k == 2, "Turbo Cabrio").otherwise("unknown")
    where = F.when(F.col("c_nationkey") % 3 == 0, " (USA) — late").when(F.col("c_nationkey") % 3 == 1, " (USA, CDN)").otherwise(" (rest of the world)")
    of = lambda *x: F.array(*map(F.lit, x))
    v = vin.variant_facets(F.concat(name, where), of("CABRIO"), of(*_LINES), of("COUPE", "CABRIO"))
    return t("customer").select("c_custkey", v["line"].alias("line"), v["body"].alias("body"), v["market"].alias("market"))


def garage_of(supplier: DataFrame) -> DataFrame:
    """A vehicle for each supplier, every field set from its keys."""
    from ..model import VEHICLE

    c, k = F.col, F.col("s_suppkey")
    text = lambda x: x.cast("string")
    none = F.lit(None)
    block = F.struct(F.lit("99-8S000001").alias("from"), F.lit("99-8S500000").alias("to"))
    held = {
        "line": F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("brand"), text(k % 5 + 1), text(c("s_nationkey") % 5 + 1))), "body": F.when(k % 2 == 0, "coupe").otherwise("CABRIO"), "trim": F.when(k % 3 == 0, "RS 4.0").when(k % 3 == 1, "S"),
        "engine": F.concat(F.lit("M"), text(k % 3 + 9700)), "market": F.when(k % 7 == 0, "ROK").otherwise("D"), "year": (k % 10 + 1995).cast("int"), "prCodes": F.array(text(k % 7 + 100), text(k % 4 + 200)),
        "chassis": F.concat(F.lit("99-8S"), F.lpad(text(k * 7 % 400 + 1), 6, "0")), "chassisBlock": block,
    }
    return supplier.select(k.alias("vehicle_id"), F.struct(*[held.get(f.name, none).cast(f.dataType).alias(f.name) for f in VEHICLE.fields]).alias("vehicle"))


def scopes_of(part: DataFrame) -> DataFrame:
    """Section and part scope of each part, printed from its columns and parsed."""
    c, size = F.col, F.col("p_size")
    text = lambda x: x.cast("string")
    join = lambda sep, *x: F.concat_ws(sep, *x)
    said = lambda test, value: F.when(test, F.lit(value) if isinstance(value, str) else value)
    line = F.regexp_replace(F.upper("p_brand"), "#", "")
    section = join(" ", said(size % 5 > 0, line), said(size % 2 == 0, "COUPE"), said(size % 4 == 0, "-RS"), said(size % 6 == 0, '-"ROK"'))
    own = join(" ", said(size % 3 == 0, join("", F.lit("PR:"), text(size % 7 + 100), F.lit(",-"), text(size % 4 + 200))), said(size % 8 == 0, join(",", F.lit("9700"), F.lit("9701"))))
    years = said(size % 2 == 1, join("", F.lit("D - MJ "), text(size % 10 + 1995), F.lit(">>")))
    serial = said(size % 7 == 0, join("", F.lit("F >> 99-8S"), F.lpad(text(c("p_partkey") % 400), 6, "0")))
    printed = part.select(c("p_partkey").alias("part_id"), section.alias("printed_section"), F.array_join(F.filter(F.array(own, years, serial), lambda s: s != ""), " | ").alias("printed_own"))
    from ..functions.scope import Vocabulary

    words = Vocabulary.of(engines=["9700", "9701", "9702"])
    return with_scope(with_scope(printed, "printed_section", "section_scope", words), "printed_own", "scope", words)


_FITMENT_SQL = """
WITH v AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE 'BRAND' || (s_suppkey % 5 + 1) || (s_nationkey % 5 + 1) END AS line FROM supplier)
SELECT v.id AS vehicle_id, p_partkey AS part_id FROM v, part WHERE (p_size % 5 = 0 OR v.line = '' OR v.line = replace(upper(p_brand), '#', '')) AND (p_size % 2 <> 0 OR v.id % 2 = 0)
  AND NOT (p_size % 4 = 0 AND v.id % 3 = 0) AND NOT (p_size % 6 = 0 AND v.id % 7 = 0) AND (p_size % 3 <> 0 OR (v.id % 7 = p_size % 7 AND v.id % 4 <> p_size % 4))
  AND (p_size % 8 <> 0 OR v.id % 3 < 2) AND (p_size % 2 = 0 OR v.id % 10 >= p_size % 10) AND (p_size % 7 <> 0 OR p_partkey % 400 = 0 OR v.id * 7 % 400 + 1 <= p_partkey % 400)
"""


@query("t49_fitment", _FITMENT_SQL)
def fits(t):
    return profiles.fitting_parts(scopes_of(t("part")).select("part_id", "section_scope", "scope"), garage_of(t("supplier")))


@query("t71_first_events", "SELECT event_id, min(ts) AS ts FROM (SELECT event_id, ts FROM events UNION ALL SELECT event_id, ts FROM events) GROUP BY 1")
def first_events(t):
    twice = t("events").select("event_id", "ts")
    return stages.timed(twice.unionByName(twice)).dropDuplicates(["event_id"]).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("t72_ordered_sample")
def ordered_sample(t):
    return evaluation.ordered_sample(t("part"), "p_partkey", 15).select("p_partkey")


_SHAPES_SQL = """
WITH s AS (SELECT s_nationkey AS section_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, CAST(3 + s_suppkey % 7 AS INTEGER) AS w, CAST(6 + s_suppkey % 9 AS INTEGER) AS h FROM supplier),
b AS (SELECT section_id, CAST(i % 20 * 20 + 2 AS INTEGER) AS x0, CAST(i // 20 * 20 + 2 AS INTEGER) AS y0, w, h, max(i // 20 + 1) OVER (PARTITION BY section_id) * 20 AS height FROM s)
SELECT CAST(section_id AS BIGINT) AS section_id, x0, y0, x0 + w AS x1, y0 + h AS y1, w * h AS area FROM b WHERE h >= 8 AND h <= 0.06 * greatest(height, 400) AND w <= 24 AND w * h >= 12
"""


def drawn(supplier: DataFrame) -> DataFrame:
    """A picture for each nation with a dark rectangle for each of its suppliers, in cells of 20 by 20."""
    from ..operators.imaging import encode_picture

    c, k = F.col, F.col("s_suppkey")
    turn = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    shapes = supplier.withColumn("i", turn).select(c("s_nationkey").cast("long").alias("section_id"), (c("i") % 20).alias("col"), F.floor(c("i") / 20).cast("int").alias("line"), (k % 7 + 3).cast("int").alias("w"), (k % 9 + 6).cast("int").alias("h"))
    # a line of cells is 20 rows of 400 pixels, each the overlay of its cells' bits
    rows = shapes.select("section_id", "line", "col", "w", F.explode(F.sequence(F.lit(2), c("h") + 1)).alias("y"))
    ink = rows.groupBy("section_id", (c("line") * 20 + c("y")).alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("col", "w"))).alias("cells"))
    whole = shapes.groupBy("section_id").agg(F.greatest(F.max("line") * 20 + 20, F.lit(400)).alias("height")).withColumn("row", F.explode(F.sequence(F.lit(0), c("height") - 1)))
    bits = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda x: F.when((x % 20 >= 2) & (x % 20 < 2 + F.coalesce(F.try_element_at(c("cells"), F.floor(x / 20).cast("int")), F.lit(0))), "01").otherwise("00"))
    lined = whole.join(ink, ["section_id", "row"], "left").withColumn("bits", F.array_join(bits, ""))
    pixels = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "bits"))), lambda r: r["bits"]), ""))
    pictures = lined.groupBy("section_id").agg(pixels.alias("pixels"), F.first("height").alias("height"), F.lit(400).alias("width"))
    return pictures.select("section_id", encode_picture("pixels", "width", "height").alias("diagram"), "width", "height")


@query("t73_candidates", _SHAPES_SQL)
def digit_candidates(t):
    from ..operators.imaging import candidate_boxes

    return candidate_boxes(drawn(t("supplier"))).select("section_id", "x0", "y0", "x1", "y1", "area")


@query("t88_strips", _SHAPES_SQL)
def strip_candidates(t):
    """The rows of t73, by components over strips of the pictures."""
    from ..operators import strips
    from ..sources.tables import settled

    pictures = settled(drawn(t("supplier")), "pictures")
    found = strips.component_boxes(settled(strips.picture_runs(pictures), "runs"), 16)
    return strips.digit_sized(found, pictures).select("section_id", "x0", "y0", "x1", "y1", F.col("area").cast("int").alias("area"))
