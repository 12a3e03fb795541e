import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.functions import text, vin
from partloom.operators import applicability, directory, evaluation, garage, imaging, ordered, parts, vpages

HEAD = [("Pos", 14.0), ("Part Number", 57.0), ("Description", 162.0), ("Remark", 346.0), ("Qty", 445.0), ("Model", 488.0)]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def read(spark, pages, old=False):
    """Rows of one section without their first two columns, in print order."""
    items = []
    for p, rows in enumerate(pages, 1):
        for y, row in enumerate(rows):
            items += [("c", "s", p, 800.0, 100 * y + i, t, None if x is None else float(x), 700.0 - 10 * y, "old" if old else None, 1998, 2005) for i, (t, x) in enumerate(row)]
    df = spark.createDataFrame(items, "catalog_id string, section_id string, page int, page_height double, item_idx int, str string, x double, y double, dialect string, pivot int, life_end int")
    return [tuple(r)[2:] for r in sorted(parts.extract(df).collect(), key=lambda r: (r.block, r.child))]


def test_vin(spark):
    v = one(spark, vin.decode_vin(F.lit("wp0zzz99z5S750061")))
    assert (v.ok, v.family, v.model_year, v.chassis) == (True, "997", 2005, "99-5S750061")
    assert one(spark, vin.decode_vin(F.lit("WP1ZZZ9PZ3LA00061"))).chassis == "9P3LA00061"
    assert not one(spark, vin.decode_vin(F.lit("WP0ZZZ99Z5S75006I"))).ok and not one(spark, vin.decode_vin(F.lit(None).cast("string"))).ok


def test_variant_facets(spark):
    bodies, lines = F.array(*map(F.lit, ("COUPE", "CABRIO"))), F.array(*map(F.lit, ("TURBO", "GT2")))
    named = F.array(F.lit("CABRIO"))
    v = one(spark, vin.variant_facets(F.lit("997 Turbo GT2 (USA)"), named, lines, bodies))
    assert (v.line, v.body, v.market) == ("GT2", "COUPE", "USA")
    v = one(spark, vin.variant_facets(F.lit("997 Turbo Cabrio (rest of the world)"), named, lines, bodies))
    assert (v.line, v.body, v.market) == ("TURBO", "CABRIO", "")


def test_numbers(spark):
    assert one(spark, text.range_end(F.lit("627 00501"), F.lit("18000"))) == "627 18000"
    assert one(spark, text.expand_year(F.lit("59"), F.lit(1950))) == 1959 and one(spark, text.expand_year(F.lit("05"), F.lit(None).cast("int"))) == 5
    assert one(spark, text.expand_two_digit(F.lit("05"), F.lit(None).cast("int"))) is None
    assert one(spark, text.half_up(F.lit(-2.5))) == -2 and one(spark, text.half_even(F.lit(2.5))) == 2
    assert one(spark, text.undotted(F.lit("M96.70S"))) == "9670S" and one(spark, text.normal_market(F.lit("J.."))) == "J"
    assert one(spark, text.natural_key(F.lit("3/12"))) == [3, 12]


def test_wrapped_options_and_variants(spark):
    rows = read(spark, [[HEAD, [("1", 14), ("997", 57), ("501", 78), ("Lock", 162), ("2", 445), ("PR:098,", 488)], [("490", 488)], [("D - MJ 2008>>", 162)], [("997", 57), ("502", 78), ("FSA", 135), ("black", 162), ("D >> - MJ 2009", 488)], [("A", 57), ("paint", 162), ("A 1", 488)]]])
    assert rows[0][-1] == "PR:098,490 | D - MJ 2008>>"
    assert rows[1][4:7] == ("997 502 FSA", "FSA", "black") and rows[1][-1] == "PR:098,490 | D >> - MJ 2009"
    assert rows[2][8] == "A 1" and rows[2][-1] == ""


def test_block_crosses_pages_and_bulk_is_cloned(spark):
    first = [HEAD, [("-", 14), ("900", 57), ("918", 78), ("Pipe", 162), ("*", 445)], [("16", 14), ("shorten to:", 162), ("980 MM", 346), ("1", 445)]]
    rows = read(spark, [first, [HEAD, [("rest", 162)], [("not for:", 162)], [("Australien", 162)]]])
    assert rows[1][4] == "900 918" and rows[1][6] == "Pipe rest" and rows[1][8] == "shorten to: 980 MM" and rows[1][-1] == '-"AUS"'


def test_notes_close_descriptions(spark):
    (row,) = read(spark, [[HEAD, [("(2)", 14), ("996", 57), ("Relay", 162)], [("relay location/code no.:", 162), ("S4", 346)], [("also use:", 162), ("997", 346)], [("more", 162)], [("Discontinued part", 162)], [("X", 14), ("legend", 162)], [("lost", 162)]]])
    assert row[6] == "Relay Discontinued part" and row[8] == "relay location/code no.: S4 also use: 997 more"


def test_titles_and_old_remarks(spark):
    rows = read(spark, [[HEAD, [("Body", 162), ("COUPE", 488)], [("Sound", 162)], [("third", 162)], [("1", 14), ("996", 57), ("Mat", 162), ("-02 (J) 45-46", 346)]]], old=True)
    assert rows[0][0] == "title" and rows[0][6] == "Body Sound third" and rows[0][10] == "COUPE"
    assert rows[1][-1] == "-02 | (J)"


def test_extract_skips_bad_pages(spark):
    items = []
    for p, rows in ((1, [HEAD, [("1", 14.0), ("996", 57.0), ("Mat", 162.0)]]), (2, [[("bad", None)]]), (3, [HEAD, [("more", 162.0)]])):
        for y, row in enumerate(rows):
            items += [("c", "s", p, 800.0, 100 * y + i, t, x, 700.0 - 10 * y, None, None, None) for i, (t, x) in enumerate(row)]
    df = spark.createDataFrame(items, "catalog_id string, section_id string, page int, page_height double, item_idx int, str string, x double, y double, dialect string, pivot int, life_end int")
    assert [r.description for r in parts.extract(df).collect()] == ["Mat more"]


def test_front_pages(spark):
    pages = {
        1: [["Model: 997 Model life 2007>>2009"], ["Optional Equipment"], ["NR", "Description"], ["567", "Windscreen tinted,"], ["upper part"]],
        2: [["darker"], ["XMJ", "Other"]],
        3: [["Model Overview EC"], ["EC", "Ltr"], ["9770", "3.6", "353", "480", "6", "08/06-07/08", "Turbo"]],
        4: [["Engine type"], ["Engine number"], ["627", "00501>18000", "2007", "Turbo", "9770"]],
        5: [["SUMMARY TYPES"], ["VEHICLE", "IDENT.NR."], ["996", "COUPE", "99", "X", "99XS6", "20061>30000", "M96.01"], ["911", "TURBO", "75", "5", "93057", "0001>>", "930.50"]],
        6: [["SUMMARY ENGINES"], ["MY"], ["996", "M96.01", "99", "9", "661", "00501>60000", "6ZYL/3,4L", "/220 KW"]],
    }
    rows = spark.createDataFrame([("c", p, i, t) for p, rs in pages.items() for i, t in enumerate(rs)], "catalog_id string, page int, row_idx int, tokens array<string>")
    got = {}
    for r in vpages.parse(rows).collect():
        got.setdefault(r.table_name, []).append(r.fields)
    assert [r["description"] for r in got["pr_code"]] == ["Windscreen tinted, upper part darker", "Other"]
    assert got["engine_code"][0]["power_hp"] == "480" and got["engine_code"][1]["displacement_l"] == "3.4"
    assert got["engine_number_range"][0]["number_to"] == "627 18000" and got["engine_number_range"][1]["number_to"] == "661 60000"
    assert got["engine_number_range"][1]["model_year"] == "2099"
    assert [r["vin_from"] for r in got["vin_range"]] == ["99XS620061", "93057 0001"]
    assert got["catalog"][0]["dialect"] == "old" and got["catalog"][0]["pivot"] == "2007"


def test_child_scope_and_titles(spark):
    assert one(spark, applicability.child_scope(F.lit("D >> - MJ 2007"), F.lit("PR:1 | D >> - MJ 2008"))) == "PR:1 | D >> - MJ 2007"
    assert one(spark, applicability.glued_list(F.array(F.lit("PR:1,"), F.lit("2"), F.lit("X")))) == "PR:1,2 X"
    heads = F.array(*map(F.lit, (True, False, True, False)))
    assert one(spark, applicability.title_variants(F.array(*map(F.lit, ("CARRERA", "4", "TARGA", "S"))), heads)) == [["CARRERA", "4"], ["TARGA", "S"]]


def test_greedy_equals_python(spark):
    r = random.Random(1)
    rows = [(g, round(r.choice([0.3, 0.5, 0.7, r.random()]), 3), gi, pi) for g in range(40) for gi in range(5) for pi in range(5) if r.random() < 0.6]
    got = {(x.k, x.gi, x.pi) for x in evaluation.greedy_matches(spark.createDataFrame(rows, "k int, v double, gi long, pi long"), ["k"]).collect()}
    want = set()
    for g in range(40):
        a, b = set(), set()
        for _, v, gi, pi in sorted((x for x in rows if x[0] == g), key=lambda x: x[1:], reverse=True):
            if gi not in a and pi not in b:
                a.add(gi), b.add(pi), want.add((g, gi, pi))
    assert got == want


def test_garage(spark):
    kind = f"id string, nickname string, partMeta {garage.META}, createdAt string, updatedAt string"
    held = spark.createDataFrame([("1", "a", {"k": (True, "n"), "z": (True, "")}, "old", "old"), (None, "b", None, "old", "old")], kind)
    got = {r.id: r for r in garage.upsert(held.where("id = '1'"), spark.createDataFrame([("1", "new"), ("2", "x")], "id string, nickname string"), F.lit("now")).collect()}
    assert (got["1"].nickname, got["1"].createdAt, got["1"].updatedAt, got["2"].createdAt, got["2"].partMeta) == ("new", "old", "now", "now", {})
    patches = spark.createDataFrame([("1", {"k": (False, " "), "q": (True, " hi ")})], f"id string, patch {garage.META}")
    meta = garage.set_part_meta(held.where("id = '1'"), patches, F.lit("now")).first().partMeta
    assert {k: (v.ok, v.notes) for k, v in meta.items()} == {"z": (True, ""), "q": (True, "hi")}
    assert garage.remove(held.where("id = '1'"), spark.createDataFrame([("1",)], "id string")).count() == 0


def test_shape_and_runs(spark):
    assert directory.shape({"b": ["y", "x"], "a": ["z"]}) == "a(z);b(x,y)"
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabba")], "k int, i int, v string")
    assert sorted((r.run, r.v, r.length) for r in ordered.runs(df, "v", ["k"], "i").collect()) == [(1, "a", 2), (2, "b", 2), (3, "a", 1)]


@pytest.mark.parametrize("seed", range(3))
def test_codec_roundtrip(seed):
    r = np.random.default_rng(seed)
    for _ in range(60):
        p = (r.random((r.integers(1, 30), r.integers(1, 200))) < r.choice([0.02, 0.3, 0.5, 0.98])).astype(np.uint8)
        assert (imaging.g4_decode(imaging.g4_encode(p), p.shape[1], p.shape[0]) == p).all()
    for p in (np.zeros((4, 7000)), np.ones((3, 5300)), np.tile([0, 1], (9, 40)), np.eye(64)):
        assert (imaging.g4_decode(imaging.g4_encode(p.astype(np.uint8)), p.shape[1], p.shape[0]) == p).all()


def test_run_codes_are_prefix_free():
    for codes in imaging.RUNS:
        v = sorted(codes.values())
        assert len(v) == 104 and all(not b.startswith(a) for a, b in zip(v, v[1:], strict=False))


def test_components_and_depth():
    r = np.random.default_rng(2)
    mask = r.random((25, 31)) < 0.55
    labels, n = imaging.components(mask)
    seen = np.zeros_like(labels)
    k = 0
    for y, x in np.argwhere(mask):
        if not seen[y, x]:
            k += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 25 and 0 <= b < 31 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = k
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert n == k and (labels == seen).all()
    ring = np.zeros((11, 11), np.uint8)
    ring[1:10, 1:10], ring[2:9, 2:9], ring[5, 5] = 1, 0, 1
    depth = imaging.nesting_depth(ring)
    assert (depth[1, 1], depth[5, 5], depth[0, 0]) == (1, 3, -1)


def test_digits():
    d = lambda t, x, p=0.9: {"text": t, "x0": x, "y0": 0, "x1": x + 6, "y1": 10, "prob": p}
    groups = imaging.grouped_digits([d("2", 8), d("1", 0), d("3", 40), d("1", 100, 0.1)])
    assert [g["num"] for g in groups] == ["12", "3", "1"] and [g["num"] for g in imaging.gated(groups)] == ["12", "3"]
    assert imaging.read_choice(("4", 50), ("7", 60), 0.6) == ("7", 60) and imaging.read_choice(("", 0), ("x", 1), 0.2) == ("1", 0)
    assert imaging.compound_spans([d("1", 0) | {"num": "1"}, d("2", 14) | {"num": "2"}]) == [(0, 1)]
    ink = np.zeros((20, 20), np.uint8)
    ink[5:10, 5:8] = ink[5:10, 10:12] = 1
    assert imaging.snapped(ink, (4, 4, 13, 11)) == (5, 5, 12, 10)


def test_candidates_from_diagrams(spark):
    ink = np.zeros((300, 300), np.uint8)
    ink[20:32, 20:28] = 1
    df = spark.createDataFrame([(1, bytearray(imaging.g4_encode(ink)), 300, 300), (2, None, 1, 1)], "section_id long, diagram binary, width int, height int")
    (row,) = imaging.candidate_boxes(df).collect()
    assert (row.x0, row.y0, row.x1, row.y1, row.depth, len(row.patch)) == (20, 20, 28, 32, 1, 48 * 48 * 4)
