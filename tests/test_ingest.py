import json

from pyspark.sql import functions as F

from partloom.model import VEHICLE
from partloom.operators import truth
from partloom.plans import ingest
from partloom.sources.documents import OUTLINE

HEAD = [("Pos", 14.0), ("Part Number", 57.0), ("Description", 162.0), ("Remark", 346.0), ("Qty", 445.0), ("Model", 488.0)]


def items(pages):
    out = []
    for p, rows in pages.items():
        for y, row in enumerate(rows):
            out += [("c", p, 800.0, 100 * y + i, t, x, 700.0 - 10 * y) for i, (t, x) in enumerate(row)]
    return out


def test_catalogue_and_fitting_parts(spark):
    outline = [{"title": "1 Engine", "page": 2, "items": [{"title": "101-000 Block", "page": 3, "items": []}, {"title": "101-005 Head", "page": 6, "items": []}]}, {"title": "2 Body", "page": 8, "items": [{"title": "201-000 Door", "page": 8, "items": []}]}]
    outlines = spark.createDataFrame([(json.dumps({"catalog_id": "c", "outline": outline}),)], "j string").select(F.from_json("j", OUTLINE).alias("o")).select("o.*")
    front = [["Model: 997 Model life 2007>>2009"], ["Model Overview EC"], ["EC"], ["9770", "3.6", "353", "480", "6", "08/06-07/08"], ["Model Overview Sales Type"], ["Sales term"], ["12345", "911", "TURBO", "08/06-07/08"]]
    rows = spark.createDataFrame([("c", 1 + i // 4, i, t) for i, t in enumerate(front)], "catalog_id string, page int, row_idx int, tokens array<string>")
    text = items(
        {
            4: [HEAD, [("Block", 162.0), ("TURBO", 488.0)], [("1", 14.0), ("996", 57.0), ("Bolt", 162.0), ("PR:480", 488.0)]],
            5: [HEAD, [("997", 57.0), ("black", 162.0), ("PR:481", 488.0)], [("2", 14.0), ("998", 57.0), ("Nut", 162.0)]],
            7: [HEAD, [("1", 14.0), ("900", 57.0), ("Cap", 162.0), ("D - MJ 2008>>", 488.0)]],
            9: [HEAD, [("Door", 162.0), ("COUPE", 488.0)], [("1", 14.0), ("901", 57.0), ("Lock", 162.0)]],
        }
    )
    page_items = spark.createDataFrame(text, "catalog_id string, page int, page_height double, item_idx int, str string, x double, y double")
    tables = ingest.build(outlines, rows, page_items, spark.createDataFrame([("c", 10)], "catalog_id string, page_count int"))
    assert [(r.id, r.number, r.title) for r in tables["main_group"].orderBy("id").collect()] == [(1, "1", "Engine"), (2, "2", "Body")]
    sections = {r.number: r for r in tables["section"].collect()}
    assert sections["101-000"].body_line == ["TURBO"] and sections["201-000"].body_style == ["COUPE"] and sections["101-005"].body_line is None
    found = {r.part_number: r for r in tables["part"].collect()}
    assert found["997"].parent_id == found["996"].id and found["997"].applicability == "PR:480 | PR:481" and found["998"].parent_id is None
    blank = dict.fromkeys(VEHICLE.names)
    cars = [(1, blank | {"line": "TURBO", "body": "COUPE", "prCodes": ["480", "481"], "year": 2007}), (2, blank | {"line": "GT2", "body": "CABRIO", "prCodes": ["1"], "year": 2008})]
    vehicles = spark.createDataFrame([(i, tuple(v[n] for n in VEHICLE.names)) for i, v in cars], f"vehicle_id int, vehicle {VEHICLE.simpleString()}")
    got = {(r.vehicle_id, r.part_id.id) for r in ingest.parts_of_vehicles(tables, vehicles).collect()}
    names = {r.id: r.part_number for r in found.values()}
    assert {(v, names[p]) for v, p in got} == {(1, "996"), (1, "997"), (1, "998"), (1, "901"), (2, "900")}


def test_to_ingest(spark):
    wanted = spark.createDataFrame([("/x/a.pdf",), ("/x/b.pdf",)], "path string")
    assert [r.catalog_id for r in ingest.to_ingest(wanted, spark.createDataFrame([("a",)], "catalog_id string")).collect()] == ["b"]


def test_truth(spark):
    kind = "section_id string, num string, x0 int, y0 int, x1 int, y1 int, source string"
    held = spark.createDataFrame([("1", "5", 0, 0, 10, 10, "vision"), ("1", "6", 50, 50, 60, 60, "human")], kind)
    found = spark.createDataFrame([("1", "5", 1, 1, 11, 11, "human"), ("1", "7", 80, 80, 90, 90, "agent")], kind)
    expected = spark.createDataFrame([("1", ["5", "6", "8"]), ("2", [])], "section_id string, tokens array<string>")
    boxes, tiers = truth.merged(held, found, expected)
    assert sorted((r.num, r.source) for r in boxes.collect()) == [("5", "human"), ("6", "human"), ("7", "agent")]
    assert {r.section_id: (r.tier, r.absent) for r in tiers.collect()} == {"1": ("partial", ["8"]), "2": ("gold", [])}
    sections = spark.createDataFrame([("1", "partial", True), ("x", "partial", False)], "section_id string, tier string, verified boolean")
    assert [(r.section_id, r.tier) for r in truth.saved(sections).collect()] == [("1", "gold")]
    numbered = boxes.withColumn("idx", F.col("x0"))
    row = truth.work_list(sections, numbered, expected, spark.createDataFrame([("1", "f")], "section_id string, flag string")).where("section_id = '1'").first()
    assert (row.missing, row.disputed, row.flags, row.overlaps) == (["8"], ["7"], 1, 0)
    assert truth.review_queue(sections, boxes).first().numbers == ["5", "6", "7"]
    candidates = spark.createDataFrame([("1", 1, 2, 2, 8, 8), ("1", 2, 30, 30, 34, 34)], "section_id string, candidate_id int, x0 int, y0 int, x1 int, y1 int")
    labelled = truth.labelled_candidates(candidates, boxes.withColumn("box_id", F.col("x0").cast("long"))).withColumn("catalog", F.lit("c"))
    assert sorted((r.label, r.num, r.origin) for r in labelled.collect() if r.label) == [(1, "5", "candidate"), (1, "6", "box"), (1, "7", "box")]
    b = truth.balance(labelled).first()
    assert (b.negative_share, round(b.candidate_recall, 6)) == (0.5, 0.333333)
    assert truth.error_shapes(candidates.withColumn("kind", F.lit("fp"))).first().median_w == 5.0
    df, seen = truth.metered(candidates, "m", n=F.count(F.lit(1)))
    df.collect()
    assert seen.get == {"n": 2}


def test_vocabularies_meet_distinct_strings_only(spark):
    """Rows of titles don't carry their catalogue's words; titles of catalogues that aren't known drop out."""
    titles = spark.createDataFrame([("a", 1, "CARRERA 9700"), ("a", 2, "CARRERA 9700"), ("b", 1, "CARRERA TURBO 9700"), ("a", 3, None), ("x", 1, "CARRERA"), (None, 1, "CARRERA")], "catalog_id string, section_id int, model_scope string")
    words = spark.createDataFrame([("a", "lines", "CARRERA"), ("b", "lines", "TURBO"), ("b", "engines", "9700"), ("a", "engines", "9700")], "catalog_id string, kind string, word string")
    catalogs = spark.createDataFrame([("a", "modern", 2007), ("b", "modern", 2007)], "catalog_id string, dialect string, pivot int")
    found = ingest.title_facets(titles, words, catalogs)
    assert {(r.catalog_id, r.section_id): (r.body_line, r.engine_code) for r in found.collect()} == {("a", 1): (["CARRERA"], ["9700"]), ("a", 2): (["CARRERA"], ["9700"]), ("b", 1): (None, None)}
    assert "first(words" not in found._jdf.queryExecution().optimizedPlan().toString()
