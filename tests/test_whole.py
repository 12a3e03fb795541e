"""Queries over whole tables: every row takes part."""

import pytest
from conftest import SMALL, same_rows

from partloom.plans import registry


@pytest.mark.parametrize("name", ["t31_iou", "t32_greedy", "t33_prf", "t34_error_taxonomy", "t39_nms", "t56_best_containment"])
def test_boxes_of_every_order(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SMALL), duck.sql(registry.ORACLES[name]))


def test_every_line_is_a_box(spark):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert registry.QUERIES["t33_prf"](spark, SMALL).first().n_true == lines


def test_spans_run_to_the_next_section_of_every_customer(spark):
    from partloom.operators import directory

    pages = {}
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    for r in orders.collect():
        pages.setdefault(r.o_custkey, []).append(r.o_orderkey)
    want = {}
    for customer, starts in pages.items():
        starts.sort()
        for a, b in zip(starts, [*starts[1:], starts[-1] + 5], strict=True):
            want |= {(customer, a, p): 1 for p in range(a + 1, b)}
    sections = orders.selectExpr("o_custkey", "o_orderkey AS diagram_page")
    got = [tuple(r) for r in directory.page_spans(sections, sections.diagram_page + 4, ["o_custkey"]).select("o_custkey", "diagram_page", "page").collect()]
    assert sorted(got) == sorted(want)
    assert registry.QUERIES["t17_page_span"](spark, SMALL).select("o_custkey").distinct().count() == orders.select("o_custkey").distinct().count()


@pytest.mark.parametrize("name", ["t42_upper_median", "t54_label_status"])
def test_every_line_counts(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SMALL), duck.sql(registry.ORACLES[name]))


def test_median_reads_all_lines_and_collects_no_group(spark, tmp_path):
    rows = [(k, 1, 1, i, float(q), 1.0, 0.0, 0.0, flag, "O") for i, (k, flag, q) in enumerate([(50, "A", 1), (51, "A", 9), (52, "A", 9), (50, "N", 4), (1, "N", 7), (3, "R", 5)])]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([*rows, (4, 1, 1, 9, None, 1.0, 0.0, 0.0, "A", "O"), (4, 1, 1, 9, None, 1.0, 0.0, 0.0, "X", "O")], names).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = registry.QUERIES["t42_upper_median"](spark, str(tmp_path))
    assert {r.l_returnflag: r.m for r in out.collect()} == {"A": 9.0, "N": 7.0, "R": 5.0, "X": None}
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()


def test_every_page_is_coded_whole(spark, tmp_path):
    import numpy as np

    from partloom.operators.imaging import g4_encode

    html = {1: "<p>" + "ab1 \u00e9\U0001f600" * 200, 2: "short", 3: "", 4: None, 5: "x" * 768, 6: "y" * 768 + "odd tail"}
    spark.createDataFrame([(k, "u", v) for k, v in html.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.bytes, r.same) for r in registry.QUERIES["t47_g4_roundtrip"](spark, str(tmp_path)).collect()}

    def size(text):
        ink = [ord(c) % 2 for c in text]
        ink += [0] * (-len(ink) % 48)
        return len(g4_encode(np.array(ink, np.uint8).reshape(-1, 48)))

    assert got == {k: (None if v is None else size(v), True) for k, v in html.items()}


def test_every_page_has_a_row(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert registry.QUERIES["t47_g4_roundtrip"](spark, SMALL).select("page_id").exceptAll(pages.select("page_id")).isEmpty()
    assert registry.QUERIES["t47_g4_roundtrip"](spark, SMALL).count() == pages.count()


def test_callouts_of_every_part(spark, duck):
    same_rows(registry.QUERIES["t51_callout_part"](spark, SMALL), duck.sql(registry.ORACLES["t51_callout_part"]))


def test_pictures_are_coded_and_read_back_by_one_worker_of_a_task(spark):
    plan = registry.QUERIES["t47_g4_roundtrip"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 0 and plan.count("MapInArrow") == 1
