"""Ordered folds and box joins that spread one large catalogue, user or diagram over tasks."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from partloom.operators import evaluation, ordered, ranges, truth


def test_segments_give_the_windows_states(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), k, r.choice([None, 1, 2, 3]), r.random() < 0.2) for k in range(900)]
    df = spark.createDataFrame(rows, "p string, k int, v int, opens boolean").withColumn("seg", F.floor(F.col("k") / 37))
    upto = Window.partitionBy("p").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("p").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    for own, w in ((True, upto), (False, before)):
        got = ordered.scanned(df, {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, ["p"], ["k"], "seg", own)
        want = df.select("k", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.max("v").over(w).alias("m"), F.last("v", True).over(w).alias("l"))
        assert sorted(map(tuple, got.select("k", "s", "m", "l").collect())) == sorted(map(tuple, want.collect()))
    for f in (lambda **s: ordered.latched(df, F.col("opens"), ["p"], ["k"], **s), lambda **s: ordered.carried(df, F.col("v"), ["p"], ["k"], "last", **s), lambda **s: ordered.records(df.where("p IS NOT NULL"), F.col("opens"), F.col("k").cast("string"), ["p"], ["k"], **s)):
        assert sorted(map(str, f(segment="seg").select(*sorted(f().columns)).collect())) == sorted(map(str, f().select(*sorted(f().columns)).collect()))


def test_one_catalogue_of_a_million_rows_is_spread(spark):
    """No window or group of the fold sees more than a segment, and none a whole catalogue's rows."""
    df = spark.range(1_000_000).select(F.lit("c").alias("p"), F.col("id").alias("k"), F.when(F.col("id") % 1000 == 7, F.col("id")).alias("v"), F.floor(F.col("id") / 10_000).alias("seg")).repartition(8)
    out = ordered.scanned(df, {"l": ("last", F.col("v")), "s": ("sum", F.lit(1))}, ["p"], ["k"], "seg")
    spread = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 700_000
    assert out.where("k >= 7 AND l <> (k - 7) div 1000 * 1000 + 7 OR k < 7 AND l IS NOT NULL OR s <> k + 1").count() == 0


def boxes(spark, r, n, diagrams, wide, size):
    rows = []
    for k in range(n):
        x, y = r.uniform(-50, wide), r.uniform(-50, wide)
        rows.append((r.choice(diagrams), k, str(k % 3), int(x), int(y), int(x) + r.choice([0, 1, size, size, wide // 2]), int(y) + r.choice([1, size, size])))
    return spark.createDataFrame(rows + [("d0", n, "1", None, 1, 2, 2)], "d string, idx long, num string, x0 int, y0 int, x1 int, y1 int")


def test_every_pair_that_shares_an_area_once(spark):
    r = random.Random(5)
    a, b = boxes(spark, r, 150, ["d0", "d1", "d2"], 3000, 200), boxes(spark, r, 150, ["d0", "d1", "x"], 3000, 200)
    want = {(p.idx, q.idx) for p in a.collect() for q in b.collect() if p.d == q.d and None not in (*p, *q) and min(p.x1, q.x1) > max(p.x0, q.x0) and min(p.y1, q.y1) > max(p.y0, q.y0)}
    for cell in (64, 512, 100_000):
        got = [(x.a.idx, x.b.idx) for x in ranges.box_pairs(a, b, "d", cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_a_diagram_of_very_many_boxes(spark):
    """20,000 boxes on one page: 200 million pairs of the page, of which only those in common cells are looked at."""
    r = np.random.default_rng(1)
    at = r.integers(0, 9900, (20_000, 2))
    df = spark.createDataFrame([("d", int(k), "1", int(x), int(y), int(x) + 60, int(y) + 40) for k, (x, y) in enumerate(at)], "section_id string, idx long, num string, x0 int, y0 int, x1 int, y1 int")
    order = np.argsort(at[:, 0])
    x, y = at[order].T
    want = 0
    for i in range(len(x)):
        j = np.searchsorted(x, x[i] + 60)
        w, h = 60 - (x[i + 1 : j] - x[i]), 40 - np.abs(y[i + 1 : j] - y[i])
        o = np.maximum(w, 0) * np.maximum(h, 0)
        want += int((o / (4800 - o) > 0.5).sum())
    assert truth.overlapping_pairs(df).collect()[0].overlaps == want > 0
    plan = truth.overlapping_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "_x" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_detection_metrics_without_cross_joins(spark):
    r = random.Random(8)
    a, b = boxes(spark, r, 60, ["d0", "d1"], 800, 150), boxes(spark, r, 60, ["d0", "d1"], 800, 150)
    out = evaluation.detection_metrics(a, b, "d")
    plan = out._jdf.queryExecution().executedPlan().toString()
    (m,) = out.collect()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and m.n_true == m.n_pred == 61 and 0 < m.tp <= 61 and m.recall == m.tp / 61
    (none,) = evaluation.detection_metrics(a.limit(0), b.limit(0), "d").collect()
    assert (none.tp, none.precision, none.mean_iou) == (0, 0.0, 0.0)


def test_front_rows_of_one_page_are_dealt(spark, monkeypatch):
    """40,000 rows of one page in one partition: several files of about equal size, as each file is a task of the readers."""
    from partloom.operators import vpages

    kept, settled = {}, vpages.settled
    monkeypatch.setattr(vpages, "settled", lambda df, name: kept.setdefault(name, settled(df, name)))
    own = spark.range(3, 40_003, 1, 1).select(F.lit("c").alias("catalog_id"), F.lit(2).alias("page"), F.col("id").cast("int").alias("row_idx"), F.array(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("x")).alias("tokens"))
    heads = spark.createDataFrame([("c", 1, 0, ["Optional Equipment"]), ("c", 1, 1, ["NR", "Description"])], own.schema).coalesce(1)
    vpages.parse(own.unionByName(heads).coalesce(1))
    files = [r["count"] for r in kept["front_rows"].groupBy(F.input_file_name()).count().collect()]
    assert sum(files) == 40_000 and len(files) >= 3 and max(files) < 20_000
