import numpy as np
from pyspark.sql import functions as F

from partloom.operators import garage, imaging


def test_detection_from_picture_to_numbers(spark):
    """Two digits side by side are one number; a mark that the classifier turns down is none; a debug run shows why."""
    ink = np.zeros((400, 400), np.uint8)
    for x in (50, 61):
        ink[100:112, x : x + 7] = 1
    ink[200:212, 300:308] = 1
    ink[300:312, 100:108] = 1
    diagrams = spark.createDataFrame([(1, bytearray(imaging.g4_encode(ink)), 400, 400)], "section_id long, diagram binary, width int, height int")
    places = {(50, 100): ("1", 90), (61, 100): ("7", 80), (300, 200): ("0", 99)}
    reads = spark.createDataFrame([(1, x, y, x + (7 if y == 100 else 8), y + 12, t, c, "", 0) for (x, y), (t, c) in places.items()], "section_id long, x0 int, y0 int, x1 int, y1 int, text_a string, conf_a int, text_b string, conf_b int")
    scorer = lambda: lambda x: np.where(x.mean((1, 2, 3)) < 2, 0.9, 0.0)
    got = imaging.detected(diagrams, reads, scorer).collect()
    assert [(r.num, r.x0, r.y0, r.x1, r.y1) for r in got] == [("17", 1250, 2500, 1700, 2800)]
    shown = imaging.detected(diagrams, reads, lambda: lambda x: np.zeros(len(x)), debug=True)
    assert shown.count() == 4 and shown.where("accepted").count() == 0


def test_pixels():
    bits = np.array([[1, 0, 1], [0, 1, 1]], np.uint8)
    told = imaging.native_rgba(np.packbits(bits, axis=1).tobytes(), 3, 2, "1bpp")
    assert told.shape == (2, 3, 4) and (told[:, :, 0] == bits * 255).all() and (told[:, :, 3] == 255).all()
    assert imaging.native_rgba(bytes(range(6)), 2, 1, "rgb").tolist() == [[[0, 1, 2, 255], [3, 4, 5, 255]]]
    grey = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert imaging.resampled(grey, 2, 2).tolist() == [[3, 5], [11, 13]] and (imaging.resampled(grey, 4, 4) == grey).all()
    cut = imaging.region(grey, (2, 2, 6, 4), 1)
    assert cut.shape == (4, 6) and cut[1:3, 1:3].tolist() == [[10, 11], [14, 15]] and (cut[0] == 255).all()
    line = np.zeros((50, 50, 3), np.uint8)
    assert imaging.picture_codec(line) == "g4" and imaging.picture_codec(np.full((50, 50, 3), 128, np.uint8)) == "raster"


def test_garage_documents(spark):
    rows = [("a", 0, None, "first", {"k": (True, "x")}), ("a", 1, "v2", "second", None), ("b", 0, "v3", "other", None)]
    held = spark.createDataFrame(rows, "owner string, place int, id string, nickname string, partMeta map<string,struct<ok:boolean,notes:string>>")
    texts = garage.save(held).unionByName(spark.createDataFrame([("c", "{not json"), ("d", None)], "owner string, text string"))
    read = garage.load(texts)
    got = {(r.owner, r.place): (r.id, r.nickname, r.marks) for r in garage.listed(read).collect()}
    again = {(r.owner, r.place): r.id for r in garage.load(texts).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("b", 0)} and got["a", 1] == ("v2", "second", 0) and got["a", 0][1:] == ("first", 1)
    assert len(got["a", 0][0]) == 64 and again["a", 0] == got["a", 0][0]
    assert [r.nickname for r in garage.get(read, "v3").collect()] == ["other"]
    now = F.lit("now")
    patched = garage.set_one_part_meta(read, "v2", "p", True, "ok ", now)
    assert [r.partMeta["p"].notes for r in garage.get(patched, "v2").collect()] == ["ok"]
    edits = spark.createDataFrame([("a", "2024-01-01 00:00:00.0"), ("a", "2024-01-01 00:00:00.4"), ("a", "2024-01-01 00:00:02.0")], "id string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted(r.n for r in garage.coalesced_writes(edits, "id", "at").collect()) == [1, 2]


def test_tasks_grow_with_the_rows(spark):
    """Boxes are dealt over more tasks when there are more of them, and each task's rows stay as many."""
    from partloom.operators import ranges
    from partloom.sources.tables import TASK_ROWS, tasks_for

    assert tasks_for(spark, 0) == 1
    for rows in (1 << 22, 1 << 28):
        assert rows / tasks_for(spark, rows) <= TASK_ROWS
    boxes = spark.createDataFrame([(1, 1, "a", 0, 0, 20, 20), (1, 2, "b", 5, 5, 25, 25)], "d long, idx long, num string, x0 int, y0 int, x1 int, y1 int")
    met = ranges.box_pairs(boxes, boxes, "d", tasks=7)
    assert met.rdd.getNumPartitions() == 7 and met.count() == 4
