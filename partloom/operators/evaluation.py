"""Box overlap, greedy matching, suppression, precision and recall, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..sources.tables import settled, tasks_for
from .ranges import box_pairs

# How far each source of a box is trusted.
SOURCE_RANK = {"human": 3, "agent": 2, "vision": 1}


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return F.when(a.isNotNull() & b.isNotNull(), w * h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without an intersection, null for a null box."""
    o = overlap(a, b)
    return F.when(o > 0, o / (area(a) + area(b) - o)).otherwise(F.when(o.isNotNull(), F.lit(0.0)))


def contained_fraction(a: Column, b: Column) -> Column:
    return F.when(area(a) > 0, overlap(a, b) / area(a)).otherwise(F.lit(0.0))


def source_rank(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in SOURCE_RANK.items() for x in p]), c), F.lit(0))


def greedy_matches(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one matches from scored pairs (keys, v, gi, pi): best first, ties by larger gi, then pi.

    A diagram's pairs are bounded by its callouts, so a group is one array.
    """
    best = F.sort_array(F.collect_list(F.struct("v", "gi", "pi")), asc=False)
    empty = F.array().cast("array<struct<v:double,gi:bigint,pi:bigint>>")
    take = lambda acc, p: F.when(F.exists(acc, lambda m: (m["gi"] == p["gi"]) | (m["pi"] == p["pi"])), acc).otherwise(F.concat(acc, F.array(p)))
    folded = pairs.select(*keys, F.col("v").cast("double").alias("v"), F.col("gi").cast("long").alias("gi"), F.col("pi").cast("long").alias("pi")).groupBy(*keys).agg(F.aggregate(best, empty, take).alias("m"))
    return folded.select(*keys, F.explode("m").alias("m")).select(*keys, "m.v", "m.gi", "m.pi")


def suppressed(boxes: DataFrame, keys: list[str], same: float = 0.3, other: float = 0.5) -> DataFrame:
    """Boxes kept in order of (rank descending, idx): a later one goes if it overlaps a kept one too much.

    `boxes` has keys, idx, rank, num, x0..y1; the same number tolerates less overlap.
    """
    kind = "struct<r:int,idx:bigint,num:string,x0:int,y0:int,x1:int,y1:int>"
    row = F.struct((-F.col("rank")).cast("int").alias("r"), F.col("idx").cast("long").alias("idx"), F.col("num").cast("string").alias("num"), *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])
    ordered = F.sort_array(F.collect_list(row))
    hit = lambda k, b: F.when(k["num"] == b["num"], iou(k, b) > same).otherwise(iou(k, b) > other)
    take = lambda acc, b: F.when(F.exists(acc, lambda k: hit(k, b)), acc).otherwise(F.concat(acc, F.array(b)))
    return boxes.groupBy(*keys).agg(F.aggregate(ordered, F.array().cast(f"array<{kind}>"), take).alias("k")).select(*keys, F.explode("k").alias("k")).select(*keys, "k.idx", "k.num", "k.x0", "k.y0", "k.x1", "k.y1")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def precision_recall(df: DataFrame, tp: str = "tp", n_pred: str = "n_pred", n_true: str = "n_true") -> DataFrame:
    """Micro precision, recall and F1 over rows of counts."""
    t = df.agg(F.sum(tp).alias("tp"), F.sum(n_pred).alias("n_pred"), F.sum(n_true).alias("n_true"))
    t = t.withColumn("precision", ratio(F.col("tp"), F.col("n_pred"))).withColumn("recall", ratio(F.col("tp"), F.col("n_true")))
    return t.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


#: Ranges of scores that running sums are worked out in.
SCORE_RANGES = 64


def pr_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(score, hits, tp, fp, precision, recall) at each distinct score, from the highest down.

    Scores are summed first.  Running sums go within ranges of scores, cut at
    approximate quantiles, and the ranges' totals, at most SCORE_RANGES rows, are
    added: no task sees all scores.
    """
    per = df.groupBy(F.col(score).alias("score")).agg(F.sum(label).alias("hits"), F.count(F.lit(1)).alias("n"))
    cuts = per.agg(F.percentile_approx("score", [k / SCORE_RANGES for k in range(1, SCORE_RANGES)], 10_000).alias("c")).first().c or []
    per = per.withColumn("_r", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c > F.col("score"))) if cuts else F.lit(0))
    down = Window.partitionBy("_r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = per.groupBy("_r").agg(F.sum("hits").alias("_p"), F.sum("n").alias("_n"))
    totals = totals.select("_r", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_tp"), F.coalesce(F.sum(F.col("_n") - F.col("_p")).over(before), F.lit(0)).alias("_fp"), F.sum("_p").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("positives"))
    run = per.select("_r", "score", "hits", F.sum("hits").over(down).alias("tp"), F.sum(F.col("n") - F.col("hits")).over(down).alias("fp"))
    both = run.join(F.broadcast(totals), "_r").withColumn("tp", F.col("tp") + F.col("_tp")).withColumn("fp", F.col("fp") + F.col("_fp"))
    return both.select("score", "hits", "tp", "fp", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("positives")).alias("recall"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Sum of precision times the recall that each score adds."""
    added = F.when(F.col("tp") > 0, F.col("recall") * F.col("hits") / F.col("tp")).otherwise(F.lit(0.0))
    return curve.agg(F.sum(added * F.col("precision")).alias("average_precision"))


def best_f1(curve: DataFrame) -> DataFrame:
    """The point of highest F1; the highest score among ties."""
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return curve.withColumn("f1", f1).agg(F.max(F.struct("f1", "score", "precision", "recall")).alias("m")).select("m.*")


def operating_points(curve: DataFrame, floors: list[float]) -> DataFrame:
    """For each recall floor the highest score that reaches it."""
    spark = curve.sparkSession
    wanted = spark.createDataFrame([(f,) for f in floors], "floor double")
    return curve.join(F.broadcast(wanted), F.col("recall") >= F.col("floor")).groupBy("floor").agg(F.max(F.struct("score", "precision", "recall")).alias("m")).select("floor", "m.score", "m.precision", "m.recall")


def reconciled(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, status, missing, extra): CLEAN where the sets agree, HUMAN where not, NO-EXPECT without expectations."""
    a, b = found.select(key, F.col("tokens").alias("_found")), expected.select(key, F.col("tokens").alias("_want"))
    none = F.array().cast("array<string>")
    both = a.join(b, key, "full_outer").withColumn("_f", F.coalesce("_found", none)).withColumn("_w", F.coalesce("_want", none))
    miss, extra = F.array_sort(F.array_except("_w", "_f")), F.array_sort(F.array_except("_f", "_w"))
    status = F.when(F.size("_w") == 0, F.lit("NO-EXPECT")).when((F.size(miss) == 0) & (F.size(extra) == 0), F.lit("CLEAN")).otherwise(F.lit("HUMAN"))
    return both.select(key, status.alias("status"), miss.alias("missing"), extra.alias("extra"))


def upper_median(values: Column) -> Column:
    """The element at half the length of the sorted array: the larger middle one of an even number."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def grouped_upper_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): each group's `upper_median`, from running counts of its distinct values; null where it has none."""
    counted = df.groupBy(*keys, value).agg(F.count(value).alias("_n"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    marked = counted.withColumn("_upto", upto).withColumn("_half", F.floor(F.sum("_n").over(group) / 2))
    return marked.groupBy(*keys).agg(F.min(F.when(F.col("_upto") > F.col("_half"), F.col(value))).alias(out))


def split_groups(df: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """Whole groups to `val` by a hash of the group, about `share` of them."""
    h = F.conv(F.substring(F.md5(F.concat_ws("/", F.col(group).cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long") % 10_000
    return df.withColumn("split", F.when(h < int(share * 10_000), F.lit("val")).otherwise(F.lit("train")))


def tasks_of(*boxes: DataFrame) -> int:
    """Tasks for the rows of all; they are counted, so they should be tables."""
    return tasks_for(boxes[0].sparkSession, sum(b.count() for b in boxes))


def near_pairs(truth: DataFrame, predicted: DataFrame, key: str, least: float) -> DataFrame:
    """(key, gi, pi, same, v): boxes of both sides that overlap by at least `least` (over 0), and whether their numbers agree."""
    a, b = F.col("a"), F.col("b")
    return box_pairs(truth, predicted, key, tasks=tasks_of(truth, predicted)).select(a[key].alias(key), a["idx"].alias("gi"), b["idx"].alias("pi"), (a["num"] == b["num"]).alias("same"), iou(a, b).cast("double").alias("v")).where(F.col("v") >= least)


def error_kinds(truth: DataFrame, predicted: DataFrame, key: str, least: float = 0.3) -> DataFrame:
    """(key, hit, misread, missed, spurious) counts: a box is misread if only boxes of other numbers overlap it enough."""
    near = settled(near_pairs(truth, predicted, key, least), "near")
    row = lambda df, side, idx, n, same: df.select(F.col(key), F.lit(side).alias("side"), F.col(idx).alias("idx"), F.lit(n).alias("n"), same.alias("same"))
    none = F.lit(None).cast("boolean")
    rows = reduce(DataFrame.unionByName, [row(truth, True, "idx", 1, none), row(predicted, False, "idx", 1, none), row(near, True, "gi", 0, F.col("same")), row(near, False, "pi", 0, F.lit(True))])
    # dealt by the box, so one exchange serves all four and a diagram is spread
    boxes = rows.repartition(tasks_of(truth, predicted, near, near), key, "side", "idx").groupBy(key, "side", "idx").agg(F.sum("n").alias("n"), F.max("same").alias("same"))
    of = lambda test, name: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(name)
    side, same = F.col("side"), F.col("same")
    return boxes.groupBy(key).agg(of(side & same, "hit"), of(side & ~same, "misread"), of(side & same.isNull(), "missed"), of(~side & same.isNull(), "spurious"))


def attribution(d: Column, marks: dict[str, Column]) -> Column:
    """The first cause that holds, in the given order; `d` where the finding was right."""
    out = F.when(d, F.lit("TP"))
    for name, holds in marks.items():
        out = out.when(holds, F.lit(name))
    return out.otherwise(F.lit("NODBG"))


def causes(truth: DataFrame, predicted: DataFrame, candidates: DataFrame, key: str, least: float = 0.3) -> DataFrame:
    """(key, idx, cause) of each true box, by how far the detector came with it.

    `TP`: matched with its number; `D`: matched, but read as another; else `A`: no
    candidate touches it, `B`: some do and none was `accepted`, `C`: an accepted one
    does and nothing matched; `NODBG`: the detector left nothing of this `key`.
    """
    near = settled(near_pairs(truth, predicted, key, least), "near")
    of = lambda pairs, name: pairs.select(key, F.col("gi").alias("idx"), F.lit(True).alias(name))
    touched = box_pairs(truth, candidates, key, tasks=tasks_of(truth, candidates)).groupBy(F.col(f"a.{key}").alias(key), F.col("a.idx").alias("idx")).agg(F.max("b.accepted").alias("accepted"))
    seen = predicted.select(key).unionByName(candidates.select(key)).distinct().withColumn("seen", F.lit(True))
    told = truth.select(key, F.col("idx").cast("long").alias("idx")).repartition(tasks_of(truth, predicted), key, "idx").join(of(greedy_matches(near.where("same"), [key]), "read"), [key, "idx"], "left").join(of(greedy_matches(near, [key]), "matched"), [key, "idx"], "left").join(touched, [key, "idx"], "left").join(seen, key, "left")
    cause = F.when(F.col("seen").isNull(), "NODBG").when(F.col("read"), "TP").when(F.col("matched"), "D").when(F.col("accepted").isNull(), "A").when(F.col("accepted"), "C").otherwise("B")
    return told.select(key, "idx", cause.alias("cause"))


def cause_counts(caused: DataFrame) -> DataFrame:
    """(cause, n, dominant) of causes(): the most frequent of A, B and C, the first of equals, is dominant."""
    counts = caused.groupBy("cause").agg(F.count(F.lit(1)).alias("n"))
    most = counts.where(F.col("cause").isin("A", "B", "C")).orderBy(F.desc("n"), "cause").limit(1).select("cause", F.lit(True).alias("dominant"))
    return counts.join(most, "cause", "left").withColumn("dominant", F.coalesce("dominant", F.lit(False)))


def first_examples(truth: DataFrame, predicted: DataFrame, key: str, least: float = 0.3, most: int = 40) -> DataFrame:
    """(kind, key, idx, num, read_num): the first `most` missed, misread and spurious boxes, in order of key and idx.

    A true box without a match is misread if any prediction touches it, as the
    number of the first that does; else it is missed.  A prediction without a
    match that touches no true box is spurious.
    """
    a, b = F.col("a"), F.col("b")
    touching = settled(box_pairs(truth, predicted, key, tasks=tasks_of(truth, predicted)).select(a[key].alias(key), a["idx"].alias("gi"), b["idx"].alias("pi"), b["num"].alias("read_num"), (a["num"] == b["num"]).alias("same"), iou(a, b).cast("double").alias("v")), "touching")
    hits = greedy_matches(touching.where(F.col("same") & (F.col("v") >= least)), [key])
    first = touching.groupBy(key, F.col("gi").alias("idx")).agg(F.min_by("read_num", "pi").alias("read_num"))
    tasks = tasks_of(truth, predicted)
    free = truth.repartition(tasks, key, "idx").join(hits.select(key, F.col("gi").alias("idx")), [key, "idx"], "left_anti").join(first, [key, "idx"], "left")
    lone = predicted.repartition(tasks, key, "idx").join(touching.select(key, F.col("pi").alias("idx")).distinct(), [key, "idx"], "left_anti").withColumn("read_num", F.lit(None).cast("string"))
    shown = lambda df, kind: df.orderBy(key, "idx").limit(most).select(F.lit(kind).alias("kind"), key, "idx", "num", "read_num")
    return shown(free.where("read_num IS NULL"), "missed").unionByName(shown(free.where("read_num IS NOT NULL"), "misread")).unionByName(shown(lone, "spurious"))


def label_status(expected: Column, first: Column, second: Column) -> Column:
    """ok if either reader agrees, unread if neither read, partial if one read a part of it, else mismatch."""
    read = lambda c: F.coalesce(c, F.lit(""))
    part = lambda c: (read(c) != "") & expected.contains(read(c))
    return F.when((read(first) == expected) | (read(second) == expected), F.lit("ok")).when((read(first) == "") & (read(second) == ""), F.lit("unread")).when(part(first) | part(second), F.lit("partial")).otherwise(F.lit("mismatch"))


def tightened(before: Column, after: Column, least_iou: float = 0.1, most_growth: float = 3.0) -> Column:
    """The tightened box, unless there is none, it moved away or it grew too much."""
    good = after.isNotNull() & (iou(before, after) >= least_iou) & (area(after) <= most_growth * area(before))
    return F.when(good, after).otherwise(before)


def detection_metrics(truth: DataFrame, predicted: DataFrame, key: str, least: float = 0.3) -> DataFrame:
    """Micro precision, recall and F1 of numbered boxes, recall of boxes whatever their number, and mean overlap of the matches.

    Boxes are matched one to one within `key`, the best overlaps first; a pair
    counts as found with a number of its own only if the numbers agree.
    """
    near = settled(near_pairs(truth, predicted, key, least), "near")
    none = F.lit(0)
    tagged = lambda df, tp, found, v, n_true, n_pred: df.select(*[F.lit(x).cast("long").alias(n) if isinstance(x, int) else x.alias(n) for n, x in (("tp", tp), ("found", found), ("v", v), ("n_true", n_true), ("n_pred", n_pred))])
    rows = [
        tagged(greedy_matches(near.where("same"), [key]), 1, 0, F.col("v"), 0, 0), tagged(greedy_matches(near, [key]), 0, 1, none.cast("double"), 0, 0),
        tagged(truth, 0, 0, none.cast("double"), 1, 0), tagged(predicted, 0, 0, none.cast("double"), 0, 1),
    ]
    both = reduce(DataFrame.unionByName, rows).agg(*[F.coalesce(F.sum(c), none).alias(c) for c in ("tp", "found", "v", "n_true", "n_pred")])
    p, r = ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), F.col("n_true"))
    return both.select("tp", "n_pred", "n_true", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(F.col("found"), F.col("n_true")).alias("detection_recall"), ratio(F.col("v"), F.col("tp")).alias("mean_iou"))


def number_counts(found: DataFrame, expected: DataFrame, key: str, num: str = "num") -> DataFrame:
    """(key, repeats, extras): numbers found more than once, and found numbers that nobody expects, in natural order."""
    counted = found.groupBy(key, num).agg(F.count(F.lit(1)).alias("_n")).join(expected.select(key, F.explode("tokens").alias(num), F.lit(True).alias("_known")).distinct(), [key, num], "left")
    told = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct(natural_key(F.col(num)).alias("k"), F.col(num).alias("v"))))), lambda x: x["v"])
    return counted.groupBy(key).agg(told(F.col("_n") > 1).alias("repeats"), told(F.col("_known").isNull()).alias("extras"))


def top_confusions(truth: DataFrame, predicted: DataFrame, key: str, least: float = 0.3, most: int = 20) -> DataFrame:
    """(true_num, read_num, n): the most frequent pairs of a box's number and another one read where it stands."""
    a, b = F.col("a.num"), F.col("b.num")
    wrong = box_pairs(truth, predicted, key, tasks=tasks_of(truth, predicted)).where((a != b) & (iou(F.col("a"), F.col("b")) >= least))
    return wrong.groupBy(a.alias("true_num"), b.alias("read_num")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "true_num", "read_num").limit(most)


def ordered_sample(df: DataFrame, key: str, most: int, seed: int = 1) -> DataFrame:
    """At most `most` rows, the first by a hash of their key: the same ones on every run."""
    return df.withColumn("_luck", F.xxhash64(F.lit(seed), F.col(key).cast("string"))).orderBy("_luck", key).limit(most).drop("_luck")
