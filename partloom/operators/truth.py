"""Ground truth of callouts: merging, saving, work lists, patch labels, balance and error shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import iou, source_rank, suppressed
from .ranges import best_containment, box_pairs

BOX = ("x0", "y0", "x1", "y1")


def valid_ids(df: DataFrame, key: str = "section_id") -> DataFrame:
    """Rows whose id is a number; a malformed id is left out."""
    return df.where(F.col(key).cast("string").rlike(r"^[0-9]+\z"))


def saved(sections: DataFrame) -> DataFrame:
    """Edited sections as they are kept: a verified one is gold."""
    return valid_ids(sections).withColumn("tier", F.when(F.col("verified"), F.lit("gold")).otherwise(F.col("tier")))


def merged(held: DataFrame, found: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Held and newly found boxes without repeats, the more trusted source first, and each section's tier.

    Boxes have section_id, num, x0..y1, source; `expected` section_id, tokens.  A
    section is gold if it has every expected number, else partial.
    """
    both = held.select("section_id", "num", *BOX, "source").unionByName(found.select("section_id", "num", *BOX, "source"))
    ranked = both.withColumn("rank", source_rank(F.col("source"))).withColumn("idx", F.row_number().over(Window.partitionBy("section_id").orderBy(F.desc("rank"), "num", *BOX)))
    kept = suppressed(ranked, ["section_id"])
    boxes = kept.join(ranked.select("section_id", F.col("idx").cast("long").alias("idx"), "source"), ["section_id", "idx"]).drop("idx")
    numbers = boxes.groupBy("section_id").agg(F.collect_set("num").alias("numbers"))
    lack = F.size(F.array_except("tokens", F.coalesce("numbers", F.array().cast("array<string>"))))
    tiers = expected.join(numbers, "section_id", "left").select("section_id", F.when(lack == 0, F.lit("gold")).otherwise(F.lit("partial")).alias("tier"), F.array_sort(F.array_except("tokens", F.coalesce("numbers", F.array().cast("array<string>")))).alias("absent"))
    return boxes, tiers


def overlapping_pairs(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """(section_id, overlaps): pairs of a section's boxes, of any numbers, that overlap more than `least`."""
    hit = (F.col("a.idx") < F.col("b.idx")) & (iou(F.col("a"), F.col("b")) > least)
    return box_pairs(boxes, boxes, "section_id").where(hit).groupBy(F.col("a.section_id").alias("section_id")).agg(F.count(F.lit(1)).alias("overlaps"))


def work_list(sections: DataFrame, boxes: DataFrame, expected: DataFrame, flags: DataFrame) -> DataFrame:
    """Sections with what is wrong: missing and disputed numbers, flags, overlapping boxes; the worst first."""
    none = F.array().cast("array<string>")
    found = boxes.groupBy("section_id").agg(F.collect_set("num").alias("_have"))
    out = sections.join(found, "section_id", "left").join(expected.select("section_id", F.col("tokens").alias("_want")), "section_id", "left").join(flags.groupBy("section_id").agg(F.count(F.lit(1)).alias("_flags")), "section_id", "left").join(overlapping_pairs(boxes), "section_id", "left")
    have, want = F.coalesce("_have", none), F.coalesce("_want", none)
    out = out.withColumn("missing", F.array_sort(F.array_except(want, have))).withColumn("disputed", F.array_sort(F.array_except(have, want))).withColumn("flags", F.coalesce("_flags", F.lit(0))).withColumn("overlaps", F.coalesce("overlaps", F.lit(0))).drop("_have", "_want", "_flags")
    return out.orderBy(F.desc(F.size("missing") + F.size("disputed") + F.col("flags") + F.col("overlaps")), "section_id")


def labelled_candidates(candidates: DataFrame, boxes: DataFrame) -> DataFrame:
    """Candidates with label 1 and their box's number where a box holds them, else 0; and a label-1 row for each box without candidate.

    Candidates have section_id, candidate_id, x0..y1, boxes section_id, box_id, num, x0..y1.
    """
    best = best_containment(candidates, boxes, "section_id").join(boxes.select("section_id", "box_id", "num"), ["section_id", "box_id"])
    own = candidates.join(best.select("section_id", "candidate_id", "box_id", "num"), ["section_id", "candidate_id"], "left").select("section_id", "candidate_id", *BOX, F.col("num").isNotNull().cast("int").alias("label"), "num", F.lit("candidate").alias("origin"))
    lost = boxes.join(best.select("section_id", "box_id").distinct(), ["section_id", "box_id"], "left_anti").select("section_id", F.lit(None).cast(candidates.schema["candidate_id"].dataType).alias("candidate_id"), *BOX, F.lit(1).alias("label"), "num", F.lit("box").alias("origin"))
    return own.unionByName(lost)


def balance(labelled: DataFrame, key: str = "catalog") -> DataFrame:
    """Share of negatives among candidates, and the share of boxes that some candidate found."""
    of = F.col("origin") == "candidate"
    return labelled.groupBy(key).agg((F.count_if(of & (F.col("label") == 0)) / F.greatest(F.count_if(of), F.lit(1))).alias("negative_share"), (F.count_if(of & (F.col("label") == 1)) / F.greatest(F.count_if(F.col("label") == 1), F.lit(1))).alias("candidate_recall"))


def error_shapes(errors: DataFrame, narrow: float = 0.45) -> DataFrame:
    """(kind, n, median_w, median_h, narrow) of wrong candidates."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return errors.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.median(w).alias("median_w"), F.median(h).alias("median_h"), F.count_if(w < narrow * h).alias("narrow"))


def review_queue(sections: DataFrame, boxes: DataFrame, tier: str = "partial") -> DataFrame:
    """(section_id, numbers, boxes) of the sections of a tier that still need eyes."""
    held = F.array_sort(F.collect_list(F.struct("num", *BOX)))
    own = boxes.groupBy("section_id").agg(held.alias("boxes"), F.array_sort(F.collect_set("num")).alias("numbers"))
    return sections.where(F.col("tier") == tier).join(own, "section_id", "left").orderBy("section_id")


def metered(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, object]:
    """The frame and an observation of its named measures, filled when it is computed."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *[c.alias(n) for n, c in measures.items()]), seen


