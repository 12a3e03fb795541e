"""Scope segments of rows: kinds, inheritance between parents and variants, remark tokens, title variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, expand_two_digit

SEPARATOR = " | "


def joined_segments(segments: Column) -> Column:
    return F.array_join(F.filter(segments, lambda s: s != ""), SEPARATOR)


def segments_of(scope: Column) -> Column:
    return F.filter(F.split(F.coalesce(scope, F.lit("")), r" [|] "), lambda s: s != "")


def segment_kind(s: Column) -> Column:
    """year, chassis or engineNum for a breakpoint of that kind, else facet; calendar dates and gearbox serials are facets."""
    return F.when(s.rlike(r"\bMJ\s*[0-9]{4}"), F.lit("year")).when(s.rlike(r"^F(\s|>>)"), F.lit("chassis")).when(s.rlike(r"^M(\s|>>)"), F.lit("engineNum")).otherwise(F.lit("facet"))


def child_scope(own: Column, parent: Column) -> Column:
    """A variant's full scope: its parent's segments, but for breakpoint kinds it states itself, then its own; '' without own."""
    mine = segments_of(own)
    kinds = F.filter(F.transform(mine, segment_kind), lambda k: k != "facet")
    kept = F.filter(segments_of(parent), lambda s: ~F.array_contains(kinds, segment_kind(s)))
    return F.when(F.size(mine) == 0, F.lit("")).otherwise(F.array_join(F.concat(kept, mine), SEPARATOR))


def inherited(child: Column, parent: Column) -> Column:
    """What a reader takes as scope: the row's own unless blank, else its parent's."""
    return F.coalesce(blank(child), blank(parent))


def with_inherited_scope(parts: DataFrame, key: str = "id", parent: str = "parent_id", scope: str = "applicability") -> DataFrame:
    above = parts.select(F.col(key).alias("_above"), F.col(scope).alias("_scope"))
    return parts.join(above, F.col(parent) == F.col("_above"), "left").withColumn("effective_scope", inherited(F.col(scope), F.col("_scope"))).drop("_above", "_scope")


def remark_scope_tokens(remark: Column, pivot: Column, life_end: Column, dialect: Column) -> Column:
    """Markets in parentheses and two-digit windows inside the model's life that the old dialect prints as remarks."""
    end = F.coalesce(life_end, pivot + 20)

    def in_life(two: Column) -> Column:
        y = expand_two_digit(two, pivot)
        return (two == "") | F.coalesce((y >= pivot) & (y <= end), F.lit(False))

    window = r"^([0-9]{2})?-([0-9]{2})?\z"
    first, second = (lambda t: F.regexp_extract(t, window, 1)), (lambda t: F.regexp_extract(t, window, 2))
    keep = lambda t: t.rlike(r"^-?\([A-Z]{1,4}\)\z") | (t.rlike(window) & (t != "-") & in_life(first(t)) & in_life(second(t)))
    tokens = F.filter(F.split(F.coalesce(remark, F.lit("")), r"\s+"), keep)
    return F.when(dialect == "old", tokens).otherwise(F.array().cast("array<string>"))


def glued_list(tokens: Column) -> Column:
    """Wrapped Model column: a token after a trailing comma continues the list, others are set apart by a blank."""
    return F.aggregate(tokens, F.lit(""), lambda acc, t: F.when((acc == "") | acc.endswith(","), F.concat(acc, t)).otherwise(F.concat_ws(" ", acc, t)))


def printed_scope(text: Column) -> Column:
    """Whether a description line scopes its row instead of describing it."""
    return text.rlike(r"^[FM]>>\s*[0-9]") | (text.rlike(r"^[A-Z]{1,3}\s") & (text.rlike(r"\bMJ\b") | text.contains(">>")))


def printed_model_scope(text: Column) -> Column:
    return text.rlike("^PR:") | text.rlike(r"\bMJ\b") | text.contains(">>")


def title_variants(tokens: Column, is_head: Column) -> Column:
    """Groups of a title's tokens; a new one starts at each head (line or body word) after the first token.

    `is_head` is an array of booleans beside `tokens`.
    """
    pairs = F.arrays_zip(tokens.alias("t"), is_head.alias("h"))
    start = F.array().cast("array<array<string>>")
    step = lambda acc, p: F.when((F.size(acc) == 0) | p["h"], F.concat(acc, F.array(F.array(p["t"])))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.array(p["t"])))))
    return F.aggregate(pairs, start, step)


def invariant_values(variants: Column) -> Column:
    """Union, in order, of the variants' values if every variant states some; else null."""
    every = (F.size(variants) > 0) & F.forall(variants, lambda v: F.size(v) > 0)
    return F.when(every, F.array_join(F.array_distinct(F.flatten(variants)), ","))
