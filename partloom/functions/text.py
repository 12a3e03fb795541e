"""Column expressions over printed catalogue text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def normal_token(c: Column) -> Column:
    """Trimmed upper case, with the separator inside GT numbers folded."""
    return F.regexp_replace(F.upper(F.trim(c)), r"\bGT[-_]([0-9])", "GT$1")


def normal_engine(c: Column) -> Column:
    """An engine code without the M that only vehicle exports print."""
    t = normal_token(c)
    return F.when(t.rlike(r"^M[0-9]{4}[A-Z]?\z"), F.substring(t, 2, 100)).otherwise(t)


def normal_market(c: Column) -> Column:
    """A market code without the dots that pad it."""
    return F.regexp_replace(normal_token(c), r"\.+\z", "")


def leading_int(c: Column) -> Column:
    """The integer at the start of a string; null if there is none or it is 0."""
    return F.nullif(F.regexp_extract(c, r"^\s*([0-9]+)", 1).try_cast("int"), F.lit(0))


def expand_two_digit(year: Column, pivot: Column) -> Column:
    """A two-digit year in the pivot's century, or the next if it lies before the pivot; null without either."""
    y = year.try_cast("int")
    full = (F.floor(pivot / 100) * 100 + y).cast("int")
    return F.when(pivot.isNull() | (pivot == 0) | y.isNull(), None).otherwise(F.when(full < pivot, full + 100).otherwise(full))


def expand_year(year: Column, pivot: Column) -> Column:
    """As printed from 100 on or without a pivot, else the first year from the pivot on that ends so."""
    y = year.try_cast("int")
    base = (F.floor(pivot / 100) * 100 + y).cast("int")
    return F.when(y.isNull() | (y >= 100) | pivot.isNull(), y).otherwise(base + F.when(base < pivot, F.ceil((pivot - base) / 100) * 100).otherwise(0)).cast("int")


def range_end(start: Column, end: Column) -> Column:
    """A printed end with the leading segments of its start where it has fewer segments."""
    a, b = F.split(F.trim(start), r"\s+"), F.split(F.trim(end), r"\s+")
    lead = F.slice(a, F.lit(1), F.greatest(F.size(a) - F.size(b), F.lit(0)))
    return F.when(blank(end).isNull(), None).otherwise(F.array_join(F.concat(lead, b), " "))


def tech_data(c: Column) -> Column:
    """Cylinders, displacement and power of a summary's technical column, each null where not printed."""
    cylinders = blank(F.regexp_extract(c, r"([0-9]+)\s*ZYL", 1)).cast("int")
    litres = F.regexp_replace(blank(F.regexp_extract(c, r"([0-9,]+)\s*L\b", 1)), "^([^,]*),", "$1.")
    power = blank(F.regexp_extract(c, r"([0-9]+)\s*/?\s*KW", 1)).cast("int")
    return F.struct(cylinders.alias("cylinders"), litres.alias("displacement_l"), power.alias("power_kw"))


def undotted(c: Column) -> Column:
    """A code without its leading letter and its first dot."""
    return F.regexp_replace(F.regexp_replace(c, "^[A-Z]", ""), r"^([^.]*)\.", "$1")


def position_token(c: Column) -> Column:
    """A printed position without the parentheses of parts that differ from the picture."""
    return F.regexp_replace(c, "[()]", "")


def natural_key(c: Column) -> Column:
    """Sort key of position tokens such as 3/2: their numbers in order."""
    return F.transform(F.split(c, "/"), lambda p: F.coalesce(p.try_cast("int"), F.lit(2147483647)))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def half_even(c: Column) -> Column:
    return F.bround(c).cast("long")


def market_list(c: Column) -> Column:
    """The known market codes of the first parenthesised list; ROW for the rest of the world."""
    # The market codes that range remarks name.
    known = F.array(*[F.lit(x) for x in ("USA", "CDN", "MEX", "BR", "CN", "KOR", "ROW")])
    inner = F.trim(F.regexp_extract(c, r"\(([^)]*)\)", 1))
    codes = F.filter(F.transform(F.split(inner, r"[,\s]+"), F.upper), lambda x: F.array_contains(known, x))
    return F.when(inner.rlike("(?i)rest of the world"), F.array(F.lit("ROW"))).otherwise(codes)


def variant_name(c: Column) -> Column:
    """A remark without its parenthesised list and what follows a dash or bullet."""
    return F.trim(F.regexp_replace(F.split(F.regexp_replace(c, r"^([^(]*?)\s*\([^)]*\)\s*", "$1 "), "[—–•�]")[0], r"\s+", " "))
