"""Vehicle identification numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import market_list, variant_name

# Model-year characters, and catalogue families by type digits.
MODEL_YEARS = {"3": 2003, "4": 2004, "5": 2005, "6": 2006, "7": 2007, "8": 2008, "9": 2009, "A": 2010, "B": 2011, "C": 2012, "D": 2013, "E": 2014, "F": 2015, "G": 2016, "H": 2017}
FAMILIES = {"99": "997", "98": "987", "9P": "cayenne"}


def _looked_up(table: dict, c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def decode_vin(c: Column) -> Column:
    """struct(ok, vin, family, type, model_year, plant, chassis); all but ok null for what is no VIN."""
    vin = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    ok = vin.rlike(r"^[A-HJ-NPR-Z0-9]{17}\z")
    kind, year = F.substring(vin, 7, 2), F.substring(vin, 10, 1)
    family = _looked_up(FAMILIES, kind)
    wide = family == "cayenne"
    plant = F.when(wide, F.substring(vin, 11, 2)).when(family.isNotNull(), F.substring(vin, 11, 1))
    chassis = F.when(wide, F.concat(kind, year, F.substring(vin, 11, 7))).when(family.isNotNull(), F.concat(kind, F.lit("-"), year, F.substring(vin, 11, 7)))
    own = lambda x: F.when(ok, x)
    return F.struct(ok.alias("ok"), own(vin).alias("vin"), own(family).alias("family"), own(kind).alias("type"), own(_looked_up(MODEL_YEARS, year)).alias("model_year"), own(plant).alias("plant"), own(chassis).alias("chassis"))


def _last_known(tokens: Column, known: Column) -> Column:
    return F.coalesce(F.get(F.reverse(F.filter(tokens, lambda t: F.array_contains(known, t))), 0), F.lit(""))


def remark_tokens(c: Column) -> Column:
    return F.filter(F.split(F.upper(variant_name(c)), r"[\s/]+"), lambda t: t != "")


def variant_facets(remark: Column, named_bodies: Column, lines: Column, bodies: Column) -> Column:
    """struct(line, body, market) that a matched range says of the car.

    The last known line word and body word count.  Without a body, the one body
    that no range of the catalogue names (`named_bodies` lists those named) is
    meant, if there is exactly one.  A market counts if it is the only one.
    """
    tokens = remark_tokens(remark)
    body, unnamed, markets = _last_known(tokens, bodies), F.array_except(bodies, named_bodies), market_list(remark)
    silent = F.when((F.size(named_bodies) > 0) & (F.size(unnamed) == 1), unnamed[0]).otherwise(F.lit(""))
    single = F.when((F.size(markets) == 1) & (F.get(markets, 0) != "ROW"), F.get(markets, 0)).otherwise(F.lit(""))
    return F.struct(_last_known(tokens, lines).alias("line"), F.when(body != "", body).otherwise(silent).alias("body"), single.alias("market"))
