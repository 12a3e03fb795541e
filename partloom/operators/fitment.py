"""Whether a parsed scope admits a vehicle: one Column for each facet, and their conjunction.

Absent facts never exclude: a blank vehicle field admits, and so does an empty
list of alternatives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.serials import serial_admits, serial_key
from ..functions.text import normal_engine, normal_token


def facet_admits(group: Column, value: Column) -> Column:
    v = normal_token(value)
    wanted = (F.size(group["any"]) <= 0) | F.array_contains(group["any"], v)
    return value.isNull() | (v == "") | (~F.coalesce(F.array_contains(group["not"], v), F.lit(False)) & F.coalesce(wanted, F.lit(True)))


def trim_admits(group: Column, value: Column) -> Column:
    """As facet_admits, but an RS 4.0 is also an RS."""
    v = normal_token(value)
    fits = lambda t: (t == v) | ((t == "RS") & (v == "RS 4.0"))
    return value.isNull() | (v == "") | (~F.exists(group["not"], fits) & ((F.size(group["any"]) <= 0) | F.exists(group["any"], fits)))


def options_admit(groups: Column, codes: Column) -> Column:
    """Every slot needs one of its codes and none of its barred ones; unknown equipment admits."""
    slot = lambda g: ~F.exists(g["not"], lambda c: F.array_contains(codes, c)) & ((F.size(g["any"]) <= 0) | F.arrays_overlap(g["any"], codes))
    return codes.isNull() | (F.size(codes) <= 0) | F.forall(groups, slot)


def years_admit(ranges: Column, year: Column) -> Column:
    """Some window holds the year; windows' markets are not looked at, year 0 or null admits."""
    inside = lambda r: (r["from"].isNull() | (year >= r["from"])) & (r["to"].isNull() | (year <= r["to"]))
    return year.isNull() | (year == 0) | (F.size(ranges) <= 0) | F.exists(ranges, inside)


def scope_admits(scope: Column, vehicle: Column) -> Column:
    """All facets; `vehicle` has line, body, drive, trim, engine, gearbox, market, year, prCodes, and for each serial its number and block."""
    tests = [facet_admits(scope[g], vehicle[f]) for g, f in (("lines", "line"), ("bodies", "body"), ("drive", "drive"))]
    tests += [trim_admits(scope["trim"], vehicle["trim"]), facet_admits(scope["engines"], normal_engine(vehicle["engine"]))]
    tests += [facet_admits(scope["gearboxes"], vehicle["gearbox"]), facet_admits(scope["markets"], vehicle["market"])]
    tests += [options_admit(scope["prGroups"], vehicle["prCodes"]), years_admit(scope["mjRanges"], vehicle["year"])]
    for facet, number in (("chassis", "chassis"), ("engineNums", "engineNum"), ("transmissionNums", "transmissionNum")):
        block = vehicle["chassisBlock" if number == "chassis" else f"{number}Block" if number == "engineNum" else "transmissionBlock"]
        tests.append(serial_admits(scope[facet], serial_key(vehicle[number]), serial_key(block["from"]), serial_key(block["to"])))
    return reduce(lambda a, b: a & b, tests)
