"""Vehicle documents: load, upsert, remove, and patches of the marks on parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META = "map<string,struct<ok:boolean,notes:string>>"


def patched_meta(old: Column, patch: Column) -> Column:
    """Marks with a patch merged over them, key by key and field by field; marks that say nothing go.

    A null field of the patch leaves the mark's field as it was.
    """
    empty = F.create_map().cast(META)
    a, b = F.coalesce(old, empty), F.coalesce(patch, empty)
    both = F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(y["ok"], x["ok"], F.lit(False)).alias("ok"), F.trim(F.coalesce(y["notes"], x["notes"], F.lit(""))).alias("notes")))
    touched = F.map_filter(both, lambda k, v: ~F.map_contains_key(b, k) | v["ok"] | (v["notes"] != ""))
    return F.map_zip_with(touched, F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), lambda _, x, y: F.coalesce(y, x))


def upsert(held: DataFrame, incoming: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Incoming documents merged over held ones by id, field by field; others are inserted with the defaults.

    A null incoming field, or one it lacks, keeps what is held.  An update stamps
    updatedAt; an insert stamps both times and starts with empty marks.
    """
    own = incoming.where(F.col(key).isNotNull()).select(*[F.col(c).alias(f"_new_{c}") for c in incoming.columns])
    both = held.join(own, F.col(key) == F.col(f"_new_{key}"), "full_outer")
    fresh, changed = F.col(key).isNull(), F.col(f"_new_{key}").isNotNull()

    def field(c: str) -> Column:
        value = F.coalesce(f"_new_{c}", c) if c in incoming.columns else F.col(c)
        if c == "updatedAt":
            return F.when(changed, now).otherwise(F.col(c))
        if c == "createdAt":
            return F.when(fresh, now).otherwise(value)
        if c == "partMeta":
            return F.coalesce(value, F.create_map().cast(META))
        return value

    return both.select(*[field(c).alias(c) for c in held.columns])


def remove(held: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return held.join(ids.select(key), key, "left_anti")


def set_part_meta(held: DataFrame, patches: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Patches (id, patch) of marks, applied to their vehicles."""
    p = patches.select(F.col(key).alias("_key"), F.col("patch").alias("_patch"))
    both = held.join(p, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    return both.withColumn("partMeta", F.when(hit, patched_meta(F.col("partMeta"), F.col("_patch"))).otherwise(F.col("partMeta"))).withColumn("updatedAt", F.when(hit, now).otherwise(F.col("updatedAt"))).drop("_key", "_patch")


GARAGE_FIELDS = "id string, nickname string, partMeta map<string,struct<ok:boolean,notes:string>>, savedParts array<string>, createdAt string, updatedAt string"


def load(texts: DataFrame, fields: str = GARAGE_FIELDS) -> DataFrame:
    """Vehicles of garage documents (owner, text); a text that can't be read is an empty garage.

    A vehicle without an id gets one that depends on its owner and place alone,
    so every read gives it again.
    """
    document = F.from_json("text", f"version int, vehicles array<struct<{', '.join(f.replace(' ', ':', 1) for f in _split_fields(fields))}>>")
    rows = texts.select("owner", F.posexplode(F.coalesce(document["vehicles"], F.array())).alias("place", "v")).select("owner", "place", "v.*")
    return rows.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.sha2(F.concat_ws("/", "owner", F.col("place").cast("string")), 256)))


def _split_fields(fields: str) -> list[str]:
    """Top-level fields of a DDL list."""
    out, depth = [""], 0
    for c in fields:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def save(vehicles: DataFrame, version: int = 1) -> DataFrame:
    """(owner, text): each owner's garage as one JSON document, vehicles in their order."""
    columns = [c for c in vehicles.columns if c not in ("owner", "place")]
    rows = F.array_sort(F.collect_list(F.struct("place", F.to_json(F.struct(*columns)).alias("v"))))
    listed_ = vehicles.groupBy("owner").agg(F.array_join(F.transform(rows, lambda r: r["v"]), ",").alias("_rows"))
    return listed_.select("owner", F.concat(F.lit(f'{{"version":{version},"vehicles":['), "_rows", F.lit("]}")).alias("text"))


def listed(vehicles: DataFrame) -> DataFrame:
    """What a list of vehicles shows: ids and nicknames in their order, with the number of marks."""
    return vehicles.select("owner", "place", "id", "nickname", F.coalesce(F.size("partMeta"), F.lit(0)).cast("int").alias("marks")).orderBy("owner", "place")


def get(vehicles: DataFrame, key_value: str, key: str = "id") -> DataFrame:
    return vehicles.where(F.col(key) == key_value)


def set_one_part_meta(held: DataFrame, vehicle_id: str, part: str, ok: bool | None, notes: str | None, now: Column, key: str = "id") -> DataFrame:
    """One mark of one vehicle, patched."""
    patch = held.sparkSession.createDataFrame([(vehicle_id, {part: (ok, notes)})], f"{key} string, patch {META}")
    return set_part_meta(held, patch, now, key)


def coalesced_writes(events: DataFrame, key: str, at: str, gap: str = "600 milliseconds") -> DataFrame:
    """(key, first, last, n): edits of a document that no pause of `gap` parts become one write."""
    session = F.session_window(at, gap)
    return events.groupBy(key, session.alias("_s")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last")).select(key, F.col("_s.start").alias("first"), "last", "n")
