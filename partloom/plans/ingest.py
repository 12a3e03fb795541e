"""From outlines, front pages and positioned items to the tables of catalogues; from vehicles to their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scope as language
from ..functions.text import normal_token
from ..operators import applicability, directory, parts, profiles, ranges, vpages
from ..sources.documents import outline_sections
from ..sources.tables import settled, tasks_for

_FACETS = {"engine_code": "engines", "gearbox_code": "gearboxes", "body_line": "lines", "body_style": "bodies", "drive_code": "drive", "trim_code": "trim"}
_TYPED = {
    "pr_code": {"code": "string", "description": "string"},
    "sales_type": {c: "string" for c in ("sales_term", "description", "mount_from", "mount_to", "remark")},
    "vin_range": {"model_year": "int", **{c: "string" for c in ("start_date", "vin_from", "vin_to", "remark")}},
    "engine_code": {"ec": "string", "displacement_l": "string", "power_kw": "int", "power_hp": "int", "cylinders": "int", **{c: "string" for c in ("mount_from", "mount_to", "remark")}},
    "transmission_code": {c: "string" for c in ("tc", "type_code", "mount_from", "mount_to", "remark")},
    "engine_number_range": {"number_from": "string", "number_to": "string", "model_year": "int", "vehicle_type": "string", "engine_type": "string"},
    "transmission_number_range": {"number_from": "string", "number_to": "string", "model_year": "int", "vehicle_type": "string", "gearbox_type": "string"},
}


def vocabulary(tables: dict[str, DataFrame]) -> DataFrame:
    """(catalog_id, kind, word): the words that a catalogue's own tables make known."""
    code = lambda name, column, kind: tables[name].select("catalog_id", F.lit(kind).alias("kind"), F.col(column).alias("word"))
    out = code("engine_code", "ec", "engines").unionByName(code("transmission_code", "tc", "gearboxes")).unionByName(code("pr_code", "code", "options"))
    for name, column in (("sales_type", "description"), ("vin_range", "remark"), ("engine_number_range", "vehicle_type"), ("transmission_number_range", "vehicle_type")):
        out = out.unionByName(language.line_words(tables[name], column).select("catalog_id", F.lit("lines").alias("kind"), "word"))
    return out.where("word IS NOT NULL").distinct()


def vocabularies(words: DataFrame, catalogs: DataFrame) -> DataFrame:
    """(catalog_id, words): each catalogue's vocabulary as one struct."""
    held = lambda kind: F.collect_set(F.when(F.col("kind") == kind, normal_token(F.col("word")))).alias(kind)
    listed = words.groupBy("catalog_id").agg(*[held(k) for k in ("engines", "gearboxes", "options", "lines")])
    none = F.array().cast("array<string>")
    lists = [F.coalesce(k, none).alias(k) for k in ("engines", "gearboxes", "options", "lines")]
    return catalogs.join(listed, "catalog_id", "left").select("catalog_id", F.struct(*lists, F.coalesce("dialect", F.lit("modern")).alias("dialect"), "pivot").cast(language.VOCABULARY).alias("words"))


def title_facets(titles: DataFrame, words: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Facet values that every variant of a section's title states; null where some variant is silent.

    A variant begins at each token that names a line or a body.
    """
    key = ["catalog_id", "section_id"]
    known = vocabularies(words, catalogs)
    tokens = F.filter(F.split(F.coalesce("model_scope", F.lit("")), r"\s+"), lambda t: t != "")
    tasks = tasks_for(titles.sparkSession, 4 * titles.count())
    # vocabularies meet distinct strings only; a row that has one with it weighs many times what it says
    told = titles.select(*key, F.posexplode(tokens).alias("pos", "token"))
    told = language.with_scope(told, "token", "read", known).where("read IS NOT NULL")
    begins = (F.size("read.lines.any") > 0) | (F.size("read.bodies.any") > 0)
    told = told.select(*key, "pos", "token", begins.alias("begins")).repartition(tasks, *key)
    upto = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # tokens before the first that begins a variant are one too
    told = told.withColumn("variant", F.sum((F.col("begins") & (F.col("pos") > 0)).cast("int")).over(upto))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))
    variants = told.groupBy(*key, "variant").agg(F.array_join(F.transform(ordered, lambda t: t["token"]), " ").alias("text"))
    read = language.with_scope(variants, "text", "read", known).select(*key, "variant", "read").repartition(tasks, *key)
    stated = lambda group: F.transform(F.array_sort(F.collect_list(F.struct("variant", F.col(f"read.{group}.any").alias("v")))), lambda x: x["v"])
    every = lambda group: F.min(F.size(F.col(f"read.{group}.any"))) > 0
    return read.groupBy(*key).agg(*[F.when(every(g), F.array_distinct(F.flatten(stated(g)))).alias(c) for c, g in _FACETS.items()])


def build(outlines: DataFrame, front_rows: DataFrame, items: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """All text tables of catalogues.

    `outlines` (catalog_id, outline), `front_rows` (catalog_id, page, row_idx,
    tokens), `items` (catalog_id, page, page_height, item_idx, str, x, y), `pages`
    (catalog_id, page_count).  The work is dealt by (catalogue, section); ids
    follow print order.
    """
    front = settled(vpages.parse(front_rows), "front")
    out = {name: vpages.table_of(front, name, kinds) for name, kinds in _TYPED.items()}
    catalogs = vpages.table_of(front, "catalog", {"model": "string", "dialect": "string", "pivot": "int", "life_end": "int"}).join(pages, "catalog_id")
    out["catalog"] = catalogs.select(F.col("catalog_id").alias("id"), "model", "page_count", "dialect", F.col("pivot").alias("year_pivot"))
    listed = outline_sections(outlines).join(pages, "catalog_id")
    out["main_group"] = directory.main_groups(listed.select("catalog_id", F.col("group_number").alias("number"), F.col("group_title").alias("title"), "seq"))
    spans = directory.page_spans(listed, F.col("page_count"), ["catalog_id"])
    own = items.join(spans.select("catalog_id", "page", F.col("seq").cast("string").alias("section_id")), ["catalog_id", "page"]).join(catalogs.select("catalog_id", "dialect", "pivot", "life_end"), "catalog_id")
    rows = settled(parts.extract(own), "parts")
    titles = rows.where("kind = 'title'").select("catalog_id", "section_id", F.col("description").alias("_title"), F.col("remarks").alias("_remark"), F.col("model").alias("_model"), "model_scope", F.col("applicability").alias("_scope"))
    facets = settled(title_facets(titles, settled(vocabulary(out), "words"), catalogs), "facets")
    groups = out["main_group"].select("catalog_id", F.col("number").alias("group_number"), F.col("id").alias("main_group_id"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    sections = listed.withColumn("section_id", F.col("seq").cast("string")).join(groups, ["catalog_id", "group_number"]).join(titles, ["catalog_id", "section_id"], "left").join(facets, ["catalog_id", "section_id"], "left")
    out["section"] = sections.select(F.col("seq").cast("long").alias("id"), F.col("main_group_id").cast("long").alias("main_group_id"), "catalog_id", "number", F.coalesce(blank("_title"), "title").alias("title"), (F.col("diagram_page") + 1).alias("parts_page"), "diagram_page", blank("_remark").alias("title_remark"), blank("_model").alias("title_model"), blank("_scope").alias("applicability"), *_FACETS)
    order = Window.partitionBy("catalog_id").orderBy(F.col("section_id").cast("long"), "block", "child")
    numbered = rows.where("kind = 'part'").withColumn("id", F.row_number().over(order).cast("long"))
    heads = numbered.where("child = 0").select("catalog_id", "section_id", "block", F.col("id").alias("parent_id"))
    out["part"] = numbered.join(heads, ["catalog_id", "section_id", "block"]).select("id", F.col("section_id").cast("long").alias("section_id"), "catalog_id", F.when(F.col("child") > 0, F.col("parent_id")).alias("parent_id"), "position", "part_number", "colour_code", "description", "quantity", "remarks", "applicability")
    return out


def to_ingest(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Catalogue files not read yet, by file stem."""
    stems = wanted.withColumn("catalog_id", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*\z", ""))
    return directory.missing(stems, held, "catalog_id")


def vehicle_ranges(vehicles: DataFrame, vin_range: DataFrame) -> DataFrame:
    """Every range that holds each vehicle's chassis."""
    return ranges.serial_range_join(vehicles, vin_range, "chassis")


def parts_of_vehicles(tables: dict[str, DataFrame], vehicles: DataFrame) -> DataFrame:
    """(vehicle_id, part_id): parts whose section and inherited scope admit the vehicle."""
    none = F.array().cast("array<string>")
    part = applicability.with_inherited_scope(tables["part"].withColumn("id", F.struct("catalog_id", "id")).withColumn("parent_id", F.when(F.col("parent_id").isNotNull(), F.struct("catalog_id", "parent_id").cast("struct<catalog_id:string,id:bigint>"))))
    part = settled(language.with_scope(part, "effective_scope", "scope"), "part_scopes")
    section = settled(language.with_scope(tables["section"].withColumn("_s", F.coalesce("applicability", F.lit(""))), "_s", "section_scope"), "section_scopes")
    for column, group in _FACETS.items():
        stated = F.struct(F.array_union(F.col(f"section_scope.{group}.any"), F.coalesce(column, none)).alias("any"), F.col(f"section_scope.{group}.not").alias("not"))
        section = section.withColumn("section_scope", F.col("section_scope").withField(group, stated))
    own = section.select("catalog_id", F.col("id").alias("section_id"), "section_scope")
    return profiles.fitting_parts(part.select("catalog_id", "section_id", F.col("id").alias("part_id"), "scope").join(own, ["catalog_id", "section_id"]), vehicles)
