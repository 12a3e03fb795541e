"""JSON, outline, manifest, archive and batch sources and sinks."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "id string, file string, title string, model string, dialect string, year_pivot int, bytes long, vinRanges array<struct<from:string,to:string,model_year:int,remark:string>>"
OUTLINE = "catalog_id string, outline array<struct<title:string,page:int,items:array<struct<title:string,page:int,items:array<struct<title:string,page:int>>>>>>"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Positioned page text, blank items left out."""
    kinds = "catalog_id string, section_id string, page int, page_height double, item_idx int, str string, x double, y double"
    return spark.read.schema(kinds).json(path).where("trim(str) <> ''")


def outline_sections(df: DataFrame) -> DataFrame:
    """(catalog_id, seq, group_number, group_title, number, title, diagram_page) of outlines three levels deep; entries without a page go."""
    groups = df.select("catalog_id", F.posexplode("outline").alias("_g", "g")).select("catalog_id", "_g", "g")
    sections = groups.select("catalog_id", "_g", F.col("g.title").alias("_group"), F.posexplode("g.items").alias("_s", "s"))
    split = lambda c, i: F.regexp_extract(c, r"^\s*([0-9][0-9-]*)?\s*(.*?)\s*$", i)
    rows = sections.where("s.page IS NOT NULL").select(
        "catalog_id", F.row_number().over(_in_order()).alias("seq"), split("_group", 1).alias("group_number"), split("_group", 2).alias("group_title"), split("s.title", 1).alias("number"), split("s.title", 2).alias("title"), F.col("s.page").alias("diagram_page")
    )
    return rows


def _in_order():
    from pyspark.sql import Window

    return Window.partitionBy("catalog_id").orderBy("_g", "_s")


def resolved_pages(entries: DataFrame, destinations: DataFrame) -> DataFrame:
    """Entries (dest) with the 1-based page of their named destination (dest, page_index); null where there is none."""
    return entries.join(destinations.select("dest", (F.col("page_index") + 1).alias("page")), "dest", "left")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's rows; none where it is missing or unreadable."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A few hundred catalogues as one JSON array, sorted by id; the file appears whole."""
    rows = [json.loads(r) for r in manifest.orderBy("id").toJSON().toLocalIterator()]
    save_whole(path, json.dumps(rows, ensure_ascii=False))


def salvaged(text: Column, backup: Column, kind: str, default: Column) -> Column:
    """A parsed JSON column: the text's, else its backup's, else the default."""
    parsed = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, kind))
    return F.coalesce(parsed(text), parsed(backup), default)


def leading_object(text: str) -> dict | None:
    """The JSON object a damaged file begins with."""
    try:
        found, _ = json.JSONDecoder().raw_decode(text.lstrip())
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def save_whole(path: str, text: str) -> None:
    """Write beside the target, keep the old file as .bak, then take its place."""
    if os.path.exists(path):
        shutil.copyfile(path, f"{path}.bak")
    handle, draft = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(draft, path)


def truth_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """(section_id, number, tier, source, x0..y1) from maps of sections with their callouts."""
    box = "struct<num:string,x0:int,y0:int,x1:int,y1:int,conf:int,source:string>"
    kind = f"map<string,struct<number:string,tier:string,callouts:array<{box}>,verified:boolean>>"
    sections = df.select(F.explode(F.from_json(column, kind)).alias("section_id", "s")).where(F.col("section_id").rlike("^[0-9]+$"))
    boxes = sections.select("section_id", F.col("s.number").alias("section_number"), F.when(F.col("s.verified"), F.lit("gold")).otherwise(F.col("s.tier")).alias("tier"), F.explode("s.callouts").alias("c"))
    return boxes.select("section_id", "section_number", "tier", "c.*")


def export_archive(folder: str, target: str) -> None:
    """All `<id>/...` files below a folder, stored as they are: they are compressed already."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_STORED) as z:
        for base, _, names in sorted(os.walk(folder)):
            for n in sorted(names):
                full = os.path.join(base, n)
                z.write(full, os.path.relpath(full, folder))


def import_archive(source: str, folder: str, name: str = "catalog.sqlite") -> list[str]:
    """Ids of the `<id>/<name>` members taken in; anything else in the archive is left alone."""
    taken = []
    with zipfile.ZipFile(source) as z:
        for member in z.namelist():
            parts = member.split("/")
            if len(parts) == 2 and parts[1] == name and parts[0] not in ("", ".", ".."):
                z.extract(member, folder)
                taken.append(parts[0])
    return taken


def install(df: DataFrame, path: str) -> None:
    """Write a catalogue's table unless it is there."""
    df.write.mode("ignore").parquet(path)


def write_catalog(tables: dict[str, DataFrame], root: str) -> None:
    """Tables as Parquet by catalogue; only the catalogues written are replaced."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy("catalog_id") if "catalog_id" in df.columns else writer).parquet(f"{root}/{name}")


def delete_catalog(spark: SparkSession, root: str, catalog: str, tables: list[str]) -> None:
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/catalog_id={catalog}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def page_text(items: DataFrame, query: str, pages: int = 50, head: int = 2000) -> DataFrame:
    """(catalog_id, page, text) of the first `pages` pages that hold the query, whatever the case, cut to `head` characters."""
    lines = F.array_sort(F.collect_list(F.struct("item_idx", "str")))
    text = F.array_join(F.transform(lines, lambda x: x["str"]), " ")
    found = items.groupBy("catalog_id", "page").agg(text.alias("text")).where(F.lower("text").contains(query.lower()))
    return found.orderBy("catalog_id", "page").limit(pages).withColumn("text", F.substring("text", 1, head))
