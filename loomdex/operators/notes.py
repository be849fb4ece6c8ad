"""Notes with a JSON header in a comment, digests and their validity, and title maps of exports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_lines, is_ai_note
from ..session import importable

#: The comment that opens a note: any tool's name, then one JSON object; and the fields of that header.
HEADER = r"(?s)^<!-- [A-Za-z][A-Za-z0-9_-]*\n(\{.*?\})\n-->\n?"
TAG = "loomdex"
#: Fixed value: a line of an export's list of files.
EXPORT_LINE = r"^\s*(.+?)\s+(?:——|--)\s+(\S+\.[A-Za-z0-9]+)\s*$"
META = "struct<type:string,createdAt:string,author:string,cwd:string,sourcePath:string,sourceHash:string,sourceTitle:string,coverage:string,scope:string>"
SCOPE = "struct<kind:string,projects:array<string>>"


def parse_scope(raw: Column) -> Column:
    """``shared``, ``unassigned`` or {"projects": [...]} as a struct; null if it is none of these."""
    listed = F.array_distinct(F.transform(F.from_json(raw, "struct<projects:array<string>>")["projects"], F.trim))
    good = (F.size(listed) > 0) & F.forall(listed, lambda p: p.isNotNull() & (p != "") & ~p.rlike(r"\s") & ~F.lower(p).isin("auto", "shared", "current", "all"))
    plain = F.when(raw.isin("shared", "unassigned"), F.struct(raw.alias("kind"), F.array().cast("array<string>").alias("projects")))
    return F.coalesce(plain, F.when(good, F.struct(F.lit("projects").alias("kind"), listed.alias("projects")))).cast(SCOPE)


def note_meta(text: Column) -> Column:
    """The header if it is complete for its type; else null."""
    m = F.from_json(F.nullif(F.regexp_extract(text, HEADER, 1), F.lit("")), META)
    common = m["type"].isin("digest", "lesson") & m["createdAt"].isNotNull() & m["author"].isNotNull() & m["cwd"].isNotNull()
    digest = m["sourcePath"].isNotNull() & m["sourceHash"].isNotNull() & (m["coverage"] == "full-text")
    return F.when(common & ((m["type"] == "lesson") | digest), m)


def note_kind(text: Column) -> Column:
    """Whatever isn't a digest is a lesson."""
    return F.when(note_meta(text)["type"] == "digest", F.lit("digest")).otherwise(F.lit("lesson"))


def format_note(meta: dict, title: str, body: str, tag: str = TAG) -> str:
    return f"<!-- {tag}\n{json.dumps(meta, ensure_ascii=False, separators=(',', ':'))}\n-->\n\n# {title}\n\n{body.strip()}\n"


def digest_status(digests: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds status to digests (text): unchanged, changed, missing, out-of-scope, unverified.

    ``sources`` has path, readable hash (null: it can't be read), in_scope.
    """
    m = digests.withColumn("_m", note_meta(F.col("text")))
    found = m.join(sources.select(F.col("path").alias("_p"), F.col("hash").alias("_h"), F.col("in_scope").alias("_in")), F.col("_m.sourcePath") == F.col("_p"), "left")
    status = (
        F.when(F.col("_m").isNull() | (F.col("_m.type") != "digest"), "unverified")
        .when(F.col("_p").isNull(), "missing")
        .when(~F.col("_in") | is_ai_note(F.col("_p")), "out-of-scope")
        .when(F.col("_h").isNull(), "unverified")
        .when(F.col("_h") != F.col("_m.sourceHash"), "changed")
        .otherwise("unchanged")
    )
    return found.select(*digests.columns, status.alias("status"))


def readme_titles(readmes: DataFrame) -> DataFrame:
    """folder, file, title from lines ``title -- file.ext``; files with several titles or ``..`` are dropped."""
    line = readmes.select("folder", F.explode(as_lines(F.col("text"))).alias("line"))
    pairs = line.filter(F.col("line").rlike(EXPORT_LINE)).select("folder", F.replace(F.regexp_extract("line", EXPORT_LINE, 2), F.lit("\\"), F.lit("/")).alias("file"), F.trim(F.regexp_extract("line", EXPORT_LINE, 1)).alias("title"))
    grouped = pairs.groupBy("folder", "file").agg(F.countDistinct("title").alias("n"), F.min("title").alias("title"))
    return grouped.filter((F.col("n") == 1) & (F.col("title") != "") & ~F.contains("file", F.lit(".."))).drop("n")


def info_catalogs(text: str) -> list[tuple[str, list[str]]] | None:
    """(title, catalog path) of an export's tree of pages; titles that occur twice are dropped."""
    try:
        pages = json.loads(text)["pages"]
        if not isinstance(pages, dict) or not (isinstance(pages.get("pages"), list) or isinstance(pages.get("catalogs"), list)):
            return None
    except (ValueError, KeyError, TypeError):
        return None
    seen: dict[str, list[str] | None] = {}
    todo = [(pages, [])]
    while todo:
        node, above = todo.pop()
        for page in node.get("pages") or []:
            title = page.get("page_title") if isinstance(page, dict) else None
            if isinstance(title, str) and title.strip():
                key = title.strip()
                seen[key] = None if key in seen else above
        for cat in node.get("catalogs") or []:
            if isinstance(cat, dict):
                name = cat["cat_name"].strip() if isinstance(cat.get("cat_name"), str) else ""
                todo.append((cat, [*above, name] if name else above))
    return sorted((k, v) for k, v in seen.items() if v is not None)


def info_titles(infos: DataFrame) -> DataFrame:
    """folder, title, catalog from the trees in ``infos`` (folder, text); a tree has no fixed depth."""
    importable(infos.sparkSession)

    @F.pandas_udf("array<struct<title:string,catalog:array<string>>>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"title": k, "catalog": v} for k, v in info_catalogs(t) or []])

    each = infos.select("folder", F.explode(parse("text")).alias("p")).select("folder", "p.title", "p.catalog")
    return each.groupBy("folder", "title").agg(F.count("*").alias("n"), F.first("catalog").alias("catalog")).filter("n = 1").drop("n")


def with_export_titles(files: DataFrame, titles: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Adds mapped_title and catalog to files (folder, file)."""
    named = files.join(titles.withColumnRenamed("title", "mapped_title"), ["folder", "file"], "left")
    return named.join(catalogs.withColumnRenamed("title", "mapped_title"), ["folder", "mapped_title"], "left").withColumn("catalog", F.coalesce("catalog", F.array().cast("array<string>")))
