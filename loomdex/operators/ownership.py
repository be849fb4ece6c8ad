"""Which root, project and scope a file belongs to, and who may see it.

Roots, bindings and projects are configuration: a driver-side list, broadcast.  A file's covering
bindings are all folders above it (or the file itself), so instead of comparing each file with each
binding, a file is exploded into its own ancestors and joined on equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import excluded, in_folder, is_managed

SCOPE = "struct<kind:string,projects:array<string>>"
ROOTS = "name string, path string, exclude array<string>"
BINDINGS = f"root string, path string, scope {SCOPE}"


def ancestors(path: Column) -> Column:
    """The path itself and every folder above it, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def same_scope(scope: Column) -> Column:
    return F.struct(scope["kind"].alias("kind"), F.array_sort(F.array_distinct(F.coalesce(scope["projects"], F.array().cast("array<string>")))).alias("projects"))


def covering_roots(files: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """A row for each (file, root that covers it) with the path within the root and whether it is excluded there."""
    above = files.select(path, F.explode(ancestors(F.col(path))).alias("_base"))
    found = above.join(F.broadcast(roots.select(F.col("name").alias("root"), F.col("path").alias("_base"), "exclude")), "_base")
    rel = F.expr(f"substring(`{path}`, length(_base) + 2)")
    return found.withColumn("rel", rel).filter("rel <> ''").select(path, "root", F.col("_base").alias("base"), "rel", excluded(F.col("rel"), F.col("exclude")).alias("excluded"))


def most_specific_root(files: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """Each file's root with the longest folder; null where none covers it."""
    found = covering_roots(files, roots, path).groupBy(path).agg(F.max_by("root", F.length("base")).alias("root"), F.bool_or("excluded").alias("excluded"))
    return files.select(path).distinct().join(found, path, "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def resolve(files: DataFrame, roots: DataFrame, bindings: DataFrame, path: str = "path") -> DataFrame:
    """``path``, excluded, conflict, kind, projects of each distinct file.

    An exact binding wins over a folder, a deeper folder over a higher one; equal targets must agree, or
    the file is in conflict and excluded.  In managed folders only exact bindings count.  An exclude rule
    of any covering root excludes.
    """
    covered = covering_roots(files, roots, path)
    rules = covered.groupBy(path).agg(F.bool_or("excluded").alias("excluded"), F.bool_or(is_managed(F.col("rel"))).alias("managed"))
    options = F.concat(ancestors(F.col("rel")), F.array(F.lit(".")))
    near = covered.select(path, "root", "base", "rel", F.explode(options).alias("_bind")).join(
        F.broadcast(bindings.select("root", F.col("path").alias("_bind"), same_scope(F.col("scope")).alias("scope"))), ["root", "_bind"]
    )
    target = F.when(F.col("_bind") == ".", F.col("base")).otherwise(F.concat_ws("/", "base", "_bind"))
    hits = near.select(path, (F.col("_bind") == F.col("rel")).alias("exact"), target.alias("target"), "scope")
    hits = hits.join(rules.select(path, "managed"), path).filter("exact or not managed")
    order = F.struct(F.col("exact").cast("int").alias("exact"), F.length("target").alias("depth"))
    # The scopes of the best targets only: a bounded set, since targets of one length above one file are the same folder.
    by_rank = hits.groupBy(path, order.alias("rank")).agg(F.collect_set("scope").alias("scopes"))
    top = by_rank.groupBy(path).agg(F.max_by("scopes", "rank").alias("scopes"))
    out = files.select(path).distinct().join(rules, path, "left").join(top, path, "left")
    conflict = F.coalesce(F.size("scopes") > 1, F.lit(False)) & ~F.coalesce("excluded", F.lit(False))
    gone = F.coalesce("excluded", F.lit(False)) | conflict
    scope = F.when(~gone, F.get("scopes", F.lit(0)))
    return out.select(
        path,
        gone.alias("excluded"),
        conflict.alias("conflict"),
        F.coalesce(scope["kind"], F.lit("unassigned")).alias("kind"),
        F.coalesce(scope["projects"], F.array().cast("array<string>")).alias("projects"),
    )


def document_ownership(docs: DataFrame, roots: DataFrame, bindings: DataFrame) -> DataFrame:
    """Adds own_excluded, own_kind, own_projects to documents with path, kind, source_path and scope.

    Digests and derived notes belong to their source (without one they are excluded); a lesson takes the scope of
    its header only if its path is unassigned.
    """
    from_source = F.col("kind").isin("digest", "derived")
    judged = docs.withColumn("_file", F.when(from_source, F.col("source_path")).otherwise(F.col("path")))
    own = resolve(judged.filter("_file is not null").select("_file"), roots, bindings, "_file").withColumnsRenamed({"excluded": "_x", "kind": "_k", "projects": "_p"})
    both = judged.join(own, "_file", "left")
    lesson = (F.col("kind") == "lesson") & ~F.col("_x") & (F.col("_k") == "unassigned") & F.col("scope").isNotNull()
    none = F.array().cast("array<string>")
    return both.select(
        *docs.columns,
        F.coalesce("_x", F.lit(True)).alias("own_excluded"),
        F.when(lesson, F.col("scope.kind")).otherwise(F.coalesce("_k", F.lit("unassigned"))).alias("own_kind"),
        F.when(lesson, F.coalesce("scope.projects", none)).otherwise(F.coalesce("_p", none)).alias("own_projects"),
    )


def is_visible(excluded_: Column, kind: Column, projects: Column, isolation: bool, ids: list[str]) -> Column:
    """Without isolation all that isn't excluded; with it shared documents and those of the projects ``ids``."""
    if not isolation:
        return ~excluded_
    own = F.arrays_overlap(projects, F.array(*(F.lit(i) for i in ids)).cast("array<string>")) if ids else F.lit(False)
    return ~excluded_ & ((kind == "shared") | ((kind == "projects") & own))


def match_workspace(folders: DataFrame, projects: DataFrame, path: str = "cwd") -> DataFrame:
    """``path``, project_id, ambiguous: the project with the longest workspace above a folder."""
    spaces = projects.select(F.col("id").alias("_id"), F.explode("workspaces").alias("_ws"))
    above = folders.select(path, F.explode(ancestors(F.col(path))).alias("_ws")).join(F.broadcast(spaces), "_ws")
    by_length = above.groupBy(path, F.length("_ws").alias("_n")).agg(F.min("_id").alias("_first"), (F.countDistinct("_id") > 1).alias("_many"))
    top = by_length.groupBy(path).agg(F.max_by(F.struct("_first", "_many"), "_n").alias("_b"))
    return folders.select(path).distinct().join(top, path, "left").select(
        path, F.when(~F.col("_b._many"), F.col("_b._first")).alias("project_id"), F.coalesce("_b._many", F.lit(False)).alias("ambiguous")
    )


def workspace_conflicts(projects: DataFrame) -> DataFrame:
    """Workspaces of more than one project."""
    return projects.select("id", F.explode("workspaces").alias("workspace")).groupBy("workspace").agg(F.array_sort(F.collect_set("id")).alias("ids")).filter(F.size("ids") > 1)


def binding_conflicts(roots: DataFrame, bindings: DataFrame) -> DataFrame:
    """Targets whose bindings don't agree on the scope."""
    r = roots.select(F.col("name").alias("root"), F.col("path").alias("base"))
    target = F.when(F.col("path") == ".", F.col("base")).otherwise(F.concat_ws("/", "base", "path"))
    hits = bindings.join(F.broadcast(r), "root").select(target.alias("target"), same_scope(F.col("scope")).alias("scope"))
    return hits.groupBy("target").agg(F.countDistinct("scope").alias("scopes")).filter("scopes > 1")


def unknown_references(bindings: DataFrame, roots: DataFrame, projects: DataFrame) -> DataFrame:
    """Bindings of roots or projects that don't exist."""
    bad_root = bindings.join(roots.select(F.col("name").alias("root")), "root", "left_anti").select("root", "path", F.lit("root").alias("missing"))
    ids = bindings.select("root", "path", F.explode("scope.projects").alias("id"))
    return bad_root.unionByName(ids.join(projects.select("id"), "id", "left_anti").select("root", "path", F.col("id").alias("missing")))


def not_in(files: DataFrame, folders: list[str], path: str = "path") -> DataFrame:
    """Files outside all of ``folders`` (a few, from the configuration)."""
    keep = F.lit(True)
    for f in folders:
        keep = keep & ~in_folder(F.col(path), F.lit(f))
    return files.filter(keep)
