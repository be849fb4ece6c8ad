"""Postings: one row for each (document, term) with frequency, fields and first lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_lines, bucket_of, clean_relative, let
from ..functions.tokens import terms
from ..session import prepare, spread
from .term_counts import LINES, counter

#: What postings hold besides term and key.
COLUMNS = {"tf": "long", "fields": "array<string>", "lines": "array<int>"}


def _stretches(columns: list[str]):
    """Array of (field, line, text) of a document; all fields but the body count as line 1."""
    none = F.array().cast("array<struct<field:string,line:int,text:string>>")
    one = lambda name, text: F.array(F.struct(F.lit(name).alias("field"), F.lit(1).alias("line"), text.alias("text")))
    parts = []
    if "rel_path" in columns:
        parts.append(one("path", clean_relative(F.col("rel_path"))))
    if "title" in columns:
        parts.append(one("title", F.col("title")))
    if "catalog" in columns:
        parts.append(F.transform(F.col("catalog"), lambda c: F.struct(F.lit("catalog").alias("field"), F.lit(1).alias("line"), c.alias("text"))))
    if "extra" in columns:
        parts.append(one("alias", F.col("extra")))
    lines = F.col("lines") if "lines" in columns else as_lines(F.col("text"))
    parts.append(F.transform(lines, lambda x, i: F.struct(F.lit("body").alias("field"), (i + 1).alias("line"), x.alias("text"))))
    return F.concat(*(F.coalesce(p.cast("array<struct<field:string,line:int,text:string>>"), none) for p in parts))


def _runs(emitted: Column) -> Column:
    """(term, tf, fields, lines) of each run of equal terms in a sorted array of (term, line, field)."""

    def of(e: Column) -> Column:
        n = F.size(e)
        first = lambda i: (i == 1) | (F.get(e, i - 1)["term"] != F.get(e, i - 2)["term"])
        starts = F.filter(F.sequence(F.lit(1), n), first)

        def run(starts: Column) -> Column:
            own = lambda s, k: F.slice(e, s, F.coalesce(F.get(starts, k + 1), n + 1) - s)
            row = lambda part: F.struct(
                F.get(part, F.lit(0))["term"].alias("term"), F.size(part).cast("long").alias("tf"),
                F.sort_array(F.array_distinct(F.transform(part, lambda x: x["field"]))).alias("fields"),
                F.slice(F.array_distinct(F.transform(part, lambda x: x["line"])), 1, LINES).alias("lines"),
            )
            return F.transform(starts, lambda s, k: let(own(s, k), row))

        return let(starts, run)

    return let(F.sort_array(emitted), of)


def _asked(docs: DataFrame, key: str, only: list[str]) -> DataFrame:
    """Postings of the terms ``only`` by Column expressions: stretches that hold none of them aren't cut into terms at all."""
    holds = lambda s: F.exists(F.array(*(F.lit(t) for t in only)).cast("array<string>"), lambda t: F.contains(s, t))
    stretches = F.filter(_stretches(docs.columns), lambda s: let(F.lower(s["text"]), holds))
    of = lambda s: F.transform(F.filter(terms(s["text"]), lambda t: t.isin(*only)), lambda t: F.struct(t.alias("term"), s["line"].alias("line"), s["field"].alias("field")))
    runs = let(F.flatten(F.transform(stretches, of)), lambda e: F.when(F.size(e) > 0, _runs(e)))
    return spread(docs).select(key, F.explode(runs).alias("r")).select("r.term", key, "r.tf", "r.fields", "r.lines")


def postings(docs: DataFrame, key: str = "doc_id", buckets: int | None = None, only: list[str] | None = None, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """term, ``key``, tf, fields, lines of ``docs`` (text or lines; rel_path, title, catalog and extra if there).

    A document is one row, so its terms are counted within the row: a map of Arrow batches, without any shuffle.
    ``columns`` says which of tf, fields and lines are made.  ``only`` keeps the terms of a query.  With ``buckets`` the
    term's bucket is added.
    """
    if only is not None:
        out = _asked(docs, key, only).select("term", key, *columns)
    else:
        prepare(docs.sparkSession)
        named = {"rel_path": clean_relative(F.col("rel_path")).alias("path"), "title": F.col("title"), "catalog": F.col("catalog"), "extra": F.col("extra").alias("alias")}
        given = [column for name, column in named.items() if name in docs.columns]
        body = "lines" if "lines" in docs.columns else "text"
        rows = spread(docs).select(F.col(key).alias("_key"), *given, body)
        schema = T.StructType([T.StructField("term", T.StringType()), T.StructField(key, docs.schema[key].dataType), *(T.StructField(c, T.DataType.fromDDL(COLUMNS[c])) for c in columns)])
        out = rows.mapInArrow(counter(key, columns), schema)
    return out if buckets is None else out.withColumn("bucket", bucket_of(F.col("term"), buckets))


def document_frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))
