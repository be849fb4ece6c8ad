"""Bounded training samples: which rows a classifier learns from, and their whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int):
    """crc32 of the id's text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def thinned(rows: DataFrame, keep: int, by: list[str] = (), groups: int = 1) -> DataFrame:
    """About twice ``keep`` rows of (doc_id, ...), or of each group ``by``: those whose hash falls in so small a share.

    An exact cut to ``keep`` by that hash may follow: it then sees a bounded number of rows, however many tasks
    there are.  Smaller groups stay whole; of more than ``groups`` groups the largest are taken, so that their
    counts can be broadcast.
    """
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), *by).limit(groups)
    sized = rows.join(F.broadcast(counts), list(by)) if by else rows.join(F.broadcast(counts), F.lit(True))
    return sized.filter(F.pmod(F.xxhash64("doc_id"), F.greatest("_n", F.lit(1))) < 2 * keep).drop("_n")


def sampled_texts(docs: DataFrame, sample: DataFrame, label: str, text: str, doc_id: str) -> DataFrame:
    """doc_id, label and text of a bounded ``sample`` of (doc_id, label); of repeated ids the smallest text.

    The sample has at most the documented number of rows, so it is broadcast.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = rows.join(F.broadcast(sample), "doc_id")
    return found.groupBy("doc_id", label).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
