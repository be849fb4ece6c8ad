"""Document pipeline: quality classifier, quality rules, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir).  All but the last return the columns of ``docs``; the last
returns the packed pieces.  The classifier learns from the labels in ``sf_dir``.  The near-dedup links texts whose
five-word shingles have a similarity of 0.8 or more: pairs of fingerprints that BK-trees find within their radius,
and then all others, each verified on the whole texts.  Duplicates are judged after both filters, so a rejected copy
can't stand in for a clean one.

Defined results: null and empty texts are judged like others (the rules reject them); very long texts are read
whole by every stage; of equal texts the smallest doc_id stays, of repeated rows the first; columns of any name pass
through all but the last stage; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomdex.llm import common, near_copies, packing, quality_classifier, quality_rules
from loomdex.llm.queries import WORDS, tokenizer_file


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, common.table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file(WORDS))


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("simhash_dedup", deduplicate), ("best_fit_packing", pack)]

#: No SQL: neither the learnt classifier nor XXH64 fingerprints can be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and reread as the next one's input."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        mark = common.made()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialise(docs, name)
            common.forget(mark, docs)  # what the stage wrote on its way
    return docs
