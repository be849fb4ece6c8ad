"""Operator 9: token counts by a map-side two-tier lookup.

Tier one is a compact hash table of frequent pre-tokens and their numbers of tokens (``LengthTable``: sorted 64-bit
hashes, 16-bit lengths and the words as one run of bytes, by which a hit is checked), broadcast to all executors;
its size is bounded by FREQUENT entries of at most 64 characters, about 2 MB.  Tier two is a bounded cache in each
Python worker, through which the misses are encoded.  Nothing is shuffled, neither texts nor pre-tokens.

Tier one only decides speed; counts are the library's whatever it holds.  So it is chosen from a sample: about SAMPLE
texts drawn from all rows, read whole, each giving its PER_TEXT most frequent pre-tokens.  At most that many pairs
reach the driver, however large the input is.

Defined results: a null or empty text has 0 tokens and 0 bytes; very long texts are counted whole, in memory of a few
times their size; pre-tokens equally frequent in the sample enter tier one in alphabetical order; repeated rows are
counted each; extra columns are ignored; an empty table gives no rows; a null doc_id stays null.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .pretoken import LONGEST, PretokenEncoder, pretokens

#: Entries of tier one; texts of the sample that it is chosen from, and pre-tokens that each of them names.
FREQUENT, SAMPLE, PER_TEXT = 65_536, 2_048, 256

_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


class LengthTable:
    """Words and their lengths in tokens as four arrays; hashes are sorted, and equal bytes make a hit."""

    def __init__(self, words: list[str], lengths: list[int]):
        data = [w.encode() for w in words]
        hashes = np.array([xxhash.xxh64_intdigest(b) for b in data], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.lengths = hashes[order], np.minimum(np.array(lengths, np.int64)[order], 0xFFFF).astype(np.uint16)
        self.ends = np.cumsum([len(data[i]) for i in order]).astype(np.uint32)
        self.bytes = b"".join(data[i] for i in order)

    def __len__(self) -> int:
        return len(self.hashes)

    def lookup(self, words: list[str]) -> dict[str, int]:
        """The lengths of those ``words`` that the table holds."""
        if not words or not len(self):
            return {}
        hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in words), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        at = at[hit]
        ends, begins = self.ends[at].tolist(), np.where(at > 0, self.ends[at - 1], 0).tolist()
        rows = zip(hit.tolist(), begins, ends, self.lengths[at].tolist(), strict=True)
        return {words[i]: n for i, a, b, n in rows if n < 0xFFFF and self.bytes[a:b] == words[i].encode()}


def _summarise(batches):
    for batch in batches:
        words, counts = [], []
        for text in batch.column(0).to_pylist():
            own = [x for x in Counter(pretokens(text)).most_common() if len(x[0]) <= LONGEST][:PER_TEXT]
            words += [w for w, _ in own]
            counts += [n for _, n in own]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])


def frequent_pretokens(docs: DataFrame, text: str = "text", size: int = FREQUENT, sample: int = SAMPLE) -> list[str]:
    """At most ``size`` of the pre-tokens that are most frequent in about ``sample`` texts of ``docs``."""
    rows = docs.select(F.col(text).cast("string").alias("text"))
    some = rows.sample(min(1.0, sample / max(1, docs.count())), seed=1)
    found = some.mapInArrow(_summarise, "word string, n long").toArrow()
    seen: Counter = Counter()
    for word, n in zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True):
        seen[word] += n
    return [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]]


def _counter(path: str, shared):
    def run(batches):
        encoder = PretokenEncoder(path, "counts", len, shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [sum(x) for x in encoder.values(texts)]
            sizes = [0 if t is None else len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], schema=_COUNTS)

    return run


def token_counts(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``; ``path`` is the tokenizer's file."""
    spark = docs.sparkSession
    common.prepare(spark)
    words = frequent_pretokens(docs, text)
    shared = spark.sparkContext.broadcast(LengthTable(words, list(PretokenEncoder(path, "counts", len).encode(words))))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = rows.mapInArrow(_counter(path, shared), "doc_id long, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
