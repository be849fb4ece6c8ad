"""Operator 1: best-fit packing with exact-complement hashing.

A document's tokens and one separator make one piece; only longer documents are cut, into pieces
of the capacity, the last of which may be shorter.  Packing needs no piece, only how many there
are of each length, and lengths are at most the capacity (2048): the driver plans over that
histogram, whatever the number of documents.

Plan (``plan_packing``), from the longest length down: the gap that it leaves is looked up among
the single lengths, then among sums of pairs, then of triples, under the counts that are still
available; a combination that fills the gap exactly is consumed as often as the counts allow at
once.  What no combination fills goes, longest first, to the tightest open gap that holds it
(best fit), and to a new sequence where there is none.  Each step uses up a length or a gap,
so steps and plan are bounded by the capacity and not by the data.

Placement: pieces are numbered within their length by one range shuffle of a narrow table
(``common.range_ranked``), and the plan, a few thousand ranges of ranks, gives each its sequence
and offset.  A length that a third of all pieces share is spread over many partitions.

Defined results: a null or empty text is one piece, the separator alone; very long texts are encoded whole, in
memory of a few times their size; repeated rows are packed each; pieces of equal length are interchangeable, and
which takes which place is undefined; extra columns are ignored by ``pack_documents`` and kept by ``pack``, whatever
their names; an empty table gives no rows; a null doc_id stays null.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .pretoken import PretokenEncoder

CAPACITY = 2048

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class ComplementIndex:
    """Which lengths, and which sums of two lengths, the counts still allow.

    ``ways[s]`` is the number of pairs of available lengths (a smaller or equal to b) with a + b = s.
    """

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64).copy()
        self.size = len(counts)
        self.here, self.twice = self.n > 0, self.n > 1
        self.ways = np.zeros(self.size, np.int64)
        for a in np.flatnonzero(self.here):
            b = np.flatnonzero(self.here[a + 1 : self.size - a]) + a + 1
            self.ways[a + b] += 1
        self._double(np.flatnonzero(self.twice), 1)

    def _double(self, a: np.ndarray, by: int) -> None:
        s = 2 * a
        self.ways[s[s < self.size]] += by

    def change(self, length: int, by: int) -> None:
        """Add ``by`` pieces of ``length``, or take them away, and keep the sums of pairs right."""
        self.n[length] += by
        if self.twice[length] != (self.n[length] > 1):
            self.twice[length] = not self.twice[length]
            self._double(np.array([length]), 1 if self.twice[length] else -1)
        if self.here[length] != (self.n[length] > 0):
            self.here[length] = not self.here[length]
            other = np.flatnonzero(self.here[: self.size - length])
            self.ways[other[other != length] + length] += 1 if self.here[length] else -1

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if 0 < gap < self.size and self.here[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The pair with the longest first part."""
        if gap < 2 or not self.ways[gap]:
            return None
        low = (gap + 1) // 2
        first = np.arange(gap - 1, low - 1, -1)
        ok = self.here[first] & self.here[gap - first]
        if 2 * low == gap and not self.twice[low]:
            ok[-1] = False
        at = int(ok.argmax())
        return (int(first[at]), int(gap - first[at])) if ok[at] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """The triple with the longest first part, found by that part and the sum of the other two."""
        if gap < 3:
            return None
        first = np.arange(gap - 2, 0, -1)
        for a in first[self.here[first] & (self.ways[gap - first] > 0)]:
            rest = self.pair(gap - int(a))
            if rest and self.fits((int(a), *rest)):
                return (int(a), *rest)
        return None

    def fits(self, parts: tuple[int, ...]) -> bool:
        return all(self.n[x] >= parts.count(x) for x in set(parts))


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(sequences, [(length, pieces in each of them), ...]), ...] that use up ``counts``."""
    n = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 to {capacity}")
        n[length] += count
    plan: list[tuple[int, list[tuple[int, int]]]] = []
    if n[capacity]:
        plan.append((int(n[capacity]), [(capacity, 1)]))
    index = ComplementIndex(n[:capacity])
    for length in range(capacity - 1, 0, -1):
        while index.n[length]:
            gap = capacity - length
            index.change(length, -1)  # the piece itself can't fill its own gap
            rest = index.single(gap) or index.pair(gap) or index.triple(gap)
            index.change(length, 1)
            if not rest:
                break
            parts = (length, *rest)
            uses = {x: parts.count(x) for x in parts}
            times = min(int(index.n[x]) // k for x, k in uses.items())
            if not times:
                break
            for x, k in uses.items():
                index.change(x, -times * k)
            plan.append((times, list(uses.items())))
    return plan + best_fit({int(x): int(index.n[x]) for x in np.flatnonzero(index.n)}, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, over counts: equal pieces go into equal gaps at once."""
    open_: dict[int, list[list]] = {}  # gap: [[sequences, parts], ...]
    gaps: list[int] = []
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def put(gap: int, times: int, parts: list[tuple[int, int]]) -> None:
        if not gap:
            done.append((times, parts))
            return
        if gap not in open_:
            at = int(np.searchsorted(gaps, gap)) if gaps else 0
            gaps.insert(at, gap)
            open_[gap] = []
        open_[gap].append([times, parts])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = int(np.searchsorted(gaps, length)) if gaps else 0
            if at < len(gaps):
                gap = gaps[at]
                times, parts = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
            else:
                gap, times, parts = capacity, left, []
            each = min(gap // length, left)
            used = min(times, left // each)
            if parts and used < times:
                put(gap, times - used, parts)
            put(gap - each * length, used, [*parts, (length, each)])
            left -= used * each
    return done + [(times, parts) for groups in open_.values() for times, parts in groups]


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences than all lengths need together."""
    return -(-sum(k * v for k, v in counts.items()) // capacity)


class Placement:
    """The plan as arrays that are searched by (length, rank within the length)."""

    def __init__(self, plan: list[tuple[int, list[tuple[int, int]]]], capacity: int = CAPACITY):
        rows, sequence = [], 0
        seen: dict[int, int] = {}
        for times, parts in plan:
            at = 0
            for length, each in parts:
                rows.append((length, seen.get(length, 0), sequence, each, at))
                seen[length] = seen.get(length, 0) + times * each
                at += length * each
            sequence += times
        self.sequences = sequence
        rows.sort()
        self.length, self.first, self.base, self.each, self.at = (np.array(x, np.int64) for x in (zip(*rows) if rows else [()] * 5))
        self.begin = np.searchsorted(self.length, np.arange(capacity + 2))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.empty(len(length), np.int64)
        for x in np.unique(length):
            own = slice(self.begin[x], self.begin[x + 1])
            of = length == x
            row[of] = self.begin[x] + np.searchsorted(self.first[own], rank[of], "right") - 1
        k = rank - self.first[row]
        return self.base[row] + k // self.each[row], self.at[row] + k % self.each[row] * length


def _pieces(path: str, separator: int, capacity: int, with_ids: bool):
    def run(batches):
        end = struct.pack("<I", separator)
        encoder = PretokenEncoder(path, "ids", lambda ids: struct.pack(f"<{len(ids)}I", *ids))
        for batch in batches:
            rows, ids = [], []
            for doc_id, words in zip(batch.column(0).to_pylist(), encoder.values(batch.column(1).to_pylist()), strict=True):
                data = b"".join([*words, end])
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                    if with_ids:
                        ids.append(piece)
            out = [pa.array(x, t) for x, t in zip(zip(*rows), _SCHEMA.types, strict=True)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(ids, pa.binary())], names=[*_SCHEMA.names, "ids"]) if with_ids else pa.RecordBatch.from_arrays(out, schema=_SCHEMA)
        common.give_back()

    return run


def pieces(docs: DataFrame, path: str, separator: int = 0, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds its ids as little-endian unsigned 32-bit numbers."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(path, separator, capacity, with_ids), _PIECES + ", ids binary" * with_ids)


def _placer(shared):
    def run(batches):
        placement, before = shared.value
        for batch in batches:
            part, place, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_part", "_place", "length"))
            rank = np.array([before[p, x] for p, x in zip(part.tolist(), length.tolist(), strict=True)], np.int64) + place
            sequence, offset = placement.place(length, rank)
            yield pa.RecordBatch.from_arrays([batch.column("data"), pa.array(sequence), pa.array(offset)], names=["data", "sequence_id", "offset"])

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``capacity``; other columns are kept, but for two of these names.

    ``cut`` should come from a table, since it is read twice (bounds, then rows).
    """
    spark = cut.sparkSession
    rows = cut.select(common.in_one(cut), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("_row"))
    ranked = common.range_ranked(rows, ["length", "_row"], "packing-ranked")
    # Sorted by length, a partition holds a stretch of lengths: at most partitions + capacity groups in all.
    groups = ranked.groupBy("length", "_part").agg(F.count("*").alias("n"), F.min("_place").alias("first")).collect()
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for g in sorted(groups, key=lambda g: (g.length, g._part)):
        before[g._part, g.length] = counts.get(g.length, 0) - g.first
        counts[g.length] = counts.get(g.length, 0) + g.n
    shared = spark.sparkContext.broadcast((Placement(plan_packing(counts, capacity), capacity), before))
    schema = T.StructType([ranked.schema["data"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return common.out_of(ranked.select("data", "length", "_part", "_place").mapInArrow(_placer(shared), schema), cut, ["sequence_id", "offset"])


def pack_documents(docs: DataFrame, path: str, separator: int = 0, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Cut, encode and pack; the pieces are written once so that no text is encoded twice."""
    return pack(common.materialise(pieces(docs, path, separator, capacity, text, doc_id, with_ids), "packing-pieces"), capacity)


def _assemble(batches):
    for batch in batches:
        out = [b"".join(x["ids"] for x in sorted(parts, key=lambda x: x["offset"])) for parts in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x, "<u4").astype(np.int32).tolist() for x in out], pa.list_(pa.int32()))], names=["sequence_id", "ids"])


def assemble(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, from pieces packed ``with_ids``; a group has at most a capacity of ids."""
    parts = packed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("parts"))
    return parts.mapInArrow(_assemble, "sequence_id long, ids array<int>")
