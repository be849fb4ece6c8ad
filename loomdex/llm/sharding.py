"""Operator 8: shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points of a ring (virtual nodes); a key belongs to the first point clockwise
of its hash.  Loads are bounded: a shard takes no more than its quota, and keys that find a shard
full continue clockwise to the next point whose shard has room.  Quotas are whole rows that differ
by at most one and add up to all rows, so the counts of shards differ by at most one (law ``rows``).
Only what overflows moves away from its own shard.

The ring is resolved over counts of arcs, not over rows: the keys of an arc are ranked along the
ring, its first ones stay, the rest flow on.  One range shuffle of a narrow table ranks the keys
(``common.range_ranked``); the driver sees a count per (arc, partition), at most arcs + partitions.

Defined results: a null text has a size of 1 byte and the crc32 of nothing, 0; repeated rows and
null ids are placed each (ties in the ring are broken by the row's place in the input); very long texts count like
others, only their size and checksum travel; extra columns are ignored by ``shard_documents`` and kept by
``shard_rows``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHARDS, VIRTUAL = 16, 256


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """Points in ascending order as signed 64-bit numbers, and their shards.  A shard's points don't depend on the others."""
    points = [(int.from_bytes(hashlib.blake2b(f"shard {s} point {v}".encode(), digest_size=8).digest(), "little", signed=True), s) for s in range(shards) for v in range(virtual)]
    points.sort()
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int32)


def quotas(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def resolve(arcs: np.ndarray, owner: np.ndarray, room: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each arc [(shard, rows), ...] in the order of its keys.

    Keys of an arc fill its own shard first.  What is over goes on clockwise and takes room where
    there is some; the ring is walked at most twice, since all rows have room in all shards together.
    """
    room = room.copy()
    n = len(arcs)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    over: list[list[int]] = []
    for a in range(n):
        s, count = int(owner[a]), int(arcs[a])
        kept = min(count, int(room[s]))
        room[s] -= kept
        if kept:
            out[a].append((s, kept))
        if count > kept:
            over.append([a, count - kept])
    waiting: list[list[int]] = []
    at = 0
    for step in range(2 * n):
        a = step % n
        if step < n and at < len(over) and over[at][0] == a:
            waiting.append(over[at])
            at += 1
        s = int(owner[a])
        while waiting and room[s]:
            took = min(int(room[s]), waiting[0][1])
            room[s] -= took
            out[waiting[0][0]].append((s, took))
            waiting[0][1] -= took
            if not waiting[0][1]:
                waiting.pop(0)
    if waiting:
        raise ValueError("the quotas don't hold all rows")
    return out


class Slices:
    """Ranks along the ring, cut into stretches of one shard with a gapless stretch of its slots."""

    def __init__(self, resolved: list[list[tuple[int, int]]]):
        used: dict[int, int] = {}
        first, shard, slot, base, rank = [], [], [], [], 0
        for parts in resolved:
            base.append(rank)
            for s, count in parts:
                first.append(rank)
                shard.append(s)
                slot.append(used.get(s, 0))
                used[s] = used.get(s, 0) + count
                rank += count
        self.base, self.first, self.shard, self.slot = np.array(base, np.int64), np.array(first, np.int64), np.array(shard, np.int32), np.array(slot, np.int64)

    def place(self, arc: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot of keys by their arc and their rank within it."""
        at = self.base[arc] + rank
        row = np.searchsorted(self.first, at, "right") - 1
        return self.shard[row], self.slot[row] + at - self.first[row]


def _arcs(points: np.ndarray):
    """(data, _at, _arc): the arc of each ring position is the first point at or after it, the first of all after the last."""

    def run(batches):
        for batch in batches:
            at = np.searchsorted(points, batch.column(1).to_numpy()) % len(points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=["data", "_at", "_arc"])

    return run


def _placer(shared):
    def run(batches):
        slices, before = shared.value
        for batch in batches:
            part, place, arc = (batch.column(c).to_numpy() for c in ("_part", "_place", "_arc"))
            rank = place + np.array([before[k] for k in zip(part.tolist(), arc.tolist(), strict=True)], np.int64)
            shard, slot = slices.place(arc, rank)
            yield pa.RecordBatch.from_arrays([batch.column("data"), pa.array(shard), pa.array(slot)], names=["data", "shard", "slot"])

    return run


def shard_rows(narrow: DataFrame, key: str, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """Add shard and slot to every row of ``narrow``, in place of columns of these names; the ring position is the hash of ``key``."""
    spark = narrow.sparkSession
    common.prepare(spark)
    points, owner = ring(shards, virtual)
    placed = narrow.select(common.in_one(narrow), F.xxhash64(F.col(f"`{key}`")).alias("_at"))
    schema = T.StructType([*placed.schema.fields, T.StructField("_arc", T.IntegerType())])
    written = common.materialise(placed.mapInArrow(_arcs(points), schema), "sharding-rows")
    # Arcs in ring order; the arc that wraps around holds the highest and the lowest positions, and its order doesn't matter.
    ranked = common.range_ranked(written.withColumn("_row", F.monotonically_increasing_id()), ["_arc", "_at", "_row"], "sharding-ranked")
    groups = ranked.groupBy("_arc", "_part").agg(F.count("*").alias("n"), F.min("_place").alias("first")).collect()
    arcs, before = np.zeros(len(points), np.int64), {}
    for g in sorted(groups, key=lambda g: (g._arc, g._part)):
        before[g._part, g._arc] = int(arcs[g._arc]) - g.first
        arcs[g._arc] += g.n
    slices = Slices(resolve(arcs, owner, quotas(int(arcs.sum()), shards)))
    shared = spark.sparkContext.broadcast((slices, before))
    schema = T.StructType([ranked.schema["data"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return common.out_of(ranked.select("data", "_arc", "_part", "_place").mapInArrow(_placer(shared), schema), narrow, ["shard", "slot"])


def shard_documents(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    placed = shard_rows(narrow, "doc_id", shards, virtual)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows changed their shard between two placements of the same ids, and how many there are."""
    pair = before.select("doc_id", F.col("shard").alias("a")).join(after.select("doc_id", F.col("shard").alias("b")), "doc_id")
    return pair.agg(F.count_if(F.col("a") != F.col("b")).alias("moved"), F.count("*").alias("rows"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write whole documents as one folder per shard, each in the order of slots; ids must be unique here."""
    body = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    body.repartitionByRange(common.partitions_for(docs), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
