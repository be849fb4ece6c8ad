"""Operator 6: near-duplicates by SimHash fingerprints, linked through BK-trees.

A text's words are its runs without ASCII white space, A-Z lower-cased; its shingles are four words
each (fewer words: all of them; none: fingerprint zero).  A bit of the fingerprint is 1 if it is
set in over half of the shingles' XXH64 (seed 42).  Fingerprints within RADIUS bits are linked, and
a document's component is the smallest doc_id that links reach.

Equal fingerprints are one node, so copies cost nothing further.  Nodes are dealt into shards so
that every pair within the radius meets in one: the 64 bits are cut into m blocks, of which m - RADIUS
must be equal, and a shard is a choice of blocks and their bits (``tables_for``: more nodes, longer
keys).  In each shard a BK-tree, children keyed by their Hamming distance to the parent, follows
only the edges that the radius allows.  A shard of more than SHARD nodes is split into chunks that
meet in pairs, so no task holds more than two chunks.  A task gives the forest of its links (each
member and the smallest of its class), never all pairs.

The trees are built by the tasks that own the shards, and are not broadcast: trees of all
fingerprints have no bound that a broadcast could rely on.

Components of the links: alternating large-star and small-star steps, each from a written table.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a bit set in exactly half of
the shingles is 0; very long texts are hashed whole, in memory of about ten times their size; repeated
rows each get their row; a null doc_id never becomes a component_id, which is null if a component
has no other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

RADIUS, WORDS, SEED = 4, 4, 42
#: Nodes that one BK-tree holds; larger shards are split into chunks.
SHARD = 1024

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, words: int = WORDS) -> list[int]:
    """XXH64 of each shingle, repeats included."""
    found = (text or "").encode().lower().split()  # bytes: ASCII rules for case and white space
    if not found:
        return []
    digest, whole = xxhash.xxh64_intdigest, b" ".join(found)
    if len(found) <= words:
        return [digest(whole, SEED)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[: -words].tolist()]
    return [digest(whole[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def fingerprints_of(hashes: list[list[int]]) -> np.ndarray:
    """uint64 fingerprints.  Bits are counted eight at a time in the bytes of 64-bit sums of up to 255 hashes."""
    n = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(n.sum()))
    begin = np.cumsum(n) - n
    blocks = [np.arange(begin[i], begin[i] + n[i], 255) for i in some]
    of_doc = np.cumsum([0, *map(len, blocks[:-1])])
    at = np.concatenate(blocks)
    half = n[some] // 2  # more than half: count > n // 2
    for k in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & _LANES, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), of_doc, axis=0)
        for byte in range(8):
            out[some] |= (counts[:, byte] > half).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints(texts: list[str | None], words: int = WORDS) -> np.ndarray:
    return fingerprints_of([shingle_hashes(x, words) for x in texts])


@F.pandas_udf(T.LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fingerprint's 64 bits as a signed number."""
    for x in texts:
        out = [fingerprints([None if t is None else t for t in x.iloc[i : i + 128]]) for i in range(0, len(x), 128)]
        yield pd.Series(np.concatenate(out).view(np.int64) if out else np.array([], np.int64))


class BKTree:
    """Integers by Hamming distance: a node's children are keyed by their distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        node, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        if new:
            while True:
                d = (value ^ self.values[node]).bit_count()
                follow = self.children[node].get(d)
                if follow is None:
                    self.children[node][d] = new
                    break
                node = follow
        return new

    def near(self, value: int, radius: int) -> list[int]:
        """Nodes within ``radius``: only edges from d - radius to d + radius can lead to one."""
        if not self.values:
            return []
        found, stack, values, children = [], [0], self.values, self.children
        while stack:
            node = stack.pop()
            d = (value ^ values[node]).bit_count()
            if d <= radius:
                found.append(node)
            low, high = d - radius, d + radius
            for edge, child in children[node].items():
                if low <= edge <= high:
                    stack.append(child)
        return found


def links(left: list[int], right: list[int] | None, radius: int = RADIUS, edges: bool = False) -> list[tuple[int, int]]:
    """(member, smallest member of its class) from the links within ``left``, or of ``right`` with ``left``.

    With ``edges``: links that make up the same classes, each a pair within the radius.
    """
    tree, members, parent, made = BKTree(), [], [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, found: list[int]) -> None:
        for j in found:
            a, b = root(i), root(j)
            if a != b:
                made.append((members[i], members[j]))
                if members[a] < members[b]:
                    a, b = b, a
                parent[a] = b

    for x in left:
        found = tree.near(x, radius) if right is None else []
        parent.append(len(members))
        members.append(x)
        tree.add(x)
        join(len(members) - 1, found)
    for x in right or ():
        parent.append(len(members))
        members.append(x)
        join(len(members) - 1, tree.near(x, radius))
    return made if edges else [(members[i], members[root(i)]) for i in range(len(members)) if root(i) != i]


def tables_for(nodes: int, radius: int = RADIUS, per_shard: int = SHARD // 2) -> list[list[tuple[int, int]]]:
    """Choices of bit ranges [(start, bits), ...] so that any two nodes within ``radius`` agree in one choice.

    Of m blocks at most ``radius`` can differ, so m - radius agree.  m is the smallest with which
    evenly spread nodes make shards of at most ``per_shard``.
    """
    m = radius + 1
    while m < 2 * radius and nodes >> (64 // m * (m - radius)) > per_shard:
        m += 1
    cut = [round(64 * k / m) for k in range(m + 1)]
    ranges = [(a, b - a) for a, b in zip(cut, cut[1:])]
    return [list(x) for x in combinations(ranges, m - radius)]


def _shard_keys(tables: list[list[tuple[int, int]]]):
    keys = []
    for k, ranges in enumerate(tables):
        key = F.lit(k).cast("long")
        for start, bits in ranges:
            part = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
            key = F.shiftleft(key, bits).bitwiseOR(part)
        keys.append(key)
    return F.array(*keys)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link_groups(radius: int, edges: bool):
    """Rows come sorted by (shard, one, two); a group is a shard, or two chunks of a large one."""

    def solve(rows) -> Iterator[tuple[int, int]]:
        fp, chunk, (_, one, two) = rows[0], rows[1], rows[2]
        if one == two:
            return links(fp, None, radius, edges)
        return links([f for f, c in zip(fp, chunk) if c == one], [f for f, c in zip(fp, chunk) if c == two], radius, edges)

    def run(batches):
        key, fps, chunks = None, [], []
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("shard", "one", "two", "fp", "chunk")]
            shard, one, two = cols[:3]
            new = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
            fp, chunk = cols[3].view(np.uint64).tolist(), cols[4].tolist()
            out: list[tuple[int, int]] = []
            for a, b in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows], strict=True):
                own = (int(shard[a]), int(one[a]), int(two[a]))
                if own != key:
                    if len(fps) > 1:
                        out += solve((fps, chunks, key))
                    key, fps, chunks = own, [], []
                fps += fp[a:b]
                chunks += chunk[a:b]
            if out:
                yield _batch(out)
        if len(fps) > 1:
            yield _batch(solve((fps, chunks, key)))

    def _batch(pairs):
        both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=_LINKS)

    return run


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD, edges: bool = False) -> DataFrame:
    """Links (a, b) whose classes are those of all links between the distinct values ``nodes.fp``.

    With ``edges`` each of them is a pair within the radius; else b may be reached from a by several.
    """
    tables = tables_for(nodes.count(), radius, shard // 2)
    members = nodes.select("fp", F.explode(_shard_keys(tables)).alias("shard"))
    large = members.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > shard)
    sized = members.join(large, "shard", "left").withColumn("chunks", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(shard)).cast("int"))
    own = sized.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    groups = dealt.select("shard", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "fp", "chunk")
    groups = groups.repartition(common.partitions_for(nodes), "shard", "one", "two").sortWithinPartitions("shard", "one", "two")
    return groups.mapInArrow(_link_groups(radius, edges), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Large-star and small-star by turns, until a step changes nothing.  Each step is an aggregation
    with map-side combine and a join that can be split where one node has many links.
    """
    mark = common.made()
    edges = common.materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before, now = None, sign(edges)
    while now[0] and now != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = common.materialise(large, "large-star")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = common.materialise(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        common.forget(mark, edges)
        before, now = now, sign(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def component_of(hashed: DataFrame, first, radius: int = RADIUS) -> DataFrame:
    """(fp, best) for each distinct ``fp``: the smallest value of the expression ``first`` in its component."""
    nodes = common.materialise(hashed.groupBy("fp").agg(F.min(first).alias("own")), "fingerprints")
    linked = components(fingerprint_links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = common.materialise(linked.join(nodes, "fp"), "components")
    best = linked.groupBy("root").agg(F.min("own").alias("best"))
    better = linked.join(best, "root").select("fp", "best")
    return nodes.join(better, "fp", "left").select("fp", F.coalesce("best", "own").alias("best"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``."""
    common.prepare(docs.sparkSession)
    hashed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprint(F.col(text).cast("string")).alias("fp"))
    hashed = common.materialise(hashed, "hashed")
    # Written, so that the join's sides are both shuffled and a hot fingerprint's rows can be split among tasks.
    found = hashed.join(common.materialise(component_of(hashed, F.col("doc_id"), radius), "component-of"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best").alias("component_id"))

