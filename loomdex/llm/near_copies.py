"""Operator 6 by similarity: SimHash and BK-trees first, then whatever their radius can't reach, every link exact.

Two texts are linked if their sets of five-word shingles have a Jaccard index of PERCENT % or more; words and
shingles are those of ``simhash``, and equal sets are one node.  Three sources name candidate pairs:

* nodes whose five-word fingerprints lie within RADIUS bits, found by the BK-trees of ``simhash``;
* neighbours by size among the sets that share a rare shingle, then the nearest of another class;
* all other pairs of such sets that the links so far leave apart.

The last loses no pair: under one order of all shingles, two sets that share at least PERCENT % of either
have their first common shingle within the first n - ceil(PERCENT n / 100) + 1 shingles of both, so sets are
grouped by each of those.  Shingles that are frequent in a sample come last in the order, so that common
lines make no groups.  A pair is linked only if its whole texts, read again, are similar enough.

The links so far make large groups of near copies one class at little more than their size; only groups that still
hold several classes are compared across classes, in chunks of at most CHUNK, by their sizes and parities: a set's
parity is one bit for each of L places (two to four times its size), and two parities differ in no more places than
the sets in shingles.  What passes is verified on the texts.

Each plan costs the driver memory that its JVM keeps (generated and compiled code, statuses, threads), however few its rows.
So up to BLOCK links are made classes by one task, and a comparison across classes without any mixed group is not planned.

Shingles of a prefix travel as arrays, one row for each task and bucket (``_signatures``); equal sets
within a task go once, so a text that a third of all rows share costs one entry a task.

A set is named by 64 bits of its XXH128, and shingles are compared as 64-bit hashes.

Defined results: texts without a word (null ones too) are copies of each other and of nothing else; of repeated
rows the first of the written table stays, a null doc_id comes last; whole texts of any length are compared
(a very long one costs a batch's memory); extra columns, whatever their names, pass through untouched; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .simhash import components, fingerprint_links, fingerprints_of, shingle_hashes

WORDS, PERCENT = 5, 80
#: Rows of a group that one task compares with another chunk, and bits that BK-trees follow.
CHUNK, RADIUS = 16_384, 4
#: Groups of more rows are first joined by the nearest of another class.
LARGE = 64
#: Bounds of the sample that finds frequent shingles: texts, and shingles kept.  They decide speed only.
SAMPLE, FREQUENT = 10_000, 65_536
#: Shingles that a task packs before it sends them on.
FLUSH = 1 << 17
#: Links whose classes one task finds; more take the star steps of ``simhash.components``.
BLOCK = 1 << 18
#: Fewest parity bits of a set.
_PARITY = 512

_ROW = T.StructType([T.StructField("name", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("bits", T.BinaryType())])
_SIGNATURES = "bucket int, sigs array<long>, nodes array<long>, codes array<int>"


def shingle_set(text: str | None) -> np.ndarray:
    """The text's distinct shingles as sorted uint64."""
    return np.unique(np.array(shingle_hashes(text, WORDS), np.uint64))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


#: Steps of a place within its set that travel beside the size.
_PLACES = 4096


def size_code(n: np.ndarray) -> np.ndarray:
    """Sizes as eighths of steps of 100 / PERCENT: similar sets differ by 8 steps and a rounding at most."""
    return np.floor(8 * np.log(np.maximum(n, 1)) / np.log(100 / PERCENT)).astype(np.int32)


def place_codes(n: int, prefix: int) -> np.ndarray:
    """The size code of a set and, in the last digits, how far into it each shingle of its prefix lies (rounded down)."""
    return size_code(np.array(n)) * _PLACES + (np.arange(prefix) * _PLACES // max(n, 1)).astype(np.int32)


def set_name(own: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh128_digest(own.tobytes()), np.int64)[0])


def _parity(own: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls on each of L places; L is a power of two, twice their number at least."""
    places = max(_PARITY, 1 << (2 * len(own) - 1).bit_length()) if len(own) else _PARITY
    return np.packbits(np.bincount((own % np.uint64(places)).astype(np.int64), minlength=places).astype(np.uint8) & 1).tobytes()


def apart(one: bytes, two: bytes) -> int:
    """Places at which two parities differ: no more than there are shingles in just one of the sets.  The longer is folded."""
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


@F.pandas_udf(T.BooleanType())
def _close(one: pd.Series, two: pd.Series, sizes: pd.Series) -> pd.Series:
    """Whether so few places differ that sets of these sizes together can be similar enough."""
    return pd.Series([(100 + PERCENT) * apart(a, b) <= (100 - PERCENT) * n for a, b, n in zip(one, two, sizes, strict=True)], dtype=bool)


@F.pandas_udf(_ROW)
def _named(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Name and size of a text's set, its fingerprint, and its parity."""
    for x in texts:
        rows = []
        for i in range(0, len(x), 32):
            hashes = [shingle_hashes(t, WORDS) for t in x.iloc[i : i + 32]]
            for h, fp in zip(hashes, fingerprints_of(hashes).view(np.int64).tolist(), strict=True):
                own = np.unique(np.array(h, np.uint64))
                rows.append((set_name(own), len(own), fp, _parity(own)))
        yield pd.DataFrame(rows, columns=["name", "n", "fp", "bits"])
    common.give_back()


@F.pandas_udf(T.ArrayType(T.LongType()))
def _whole_set(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in texts:
        yield pd.Series([shingle_set(t).view(np.int64) for t in x], dtype=object)


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that several texts of a bounded sample share, and how many share each."""
    some = texts.sample(min(1.0, SAMPLE / max(1, texts.count())), seed=1)
    counts = some.select(F.explode(_whole_set("text")).alias("g")).groupBy("g").agg(F.count("*").alias("c")).filter("c > 1")
    rows = counts.orderBy(F.desc("c"), "g").limit(FREQUENT).collect()
    found = np.array([r.g for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r.c for r in rows], np.int64)[order]


def _prefix(own: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The start of a set under the order of all shingles, frequent ones last."""
    k = prefix_length(len(own))
    if len(frequent) and len(own):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        own = own[np.lexsort((own, np.where(frequent[at] == own, rank[at], 0)))]
    return own[:k]


def _signatures(shared, buckets: int):
    """(bucket, shingles, names, codes of size and place) of the prefixes of a task's distinct sets, a row for each bucket."""

    def flush(held):
        sig, name, code = (np.concatenate(c) for c in zip(*held))
        bucket = (sig % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        ends = pa.array([*cut.tolist(), len(order)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (sig.view(np.int64), name, code)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[order][cut]), *lists], names=["bucket", "sigs", "nodes", "codes"])

    def run(batches):
        frequent, rank = shared.value
        held, size, seen = [], 0, set()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name in seen:
                    continue
                seen.add(name)
                own = shingle_set(text)
                first = _prefix(own, frequent, rank)
                if len(first):
                    held.append((first, np.full(len(first), name, np.int64), place_codes(len(own), len(first))))
                    size += len(first)
                if size >= FLUSH:
                    yield flush(held)
                    held, size, seen = [], 0, set()
        if held:
            yield flush(held)
        common.give_back()

    return run


def _runs(batches):
    """Batches of sorted rows with the last row of the one before in front, and where a row follows a like one.

    A row that repeats the one before (a set that several tasks sent) is left out.
    """
    last = None
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if not len(cols[0]):
            continue
        if last is not None:
            cols = [np.concatenate([[x], c]) for x, c in zip(last, cols, strict=True)]
        last = [c[-1] for c in cols]
        new = np.ones(len(cols[0]), bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        yield [c[new] for c in cols]


def _shared(batches):
    """The rows (sig, node, code) that have a neighbour of the same sig and a similar size, with the one before; they come sorted by all three."""
    names = ["sig", "node", "code", "before"]
    held, own = None, (False, 0)  # the last row, whether the one before it is its neighbour, and which
    for sig, node, code in _runs(batches):
        size = code // _PLACES
        pair = (sig[1:] == sig[:-1]) & (size[1:] - size[:-1] <= 9)
        has = np.concatenate([[own[0]], pair])
        before = np.concatenate([[own[1]], node[:-1]])
        out = has | np.concatenate([pair, [False]])
        held, own = (sig[-1:], node[-1:], code[-1:]), (bool(has[-1]), before[-1])
        out[-1] = False  # it comes again, with what follows it
        if out.any():
            yield pa.RecordBatch.from_arrays([*(pa.array(c[out]) for c in (sig, node, code)), pa.array(before[out], mask=~has[out])], names=names)
    if held is not None and own[0]:
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in held), pa.array([own[1]], pa.int64())], names=names)


def _folded(bits: np.ndarray) -> np.ndarray:
    """Rows of parities over half as many places."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def _close_pairs(rows, left: np.ndarray, right: np.ndarray, same: bool, closest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of different classes, one in ``left`` and one in ``right``, that can be similar by their sizes, places and parities.

    Rows of the most frequent class are only compared with the others.  ``closest`` gives each of the others its nearest alone.
    If this shingle is the first that both prefixes share, what stands before it is in just one of the sets; a pair for
    which that is too much meets again, at its first shared shingle.
    """
    node, n, kind, code, bits = rows
    after = n - n * (code % _PLACES) // _PLACES  # shingles from this one on, or a few more
    kinds, counts = np.unique(kind[np.union1d(left, right)], return_counts=True)
    most = kinds[counts.argmax()]

    def found(i, own, others):
        sizes = n[others] + n[i]
        ok = (kind[others] != kind[i]) & (100 * np.minimum(n[others], n[i]) >= PERCENT * np.maximum(n[others], n[i]))
        near = np.flatnonzero(ok & ((100 + PERCENT) * np.minimum(after[others], after[i]) >= PERCENT * sizes))
        if len(near):
            apart = np.bitwise_count(own ^ place[others[near]]).sum(axis=1, dtype=np.int64)
            within = (100 + PERCENT) * apart <= (100 - PERCENT) * sizes[near]
            near, apart = near[within], apart[within]
        if len(near):
            near = near[[apart.argmin()]] if closest else near
            yield np.full(len(near), node[i]), node[others[near]]

    width = np.fromiter(map(len, bits), np.int64, len(bits))
    for w in np.unique(width):
        # Sizes of similar sets differ by a quarter at most, so their parities by one doubling.
        near_width = np.flatnonzero((width == w) | (width == 2 * w))
        place = np.zeros((len(bits), w // 8), np.uint64)
        for own in (w, 2 * w):
            at = near_width[width[near_width] == own]
            if len(at):
                matrix = np.frombuffer(b"".join([bits[i] for i in at]), np.uint8).reshape(len(at), own)
                place[at] = (matrix if own == w else _folded(matrix)).copy().view(np.uint64)
        usable = np.zeros(len(bits), bool)
        usable[near_width] = True
        first = width == w  # pairs of two wider ones wait for their own width
        for a, b in ((left, right),) if same else ((left, right), (right, left)):
            for i in a[usable[a] & (kind[a] != most)]:
                others = b[usable[b] & (first[b] | first[i])]
                if same:
                    others = others[(kind[others] == most) | (others > i)]
                elif a is right:
                    others = others[kind[others] == most]  # the rest was compared from the left
                yield from found(i, place[i], others)


def _across(closest: bool):
    """Pairs of ``_close_pairs`` within a chunk, or of two chunks; rows come sorted by (sig, one, two)."""

    def pairs(rows):
        node, n, kind, code, chunk, bits = rows[3:]
        one, two = rows[1][0], rows[2][0]
        left = np.flatnonzero(chunk == one)
        held, count = [], 0
        for pair in _close_pairs((node, n.astype(np.int64), kind, code.astype(np.int64), bits), left, left if one == two else np.flatnonzero(chunk == two), one == two, closest):
            held.append(pair)
            count += len(pair[0])
            if count > 50_000:
                yield _pairs_batch(held)
                held, count = [], 0
        if held:
            yield _pairs_batch(held)

    def run(batches):
        held = None
        for batch in batches:
            cols = [np.array(c.to_pylist(), object) if k == 8 else c.to_numpy() for k, c in enumerate(batch.columns)]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            new = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])])
            cut = np.flatnonzero(new)
            for a, b in zip(cut, cut[1:]):
                yield from pairs([c[a:b] for c in cols])
            held = [c[cut[-1] :] for c in cols]
        if held is not None:
            yield from pairs(held)

    return run


def _pairs_batch(held):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["a", "b"])


def _roots(batches):
    """(node, root) for every node of the links (a, b), which come to one task: trees hook to the smallest root beside them until none can."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not sum(len(a) for a, _ in held):
        return
    nodes, ends = np.unique(np.concatenate([np.concatenate(x) for x in zip(*held)]), return_inverse=True)
    one, two = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(one):
        low = np.minimum(root[one], root[two])
        np.minimum.at(root, np.concatenate([root[one], root[two]]), np.concatenate([low, low]))
        while (above := root[root]).tobytes() != root.tobytes():
            root = above
        open_ = root[one] != root[two]
        one, two = one[open_], two[open_]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])
    common.give_back()


def classes_of(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), as ``components`` gives them; a written table."""
    mark = common.made()
    links = common.materialise(_in_order(links).distinct(), "links")
    few = links.count() <= BLOCK
    out = common.materialise(links.coalesce(1).mapInArrow(_roots, "node long, root long") if few else components(links), "classes")
    common.forget(mark, out)
    return out


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")


def by_signatures(whole: DataFrame) -> DataFrame:
    """(sig, node, code, before): the sets that share a shingle of both prefixes with a set of similar size, and the one before by size; a written table."""
    spark = whole.sparkSession
    buckets = common.partitions_for(whole)
    shared = spark.sparkContext.broadcast(frequent_shingles(whole.select(F.col("body").alias("text"))))
    packed = whole.select("name", "body").mapInArrow(_signatures(shared, buckets), _SIGNATURES)
    rows = packed.repartitionById(buckets, "bucket").select(F.explode(F.arrays_zip("sigs", "nodes", "codes")).alias("r"))
    spelt = rows.select(F.col("r.sigs").alias("sig"), F.col("r.nodes").alias("node"), F.col("r.codes").alias("code"))
    return common.materialise(spelt.sortWithinPartitions("sig", "code", "node").mapInArrow(_shared, "sig long, node long, code int, before long"), "groups")


def within_radius(own: DataFrame) -> DataFrame:
    """Candidate pairs of nodes by fingerprints: equal ones with the smallest node of theirs, and those BK-trees link."""
    first = common.materialise(own.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("c")), "fingerprints")
    equal = own.join(first.filter("c > 1"), "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    linked = fingerprint_links(first.select("fp"), RADIUS, edges=True).distinct()
    for c in "ab":
        linked = linked.join(first.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}")), c)
    return equal.unionByName(linked.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def across_classes(groups: DataFrame, classes: DataFrame, own: DataFrame, closest: bool) -> DataFrame | None:
    """Candidate pairs within groups that still hold several classes, None without such groups; ``closest``: in LARGE ones, at most one for each row."""
    kinds = common.materialise(groups.join(classes, "node", "left").select("sig", "node", "code", F.coalesce("root", "node").alias("kind")), "kinds")
    mixed = kinds.groupBy("sig").agg(F.min("kind").alias("low"), F.max("kind").alias("high"), F.count("*").alias("rows")).filter("low <> high")
    mixed = mixed.filter(F.col("rows") > LARGE) if closest else mixed
    mixed = common.materialise(mixed.select("sig", F.ceil(F.col("rows") / CHUNK).cast("int").alias("chunks")), "mixed")  # written, so its size is known
    if mixed.isEmpty():
        return None
    rows = kinds.join(mixed, "sig").join(own.select("node", "n", "bits"), "node").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("sig", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "node", "n", "kind", "code", "chunk", "bits")
    dealt = dealt.repartition(common.partitions_for(groups), "sig", "one", "two").sortWithinPartitions("sig", "one", "two")
    return dealt.mapInArrow(_across(closest), "a long, b long")


@F.pandas_udf(T.BooleanType())
def _similar(one: pd.Series, two: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(one, two, strict=True):
        a, b = shingle_set(a), shingle_set(b)
        both = len(np.intersect1d(a, b, assume_unique=True))
        out.append(100 * both >= PERCENT * (len(a) + len(b) - both))
    return pd.Series(out, dtype=bool)


def verified(pairs: DataFrame, own: DataFrame, whole: DataFrame, name: str, judged: bool = False) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts are similar enough; a written table.

    Sizes and parities (two to four bits a shingle) drop nearly all others before any text is read, unless the pairs
    were ``judged`` by them already.
    """
    pairs = _in_order(pairs).distinct()
    if not judged:
        for c in "ab":
            pairs = pairs.join(own.select(F.col("node").alias(c), F.col("n").alias(f"_n{c}"), F.col("bits").alias(f"_bits{c}")), c)
        alike = (100 * F.least("_na", "_nb") >= PERCENT * F.greatest("_na", "_nb")) & (F.least("_na", "_nb") > 0)
        pairs = pairs.filter(alike).filter(_close("_bitsa", "_bitsb", F.col("_na") + F.col("_nb")))
    pairs = common.materialise(pairs.select("a", "b"), f"{name}-pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    nodes = common.materialise(own.join(nodes, "node", "left_semi").select("at", "node"), f"{name}-nodes")  # written, so its size is known
    texts = common.materialise(whole.select("at", "body").join(nodes, "at").select("node", "body"), f"{name}-texts")
    one, two = (texts.select(F.col("node").alias(c), F.col("body").alias(f"_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b")
    return common.materialise(both.filter(_similar("_a", "_b")).select("a", "b"), name)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component of similar texts the row with the smallest doc_id stays."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("id"), _named(F.col(f"`{text}`").cast("string")).alias("set"))
    rows = common.materialise(rows.withColumn("at", F.monotonically_increasing_id()), "named-rows")
    whole = rows.select("at", "set.name", F.col(f"row.`{text}`").cast("string").alias("body"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("at").alias("at"), "set.n", "set.fp", "set.bits")).alias("first")
    own = rows.groupBy(F.col("set.name").alias("node")).agg(first, F.count("*").alias("c"))
    own = common.materialise(own.select("node", "c", F.struct("first.none", "first.id", "first.at").alias("own"), "first.at", "first.n", "first.fp", "first.bits"), "nodes")
    groups = by_signatures(whole)
    mark = common.made()
    near = groups.filter("before is not null").select(F.col("node").alias("a"), F.col("before").alias("b"))
    near = verified(within_radius(own).unionByName(near), own, whole, "near")
    common.forget(mark, near)
    links, classes = near, classes_of(near)
    for closest in (True, False):  # the first makes nearly all that is similar one class, the second loses nothing
        mark = common.made()
        pairs = across_classes(groups, classes, own, closest)
        more = verified(pairs, own, whole, "closest" if closest else "rest", judged=True) if pairs is not None else None
        common.forget(mark, more)
        if more is not None:
            links = links.unionByName(more)
            classes = classes_of(links)
    linked = common.materialise(classes.join(own.select("node", "own"), "node"), "components")
    best = linked.groupBy("root").agg(F.min("own").alias("best"))
    better = linked.join(best, "root").select("node", "best")
    chosen = own.join(better, "node", "left").select("node", "c", "own", F.coalesce("best", "own").alias("best"))
    # Written, so that the join's sides are both shuffled and a hot set's rows can be split among tasks.
    chosen = common.materialise(chosen.filter("c > 1 or best.at <> own.at").select("node", F.col("best.at").alias("kept")), "chosen")
    dropped = rows.select("at", F.col("set.name").alias("node")).join(chosen, "node").filter("at <> kept").select("at")
    dropped = common.materialise(dropped, "dropped")  # written, so its size is known when the join is planned
    return rows.join(dropped, "at", "left_anti").select("row.*")
