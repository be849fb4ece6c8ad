"""Operator 3: exact top-k search by inner product, with multi-resolution segment statistics.

A vector is cut into segments, of which the mean and the deviation are kept.  For a segment of l
components  <q, x> <= l (mean_q mean_x + dev_q dev_x)  (Cauchy-Schwarz around the means), so sums
over segments bound the score from above, as they bound the distance |q|^2 + |x|^2 - 2 <q, x> from
below.  Each pair passes a coarse bound, then a finer one, and its exact score is computed only if
both reach the query's threshold, its k-th best score so far; first thresholds come from a bounded
set of rows, and only what can be dropped depends on them, never the result.

Scores are of whole numbers, so a float64 product is exact while the product of two norms stays below
2^52; the other pairs are never dropped by a bound and are computed with Python's integers.  A score outside
+-(2^63 - 1) counts as that end of the range, and ties with the others there.

Queries are written to a table once, dealt into blocks of about BLOCK_BYTES.  One block at a time comes to the driver
and is broadcast; a pass over the candidates answers it, its best rows are written, and the broadcast is
destroyed before the next one.  Every task returns at most k rows for a query.

Defined results: vectors that are null, hold null or non-finite components or have a null id take no
part; only vectors of equal length are compared, very long ones like others; rows with equal id and score count
once, equal scores go to the smaller id; an id is never its own candidate; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE, K = 1024, 10
LEVELS = (4, 16)
#: Bytes of queries in one broadcast, and rows from which the first thresholds come.
BLOCK_BYTES, SEED_ROWS = 16 << 20, 1024
#: Pairs that are bounded at once.
PAIRS = 1 << 20

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


#: Ends of the range of scores, and norms whose product makes float64 scores exact.
MOST, EXACT = 2**63 - 1, 2.0**52


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as float64: whole numbers, infinite where the product overflows."""
    with np.errstate(over="ignore"):
        return np.floor(values.astype(np.float64) * scale)


def whole_numbers(row: np.ndarray, scale: int = SCALE) -> list[int]:
    """floor(scale * x) as Python's integers, of finite numbers."""
    return [math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in row.tolist()]


def norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt((x**2).sum(axis=1))


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of segments, weighted so that a product of two rows is the bound."""
    d = x.shape[1]
    if not d:
        return np.zeros((len(x), 1))
    bounds = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int))
    length = np.diff(bounds)
    mean = np.add.reduceat(x, bounds[:-1], axis=1) / length
    dev = np.sqrt(np.maximum(np.add.reduceat(x * x, bounds[:-1], axis=1) / length - mean**2, 0))
    return np.concatenate([mean * np.sqrt(length), dev * np.sqrt(length)], axis=1)


class Search:
    """The k best rows for each query of one length, over batches of candidates.  Vectors come as they are, before scaling."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, scale: int = SCALE, threshold: np.ndarray | None = None):
        self.ids, self.vectors, self.k, self.scale, self.d = ids, vectors, k, scale, vectors.shape[1]
        self.queries = scaled(vectors, scale)
        self.norm = norms(self.queries)
        self.features = [self._features(self.queries, self.norm, s) for s in LEVELS]
        self.threshold = np.full(len(ids), -MOST - 1, np.int64) if threshold is None else threshold.copy()
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0
        self.bounded = self.exact = 0

    @staticmethod
    def _features(x: np.ndarray, norm: np.ndarray, segments: int) -> np.ndarray:
        """Features of rows that a bound can be taken of; the others have zeros."""
        return segment_features(np.where((norm < EXACT)[:, None], x, 0.0), segments)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, PAIRS // max(1, len(self.ids)))
        for a in range(0, len(ids), step):
            self._add(ids[a : a + step], vectors[a : a + step])

    def _add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        shape = len(self.ids), len(ids)
        x = scaled(vectors, self.scale)
        norm = norms(x)
        with np.errstate(over="ignore", invalid="ignore"):
            both = np.outer(self.norm, norm)
        plain = both < EXACT  # false for what is infinite or not a number
        # What rounding can take from a bound; scores are whole numbers.
        need = self.threshold.astype(np.float64)[:, None] - 1e-6 * (np.where(plain, both, 0.0) + 1)
        coarse, fine = (self._features(x, norm, s) for s in LEVELS)
        q, c = np.nonzero(plain & (self.features[0] @ coarse.T >= need))
        ok = self._products(self.features[1], fine, q, c, shape) >= need[q, c]
        q, c = q[ok], c[ok]
        score = self._products(np.where(np.isfinite(self.queries), self.queries, 0.0), np.where(np.isfinite(x), x, 0.0), q, c, shape).astype(np.int64)
        self.bounded += shape[0] * shape[1]
        self.exact += len(q)
        if not plain.all():
            more_q, more_c = np.nonzero(~plain)
            q, c = np.concatenate([q, more_q]), np.concatenate([c, more_c])
            score = np.concatenate([score, self._long_products(vectors, more_q, more_c)])
        ok = (score >= self.threshold[q]) & (self.ids[q] != ids[c])
        if ok.any():
            self.found.append((q[ok], ids[c[ok]], score[ok]))
            self.pending += int(ok.sum())
            if self.pending > 4 * self.k * len(self.ids) or not (self.threshold >= -MOST).all():
                self.best()

    @staticmethod
    def _products(a: np.ndarray, b: np.ndarray, q: np.ndarray, c: np.ndarray, shape) -> np.ndarray:
        """Products of the pairs (q, c): all at once where most are wanted."""
        if len(q) > shape[0] * shape[1] // 20:
            with np.errstate(over="ignore", invalid="ignore"):
                return (a @ b.T)[q, c]
        return np.einsum("ij,ij->i", a[q], b[c])

    def _long_products(self, vectors: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Scores of pairs too large for float64, brought into the range of scores."""
        left = {i: whole_numbers(self.vectors[i], self.scale) for i in set(q.tolist())}
        right = {j: whole_numbers(vectors[j], self.scale) for j in set(c.tolist())}
        products = (sum(map(int.__mul__, left[i], right[j])) for i, j in zip(q.tolist(), c.tolist(), strict=True))
        return np.array([max(-MOST, min(MOST, s)) for s in products], np.int64)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query's place, id and score of the k best so far; raises the thresholds."""
        if not self.found:
            return (np.array([], np.int64),) * 3
        q, i, s = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1]) | (s[1:] != s[:-1])
        q, i, s = q[new], i[new], s[new]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.threshold[q[last]] = np.maximum(self.threshold[q[last]], s[last])
        own = rank < self.k
        self.found = [(q[own], i[own], s[own])]
        self.pending = int(own.sum())
        return self.found[0]


def _matrices(ids, vectors):
    """{length: (ids, matrix)} of rows whose vectors are lists."""
    by: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vectors, strict=True):
        own = by.setdefault(len(v), ([], []))
        own[0].append(i)
        own[1].append(v)
    return {d: (np.array(i, np.int64), np.array(v, np.float64).reshape(len(i), d)) for d, (i, v) in by.items()}


def _search(shared, k: int, scale: int):
    def run(batches):
        searches = {d: Search(ids, queries, k, scale, threshold) for d, (ids, queries, threshold) in shared.value.items()}
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            length = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy()
            if len(length) and (length == length[0]).all():
                parts = {int(length[0]): (ids, flat.reshape(len(ids), -1) if length[0] else np.zeros((len(ids), 0)))}
            else:
                parts = _matrices(ids.tolist(), vectors.to_pylist())
            for d, (i, x) in parts.items():
                if d in searches:
                    searches[d].add(i, x)
        for s in searches.values():
            q, i, score = s.best()
            yield pa.RecordBatch.from_arrays([pa.array(s.ids[q]), pa.array(i), pa.array(score)], schema=_FOUND)

    return run


def valid(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores, ties to the smaller vec_id."""
    spark = candidates.sparkSession
    common.prepare(spark)
    rows = valid(candidates, vec_id, vector)
    wanted = common.materialise(valid(queries, vec_id, vector).distinct(), "queries")
    n, d = wanted.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    blocks = max(1, -(-n * (8 * d + 8) // block_bytes))
    if blocks > 1:  # sorted by block, so that a block's rows are read alone
        dealt = wanted.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)))
        wanted = common.materialise(dealt.repartitionByRange(common.partitions_for(dealt), "block", "vec_id").sortWithinPartitions("block"), "query-blocks")
    seeds = _matrices(*map(list, zip(*[(r.vec_id, r.x) for r in rows.limit(SEED_ROWS).collect()]))) if n else {}
    parts = []
    for b in range(blocks):
        own = wanted.filter(F.col("block") == b) if blocks > 1 else wanted
        block = [(r.vec_id, r.x) for r in own.collect()]
        state = {}
        for dim, (ids, x) in _matrices(*map(list, zip(*block))).items() if block else ():
            first = Search(ids, x, k, scale)
            if dim in seeds:
                first.add(*seeds[dim])
                first.best()
            state[dim] = ids, x, first.threshold
        shared = spark.sparkContext.broadcast(state)
        parts.append(common.materialise(rows.mapInArrow(_search(shared, k, scale), "query_id long, vec_id long, score long"), "found"))
        shared.destroy()
    found = parts[0] if blocks == 1 else spark.read.schema(parts[0].schema).parquet(*[p for part in parts for p in part.inputFiles()])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
