"""Operator 2: a quality classifier of histogram gradient-boosted trees over document statistics.

Each text gives FEATURES whole-text statistics (``statistics``).  Trees are grown level by level on
features cut into at most BINS bins: sums of gradients per (node, feature, bin) come from one
weighted count, and the best cut of each node is read from their running sums.  A forest is three
arrays (feature, threshold, leaf) of complete binary trees in heap order, and scoring walks all
rows through all trees at once with numpy.

The model learns on the driver from at most SAMPLE labelled rows outside the held-out fold, those
with the smallest hash of their id; only their statistics come to the driver.  Scores are a map over
the documents, without any shuffle.

Defined results: null texts score as empty ones; equal statistics score alike, so repeated rows do; of cuts with equal
gains the first feature's lowest is taken; very long texts are read whole, in memory of a few times their size;
labels other than 0 and 1 and null ids aren't learnt from; without any label all scores are 0.5; extra columns, whatever
their names, pass through ``keep_good`` untouched; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .sampling import fold, sampled_texts, thinned

#: Labelled rows that are learnt from at most.
SAMPLE = 20_000
THRESHOLD, FOLDS = 0.3, 5
TREES, DEPTH, RATE, BINS, L2, LEAST_ROWS = 80, 4, 0.15, 64, 1.0, 5

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b"|", b"#$%&*<>", b"\"'()-:;/"]
_CLASS = np.full(256, len(_CLASSES) + 1, np.int64)
_CLASS[128:] = len(_CLASSES)
for _k, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _k
_N_CLASSES = len(_CLASSES) + 2
FEATURES = _N_CLASSES + 10


def statistics(text: str | None) -> list[float]:
    """Sizes, shares of character classes, and shares of what repeats."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    classes = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=_N_CLASSES) / size
    lines = [x for x in text.split("\n") if x.strip()]
    triples = max(1, len(words) - 2)
    return [
        *classes.tolist(),
        math.log1p(len(words)),
        math.log1p(len(data)),
        sum(map(len, words)) / n,
        math.log1p(max(map(len, words), default=0)),
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:], words[2:]))) / triples,
        len(set(lines)) / max(1, len(lines)),
        math.log1p(len(lines)),
        len(words) / max(1, len(lines)),
    ]


def statistics_of(texts) -> np.ndarray:
    return np.array([statistics(x) for x in texts], np.float64).reshape(-1, FEATURES)


class Forest:
    """feature and threshold: (trees, inner nodes); leaf: (trees, leaves).  Right is ``x > threshold``."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees or not len(x):
            return np.full(len(x), self.base)
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(int(math.log2(inner + 1))):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.leaf[tree, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Forest:
    """Boost logistic loss; cuts lie between quantiles of each feature."""
    n, f = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    if not n or y.min() == y.max():
        share = (y.sum() + 1) / (n + 2) if n else 0.5
        return Forest(math.log(share / (1 - share)), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    base = math.log(y.mean() / (1 - y.mean()))
    forest = Forest(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    raw = np.full(n, base)
    at_feature = np.arange(f)[None, :]
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)  # within the level
        for level in range(depth):
            k = 2**level
            flat = ((node[:, None] * f + at_feature) * bins + binned).ravel()
            sums = [np.bincount(flat, weights=np.repeat(w, f), minlength=k * f * bins).reshape(k, f, bins) for w in (g, h, np.ones(n))]
            left = [np.cumsum(s, axis=2) for s in sums]
            total = [x_[:, :, -1:] for x_ in left]
            right = [a - b for a, b in zip(total, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + L2) + right[0] ** 2 / (right[1] + L2) - total[0] ** 2 / (total[1] + L2)
            gain[(left[2] < LEAST_ROWS) | (right[2] < LEAST_ROWS)] = 0
            best = gain.reshape(k, -1).argmax(axis=1)
            feature, cut = best // bins, best % bins
            split = gain.reshape(k, -1)[np.arange(k), best] > 1e-6
            at = k - 1 + np.arange(k)
            forest.feature[t, at] = np.where(split, feature, 0)
            forest.threshold[t, at] = [edges[j][c] if s and c < len(edges[j]) else np.inf for j, c, s in zip(feature, cut, split, strict=True)]
            own = forest.feature[t, at][node]
            node = 2 * node + (x[np.arange(n), own] > forest.threshold[t, at][node])
        gs, hs = (np.bincount(node, weights=w, minlength=leaves) for w in (g, h))
        forest.leaf[t] = -rate * gs / (hs + L2)
        raw += forest.leaf[t][node]
    return forest


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(x) for x in texts])


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", folds: int = FOLDS, sample: int = SAMPLE) -> Forest:
    """A forest from at most ``sample`` labelled rows outside fold 0."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.filter((fold("doc_id", folds) != 0) & F.col("label").isin(0, 1)).distinct()
    rows = thinned(rows, sample).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    known = sampled_texts(docs, rows, "label", text, doc_id).select("doc_id", "label", _statistics("text").alias("x"))
    found = sorted((r.doc_id, r.label, r.x) for r in known.collect())
    x = np.array([r[2] for r in found], np.float64).reshape(-1, FEATURES)
    return fit(x, np.array([r[1] for r in found], np.float64))


def scorer(docs: DataFrame, forest: Forest):
    """A function of a text column that gives scores; the forest's arrays are broadcast (a few tens of KB)."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf(T.DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in texts:
            yield pd.Series(shared.value.score(statistics_of(x)))

    return score


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    common.prepare(docs.sparkSession)
    score = scorer(docs, learn(docs, labels, text, doc_id))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), score(F.col(text).cast("string")).alias("score"))
    held_out = F.coalesce(fold("doc_id", FOLDS) == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that score at least THRESHOLD, with all their columns."""
    common.prepare(docs.sparkSession)
    score = scorer(docs, learn(docs, labels, text, doc_id))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), score(F.col(f"`{text}`").cast("string")).alias("score"))
    return whole.filter(F.col("score") >= THRESHOLD).select("row.*")
