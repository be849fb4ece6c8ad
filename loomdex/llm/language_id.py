"""Operator 5: language identification by sparse multinomial logistic regression.

Features are character 1- to 3-grams of the whole text in lower case (what isn't a letter is one
space), hashed into 2^BITS columns, with log counts, inverse document frequencies and unit length.
Weights are learnt by follow-the-regularised-leader (per-coordinate rates) with elastic-net
penalties, the L1 part of which keeps most of them at exactly zero; a temperature, fitted on texts
that the weights haven't seen, calibrates the probabilities.  Only weights that aren't zero are kept, row by row
(``Sparse``), and broadcast: at most 2^BITS x LANGUAGES of 6 bytes, in practice about one in a hundred of them.

Learning takes a bounded sample outside the held-out fold: the LANGUAGES with most documents, of each at most
PER_LANGUAGE of them, TOTAL in all, those with the smallest hash of their id.  Their n-gram counts come to the
driver, as many bytes as the sample has distinct n-grams; the sums that are learnt hold 2^BITS x LANGUAGES
numbers at most (two arrays of 34 MB).  Predictions are a map.

Defined results: ``und`` with a score of 0 for null texts, texts without any letter, and where there is
no labelled document to learn from; equal probabilities give the language that comes first in the alphabet; very long
texts are read whole, in memory of about forty times their characters; repeated rows are predicted each; null
languages and ids aren't learnt from; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .sampling import fold, sampled_texts, thinned

FOLDS, HELD_OUT = 4, 2
#: Bounds of what is learnt from: documents of a language, documents, languages.
PER_LANGUAGE, TOTAL, LANGUAGES = 600, 6_000, 128
BITS = 15
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 2e-3, 1e-4, 3
UNKNOWN = "und"

#: Whether a code point below 0x250 is a letter; beyond, all but general and CJK punctuation counts as one.
_LETTER = np.array([chr(c).isalpha() for c in range(0x250)])
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns and counts of the n-grams of a whole text."""
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32).copy()
    low = code < 0x250
    letter = np.where(low, _LETTER[np.where(low, code, 0)], ((code < 0x2000) | (code > 0x206F)) & ((code < 0x3000) | (code > 0x303F)))
    code[~letter] = 32
    code = code[letter | np.concatenate([[True], letter[:-1]])]
    one = code * _MIX[0]
    two = (one[:-1] ^ (code[1:] * _MIX[1])) * np.uint32(0x27D4EB2F) + np.uint32(2)
    three = (two[:-1] ^ (code[2:] * _MIX[2])) * np.uint32(0x165667B1) + np.uint32(3)
    h = np.concatenate([one, two, three])
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    counts = np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    columns = np.flatnonzero(counts)
    return columns, counts[columns]


class Sparse:
    """A matrix without its zeros: of the rows that have others (``rows``), runs of columns and values."""

    def __init__(self, dense: np.ndarray):
        row, column = np.nonzero(dense)
        self.width = dense.shape[1]
        self.rows, starts = np.unique(row, return_index=True)
        self.begin = np.append(starts, len(row))
        self.column, self.value = column.astype(np.int16), dense[row, column].astype(np.float32)

    def times(self, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The product of a sparse vector with the matrix; ``columns`` are the vector's places, in order."""
        if not len(self.rows):
            return np.zeros(self.width)
        at = np.minimum(np.searchsorted(self.rows, columns), len(self.rows) - 1)
        hit = self.rows[at] == columns
        at = at[hit]
        size = self.begin[at + 1] - self.begin[at]
        each = np.repeat(self.begin[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.column[each], weights=self.value[each] * np.repeat(values[hit], size), minlength=self.width)


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: Sparse, bias: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature

    def values(self, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf[columns]
        return v / max(1e-12, float(np.sqrt((v * v).sum())))

    def logits(self, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.weights.times(columns, self.values(columns, counts)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*ngram_counts(text)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


class Leader:
    """FTRL-proximal: weights are a closed form of the sums ``z`` and ``n`` of gradients."""

    def __init__(self, shape: tuple[int, ...]):
        self.z, self.n = np.zeros(shape), np.zeros(shape)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at, g: np.ndarray, w: np.ndarray) -> None:
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]]) -> Model:
    """``rows``: columns, counts, language; every fifth row only fits the temperature."""
    langs = sorted({r[2] for r in rows})
    size = 1 << BITS
    if not langs:
        return Model([], np.ones(size), Sparse(np.zeros((size, 0))), np.zeros(0), 1.0)
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    known = [r for i, r in enumerate(rows) if i % 5 != 4]
    df = np.zeros(size)
    for columns, _, _ in known:
        df[columns] += 1
    model = Model(langs, np.log((1 + len(known)) / (1 + df)) + 1, Sparse(np.zeros((size, len(langs)))), np.zeros(len(langs)), 1.0)
    w, b = Leader((size, len(langs))), Leader((len(langs),))
    rng = np.random.default_rng(0)
    prepared = [(c, model.values(c, n), langs.index(y)) for c, n, y in known]
    for _ in range(EPOCHS):
        for i in rng.permutation(len(prepared)):
            columns, v, y = prepared[i]
            own, bias = w.weights(columns), b.weights()
            g = softmax(v @ own + bias)
            g[y] -= 1
            w.update(columns, v[:, None] * g, own)
            b.update(slice(None), g, bias)
    model.weights, model.bias = Sparse(w.weights()), b.weights()
    logits = [(model.logits(c, n), langs.index(y)) for c, n, y in held or known]
    loss = lambda t: -sum(np.log(max(1e-12, softmax(x / t)[y])) for x, y in logits)
    model.temperature = float(min(np.geomspace(0.05, 10, 60), key=loss))
    return model


@F.pandas_udf(T.StructType([T.StructField("columns", T.BinaryType()), T.StructField("counts", T.BinaryType())]))
def _ngrams(texts: pd.Series) -> pd.DataFrame:
    found = [ngram_counts(x or "") for x in texts]
    return pd.DataFrame({"columns": [c.astype(np.uint16).tobytes() for c, _ in found], "counts": [n.astype(np.uint32).tobytes() for _, n in found]})


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", folds: int = FOLDS, held_out: int = HELD_OUT, per_language: int = PER_LANGUAGE, total: int = TOTAL, languages: int = LANGUAGES) -> Model:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter((fold("doc_id", folds) != held_out) & F.col("lang").isNotNull())
    rows = thinned(rows, per_language, ["lang"], languages).withColumn("h", F.xxhash64("doc_id"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    sample = rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language).orderBy("k", "h", "lang").limit(total).select("doc_id", "lang").distinct()
    known = sampled_texts(docs, sample, "lang", text, doc_id).select("doc_id", "lang", _ngrams("text").alias("x"))
    found = sorted((r.doc_id, r.lang, bytes(r.x["columns"]), bytes(r.x["counts"])) for r in known.collect())
    order_ = np.random.default_rng(1).permutation(len(found))
    return fit([(np.frombuffer(found[i][2], np.uint16).astype(np.int64), np.frombuffer(found[i][3], np.uint32).astype(np.int64), found[i][1]) for i in order_])


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text, lang, doc_id))

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in x], columns=["lang", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), predict(F.col(text).cast("string")).alias("p"))
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
