import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import language_id, quality_classifier as qc, queries

from .texts import SCHEMA, frame

SF = "/root/testdata/sf0.01"
CLASHING = ["score", "row", "at", "fp", "length", "stats", "kept", "words"]


def test_forest_learns_a_step_and_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = ((x[:, 1] > 0.4) ^ (x[:, 3] > 0.7)).astype(float)
    forest = qc.fit(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97


def test_traversal_is_the_walk_of_each_tree():
    rng = np.random.default_rng(1)
    x = rng.random((50, 4))
    forest = qc.fit(x, (x[:, 0] > 0.5).astype(float), trees=7, depth=3)
    for i in range(50):
        total = forest.base
        for t in range(7):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(x[i, forest.feature[t, node]] > forest.threshold[t, node])
            total += forest.leaf[t, node - 7]
        assert np.isclose(total, forest.raw(x[i : i + 1])[0])


def brute_cut(x, g, h, edges):
    """The best (gain, feature, cut) over all features and all cuts, each sum taken anew."""
    score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + qc.L2)
    best = (0.0, None, None)
    for j in range(x.shape[1]):
        for cut in edges[j]:
            left, right = x[:, j] <= cut, x[:, j] > cut
            if min(left.sum(), right.sum()) >= qc.LEAST_ROWS:
                gain = score(left) + score(right) - score(np.ones(len(x), bool))
                if gain > best[0] + 1e-9:
                    best = (gain, j, cut)
    return best


def test_cuts_are_the_best_of_all():
    """Every node of a tree against a search over all features and cuts; leaves against their closed form."""
    rng = np.random.default_rng(7)
    for _ in range(8):
        n, depth, bins = 200, 3, 16
        x = np.round(rng.normal(size=(n, 4)), int(rng.integers(0, 3)))
        y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.5, n)) > 0).astype(float)
        forest = qc.fit(x, y, trees=1, depth=depth, rate=1.0, bins=bins)
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(4)]
        p = y.mean()
        g, h = p - y, np.full(n, p * (1 - p))
        at = np.zeros(n, int)
        for node in range(2**depth - 1):
            rows = at == node
            gain, j, cut = brute_cut(x[rows], g[rows], h[rows], edges)
            if j is None or gain <= 1e-6:
                assert not np.isfinite(forest.threshold[0, node])
            else:
                assert np.isclose(brute_cut(x[rows][:, [forest.feature[0, node]]], g[rows], h[rows], [[forest.threshold[0, node]]])[0], gain)
            at[rows] = 2 * node + 1 + (x[rows, forest.feature[0, node]] > forest.threshold[0, node])
        for leaf in range(2**depth):
            rows = at == 2**depth - 1 + leaf
            assert np.isclose(forest.leaf[0, leaf], -g[rows].sum() / (h[rows].sum() + qc.L2))


@pytest.mark.parametrize("y", [[], [1.0], [0.0, 0.0]])
def test_forests_of_one_class(y):
    forest = qc.fit(np.zeros((len(y), 3)), np.array(y))
    assert ((forest.score(np.zeros((2, 3))) >= 0) & (forest.score(np.zeros((2, 3))) <= 1)).all()


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = queries.op2_quality_classifier(spark, SF).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    auc = (good.score.values[:, None] > bad.score.values[None, :]).mean()
    assert auc > 0.97 and (good.predicted == 1).mean() > 0.98 and (bad.predicted == 0).mean() > 0.75


def test_classifier_on_edge_rows(spark):
    df = frame(spark)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, None), (3, None, None), (4, 7, None), (2, 1, None)], "doc_id long, quality int, text string")
    out = qc.classify(df, labels).collect()
    assert len(out) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert {r.doc_id for r in out if r.held_out} == {r.doc_id for r in df.filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()}
    kept = qc.keep_good(df, labels)
    assert kept.schema.fieldNames() == df.schema.fieldNames() and kept.count() == sum(r.predicted for r in out)
    empty = spark.createDataFrame([], SCHEMA)
    assert qc.classify(empty, labels).count() == 0 and qc.keep_good(empty, labels).count() == 0
    assert {r.score for r in qc.classify(df, labels.limit(0)).collect()} == {0.5}


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = queries.op5_language_id(spark, SF).join(docs, "doc_id")
    r = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert r.n > 200 and r.a > 0.99


def test_languages_on_edge_rows(spark):
    df = frame(spark)
    out = {r.doc_id: r for r in language_id.identify(df).filter("doc_id is not null").collect()}
    assert {i for i, r in out.items() if r.lang_pred == "und"} == {0, 1, 2, 11} and out[0].score == 0
    assert all(0 <= r.score <= 1 for r in out.values()) and {r.lang_pred for r in out.values()} <= {"en", "fr", "und"}
    assert language_id.identify(df).count() == df.count()
    assert language_id.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.lang_pred for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_penalties_keep_weights_sparse_and_temperature_positive():
    texts = [("the cat sat on the mat again", "en"), ("der hund lief über die straße", "de")] * 30
    model = language_id.fit([(*language_id.ngram_counts(t), y) for t, y in texts])
    assert len(model.weights.value) < 0.01 * 2 * 2**language_id.BITS and model.temperature > 0
    assert model.predict("the mat")[0] == "en" and model.predict("die straße")[0] == "de"


def test_sparse_products_are_the_dense_ones():
    rng = np.random.default_rng(2)
    for width in (0, 1, 5):
        dense = rng.normal(size=(300, width)) * (rng.random((300, width)) < 0.05)
        sparse = language_id.Sparse(dense)
        for _ in range(20):
            columns = np.sort(rng.choice(300, int(rng.integers(0, 60)), replace=False))
            values = rng.normal(size=len(columns))
            assert np.allclose(sparse.times(columns, values), values @ dense[columns], atol=1e-6)
    assert language_id.Sparse(np.zeros((9, 2))).times(np.array([1, 5]), np.ones(2)).tolist() == [0, 0]


def brute_fit(rows, order):
    """FTRL-proximal with elastic net, weight by weight in plain floats; ``rows`` are (places, values, class)."""
    z, n, langs = {}, {}, sorted({y for *_, y in rows})

    def weight(key):
        if abs(z.get(key, 0)) <= language_id.L1:
            return 0.0
        sign = 1 if z[key] > 0 else -1
        return (sign * language_id.L1 - z[key]) / ((language_id.BETA + n[key] ** 0.5) / language_id.ALPHA + language_id.L2)

    for i in order:
        columns, values, y = rows[i]
        logit = [weight(("bias", k)) + sum(v * weight((c, k)) for c, v in zip(columns, values)) for k in langs]
        total = sum(np.exp(x) for x in logit)
        for k in langs:
            error = np.exp(logit[langs.index(k)]) / total - (k == y)
            for key, g in [(("bias", k), error), *(((c, k), v * error) for c, v in zip(columns, values))]:
                w, old = weight(key), n.get(key, 0.0)
                n[key] = old + g * g
                z[key] = z.get(key, 0.0) + g - (n[key] ** 0.5 - old**0.5) / language_id.ALPHA * w
    return weight


def test_training_matches_brute_force():
    texts = [("the cat", "en"), ("le chat", "fr"), ("der hund", "de"), ("a dog", "en"), ("un chien", "fr"), ("die katze", "de")] * 3
    rows = [(*language_id.ngram_counts(t), y) for t, y in texts]
    model = language_id.fit(rows)
    known = [r for i, r in enumerate(rows) if i % 5 != 4]
    rng = np.random.default_rng(0)
    order = [i for _ in range(language_id.EPOCHS) for i in rng.permutation(len(known))]
    weight = brute_fit([(c, model.values(c, n), y) for c, n, y in known], order)
    places = sorted({int(c) for c, _, _ in rows for c in c})
    for k, lang in enumerate(model.langs):
        assert np.isclose(model.bias[k], weight(("bias", lang)))
        got = [model.weights.times(np.array([c]), np.ones(1))[k] for c in places]
        assert np.allclose(got, [weight((c, lang)) for c in places], atol=1e-6)


def test_languages_beyond_the_bound_are_not_learnt(spark):
    rows = [(i, f"text of language {i % 4}", f"l{min(i % 4, 2)}", "s", 1, *["c"] * 8) for i in range(200)]
    langs = language_id.learn(frame(spark, rows), languages=2).langs
    assert len(langs) == 2 and "l2" in langs  # the one with most documents


def test_ngrams_cover_the_whole_text():
    head = "abc " * 5000
    a, b = language_id.ngram_counts(head), language_id.ngram_counts(head + "xyz")
    assert b[1].sum() - a[1].sum() == 12  # four more characters, each ending three n-grams
    assert language_id.ngram_counts("A1-b")[1].sum() == language_id.ngram_counts("a b")[1].sum()
