import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomdex.llm import common
from loomdex.llm import quality_rules as q

from .texts import SCHEMA, frame


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    hit = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


@pytest.mark.parametrize("sf", ["edge", "sf0.001"])
def test_statistics_match_brute_force(spark, sf):
    df = frame(spark) if sf == "edge" else spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.quality_rules(df).collect())
    assert got == Counter((r.doc_id, *brute(r.text)) for r in df.collect())


def test_verdicts_follow_the_group(spark):
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi "
    rows = [(i, word + f"w{i} w{i + 1}", "en", "plain", 0) for i in range(80)]
    rows += [(1000 + i, word.replace(" ", "## ") + f"w{i}", "en", "code", 0) for i in range(80)]
    rows += [(2000, word.replace(" ", "## ") + "x", "en", "plain", 0), (2001, word.replace(" ", "!! "), "en", "plain", 0)]
    out = {r.doc_id: r.kept for r in q.quality_rules(frame(spark, [(*r, *["c"] * 8) for r in rows])).collect()}
    assert all(out[i] for i in range(80)) and all(out[1000 + i] for i in range(80))
    assert not out[2000] and not out[2001]


def stats_of(spark, rows):
    df = spark.createDataFrame([(i, t, lang, source) for i, (t, lang, source) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    return common.materialise(q.with_statistics(df, F.col("text")).drop("text"), "statistics")


def prose(i, symbols=0, letters=5):
    words = [chr(97 + (i + k) % 26) * (letters - 2) + chr(97 + k // 26) + chr(97 + k % 26) for k in range(100)]
    return " ".join(words) + " #" * symbols


def test_a_shifted_group_moves_its_fences(spark):
    rows = [(prose(i, i % 4), "en", "a") for i in range(120)] + [(prose(i, 10 + 3 * (i % 4), 7), "en", "b") for i in range(120)]
    f = {r.source: r for r in q.fences(q.sketches(stats_of(spark, rows))).collect()}
    assert f["b"].symbols_high > f["a"].symbols_high + 10  # both level and width shifted
    assert f["b"].length_low > f["a"].length_high
    # The same text is judged by its group: what stands out in one is usual in the other.
    more = rows + [(prose(5, 19, 7), "en", "a"), (prose(5, 19, 7), "en", "b"), (prose(5, 0), "en", "b")]
    kept = {r.doc_id: r.kept for r in q.judge(stats_of(spark, more)).collect()}
    assert (kept[240], kept[241], kept[242]) == (False, True, False)
    assert all(kept[i] for i in range(240))


def test_sketches_merge_by_sums(spark):
    rows = [(prose(i, i % 9), "en", f"s{i % 2}") for i in range(300)]
    parts = [q.sketches(stats_of(spark, rows[k::3])) for k in range(3)]
    keys = ["lang", "source", "rule", "bin"]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys).agg(F.sum("n").alias("n"))
    whole = q.sketches(stats_of(spark, rows))
    assert Counter(map(tuple, merged.collect())) == Counter(map(tuple, whole.select(merged.columns).collect()))


def test_the_groups_sketches_decide(spark):
    """Shares at sf0.1 of the fences that lie beyond the constant reach, and the rows that the pooled fences judge otherwise."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    stats = common.materialise(q.with_statistics(docs, F.col("text")).drop("text"), "statistics")
    sketch = common.materialise(q.sketches(stats), "sketch")
    by = q.fences(sketch).toPandas()
    wide = {name: float((by[f"{name}_high"] > q.LEAST_REACH).mean()) for name in q.RULES}
    print("fences that the sketch decides:", wide)
    assert wide["repeats"] > 0.9 and wide["lines"] > 0.7 and wide["length"] == 1
    assert by.length_high.nunique() > 20 and by.repeats_high.nunique() > 20
    pooled = stats.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    one, two = (df.select("doc_id", "kept", "base_failed") for df in (q.judge(stats), q.judge(pooled)))
    both = one.alias("a").join(two.alias("b"), "doc_id")
    r = both.agg(F.count_if(F.col("a.kept") != F.col("b.kept")).alias("other"), F.count_if(~F.col("a.base_failed") & ~F.col("a.kept")).alias("rejected")).first()
    print("judged otherwise by pooled fences:", r.other, "rejected by fences:", r.rejected)
    assert r.other > 50 and r.rejected > 300
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    shares = {r.quality: r.s for r in one.filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    print("kept by label:", shares)
    assert shares[1] > 0.98 and shares[0] < 0.1


def test_keep_good_keeps_columns(spark):
    df = frame(spark)
    out = q.keep_good(df)
    assert out.schema.fieldNames() == df.schema.fieldNames()
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    verdict = Counter(r.doc_id for r in q.quality_rules(df).collect() if r.kept)
    assert Counter(k for k, _ in kept.elements()) == verdict


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert q.quality_rules(empty).count() == 0 and q.keep_good(empty).count() == 0
