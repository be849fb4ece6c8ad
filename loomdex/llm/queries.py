"""The contract queries of the ten operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(common.table(spark, sf_dir, "documents"), tokenizer_file(WORDS))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = common.table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter(F.col("vec_id") % 100 == 0), vectors)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(common.table(spark, sf_dir, "documents")).drop("spans")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(common.table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepieces import round_trips

    return round_trips(common.table(spark, sf_dir, "documents"), tokenizer_file(PIECES))


def op8_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(common.table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(common.table(spark, sf_dir, "documents"), tokenizer_file(WORDS))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(common.table(spark, sf_dir, "documents"))


_QUALITY_RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT k, doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
win AS (SELECT k, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT i + j) AS n FROM dup, (VALUES (0), (1), (2), (3), (4)) AS v(j) GROUP BY k),
s AS (
  SELECT w.k, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_marks,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.k = w.k),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
r AS (
  SELECT k, lang, source, base_failed, unnest([
    {'rule': 0, 'bin': least(1000, 1000 * n_symbols // greatest(word_chars, 1)), 'bottom': NULL, 'top': 90},
    {'rule': 1, 'bin': least(1000, 1000 * n_marks // greatest(word_chars, 1)), 'bottom': NULL, 'top': 90},
    {'rule': 2, 'bin': least(1000, 1000 * n_repeat_words // greatest(n_words, 1)), 'bottom': NULL, 'top': 98},
    {'rule': 3, 'bin': least(1000, 1000 * n_dup_lines // greatest(n_lines, 1)), 'bottom': NULL, 'top': 98},
    {'rule': 4, 'bin': least(1000, 40 * word_chars // greatest(n_words, 1)), 'bottom': 10, 'top': 90}], recursive := true)
  FROM f),
own AS (SELECT lang, source, rule, bottom, top, bin, count(*) AS n FROM r WHERE NOT base_failed GROUP BY ALL),
levels AS (
  SELECT 1 AS level, lang, source, rule, bottom, top, bin, n FROM own
  UNION ALL SELECT 2, lang, NULL, rule, bottom, top, bin, sum(n) FROM own GROUP BY ALL
  UNION ALL SELECT 3, NULL, NULL, rule, bottom, top, bin, sum(n) FROM own GROUP BY ALL),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bin) AS seen,
         sum(n) OVER (PARTITION BY level, lang, source, rule) AS n_all
  FROM levels),
q AS (
  SELECT level, lang, source, rule, n_all, min(bin) FILTER (WHERE seen * 100 >= n_all * bottom) AS q_low,
         min(bin) FILTER (WHERE seen * 100 >= n_all * 50) AS middle, min(bin) FILTER (WHERE seen * 100 >= n_all * top) AS q_high
  FROM cum GROUP BY ALL),
fence AS (
  SELECT level, lang, source, rule, n_all, q_low - greatest(2 * (middle - q_low), 2) AS low,
         q_high + greatest(2 * (q_high - middle), 2) AS high
  FROM q),
pick AS (
  SELECT o.lang, o.source, o.rule, CASE WHEN o.n_all >= 50 THEN o.low WHEN t.n_all >= 50 THEN t.low ELSE e.low END AS low,
         CASE WHEN o.n_all >= 50 THEN o.high WHEN t.n_all >= 50 THEN t.high ELSE e.high END AS high
  FROM (FROM fence WHERE level = 1) o
  LEFT JOIN (FROM fence WHERE level = 2) t ON t.lang IS NOT DISTINCT FROM o.lang AND t.rule = o.rule
  LEFT JOIN (FROM fence WHERE level = 3) e ON e.rule = o.rule),
v AS (
  SELECT r.k, bool_and(bin <= p.high AND (r.rule < 4 OR bin >= p.low)) AS good
  FROM r JOIN pick p ON p.lang IS NOT DISTINCT FROM r.lang AND p.source IS NOT DISTINCT FROM r.source AND p.rule = r.rule
  GROUP BY r.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(good, false) AS kept
FROM f LEFT JOIN v ON v.k = f.k
"""

_TOP_K_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_quality_classifier,
        op3_exact_top_k,
        op4_license_scan,
        op5_language_id,
        op6_simhash_dedup,
        op7_sentencepiece,
        op8_ring_sharding,
        op9_token_counts,
        op10_quality_rules,
    )
}
SQL: dict[str, str] = {"op3_exact_top_k": _TOP_K_SQL, "op10_quality_rules": _QUALITY_RULES_SQL}
