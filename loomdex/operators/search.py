"""Ranked search over postings, scans without an index, snippets, and merging of hits.

What is broadcast here comes from the query (at most 512 characters), never from the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_lines, clip_around, decode_entities, fold_space, let
from ..functions.tokens import needles, parse_query, query_terms
from ..session import spread

LIMIT, MAX_LIMIT = 8, 20
K1 = 1.2
#: A term counts by the best of the fields it stands in.
BOOSTS = {"title": 2.6, "path": 2.1, "catalog": 1.8, "alias": 1.3}
#: Which kind of hit stands for a source.
RANKS = {"digest": 3, "derived": 2, "original": 1, "lesson": 0}


def clamp_limit(limit: int | None) -> int:
    return min(MAX_LIMIT, max(1, LIMIT if limit is None else limit))


def field_boost(fields: Column) -> Column:
    return F.greatest(F.lit(1.0), *(F.when(F.array_contains(fields, f), F.lit(b)).otherwise(F.lit(1.0)) for f, b in BOOSTS.items()))


def term_weight(tf: Column, df: Column, n: Column) -> Column:
    """BM25 without length normalisation."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * (tf * (K1 + 1)) / (tf + K1)


def wanted_terms(query: str, phrase_terms: bool = False) -> list[str]:
    """The distinct terms that ``rank`` looks for, so that postings can be asked for these alone."""
    groups, phrases = parse_query(query)
    return sorted({t for x in groups + (phrases if phrase_terms else []) for t in needles(x)})


def rank(post: DataFrame, query: str, visible: DataFrame | None = None, n_docs: int | None = None, key: str = "doc_id", boost: bool = True, phrase_terms: bool = False, with_lines: bool = True) -> DataFrame:
    """``key``, score, groups, partial and (``with_lines``) lines of the documents that cover the query.

    ``visible`` restricts the documents before frequencies and their number are counted.  A group is
    covered by any of its terms; all groups have to be, or two if the query has two or more.  With
    ``phrase_terms`` phrases count as groups too, so that a query of phrases alone finds something.
    """
    spark = post.sparkSession
    groups, phrases = parse_query(query)
    found = [x for x in map(needles, groups + (phrases if phrase_terms else [])) if x]
    pairs = [(g, t) for g, own in enumerate(found) for t in own]
    wanted = spark.createDataFrame(pairs, "g int, term string")
    hits = post.filter(F.col("term").isin(*{t for _, t in pairs})) if pairs else post.filter(F.lit(False))
    if visible is not None:
        hits = hits.join(visible.select(key), key, "left_semi")
        total = visible.agg(F.greatest(F.countDistinct(key), F.lit(1)).alias("n"))
    elif n_docs is not None:
        total = spark.range(1).select(F.lit(max(1, n_docs)).cast("long").alias("n"))
    else:
        total = post.agg(F.greatest(F.countDistinct(key), F.lit(1)).alias("n"))
    # One row for each term of the query.  It asks for the columns that scores need, which are always there, so that
    # both uses of the hits have one plan and their shuffle is done once.
    there = F.col("tf") > 0
    there = there & (F.size("fields") > 0) if boost else there
    there = there & (F.size("lines") > 0) if with_lines else there
    df = hits.groupBy("term").agg(F.count_if(there).alias("df"))
    stats = F.broadcast(df.join(F.broadcast(wanted), "term").join(F.broadcast(total), F.lit(True)))
    weight = term_weight(F.col("tf"), F.col("df"), F.col("n")) * (field_boost(F.col("fields")) if boost else F.lit(1.0))
    covered_groups = F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("g")))) if len(found) < 64 else F.size(F.collect_set("g"))
    lines = [F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))), 1, 8).alias("lines")] if with_lines else []
    scored = hits.join(stats, "term").groupBy(key).agg(F.sum(weight).alias("score"), covered_groups.cast("int").alias("groups"), *lines)
    required = len(found)
    covered = F.col("groups") >= (min(2, required) if required >= 2 else required)
    return scored.filter(covered).withColumn("partial", F.col("groups") < required)


def best(ranked: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """The first by groups, score and key: a top-k, not a sort."""
    return ranked.orderBy(F.desc("groups"), F.desc("score"), key).limit(limit)


def search(post: DataFrame, docs: DataFrame, query: str, limit: int | None = None, visible: DataFrame | None = None, key: str = "doc_id", **options) -> DataFrame:
    """Rank first, fetch documents for the few that are left, then check phrases."""
    limit = clamp_limit(limit)
    top = best(rank(post, query, visible, key=key, **options), max(4 * limit, 20), key)
    found = docs.join(F.broadcast(top), key)
    _, phrases = parse_query(query)
    return best(has_phrases(found, phrases) if phrases else found, 3 * limit, key)


def has_phrases(docs: DataFrame, phrases: list[str], text: str = "text") -> DataFrame:
    """Documents whose folded text, as it stands or decoded, holds all phrases."""
    hay = F.lower(fold_space(F.concat(F.col(text), F.lit("\n"), decode_entities(F.col(text)))))
    keep = F.lit(True)
    for p in phrases:
        keep = keep & F.contains(hay, F.lit(p.lower()))
    return docs.filter(keep)


def _hay(*parts: Column) -> Column:
    return F.lower(fold_space(F.concat_ws("\n", *parts)))


def scan(docs: DataFrame, query: str, extra: Column | None = None) -> DataFrame:
    """Documents that hold all words of the query in path, extra or body; adds path_score."""
    words = [w.lower() for w in query_terms(query)]
    lines = as_lines(F.col("text"))
    body = _hay(F.array_join(lines, "\n"), decode_entities(F.array_join(lines, "\n")))
    head = _hay(F.replace(F.col("rel_path"), F.lit("\\"), F.lit("/")), F.coalesce(extra, F.lit("")) if extra is not None else F.lit(""))
    with_hay = spread(docs).withColumn("_head", head).withColumn("_body", body)
    for w in words:
        with_hay = with_hay.filter(F.contains("_head", F.lit(w)) | F.contains("_body", F.lit(w)))
    score = sum((F.contains("_head", F.lit(w)).cast("int") for w in words), F.lit(0))
    return with_hay.withColumn("path_score", score).drop("_head", "_body")


def snippets(text: Column, wanted: list[str], preferred: Column | None = None, most: int = 2) -> Column:
    """Array of (line, text): up to ``most`` lines that hold one of ``wanted``, preferred lines first."""
    low = [w.lower() for w in wanted]

    def of(lines: Column) -> Column:
        def hit(x: Column) -> Column:
            hay = F.lower(fold_space(F.concat(x, F.lit("\n"), decode_entities(x))))
            out = F.when(F.lit(False), F.lit(""))
            for w in low:
                out = out.when(F.contains(hay, F.lit(w)), F.lit(w))
            return out

        marked = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"), hit(x).alias("hit"))), lambda m: m["hit"].isNotNull())
        first = F.coalesce(preferred, F.array().cast("array<int>")) if preferred is not None else F.array().cast("array<int>")
        ordered = F.concat(F.filter(marked, lambda m: F.array_contains(first, m["line"])), F.filter(marked, lambda m: ~F.array_contains(first, m["line"])))
        return F.transform(F.slice(ordered, 1, most), lambda m: F.struct(m["line"].alias("line"), clip_around(decode_entities(m["text"]), m["hit"]).alias("text")))

    return let(as_lines(text), of)


def preview(text: Column, needle: str) -> Column:
    """The first line with something in it, around the needle."""
    return let(F.transform(as_lines(text), decode_entities), lambda x: clip_around(F.coalesce(F.get(F.filter(x, lambda y: F.trim(y) != ""), F.lit(0)), F.lit("")), F.lit(needle)))


def merge_hits(hits: DataFrame) -> DataFrame:
    """One hit for each source: the highest kind stands for it, scores take the largest, partial only if all are.

    Needs kind, path, source_path, title, score, partial; lessons are never merged with others.
    """
    source = F.when(F.col("kind") == "lesson", F.concat(F.lit("lesson:"), F.col("path"))).otherwise(F.coalesce("source_path", "path"))
    order = F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))[F.col("kind")]
    by = F.struct(order.alias("r"), F.col("score"), F.col("path"))
    return (
        hits.groupBy(source.alias("source_key"))
        .agg(
            F.max_by(F.struct("kind", "path", "source_path"), by).alias("h"),
            F.max_by("title", F.when(F.col("title") != "", by)).alias("title"),
            F.max("score").alias("score"),
            F.bool_and("partial").alias("partial"),
            F.count("*").cast("int").alias("n_hits"),
        )
        .select("source_key", "h.kind", "h.path", "h.source_path", "title", "score", "partial", "n_hits")
    )


def fresh(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits whose file still has the hash that was indexed; for digests and derived notes the source's too."""
    now = files.select(F.col("path").alias("_path"), F.sha2("content", 256).alias("_hash"))
    current = hits.join(now, (F.col("path") == F.col("_path")) & (F.col("source_hash") == F.col("_hash")), "left_semi")
    sources = now.withColumnsRenamed({"_path": "_source", "_hash": "_source_hash"})
    from_source = F.col("kind").isin("digest", "derived") & F.col("source_path").isNotNull()
    same = (F.col("source_path") == F.col("_source")) & (F.coalesce("source_file_hash", "_source_hash") == F.col("_source_hash"))
    return current.filter(~from_source).unionByName(current.filter(from_source).join(sources, same, "left_semi"))


def unite(per_root: list[DataFrame]) -> DataFrame:
    out = per_root[0]
    for x in per_root[1:]:
        out = out.unionByName(x)
    return out


def order_hits(hits: DataFrame, limit: int) -> DataFrame:
    """Score, then path in the order of the Unicode collation."""
    return hits.orderBy(F.desc("score"), F.collate("path", "UNICODE")).limit(limit)


def semantic_extra(topics: Column, aliases: Column, questions: Column, rules: Column) -> Column:
    """One text of a record's fields; ``rules`` is an array of (text, excerpt, ...)."""
    none = F.array().cast("array<string>")
    told = F.transform(rules, lambda r: F.concat_ws(" ", F.coalesce(r["text"], F.lit("")), F.coalesce(r["excerpt"], F.lit(""))))
    return F.array_join(F.concat(*(F.coalesce(x, none) for x in (topics, aliases, questions, told))), "\n")


def semantic_matches(records: DataFrame, query: str) -> DataFrame:
    """Records whose fields hold all words, with the first field that holds one as evidence and a score of 1."""
    words = [w.lower() for w in query_terms(query.replace('"', " "))]
    hay = F.lower(fold_space(semantic_extra(*(F.col(c) for c in ("topics", "aliases", "questions", "rules")))))
    keep = F.lit(True)
    for w in words:
        keep = keep & F.contains(hay, F.lit(w))
    return records.filter(keep).withColumn("evidence", semantic_evidence(words)).withColumn("score", F.lit(1.0))


def semantic_evidence(words: list[str]) -> Column:
    """The first of a record's fields that holds one of the words, at most 300 characters."""
    none = F.array().cast("array<string>")
    fields = F.concat(F.coalesce("topics", none), F.coalesce("aliases", none), F.coalesce("questions", none), F.coalesce(F.transform("rules", lambda r: r["text"]), none))
    held = lambda f: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.lower(f), w))
    return F.substring(F.get(F.filter(fields, held), F.lit(0)), 1, 300)


def semantic_hits(records: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """Matches whose document still has the hash that the record was made of."""
    return semantic_matches(records, query).join(docs.select("path", "source_hash"), ["path", "source_hash"], "left_semi")
