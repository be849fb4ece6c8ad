"""Named queries over the driver's tables, one or more for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunks, notes, ownership, search
from ..operators.postings import document_frequencies, postings
from ..session import scratch_path
from ..sources import files
from ..sources.index_store import DOCS, IndexStore

QUERY, BOOSTED, PARTIAL, PHRASE, SCAN = "thand nder inea", "src3 thand de", "that the zzzz", '"of the" that', "thand the src1"
_CJK = r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: the source is a folder, the language a catalog."""
    d = _table(spark, sf_dir, "documents")
    rel = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.withColumns({"rel_path": rel, "path": F.concat(F.lit("/kb/"), rel)})


def _fielded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return d.select("doc_id", "text", "rel_path", tx.stem(F.col("rel_path")).alias("title"), F.array("lang").alias("catalog"))


def _lines_sql(column: str) -> str:
    return f"string_split(replace(replace({column}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"


_CAMEL_SQL = r"list_filter(string_split(lower(regexp_replace(regexp_replace(p, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), ' '), lambda c: c <> '' AND c <> lower(p) AND c <> lower(r))"
_TERMS_SQL = rf"""CASE WHEN regexp_matches(r, '^{_CJK}') THEN list_concat(list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1)), list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))
  ELSE list_concat([lower(r)], flatten(list_transform(list_filter(string_split_regex(r, '[._]'), lambda p: p <> ''), lambda p: list_concat(CASE WHEN lower(p) <> lower(r) THEN [lower(p)] ELSE [] END, {_CAMEL_SQL})))) END"""


def _postings_sql(stretches: str) -> str:
    """CTEs that end in ``post`` (doc_id, term, tf, fields, lines), from rows (doc_id, field, line, t)."""
    return rf"""stretch AS ({stretches}),
run AS (SELECT doc_id, field, line, regexp_replace(unnest(regexp_extract_all(t, '{_CJK}+|[A-Za-z0-9_][A-Za-z0-9_.]*')), '\.$', '') AS r FROM stretch),
emitted AS (SELECT doc_id, field, line, unnest({_TERMS_SQL}) AS term FROM run),
post AS (SELECT doc_id, term, count(*) AS tf, list_sort(list_distinct(list(field))) AS fields, list_sort(list_distinct(list(line)))[1:8] AS lines FROM emitted WHERE term <> '' GROUP BY doc_id, term)"""


_BODY_SQL = f"SELECT doc_id, 'body' AS field, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS t FROM (SELECT doc_id, {_lines_sql('text')} AS ls FROM documents)"
_FIELDS_SQL = f"""SELECT doc_id, 'path' AS field, 1 AS line, source || '/' || doc_id || '.txt' AS t FROM documents
  UNION ALL SELECT doc_id, 'title', 1, CAST(doc_id AS VARCHAR) FROM documents UNION ALL SELECT doc_id, 'catalog', 1, lang FROM documents UNION ALL {_BODY_SQL}"""


def _rank_sql(post: str, groups: list[list[str]], where: str = "TRUE", boost: bool = False, limit: int | None = None) -> str:
    needles = ", ".join(f"({g}, '{t}')" for g, own in enumerate(groups) for t in own)
    required = len(groups)
    b = "greatest(1.0, CASE WHEN list_contains(fields, 'title') THEN 2.6 ELSE 1 END, CASE WHEN list_contains(fields, 'path') THEN 2.1 ELSE 1 END, CASE WHEN list_contains(fields, 'catalog') THEN 1.8 ELSE 1 END)" if boost else "1.0"
    return f"""WITH {post},
visible AS (SELECT doc_id FROM documents WHERE {where}),
needle(g, term) AS (VALUES {needles}),
hit AS (SELECT p.*, n.g FROM post p JOIN needle n USING (term) WHERE p.doc_id IN (SELECT doc_id FROM visible)),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM hit GROUP BY term),
total AS (SELECT greatest(count(*), 1) AS n FROM visible),
scored AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2) * {b}), 6) AS score, CAST(count(DISTINCT g) AS INTEGER) AS groups
  FROM hit JOIN df USING (term), total GROUP BY doc_id)
SELECT doc_id, score, groups, groups < {required} AS partial FROM scored WHERE groups >= {min(2, required)}""" + (f" ORDER BY groups DESC, score DESC, doc_id LIMIT {limit}" if limit else "")


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"), "groups", "partial")


@_query(f"WITH {_postings_sql(_BODY_SQL)} SELECT doc_id, term, CAST(tf AS BIGINT) AS tf, array_to_string(lines, ',') AS lines FROM post")
def postings_body(spark, sf_dir):
    p = postings(_table(spark, sf_dir, "documents").select("doc_id", "text"), columns=("tf", "lines"))
    return p.select("doc_id", "term", "tf", F.concat_ws(",", F.transform("lines", lambda x: x.cast("string"))).alias("lines"))


@_query(f"WITH {_postings_sql(_FIELDS_SQL)} SELECT doc_id, term, CAST(tf AS BIGINT) AS tf, array_to_string(fields, ',') AS fields FROM post")
def postings_fielded(spark, sf_dir):
    return postings(_fielded(spark, sf_dir), columns=("tf", "fields")).select("doc_id", "term", "tf", F.concat_ws(",", "fields").alias("fields"))


@_query(f"WITH {_postings_sql(_BODY_SQL)} SELECT term, count(*) AS df FROM post GROUP BY term ORDER BY df DESC, term LIMIT 100")
def df_top_terms(spark, sf_dir):
    return document_frequencies(postings(_table(spark, sf_dir, "documents").select("doc_id", "text"), columns=())).orderBy(F.desc("df"), "term").limit(100)


def _asked(docs: DataFrame, query: str) -> DataFrame:
    """Postings of the query's terms alone, made from the texts on the fly; ``index_search`` reads them from an index."""
    return postings(docs, only=search.wanted_terms(query))


_GROUPS = [["thand"], ["nder"], ["inea"]]


@_query(_rank_sql(_postings_sql(_BODY_SQL), _GROUPS))
def bm25_search(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _ranked(search.rank(_asked(docs, QUERY), QUERY, docs, boost=False, with_lines=False))


@_query(_rank_sql(_postings_sql(_BODY_SQL), _GROUPS, limit=20))
def bm25_top_k(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ranked = search.rank(_asked(docs, QUERY), QUERY, docs, boost=False, with_lines=False).withColumn("score", F.round("score", 6))
    return _ranked(search.best(ranked, 20))


@_query(_rank_sql(_postings_sql(_FIELDS_SQL), [["src3"], ["thand"], ["de"]], boost=True))
def bm25_field_boost(spark, sf_dir):
    docs = _fielded(spark, sf_dir)
    return _ranked(search.rank(_asked(docs, BOOSTED), BOOSTED, docs.select("doc_id"), with_lines=False))


@_query(_rank_sql(_postings_sql(_BODY_SQL), _GROUPS, where="source IN ('src1', 'src2', 'src7')"))
def bm25_scoped(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    visible = docs.filter(F.col("source").isin("src1", "src2", "src7")).select("doc_id")
    return _ranked(search.rank(_asked(docs.select("doc_id", "text"), QUERY), QUERY, visible, boost=False, with_lines=False))


@_query(_rank_sql(_postings_sql(_BODY_SQL), [["that"], ["the"], ["zzzz"]]))
def bm25_partial_coverage(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _ranked(search.rank(_asked(docs, PARTIAL), PARTIAL, docs, boost=False, with_lines=False))


@_query(f"SELECT r.* FROM ({_rank_sql(_postings_sql(_BODY_SQL), [['that']])}) r JOIN documents d USING (doc_id) WHERE contains(lower(regexp_replace(d.text, '[ \\t]+', ' ', 'g')), 'of the')")
def phrase_search(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.join(search.rank(_asked(docs, PHRASE), PHRASE, docs, boost=False, with_lines=False), "doc_id")
    return _ranked(search.has_phrases(found, ["of the"]))


def _as_docs(d: DataFrame) -> DataFrame:
    """Documents (doc_id, text, rel_path, path) as rows of an index."""
    given = {"doc_id": F.col("doc_id").cast("string"), "rel_path": F.col("rel_path"), "path": F.col("path"), "kind": F.lit("original"), "title": tx.stem(F.col("rel_path")), "source_hash": F.sha2("text", 256)}
    return d.select(*(given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (f.split(" ", 1) for f in DOCS.split(", "))))


def _committed(store: IndexStore, d: DataFrame, deletes: DataFrame | None = None):
    return store.commit(_as_docs(d), postings(d.select(F.col("doc_id").cast("string").alias("doc_id"), "text")), deletes)


def _index_ranked(store: IndexStore, generation) -> DataFrame:
    hits = store.get_postings(search.wanted_terms(QUERY), generation.generation)
    return _ranked(search.rank(hits, QUERY, n_docs=generation.doc_count, boost=False, with_lines=False)).withColumn("doc_id", F.col("doc_id").cast("long"))


@_query(_rank_sql(_postings_sql(_BODY_SQL), _GROUPS))
def index_search(spark, sf_dir):
    """Ranked search that reads the buckets of the query's terms from an index in Parquet."""
    store = IndexStore(spark, scratch_path(spark, "index"), "kb")
    return _index_ranked(store, _committed(store, _documents(spark, sf_dir)))


_UPDATED_SQL = "documents AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'thand nder ' || text || ' inea' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 50 = 0)"


def _updated(spark, sf_dir) -> tuple[IndexStore, list]:
    """An index of all documents, then a commit that changes some of them and deletes others."""
    d = _documents(spark, sf_dir)
    store = IndexStore(spark, scratch_path(spark, "index"), "kb")
    first = _committed(store, d)
    changed = d.filter("doc_id % 50 = 0").withColumn("text", F.concat(F.lit("thand nder "), "text", F.lit(" inea")))
    second = _committed(store, changed, d.filter("doc_id % 7 = 0 and doc_id % 50 <> 0").select(F.col("doc_id").cast("string").alias("doc_id")))
    return store, [first, second]


@_query(f"{_rank_sql(_UPDATED_SQL + ', ' + _postings_sql(_BODY_SQL), _GROUPS)}")
def index_update(spark, sf_dir):
    """The same search after a commit that wrote one small segment."""
    store, generations = _updated(spark, sf_dir)
    return _index_ranked(store, generations[1])


@_query(_rank_sql(_postings_sql(_BODY_SQL), _GROUPS))
def index_time_travel(spark, sf_dir):
    """The same search at the generation before that commit."""
    store, generations = _updated(spark, sf_dir)
    return _index_ranked(store, store.generation(generations[0].generation))


_CJK_LETTERS = "".join(chr(0x4E00 + 7 * k) for k in range(26))
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@_query(f"""WITH {_postings_sql(f"SELECT doc_id, 'body' AS field, 1 AS line, translate(lower(text), '{_LETTERS}', '{_CJK_LETTERS}') AS t FROM documents")}
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM post GROUP BY term""")
def cjk_terms(spark, sf_dir):
    """Terms of texts in CJK characters: each of them and each pair within a run."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.translate(F.lower("text"), _LETTERS, _CJK_LETTERS).alias("text"))
    return postings(d, columns=("tf",)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@_query("""WITH h AS (SELECT doc_id, lower(source || '/' || doc_id || '.txt') AS head, lower(regexp_replace(text, '[ \\t]+', ' ', 'g')) AS body FROM documents)
SELECT doc_id, CAST(contains(head, 'thand') AS INTEGER) + CAST(contains(head, 'the') AS INTEGER) + CAST(contains(head, 'src1') AS INTEGER) AS path_score FROM h
WHERE (contains(head, 'thand') OR contains(body, 'thand')) AND (contains(head, 'the') OR contains(body, 'the')) AND (contains(head, 'src1') OR contains(body, 'src1'))""")
def scan_match(spark, sf_dir):
    return search.scan(_documents(spark, sf_dir), SCAN).select("doc_id", "path_score")


@_query(f"""WITH l AS (SELECT doc_id, {_lines_sql('text')} AS ls FROM documents),
m AS (SELECT doc_id, list_filter(list_transform(range(1, len(ls) + 1), lambda i: {{'i': i, 't': ls[i]}}), lambda x: contains(lower(regexp_replace(x.t, '[ \\t]+', ' ', 'g')), 'thand')) AS hits FROM l)
SELECT doc_id, CAST(s.i AS INTEGER) AS line, CAST(CASE WHEN length(s.t) <= 300 THEN length(s.t) ELSE least(300, length(s.t) - greatest(0, strpos(lower(s.t), 'thand') - 101)) END AS INTEGER) AS size FROM (SELECT doc_id, unnest(hits[1:2]) AS s FROM m)""")
def snippets(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.explode(search.snippets(F.col("text"), ["thand"])).alias("s"))
    return d.select("doc_id", "s.line", F.length("s.text").alias("size"))


_AMP = "replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&')"


@_query(f"SELECT page_id, length({_AMP}) AS size, sha256({_AMP}) AS hash FROM pages")
def entity_decode(spark, sf_dir):
    t = tx.decode_entities(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("size"), F.sha2(t, 256).alias("hash"))


@_query(f"SELECT doc_id, len({_lines_sql('text')}) AS n_lines, list_max(list_transform({_lines_sql('text')}, lambda x: length(x))) AS longest FROM documents")
def line_stats(spark, sf_dir):
    lines = tx.as_lines(F.col("text"))
    d = _table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.array_max(F.transform(lines, F.length)).cast("long").alias("longest"))
    return d


@_query("""WITH t AS (SELECT conv_id, turn, '# ' || role || chr(10) || text AS body, 'chat/' || conv_id || '-' || turn || '.md' AS path FROM conversations)
SELECT conv_id, turn, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem, substr(regexp_extract(body, '^#\\s+([^\\n]+)', 1), 1, 120) AS title FROM t""")
def note_titles(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    body = F.concat(F.lit("# "), "role", F.lit("\n"), "text")
    path = F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".md"))
    return c.select("conv_id", "turn", tx.stem(path).alias("stem"), tx.choose_title(F.lit(None).cast("string"), body, path).alias("title"))


@_query("SELECT doc_id, substr(sha256('kb' || chr(10) || source || '/' || doc_id || '.txt'), 1, 32) AS key, CAST(('0x' || substr(sha256(source), 1, 8))::UBIGINT % 256 AS INTEGER) AS bucket, sha256(text) AS source_hash FROM documents")
def document_identity(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.doc_key(F.lit("kb"), F.col("rel_path")).alias("key"), tx.bucket_of(F.col("source")).alias("bucket"), F.sha2("text", 256).alias("source_hash"))


@_query("SELECT sha256(text) AS source_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("source_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@_query("""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS rel_path, n_chars AS size, 1.0 AS mtime_ms, '' AS fingerprint, sha256(text) AS source_hash FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT CAST(doc_id AS VARCHAR) AS rel_path, n_chars AS size, CASE WHEN doc_id % 5 = 0 THEN 2.0 ELSE 1.0 END AS mtime_ms, '' AS fingerprint, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS source_hash
  FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 7 = 0)
SELECT coalesce(p.rel_path, n.rel_path) AS rel_path, CASE WHEN p.rel_path IS NULL THEN 'insert' WHEN n.rel_path IS NULL THEN 'delete'
  WHEN p.size = n.size AND p.mtime_ms = n.mtime_ms AND p.fingerprint = n.fingerprint THEN 'same' WHEN p.source_hash = n.source_hash AND p.fingerprint = n.fingerprint THEN 'same' ELSE 'update' END AS status
FROM p FULL OUTER JOIN n ON p.rel_path = n.rel_path""")
def incremental_diff(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    row = lambda stamp, body: (F.col("doc_id").cast("string").alias("rel_path"), F.col("n_chars").alias("size"), stamp.cast("double").alias("mtime_ms"), F.lit("").alias("fingerprint"), F.sha2(body, 256).alias("source_hash"))
    before = d.filter("doc_id % 7 <> 0").select(*row(F.lit(1), F.col("text")))
    touched = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    now = d.filter("doc_id % 11 <> 0 or doc_id % 7 = 0").select(*row(F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1), touched))
    return files.changes(before, now)


@_query("""WITH h AS (SELECT doc_id, sha256(text) AS src, CASE doc_id % 4 WHEN 0 THEN 'digest' WHEN 1 THEN 'derived' WHEN 2 THEN 'original' ELSE 'lesson' END AS kind, '/kb/' || source || '/' || doc_id || '.txt' AS path, CAST(n_chars AS DOUBLE) AS score, doc_id % 3 = 0 AS partial FROM documents)
SELECT CASE WHEN kind = 'lesson' THEN 'lesson:' || path ELSE src END AS source_key, arg_max(kind, CASE kind WHEN 'digest' THEN 3 WHEN 'derived' THEN 2 WHEN 'original' THEN 1 ELSE 0 END) AS kind, max(score) AS score, bool_and(partial) AS partial, CAST(count(*) AS INTEGER) AS n_hits FROM h GROUP BY 1""")
def merge_hits(spark, sf_dir):
    d = _documents(spark, sf_dir)
    kind = F.element_at(F.array(*(F.lit(k) for k in ("digest", "derived", "original", "lesson"))), (F.col("doc_id") % 4 + 1).cast("int"))
    hits = d.select(kind.alias("kind"), "path", F.sha2("text", 256).alias("source_path"), F.lit("t").alias("title"), F.col("n_chars").cast("double").alias("score"), (F.col("doc_id") % 3 == 0).alias("partial"))
    return search.merge_hits(hits).select("source_key", "kind", "score", "partial", "n_hits")


_ROOTS = [("all", "/kb", ["src9", "src2/2"]), ("one", "/kb/src1", []), ("three", "/kb/src3", ["3.txt"])]
_BINDINGS = [
    ("all", ".", ("shared", [])),
    ("all", "src1", ("projects", ["p1"])),
    ("all", "src4", ("projects", ["p1", "p2"])),
    ("three", ".", ("projects", ["p3"])),
    ("all", "src3/23.txt", ("projects", ["p1"])),
    ("one", ".", ("projects", ["p2"])),
    ("all", "src5", ("unassigned", [])),
]
_PLACES_SQL = "SELECT doc_id, source, '/kb/' || source || '/' || doc_id || '.txt' AS path FROM documents"


def _configured(spark):
    return spark.createDataFrame(_ROOTS, ownership.ROOTS), spark.createDataFrame(_BINDINGS, ownership.BINDINGS)


_EXCLUDED_SQL = "list_bool_or(list_concat([false], list_transform({rules}, lambda x: rtrim(ltrim(replace(x, chr(92), '/'), '/'), '/') <> '' AND ({path} = rtrim(ltrim(replace(x, chr(92), '/'), '/'), '/') OR starts_with({path}, rtrim(ltrim(replace(x, chr(92), '/'), '/'), '/') || '/')))))"


def _values(rows: list[tuple]) -> str:
    """Configuration as a VALUES list, written from the same constants that the query uses."""
    one = lambda x: "[" + ", ".join(map(one, x)) + "]::VARCHAR[]" if isinstance(x, list) else "'" + x + "'"
    return ", ".join("(" + ", ".join(one(x) for x in row) + ")" for row in rows)


_COVERED_SQL = f"""f AS ({_PLACES_SQL}),
roots(root, base, rules) AS (VALUES {_values(_ROOTS)}),
bindings(root, bind, kind, projects) AS (VALUES {_values([(r, p, k, sorted(set(ids))) for r, p, (k, ids) in _BINDINGS])}),
inside AS (SELECT path, root, base, rules, substr(path, length(base) + 2) AS rel FROM f JOIN roots ON starts_with(path, base || '/')),
covered AS (SELECT *, {_EXCLUDED_SQL.format(rules="rules", path="rel")} AS excluded, regexp_matches(rel, '^(digests|lessons|\\.loomdex)(/|$)') AS managed FROM inside),
placed AS (SELECT path, bool_or(excluded) AS excluded, bool_or(managed) AS managed FROM covered GROUP BY path)"""
_OWNERSHIP_SQL = f"""WITH {_COVERED_SQL},
hit AS (SELECT c.path, b.bind = c.rel AS exact, length(CASE WHEN b.bind = '.' THEN c.base ELSE c.base || '/' || b.bind END) AS depth, b.kind || ':' || array_to_string(b.projects, ',') AS scope
  FROM covered c JOIN bindings b ON b.root = c.root AND (b.bind = '.' OR b.bind = c.rel OR starts_with(c.rel, b.bind || '/')) JOIN placed p ON p.path = c.path WHERE b.bind = c.rel OR NOT p.managed),
best AS (SELECT path, scope, dense_rank() OVER (PARTITION BY path ORDER BY exact DESC, depth DESC) AS place FROM hit),
top AS (SELECT path, count(DISTINCT scope) AS scopes, min(scope) AS scope FROM best WHERE place = 1 GROUP BY path),
own AS (SELECT f.path, coalesce(p.excluded, FALSE) AS gone, coalesce(t.scopes > 1, FALSE) AND NOT coalesce(p.excluded, FALSE) AS conflict, t.scope FROM f LEFT JOIN placed p ON p.path = f.path LEFT JOIN top t ON t.path = f.path)
SELECT path, gone OR conflict AS excluded, conflict, CASE WHEN gone OR conflict OR scope IS NULL THEN 'unassigned' ELSE split_part(scope, ':', 1) END AS kind, CASE WHEN gone OR conflict OR scope IS NULL THEN '' ELSE split_part(scope, ':', 2) END AS projects FROM own"""


@_query(_OWNERSHIP_SQL)
def file_ownership(spark, sf_dir):
    roots, bindings = _configured(spark)
    own = ownership.resolve(_documents(spark, sf_dir).select("path"), roots, bindings)
    return own.withColumn("projects", F.concat_ws(",", "projects"))


@_query(f"SELECT path FROM ({_OWNERSHIP_SQL}) WHERE NOT excluded AND (kind = 'shared' OR kind = 'projects' AND list_contains(string_split(projects, ','), 'p2'))")
def visibility(spark, sf_dir):
    roots, bindings = _configured(spark)
    own = ownership.resolve(_documents(spark, sf_dir).select("path"), roots, bindings)
    return own.filter(ownership.is_visible(F.col("excluded"), F.col("kind"), F.col("projects"), True, ["p2"])).select("path")


@_query(f"""WITH {_COVERED_SQL}
SELECT f.path, max_by(c.root, length(c.base)) AS root, coalesce(bool_or(c.excluded), FALSE) AS excluded FROM f LEFT JOIN covered c ON c.path = f.path GROUP BY f.path""")
def most_specific_root(spark, sf_dir):
    return ownership.most_specific_root(_documents(spark, sf_dir).select("path"), _configured(spark)[0])


@_query(f"""WITH {_COVERED_SQL}, t AS (SELECT CASE WHEN b.bind = '.' THEN r.base ELSE r.base || '/' || b.bind END AS target, b.kind || ':' || array_to_string(b.projects, ',') AS scope FROM bindings b JOIN roots r ON r.root = b.root)
SELECT target, count(DISTINCT scope) AS scopes FROM t GROUP BY target HAVING count(DISTINCT scope) > 1""")
def binding_conflicts(spark, sf_dir):
    return ownership.binding_conflicts(*_configured(spark))


@_query(f"""WITH f AS ({_PLACES_SQL}), w(id, space) AS (VALUES ('top', '/kb'), ('deep', '/kb/src1'), ('deep', '/kb/src2'), ('twin', '/kb/src2')),
above AS (SELECT path, id, dense_rank() OVER (PARTITION BY path ORDER BY length(space) DESC) AS place FROM f JOIN w ON path = space OR starts_with(path, space || '/')),
top AS (SELECT path, min(id) AS id, count(DISTINCT id) > 1 AS many FROM above WHERE place = 1 GROUP BY path)
SELECT f.path AS cwd, CASE WHEN NOT many THEN id END AS project_id, coalesce(many, FALSE) AS ambiguous FROM f LEFT JOIN top t ON t.path = f.path""")
def workspace_match(spark, sf_dir):
    projects = spark.createDataFrame([("top", ["/kb"]), ("deep", ["/kb/src1", "/kb/src2"]), ("twin", ["/kb/src2"])], "id string, workspaces array<string>")
    return ownership.match_workspace(_documents(spark, sf_dir).select(F.col("path").alias("cwd")), projects)


@_query(f"SELECT doc_id FROM (SELECT doc_id, substr(path, 5) AS rel FROM ({_PLACES_SQL})) WHERE NOT {_EXCLUDED_SQL.format(rules="['src7/', chr(92) || 'src2' || chr(92) || '2.txt', 'src', '']", path='rel')}")
def exclude_rules(spark, sf_dir):
    rules = F.array(F.lit("src7/"), F.lit("\\src2\\2.txt"), F.lit("src"), F.lit(""))
    return _documents(spark, sf_dir).filter(~tx.excluded(F.col("rel_path"), rules)).select("doc_id")


@_query(f"""WITH c AS (SELECT doc_id, encode(text) || CASE doc_id % 3 WHEN 0 THEN '\\x00'::BLOB WHEN 1 THEN '\\xFF\\xFE'::BLOB ELSE ''::BLOB END AS content FROM documents)
SELECT doc_id, CASE WHEN octet_length(content) > {tx.FILE_MAX} THEN 'too-large' WHEN regexp_matches(hex(content), '^(?:[0-9A-F]{{2}})*00') THEN 'binary' WHEN try(decode(content)) IS NULL THEN 'non-utf8' END AS reason FROM c""")
def safe_reads(spark, sf_dir):
    body = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(body, F.unhex(F.lit("00")))).when(F.col("doc_id") % 3 == 1, F.concat(body, F.unhex(F.lit("FFFE")))).otherwise(body)
    return _table(spark, sf_dir, "documents").select("doc_id", tx.skip_reason(content).alias("reason"))


@_query(f"""WITH f AS (SELECT doc_id, 'a.b/x' || (['.md', '.YAML', '.Html', '.png', ''])[CAST(doc_id % 5 + 1 AS INTEGER)] AS path FROM documents)
SELECT doc_id FROM f WHERE regexp_extract(lower(path), '[.][^./]*$') IN {tx.TEXT_EXTENSIONS}""")
def text_extensions(spark, sf_dir):
    ext = F.element_at(F.array(*(F.lit(x) for x in (".md", ".YAML", ".Html", ".png", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "documents").filter(tx.is_text_file(F.concat(F.lit("a.b/x"), ext))).select("doc_id")


@_query("SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s <= 1000000")
def byte_budget(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("size"))
    return files.within_bytes(d, 1_000_000, "doc_id").select("doc_id")


_CHUNK_SQL = f"""WITH RECURSIVE l AS (SELECT doc_id, {_lines_sql('text')} AS ls FROM documents),
c AS (
  SELECT doc_id, ls, 1 AS n, 0 AS idx, 1 AS start, CAST(length(ls[1]) + 1 AS BIGINT) AS chars, FALSE AS cut FROM l
  UNION ALL
  SELECT doc_id, ls, n + 1, CASE WHEN k THEN idx + 1 ELSE idx END, CASE WHEN k THEN n + 1 ELSE start END, CASE WHEN k THEN size ELSE chars + size END, k
  FROM (SELECT *, length(ls[n + 1]) + 1 AS size,
          NOT regexp_matches(ls[n + 1], '^\\s*\\|') AND ((chars + length(ls[n + 1]) + 1 > 12000 AND n + 1 > start) OR (regexp_matches(trim(ls[n + 1]), '^#{{1,6}}\\s+\\S') AND chars > 6000)) AS k FROM c WHERE n < len(ls)))
SELECT doc_id, idx, CAST(min(n) AS INTEGER) AS start_line, CAST(max(n) AS INTEGER) AS end_line FROM c GROUP BY doc_id, idx"""


@_query(_CHUNK_SQL)
def document_chunks(spark, sf_dir):
    return chunks.chunks(_table(spark, sf_dir, "documents").select("doc_id", "text"))


_SECRETS = ["-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 12, "sk-" + "Ab3" * 8, "xoxb-" + "12-ab" * 5, "AKIA" + "ABCD1234" * 2, "api_key = 'qwertyuiop'", "password: changeme", "secret=short", "passwd: ${ENV_VALUE}"]
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_VALUE_SQL = f"regexp_extract(t, {_quoted(tx.LABELED)}, 1)"
_SECRET_SQL = f"""CASE {" ".join(f"WHEN regexp_matches(t, {_quoted(p)}) THEN '{k}'" for k, p in tx.SECRETS.items())}
  WHEN length({_VALUE_SQL}) >= 8 AND NOT regexp_matches({_VALUE_SQL}, {_quoted(tx.PLACEHOLDER)}) THEN 'labeled-secret' END"""


@_query(f"SELECT doc_id, {_SECRET_SQL} AS kind FROM (SELECT doc_id, coalesce(text, '') || chr(10) || ([{', '.join(map(_quoted, _SECRETS))}])[CAST(doc_id % 9 + 1 AS INTEGER)] AS t FROM documents)")
def secret_kinds(spark, sf_dir):
    planted = F.element_at(F.array(*(F.lit(x) for x in _SECRETS)), (F.col("doc_id") % 9 + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", tx.secret_kind(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), planted)).alias("kind"))


@_query("""WITH p AS (SELECT conv_id, turn, role, text, CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN 'failed' ELSE 'completed' END AS status FROM conversations)
SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS topics, substr(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE text <> ''), 1, 1200) AS summary, CAST(count(*) AS INTEGER) AS parts
FROM p GROUP BY conv_id HAVING bool_and(status = 'completed')""")
def record_merge(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    none = F.array().cast("array<string>")
    output = F.struct(F.col("text").alias("summary"), F.array("role").alias("topics"), none.alias("aliases"), none.alias("questions"), F.array().cast(f"array<{chunks.RULE}>").alias("rules"))
    parts = c.select("conv_id", F.col("turn").cast("int").alias("idx"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("h").alias("source_hash"), F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0), "failed").otherwise("completed").alias("status"), output.alias("output"))
    docs = c.select("conv_id", F.lit("h").alias("source_hash")).distinct()
    merged = chunks.merge_outputs(parts, docs, "conv_id")
    return merged.select("conv_id", F.concat_ws(",", F.array_sort("topics")).alias("topics"), "summary", F.size("coverage").alias("parts"))


@_query("""WITH c AS (SELECT source AS root, CASE WHEN doc_id % 3 = 0 THEN 'completed' WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN 'failed' WHEN doc_id % 3 = 1 THEN 'running' ELSE 'pending' END AS status FROM documents WHERE source <> 'src1' OR doc_id % 3 = 0),
n AS (SELECT root, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status IN ('pending', 'running')) AS pending FROM c GROUP BY root)
SELECT *, CAST(floor(100 * done / total + 0.5) AS INTEGER) AS percent, CASE WHEN root = 'src2' AND pending > 0 THEN 'paused' WHEN pending = 0 AND failed = 0 THEN 'complete' WHEN pending = 0 THEN 'partly complete' ELSE 'running' END AS state FROM n""")
def job_summary(spark, sf_dir):
    status = F.when(F.col("doc_id") % 3 == 0, "completed").when((F.col("doc_id") % 3 == 1) & (F.col("doc_id") % 2 == 0), "failed").when(F.col("doc_id") % 3 == 1, "running").otherwise("pending")
    parts = _table(spark, sf_dir, "documents").filter("source <> 'src1' or doc_id % 3 = 0").select(F.col("source").alias("root"), status.alias("status"))
    return chunks.job_summary(parts, paused=F.col("root") == "src2")


@_query("""WITH n AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS rel_path, sha256(source || '/' || doc_id || '.txt' || text) AS source_hash, 0 AS idx, 1 AS start_line, 9 AS end_line FROM documents),
p AS (SELECT CASE WHEN doc_id % 4 <> 1 THEN rel_path END AS rel_path, source_hash, idx, CASE WHEN doc_id % 4 = 2 THEN 2 ELSE 1 END AS start_line, end_line, CASE WHEN doc_id % 4 = 3 THEN 'failed' ELSE 'completed' END AS status FROM n),
done AS (SELECT * FROM p WHERE status = 'completed')
SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM done d WHERE (d.rel_path = n.rel_path OR d.rel_path IS NULL) AND d.source_hash = n.source_hash AND d.idx = n.idx AND d.start_line = n.start_line AND d.end_line = n.end_line) THEN 'completed' ELSE 'pending' END AS status FROM n""")
def chunk_reuse(spark, sf_dir):
    d = _documents(spark, sf_dir).select("doc_id", "rel_path", F.sha2(F.concat("rel_path", "text"), 256).alias("source_hash"), F.lit(0).alias("idx"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    none = F.array().cast("array<string>")
    output = F.struct(F.lit("s").alias("summary"), none.alias("topics"), none.alias("aliases"), none.alias("questions"), F.array().cast(f"array<{chunks.RULE}>").alias("rules"))
    m = F.col("doc_id") % 4
    before = d.select(F.when(m != 1, F.col("rel_path")).alias("rel_path"), "source_hash", "idx", F.when(m == 2, 2).otherwise(1).alias("start_line"), "end_line", F.when(m == 3, "failed").otherwise("completed").alias("status"), output.alias("output"))
    return chunks.reuse(before, d).select("doc_id", "status")


_HEADER_SQL = r"'^<!-- [A-Za-z][A-Za-z0-9_-]*\n(\{.*?\})\n-->'"
_META_SQL = "*, " + ", ".join(f"CASE WHEN json_valid(j) THEN json_extract_string(j, '$.{k}') END AS {c}" for k, c in {"type": "type", "createdAt": "made", "author": "author", "cwd": "cwd", "sourcePath": "source_path", "sourceHash": "source_hash", "coverage": "coverage"}.items())
_GOOD_SQL = "coalesce(type IN ('digest', 'lesson') AND made IS NOT NULL AND author IS NOT NULL AND cwd IS NOT NULL AND (type = 'lesson' OR source_path IS NOT NULL AND source_hash IS NOT NULL AND coverage = 'full-text'), FALSE)"


@_query(rf"""WITH d AS (SELECT doc_id, '/kb/' || source || '/' || doc_id || '.txt' AS path FROM documents),
h AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{{"type":"digest","createdAt":"2024-01-01","author":"a","cwd":"/","sourcePath":"' || path || '","sourceHash":"h","coverage":"full-text"}}'
  WHEN 1 THEN '{{"type":"lesson","createdAt":"2024-01-01","author":"a","cwd":"/"}}' WHEN 2 THEN '{{"type":"digest","createdAt":"2024-01-01","author":"a","cwd":"/"}}' ELSE '{{broken' END AS head FROM d),
m AS (SELECT doc_id, {_META_SQL} FROM (SELECT doc_id, regexp_extract('<!-- notes' || chr(10) || head || chr(10) || '-->' || chr(10), {_HEADER_SQL}, 1, 's') AS j FROM h)),
g AS (SELECT *, {_GOOD_SQL} AS good FROM m)
SELECT doc_id, CASE WHEN good THEN type END AS type, CASE WHEN good THEN source_path END AS source_path, CASE WHEN good AND type = 'digest' THEN 'digest' ELSE 'lesson' END AS kind FROM g""")
def note_headers(spark, sf_dir):
    d = _documents(spark, sf_dir)
    common = {"createdAt": F.lit("2024-01-01"), "author": F.lit("a"), "cwd": F.lit("/")}
    whole = {"sourcePath": F.col("path"), "sourceHash": F.lit("h"), "coverage": F.lit("full-text")}
    pack = lambda **f: F.to_json(F.struct(*(v.alias(k) for k, v in f.items())))
    m = F.col("doc_id") % 4
    header = F.when(m == 0, pack(type=F.lit("digest"), **common, **whole)).when(m == 1, pack(type=F.lit("lesson"), **common)).when(m == 2, pack(type=F.lit("digest"), **common)).otherwise(F.lit("{broken"))
    text = F.concat(F.lit("<!-- notes\n"), header, F.lit("\n-->\n\n# T\n\n"), "text")
    meta = notes.note_meta(text)
    return d.select("doc_id", meta["type"].alias("type"), meta["sourcePath"].alias("source_path"), notes.note_kind(text).alias("kind"))


@_query(rf"""WITH d AS (SELECT doc_id, '/kb/' || source || '/' || doc_id || '.txt' AS path, text FROM documents),
note AS (SELECT doc_id, regexp_extract('<!-- notes' || chr(10) || '{{"type":"digest","createdAt":"t","author":"a","cwd":"/","sourcePath":"' || path || '","sourceHash":"' || sha256(text) || '","coverage":"full-text"}}' || chr(10) || '-->' || chr(10), {_HEADER_SQL}, 1, 's') AS j FROM d),
m AS (SELECT doc_id, {_META_SQL} FROM note), g AS (SELECT *, {_GOOD_SQL} AS good FROM m),
src AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'other' WHEN doc_id % 2 <> 0 THEN sha256(text) END AS hash, doc_id % 5 <> 0 AS in_scope FROM d WHERE doc_id % 7 <> 0)
SELECT doc_id, CASE WHEN NOT good OR type <> 'digest' THEN 'unverified' WHEN s.path IS NULL THEN 'missing' WHEN NOT in_scope OR regexp_matches(s.path, '^/*(digests|lessons)(/|$)') THEN 'out-of-scope' WHEN hash IS NULL THEN 'unverified'
  WHEN hash <> source_hash THEN 'changed' ELSE 'unchanged' END AS status FROM g LEFT JOIN src s ON s.path = g.source_path""")
def digest_status(spark, sf_dir):
    d = _documents(spark, sf_dir)
    header = F.to_json(F.struct(F.lit("digest").alias("type"), F.lit("t").alias("createdAt"), F.lit("a").alias("author"), F.lit("/").alias("cwd"), F.col("path").alias("sourcePath"), F.sha2("text", 256).alias("sourceHash"), F.lit("full-text").alias("coverage")))
    digests = d.select("doc_id", F.concat(F.lit("<!-- notes\n"), header, F.lit("\n-->\n")).alias("text"))
    now = F.when(F.col("doc_id") % 3 == 0, F.lit("other")).when(F.col("doc_id") % 2 != 0, F.sha2("text", 256))
    sources = d.filter("doc_id % 7 <> 0").select("path", now.alias("hash"), (F.col("doc_id") % 5 != 0).alias("in_scope"))
    return notes.digest_status(digests, sources).select("doc_id", "status")


@_query("""WITH d AS (SELECT doc_id, '/kb/' || source || '/' || doc_id || '.txt' AS path, text FROM documents),
hit AS (SELECT doc_id, path, CASE WHEN doc_id % 4 = 0 THEN 'digest' ELSE 'original' END AS kind, sha256(text) AS source_hash, CASE WHEN doc_id % 4 = 0 THEN 's:' || path END AS source_path, sha256('x') AS source_file_hash FROM d),
live AS (SELECT path, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE text || '!' END) AS hash FROM d UNION ALL SELECT 's:' || path, sha256(CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE 'y' END) FROM d)
SELECT doc_id FROM hit h JOIN live l ON l.path = h.path AND l.hash = h.source_hash LEFT JOIN live o ON o.path = h.source_path
WHERE h.kind NOT IN ('digest', 'derived') OR h.source_path IS NULL OR coalesce(h.source_file_hash, o.hash) = o.hash""")
def fresh_hits(spark, sf_dir):
    d = _documents(spark, sf_dir)
    hits = d.select("doc_id", "path", F.when(F.col("doc_id") % 4 == 0, "digest").otherwise("original").alias("kind"), F.sha2("text", 256).alias("source_hash"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("s:"), "path")).alias("source_path"), F.sha2(F.lit("x"), 256).alias("source_file_hash"))
    live = d.select("path", F.encode(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))), "UTF-8").alias("content"))
    live = live.unionByName(d.select(F.concat(F.lit("s:"), "path").alias("path"), F.encode(F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y"), "UTF-8").alias("content")))
    return search.fresh(hits, live).select("doc_id")


@_query(r"""WITH t AS (SELECT '  Title ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' —— ' ELSE ' -- ' END || doc_id || '.md ' || chr(13) || chr(10) || CASE WHEN doc_id % 6 = 0 THEN 'Other -- ' || doc_id || '.md' || chr(10) ELSE 'no title here' || chr(10) END AS body FROM documents),
l AS (SELECT unnest(string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line FROM t),
p AS (SELECT regexp_extract(line, '^\s*(.+?)\s+(?:——|--)\s+(\S+\.[A-Za-z0-9]+)\s*$', 2) AS file, trim(regexp_extract(line, '^\s*(.+?)\s+(?:——|--)\s+(\S+\.[A-Za-z0-9]+)\s*$', 1)) AS title FROM l)
SELECT 'd' AS folder, file, min(title) AS title FROM p WHERE file <> '' AND NOT contains(file, '..') GROUP BY file HAVING count(DISTINCT title) = 1 AND min(title) <> ''""".replace("\\\\", "\\"))
def export_titles(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("i"), "doc_id")
    line = F.concat(F.lit("  Title "), "i", F.when(F.col("doc_id") % 2 == 0, " —— ").otherwise(" -- "), "i", F.lit(".md \r\n"))
    twice = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("Other -- "), "i", F.lit(".md\n"))).otherwise(F.lit("no title here\n"))
    return notes.readme_titles(d.select(F.lit("d").alias("folder"), F.concat(line, twice).alias("text")))


@_query("SELECT CAST(conv_id AS VARCHAR) AS folder, 'page ' || turn AS title, 'a/' || role AS catalog FROM conversations WHERE turn % 2 = 0")
def export_catalogs(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    page = F.struct(F.concat(F.lit("page "), F.col("turn").cast("string")).alias("page_title"))
    pages = F.when(F.col("turn") % 2 == 0, F.array(page)).otherwise(F.array(page, page))
    tree = F.struct(F.struct(F.array(F.struct(F.lit("a").alias("cat_name"), F.array(F.struct(F.col("role").alias("cat_name"), pages.alias("pages"))).alias("catalogs"))).alias("catalogs")).alias("pages"))
    return notes.info_titles(c.select(F.col("conv_id").cast("string").alias("folder"), F.to_json(tree).alias("text"))).withColumn("catalog", F.array_join("catalog", "/"))


@_query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE 'old' END AS source_hash, sha256(text) AS now, CASE WHEN doc_id % 3 = 0 THEN ['About ' || source] ELSE [] END AS topics, ['why is it so', 'about nothing'] AS questions FROM documents),
h AS (SELECT *, lower(regexp_replace(array_to_string(list_concat(topics, questions), chr(10)), '[ \t]+', ' ', 'g')) AS hay FROM r)
SELECT doc_id, substr(list_filter(list_concat(topics, questions), lambda x: contains(lower(x), 'why') OR contains(lower(x), 'about'))[1], 1, 300) AS evidence FROM h WHERE source_hash = now AND contains(hay, 'why') AND contains(hay, 'about')""")
def semantic_hits(spark, sf_dir):
    d = _documents(spark, sf_dir)
    none = F.array().cast("array<string>")
    records = d.select("doc_id", "path", F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise(F.lit("old")).alias("source_hash"), F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("About "), "source"))).otherwise(none).alias("topics"), none.alias("aliases"), F.array(F.lit("why is it so"), F.lit("about nothing")).alias("questions"), F.array().cast(f"array<{chunks.RULE}>").alias("rules"))
    return search.semantic_hits(records, d.select("path", F.sha2("text", 256).alias("source_hash")), "WHY about").select("doc_id", "evidence")


@_query("SELECT source AS root, count(*) AS skipped, array_to_string(list_sort(list_distinct(list('r' || (doc_id % 9))))[1:8], ',') AS reasons FROM documents WHERE doc_id % 9 <> 0 GROUP BY source")
def skip_reasons(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("source").alias("root"), F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("r"), (F.col("doc_id") % 9).cast("string"))).alias("reason"))
    return files.skip_summary(d).withColumn("reasons", F.concat_ws(",", "reasons"))


@_query(rf"""WITH run AS (SELECT p_partkey, regexp_replace(unnest(regexp_extract_all(replace(p_name, ' ', 'Of') || '.' || p_brand || '_' || p_type, '{_CJK}+|[A-Za-z0-9_][A-Za-z0-9_.]*')), '\.$', '') AS r FROM part)
SELECT p_partkey, term, count(*) AS tf FROM (SELECT p_partkey, unnest({_TERMS_SQL}) AS term FROM run) WHERE term <> '' GROUP BY ALL""")
def identifier_terms(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("Of")), F.lit("."), "p_brand", F.lit("_"), "p_type")
    # Names of one part come together before they are cut into terms: a row is what a task holds, not all its terms.
    return postings(p.groupBy("p_partkey").agg(F.collect_list(name).alias("lines")), key="p_partkey", columns=("tf",)).select("p_partkey", "term", "tf")


@_query(f"""WITH parts AS ({_CHUNK_SQL}), t AS (SELECT doc_id, {_lines_sql('text')} AS ls FROM documents)
SELECT p.doc_id, p.idx, p.start_line, p.end_line, 'completed' AS status, trim(substr(trim(t.ls[p.start_line], ' '), 1, 60)) AS summary FROM parts p JOIN t ON t.doc_id = p.doc_id""")
def enrichment(spark, sf_dir):
    """Every chunk of every document through a stand-in for a model."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = chunks.with_text(chunks.chunks(docs), docs)
    return chunks.enrich(parts, _first_line, concurrency=8).select("doc_id", "idx", "start_line", "end_line", "status", "output.summary")


def _first_line(text: str, error: str | None) -> str:
    """Stands for a model: the first line is the summary, and the first answer is never right."""
    import json

    if error is None:
        return "no object"
    return "so: " + json.dumps({"summary": text.split("\n")[0].strip(" ")[:60], "topics": [], "rules": []})
