import math

from pyspark.sql import functions as F

from loomdex.operators import search
from loomdex.operators.postings import postings


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, rel_path string, title string, catalog array<string>, text string")


def test_postings_keep_fields_and_first_lines(spark):
    df = docs(spark, [("1", "a/observedName.md", "Observed", ["Name"], "\n".join(["name"] * 12) + "\nother")])
    got = {r.term: r for r in postings(df).collect()}
    assert got["name"].tf == 14 and got["name"].fields == ["body", "catalog", "path"] and got["name"].lines == [1, 2, 3, 4, 5, 6, 7, 8]
    assert got["observed"].fields == ["path", "title"] and got["other"].lines == [13]


def test_visibility_comes_before_counts(spark):
    rows = [(f"{i:03}", "p.md", "t", [], "needle " * 20) for i in range(200)] + [("one", "p.md", "t", [], "needle")]
    post = postings(docs(spark, rows).select("doc_id", "text"))
    seen = spark.createDataFrame([("one",)], "doc_id string")
    (r,) = search.best(search.rank(post, "needle", seen), 1).collect()
    assert r.doc_id == "one" and math.isclose(r.score, math.log(1 + 0.5 / 1.5) * 2.2 / 2.2)


def test_coverage(spark):
    rows = [("a", "x", "", [], "alpha beta gamma"), ("b", "x", "", [], "alpha beta"), ("c", "x", "", [], "alpha")]
    post = postings(docs(spark, rows).select("doc_id", "text"))
    assert {r.doc_id: r.partial for r in search.rank(post, "alpha beta gamma").collect()} == {"a": False, "b": True}
    assert {r.doc_id for r in search.rank(post, "alpha zeta").collect()} == set()
    assert {r.doc_id for r in search.rank(post, "alpha").collect()} == {"a", "b", "c"}
    assert search.rank(post, '"alpha beta"').count() == 0
    assert {r.doc_id for r in search.rank(post, '"alpha beta"', phrase_terms=True).collect()} == {"a", "b", "c"}


def test_search_checks_phrases_and_limits(spark):
    rows = [(f"{i:02}", "x.md", "t", [], "apple pie" if i % 2 else "pie apple") for i in range(30)]
    df = docs(spark, rows)
    found = search.search(postings(df), df, 'apple "apple pie"', limit=2).collect()
    assert len(found) == 6 and all(int(r.doc_id) % 2 for r in found)


def test_boosts(spark):
    rows = [("t", "x.md", "zebra", [], "a"), ("p", "zebra.md", "x", [], "a"), ("c", "x.md", "x", ["zebra"], "a"), ("b", "x.md", "x", [], "zebra")]
    got = [r.doc_id for r in search.best(search.rank(postings(docs(spark, rows)), "zebra"), 9).collect()]
    assert got == ["t", "p", "c", "b"]


def test_merging(spark):
    rows = [
        ("original", "/a", None, "", 5.0, True),
        ("digest", "/d", "/a", "T", 3.0, False),
        ("derived", "/e", "/a", "U", 9.0, True),
        ("lesson", "/a", None, "L", 1.0, False),
    ]
    out = {r.source_key: r for r in search.merge_hits(spark.createDataFrame(rows, "kind string, path string, source_path string, title string, score double, partial boolean")).collect()}
    assert out["/a"].kind == "digest" and out["/a"].score == 9.0 and not out["/a"].partial and out["/a"].title == "T"
    assert out["lesson:/a"].kind == "lesson"


def test_snippets_prefer_known_lines(spark):
    text = "x needle\ny\nz NEEDLE &amp;\nneedle again"
    df = spark.createDataFrame([(text,)], "text string")
    get = lambda p: [(s.line, s.text) for s in df.select(search.snippets(F.col("text"), ["needle"], p).alias("s")).first().s]
    assert get(None) == [(1, "x needle"), (3, "z NEEDLE &")]
    assert get(F.array(F.lit(4))) == [(4, "needle again"), (1, "x needle")]


def test_order_is_the_unicode_one(spark):
    df = spark.createDataFrame([(p, 1.0) for p in "BbAa_"], "path string, score double")
    assert [r.path for r in search.order_hits(df, 9).collect()] == list("_aAbB")


def test_scan_needs_all_words(spark):
    df = spark.createDataFrame([(1, "Dir/Alpha.md", "beta  gamma &lt;tag&gt;"), (2, "x", "beta")], "doc_id int, rel_path string, text string")
    assert [(r.doc_id, r.path_score) for r in search.scan(df, "ALPHA <tag>").collect()] == [(1, 1)]
    assert search.scan(df, "beta", F.lit("beta")).filter("path_score = 1").count() == 2


def test_semantic_hits_need_current_records(spark):
    rule = "array<struct<text:string,start_line:int,end_line:int,excerpt:string>>"
    rows = [
        ("/a", "h", ["Topic One"], None, ["Why?"], [("must hold", 1, 1, "quoted words")]),
        ("/b", "old", ["Topic One"], [], [], []),
        ("/c", "h", [], ["alias"], [], []),
    ]
    records = spark.createDataFrame(rows, f"path string, source_hash string, topics array<string>, aliases array<string>, questions array<string>, rules {rule}")
    docs = spark.createDataFrame([("/a", "h"), ("/b", "h"), ("/c", "h")], "path string, source_hash string")
    find = lambda q: [(r.path, r.evidence) for r in search.semantic_hits(records, docs, q).collect()]
    assert find("topic ONE") == [("/a", "Topic One")]
    assert find('"quoted" HOLD') == [("/a", "must hold")]
    assert find("alias") == [("/c", "alias")] and find("topic alias") == []


def test_fresh_hits(spark):
    import hashlib

    digest = lambda x: hashlib.sha256(x).hexdigest()
    files = spark.createDataFrame([("/a", bytearray(b"1")), ("/d", bytearray(b"2")), ("/s", bytearray(b"3"))], "path string, content binary")
    rows = [
        ("/a", "original", digest(b"1"), None, None),
        ("/a", "original", digest(b"old"), None, None),
        ("/gone", "original", digest(b"1"), None, None),
        ("/d", "digest", digest(b"2"), "/s", digest(b"3")),
        ("/d", "derived", digest(b"2"), "/s", digest(b"old")),
        ("/d", "digest", digest(b"2"), "/gone", digest(b"3")),
        ("/d", "digest", digest(b"2"), None, None),
    ]
    hits = spark.createDataFrame(rows, "path string, kind string, source_hash string, source_path string, source_file_hash string")
    got = sorted((r.path, r.kind, r.source_path or "") for r in search.fresh(hits, files).collect())
    assert got == [("/a", "original", ""), ("/d", "digest", ""), ("/d", "digest", "/s")]


def test_paths_of_hits_are_united_and_cut(spark):
    one = spark.createDataFrame([("b", 1.0)], "path string, score double")
    two = spark.createDataFrame([("a", 1.0), ("c", 2.0)], "path string, score double")
    assert [r.path for r in search.order_hits(search.unite([one, two]), 2).collect()] == ["c", "a"]
    assert [search.clamp_limit(x) for x in (None, 0, 7, 99)] == [8, 1, 7, 20]


def brute(rows):
    """Postings of (key, text or lines, path, title, catalog, extra) by the rules of a query's words, a line at a time."""
    import re
    from collections import defaultdict

    from loomdex.functions.tokens import query_tokens

    out = {}
    for key, text, *fields in rows:
        path, title, catalog, extra = fields or (None, None, None, None)
        own = defaultdict(lambda: [0, set(), set()])
        parts = [("path", 1, path and path.replace("\\", "/")), ("title", 1, title), *(("catalog", 1, c) for c in catalog or []), ("alias", 1, extra)]
        parts += [("body", i, x) for i, x in enumerate(re.split("\r\n|\r|\n", text) if text is not None else [], 1)]
        for field, line, x in parts:
            for t in query_tokens(x or ""):
                own[t][0] += 1
                own[t][1].add(field)
                own[t][2].add(line)
        out |= {(key, t): (n, sorted(f), sorted(at)[:8]) for t, (n, f, at) in own.items()}
    return out


ODD = ["", None, "a.b.. A_b a_b a.b 中文x中 \r\n\rHTTPServer2Go é中Kİx naïve", "word " * 9 + "\nword\r" * 20, "x.", "Ａ 𠀀 豈豈豈 ﻿㐀", "HTTP http Http hTTP 12 a12B"]


def test_postings_of_odd_texts_by_brute_force(spark):
    rows = [(i, t, f"Dir\\a_B/{i}.md", None if i % 2 else "Word 中文", [None, "Cat", "cat"] if i % 3 else None, "alias a_b") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rel_path string, title string, catalog array<string>, extra string")
    found = postings(df).collect()
    assert {(r.doc_id, r.term): (r.tf, r.fields, r.lines) for r in found} == brute(rows) and len(found) == len(brute(rows))
    body = brute([r[:2] for r in rows])
    for columns in ((), ("tf",), ("lines",), ("tf", "fields")):
        got = postings(df.select("doc_id", "text"), columns=columns)
        assert got.columns == ["term", "doc_id", *columns]
        want = {k: [v[("tf", "fields", "lines").index(c)] for c in columns] for k, v in body.items()}
        assert {(r.doc_id, r.term): list(r[2:]) for r in got.collect()} == want


def test_postings_make_no_object_of_an_emission(spark):
    """Column expressions over every emission were what took the time."""
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for columns in ((), ("tf", "lines")):
        plan = postings(df, columns=columns)._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and "sort_array" not in plan and "MapInArrow" in plan


def test_cjk_terms_of_short_and_long_texts_are_the_same():
    from loomdex.operators import term_counts

    text = "".join(chr(c) for c in (0x33FF, 0x3400, 0x9FFF, 0xA000, 0xF8FF, 0xF900, 0xFAFF, 0xFB00, 0x20000, 0x4E00, 0x4E00, 0x4E00)) + "中文 中\n文é"
    once, long = dict(term_counts._cjk_counts(text)), dict(term_counts._cjk_counts((text + "\n") * 100))
    assert len(text) < term_counts.SHORT and long == {t: 100 * n for t, n in once.items()} and {"\u3400\u9fff", "一一", "中文"} < set(once)
    assert once["一"] == 3 and once["一一"] == 2 and not any(t in once for t in ("\u33ff", "\ua000", "\ufb00", "\n"))


def test_long_texts_are_counted_within_seconds(spark):
    import time

    text = "".join(chr(0x4E00 + i * i % 97) for i in range(500_000)) + " word_Part.x" * 50_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    postings(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count()
    start = time.time()
    assert postings(df, columns=("tf",)).agg(F.sum("tf")).first()[0] == 500_000 + 499_999 + 50_000 * len({"word_part.x", "word", "part", "x"})
    assert time.time() - start < 10


def test_identifier_terms_are_counted_within_a_part(spark, tmp_path):
    from loomdex.plans.queries import identifier_terms

    rows = [(1, "blue Sky", "Brand#1", "SMALL Box"), (1, "blue red", "Brand#1", "SMALL Box"), (2, None, "B", "T"), (None, "x", "B", "T"), (None, "x", "B", "T")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    out = identifier_terms(spark, str(tmp_path))
    got = {(r.p_partkey, r.term): r.tf for r in out.collect()}
    assert got[1, "blue"] == 2 and got[1, "brand"] == 2 and got[None, "x"] == 2 and not any(k == 2 for k, _ in got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
