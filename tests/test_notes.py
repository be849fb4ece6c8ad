import json

import pytest
from pyspark.sql import functions as F

from loomdex.operators import chunks, notes


def header(**meta):
    return f"<!-- some-tool\n{json.dumps(meta)}\n-->\n\n# T\n\nbody"


BASE = {"createdAt": "t", "author": "a", "cwd": "/"}


@pytest.mark.parametrize(
    "text, type_, kind",
    [
        (header(type="lesson", **BASE), "lesson", "lesson"),
        (header(type="digest", sourcePath="/p", sourceHash="h", coverage="full-text", **BASE), "digest", "digest"),
        (header(type="digest", sourcePath="/p", sourceHash="h", coverage="part", **BASE), None, "lesson"),
        (header(type="digest", **BASE), None, "lesson"),
        (header(type="other", **BASE), None, "lesson"),
        ("text\n" + header(type="lesson", **BASE), None, "lesson"),
        ("<!-- x\n{broken\n-->", None, "lesson"),
    ],
)
def test_headers(spark, text, type_, kind):
    r = spark.createDataFrame([(text,)], "t string").select(notes.note_meta(F.col("t"))["type"].alias("a"), notes.note_kind(F.col("t")).alias("b")).first()
    assert (r.a, r.b) == (type_, kind)


def test_scopes(spark):
    cases = ["shared", "unassigned", '{"projects":["a","b","a"]}', '{"projects":[]}', '{"projects":["all"]}', '{"projects":["a b"]}', "other", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", notes.parse_scope(F.col("t")).alias("s")).orderBy("i")
    assert [(r.s.kind, r.s.projects) if r.s else None for r in df.collect()] == [("shared", []), ("unassigned", []), ("projects", ["a", "b"]), None, None, None, None, None]


def test_round_trip_of_a_note(spark):
    text = notes.format_note({"type": "lesson", **BASE}, "Title", " body \n")
    assert text.endswith("-->\n\n# Title\n\nbody\n")
    assert spark.createDataFrame([(text,)], "t string").select(notes.note_meta(F.col("t"))["author"].alias("a")).first().a == "a"


def test_exports(spark):
    readme = "x —— a.md\n y  --  b/c.md\nx2 -- a.md\nbad -- ../d.md\nno line\nx3 -- a.md"
    titles = notes.readme_titles(spark.createDataFrame([("f", readme)], "folder string, text string"))
    assert [(r.file, r.title) for r in titles.collect()] == [("b/c.md", "y")]
    tree = {"pages": {"pages": [{"page_title": " y "}, {"page_title": "dup"}], "catalogs": [{"cat_name": "c", "pages": [{"page_title": "z"}, {"page_title": "dup"}], "catalogs": [{"cat_name": "", "pages": [{"page_title": "w"}]}]}]}}
    assert notes.info_catalogs(json.dumps(tree)) == [("w", ["c"]), ("y", []), ("z", ["c"])]
    for bad in ("[]", "{}", '{"pages": []}', '{"pages": {}}', "x"):
        assert notes.info_catalogs(bad) is None
    catalogs = notes.info_titles(spark.createDataFrame([("f", json.dumps(tree)), ("g", "broken")], "folder string, text string"))
    files = spark.createDataFrame([("f", "b/c.md"), ("f", "n.md")], "folder string, file string")
    got = {r.file: (r.mapped_title, r.catalog) for r in notes.with_export_titles(files, titles, catalogs).collect()}
    assert got == {"b/c.md": ("y", []), "n.md": (None, [])}


def ranges(spark, lines):
    out = chunks.chunks(spark.createDataFrame([(1, lines)], "doc_id int, lines array<string>")).orderBy("idx").collect()
    assert [r.idx for r in out] == list(range(len(out)))
    return [(r.start_line, r.end_line) for r in out]


def test_chunks(spark):
    assert ranges(spark, [""]) == [(1, 1)] and ranges(spark, []) == [(1, 1)]
    headed = [("# h" if i % 40 == 0 else "x" * 99) for i in range(400)]
    cut = ranges(spark, headed)
    assert cut[0] == (1, 80) and cut[-1][1] == 400 and all(a[1] + 1 == b[0] for a, b in zip(cut, cut[1:]))
    assert all(headed[s - 1] == "# h" for s, _ in cut)
    fence = ["intro", "```", *["y" * 999] * 20, "# not a heading", "```", "z" * 99]
    assert ranges(spark, fence) == [(1, 24), (25, 25)]
    assert ranges(spark, ["| a " + "x" * 5000] * 5 + ["end"]) == [(1, 5), (6, 6)]
    assert ranges(spark, ["w" * 20_000, "a", "w" * 20_000]) == [(1, 1), (2, 2), (3, 3)]


TEXT = "line one\nline two\nline three"


def rule(**more):
    return {"text": "t", "startLine": 11, "endLine": 12, "excerpt": "one\nline", **more}


@pytest.mark.parametrize("bad", [{"startLine": 9}, {"endLine": 14}, {"startLine": 12, "endLine": 11}, {"excerpt": "three"}, {"excerpt": ""}, {"startLine": "x"}, {"startLine": 11.5}])
def test_one_bad_rule_fails_a_chunk(bad):
    with pytest.raises(ValueError):
        chunks.validate({"rules": [rule(**bad)]}, TEXT, 11, 13)


def test_answers_are_limited():
    out = chunks.validate(chunks.extract_json('so {"summary": " %s ", "topics": ["a", "", 3, "b"], "rules": [7]} end' % ("s" * 900)), TEXT, 11, 13)
    assert len(out["summary"]) == 800 and out["topics"] == ["a", "b"] and out["rules"] == []
    assert chunks.validate({"rules": [rule()]}, TEXT, 11, 13)["rules"] == [{"text": "t", "start_line": 11, "end_line": 12, "excerpt": "one\nline"}]
    for text in ("", "}{", "{x}"):
        with pytest.raises(ValueError):
            chunks.extract_json(text)


def _answer(text, error):
    if "boom" in text:
        raise RuntimeError("no connection")
    return "nothing" if error is None else json.dumps({"summary": text[:5], "topics": ["t"]})


def test_jobs_retry_resume_and_pause(spark, tmp_path):
    parts = spark.createDataFrame([(i, 0, 1, 1, f"text {i}") for i in range(5)], "doc_id int, idx int, start_line int, end_line int, text string")
    job = chunks.Job(f"file://{tmp_path}/a", _answer, retries=1, concurrency=2, batch=2)
    out = job.run(parts, ["doc_id", "idx"]).collect()
    assert {r.status for r in out} == {"completed"} and not job.paused
    again = chunks.Job(f"file://{tmp_path}/a", None, batch=2)
    assert again.run(parts, ["doc_id", "idx"]).filter("status = 'completed'").count() == 5  # nothing is asked again
    bad = spark.createDataFrame([(i, 0, 1, 1, "boom") for i in range(6)], "doc_id int, idx int, start_line int, end_line int, text string")
    job = chunks.Job(f"file://{tmp_path}/b", _answer, retries=0, batch=1)
    counts = {r.status: r["count"] for r in job.run(bad, ["doc_id", "idx"]).groupBy("status").count().collect()}
    assert job.paused and counts == {"failed": 2, "pending": 4}
