"""Searches without an index, by records and over what a walk left out; snapshots, jobs and commands."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from loomdex import __main__ as cli
from loomdex.functions import text as tx
from loomdex.operators import chunks
from loomdex.plans.engine import Engine
from loomdex.sources import config as c
from loomdex.sources import files
from loomdex.sources.folder import Folder, lock_file
from loomdex.sources.index_store import DOCS, TERMS, IndexBusy, IndexStore
from loomdex.streaming import indexer

from .test_engine import doc, frames, write


@pytest.fixture
def engine(spark, tmp_path):
    write(str(tmp_path / "v/a.md"), "# Alpha\nheaderField is here\nmore zebra words\n")
    write(str(tmp_path / "v/b.md"), "plain zebra notes\n")
    write(str(tmp_path / "v/bad.md"), b"\xff\xfe\0a", "wb")
    write(str(tmp_path / "n/lessons/l.md"), '<!-- kb\n{"type":"lesson","createdAt":"t","author":"a","cwd":"/"}\n-->\n\n# L\n\nzebra lesson\n')
    raw = {"version": 2, "roots": [{"name": "v", "path": str(tmp_path / "v")}, {"name": "n", "path": str(tmp_path / "n"), "writable": True}], "enrich": {"provider": "p", "model": "m", "retries": 0, "concurrency": 2}}
    return Engine(spark, c.parse(raw))


def model(text, error):
    return json.dumps({"summary": text[:9], "topics": ["striped animal"], "aliases": [], "rules": []})


def test_scans_and_records_and_reports(spark, engine):
    out = engine.search("zebra", index=False)
    assert {(h.kind, h.rel_path, h.semantic) for h in out.hits.collect()} == {("original", "a.md", False), ("original", "b.md", False), ("lesson", "lessons/l.md", False)}
    assert not out.truncated and out.skipped == 1 and out.skip_reasons == ["binary"]
    assert engine.enrich("v", model).count() == 2
    (first, second) = sorted(engine.search("striped", "v", index=False).hits.collect(), key=lambda h: h.path)
    assert first.rel_path == "a.md" and first.semantic and first.evidence == "striped animal" and second.semantic
    scores = {h.rel_path: h.score for h in engine.search("zebra", "v", index=False).hits.collect()}
    assert scores == {"a.md": 1.0, "b.md": 1.0}  # a current record counts one
    # By the index as well: the derived note stands for the source, and the record says why.
    found = engine.search("striped", "v")
    assert {(h.kind, h.semantic, h.evidence) for h in found.hits.collect()} == {("derived", True, "striped animal")}
    assert found.truncated and "matched by meaning: striped animal" in found.text()  # enrichment alone doesn't make an index complete
    engine.refresh("v")
    found = engine.search("striped", "v")
    assert not found.truncated and found.skipped == 1 and found.skip_reasons == ["binary"]
    write(engine.config.root("v").path + "/a.md", "changed, no animal\n")
    assert {h.rel_path for h in engine.search("striped", "v", index=False).hits.collect()} == {"b.md"}


def test_a_locked_first_index_falls_back_to_scans(engine):
    with engine.store(engine.config.root("v")).lock():
        assert {h.rel_path for h in engine.search("zebra", "v").hits.collect()} == {"a.md", "b.md"}


def test_truncation_is_told_and_never_written(engine):
    budget = files.Budget(entries=1)
    prepared = engine.prepare("v", budget=budget)
    assert prepared.status == "memory_only" and prepared.truncated and "entries" in prepared.skip_reasons
    assert engine.prepare("v").status == "created"  # nothing was written before
    with pytest.raises(ValueError, match="entries"):
        engine.enrich("v", model, budget=files.Budget(entries=1))
    engine.refresh("v", files.Budget(entries=1))
    out = engine.search("zebra", "v")
    assert out.truncated and "entries" in out.skip_reasons and "truncated: True" in out.text()


def test_jobs_are_locked_and_gated(spark, tmp_path, monkeypatch):
    parts = spark.createDataFrame([(i, 0, 1, 1, f"text {i}") for i in range(3)], "doc_id int, idx int, start_line int, end_line int, text string")
    asked = tmp_path / "asked"
    asked.mkdir()

    def answer(text, error):
        (asked / f"{text}-{time.time_ns()}").touch()
        if "2" in text and len(os.listdir(asked)) < 4:
            return "nothing"
        return json.dumps({"summary": text})

    job = lambda **more: chunks.Job(f"file://{tmp_path}/job", answer, retries=0, concurrency=1, **more)
    first = job()
    with lock_file(Folder(spark, first.folder), "lock", chunks.JobBusy), pytest.raises(chunks.JobBusy):
        job().run(parts, ["doc_id", "idx"])
    count = lambda j: sorted(r.status for r in j.run(parts, ["doc_id", "idx"]).collect())
    assert count(first) == ["completed", "completed", "failed"] and len(os.listdir(asked)) == 3
    assert count(job()) == ["completed"] * 3 and len(os.listdir(asked)) == 4  # only the failed one was asked again
    assert count(job()) == ["completed"] * 3 and len(os.listdir(asked)) == 4
    assert count(job(full=True)) == ["completed"] * 3 and len(os.listdir(asked)) == 7
    monkeypatch.setattr(chunks, "PROMPT_VERSION", 2)
    assert count(job()) == ["completed"] * 3 and len(os.listdir(asked)) == 10


def test_a_task_stops_asking_after_failed_calls(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def broken(text, error):
        (asked / f"{time.time_ns()}").touch()
        raise RuntimeError("no connection")

    parts = spark.createDataFrame([(i, 0, 1, 1, "t") for i in range(40)], "doc_id int, idx int, start_line int, end_line int, text string")
    job = chunks.Job(f"file://{tmp_path}/job", broken, retries=0, concurrency=1)
    counts = {r.status: r["count"] for r in job.run(parts, ["doc_id", "idx"]).groupBy("status").count().collect()}
    assert job.paused and counts == {"failed": 2, "pending": 38} and len(os.listdir(asked)) == 2


def test_segments_are_small_and_merge(spark, tmp_path):
    s = IndexStore(spark, str(tmp_path / "index"), "src", per_bucket=4)
    s.commit(*frames(spark, [f"d{i}" for i in range(20)]))
    one = s.commit(*frames(spark, ["d3"], "v"))
    assert [(x.docs, x.changed, x.buckets) for x in one.segments] == [(20, 0, 8), (1, 1, 1)] and one.doc_count == 20
    two = s.commit(spark.createDataFrame([doc("new")], DOCS), spark.createDataFrame([("v", "new", 1, ["body"], [1])], TERMS), spark.createDataFrame([("d3",), ("d4",)], "doc_id string"))
    assert len(two.segments) == 2 and two.doc_count == 19  # the two small ones are one now
    assert {r.doc_id for r in s.get_postings(["v"]).collect()} == {"new"} and s.get_postings(["ownd4", "ownd3"]).count() == 0
    assert s.get_docs(["d3", "d5", "new"]).count() == 2 and s.docs().count() == 19
    assert s.docs(one.generation).count() == 20 and {r.doc_id for r in s.get_postings(["v"], one.generation).collect()} == {"d3"}
    s.commit(None, None, s.docs().select("doc_id"))
    assert s.docs().count() == 0 and s.generation().doc_count == 0
    with s.lock(), pytest.raises(IndexBusy):
        s.commit(None, None)


def test_executors_list_what_the_driver_lists(spark, engine, tmp_path):
    root = str(tmp_path / "v")
    for name in ("deep/er/x.md", "deep/y.TXT", "skip/z.md", ".git/q.md", "deep/no.png", "own/o.md"):
        write(f"{root}/{name}", "words")
    write(f"{root}/deep/big.md", "x" * (files.FILE_MAX + 1))
    os.symlink(f"{root}/a.md", f"{root}/deep/link.md")
    more = {"skip_inside": [f"{root}/own"], "exclude": ["skip"]}
    one, two = files.Budget(), files.Budget()
    want = {tuple(r) for r in files.listing(spark, "v", root, one, **more).collect()}
    got = {tuple(r) for r in files.spread_listing(spark, "v", root, two, **more).collect()}
    assert got == want and len(got) == 5 and (one.skipped, one.reasons, one.bytes, one.entries) == (two.skipped, two.reasons, two.bytes, two.entries)
    small = files.Budget(entries=2)
    assert files.spread_listing(spark, "v", root, small).count() == 3 and small.truncated and "entries" in small.reasons  # the first level
    engine.listing = files.spread_listing
    assert engine.refresh("v")["documents"] == 6 and engine.search("zebra", "v").hits.count() == 2


def test_truncated_readings_and_originals(spark):
    df = spark.createDataFrame([("all of it", None, None), ("x [Showing lines 1-20 of 90]", None, None), ("4 more lines in file. Use offset=5", None, None), ("x", 2, None), ("x", 1, None), ("x", None, True)], "t string, offset int, flag boolean")
    got = [r.x for r in df.select(tx.is_truncated_read(F.col("t"), F.col("offset"), F.col("flag")).alias("x")).collect()]
    assert got == [False, True, True, True, False, True]
    df = spark.createDataFrame([("a/b.md",), ("digests/x.md",), (".loomdex/notes/y.md",), ("a.png",), ("lessonsx/a.TXT",)], "p string")
    assert [r.x for r in df.select(tx.is_original_text_file(F.col("p")).alias("x")).collect()] == [True, False, False, False, True]


def test_arguments_and_visible_roots(tmp_path):
    os.makedirs(tmp_path / "a")
    raw = {"version": 2, "isolation": True, "roots": [{"name": "a", "path": str(tmp_path / "a")}, {"name": "b", "path": str(tmp_path / "gone")}], "projects": [{"id": "p", "name": "P", "workspaces": ["/w"]}, {"id": "q", "name": "Q", "workspaces": []}]}
    raw["bindings"] = [{"root": "a", "path": "x", "scope": {"projects": ["p"]}}, {"root": "a", "path": "y", "scope": "shared"}, {"root": "b", "path": ".", "scope": {"projects": ["p"]}}]
    config = c.parse(raw)
    assert (c.visible_roots(config), c.visible_roots(config, ["p"]), c.visible_roots(config, ["q"]), c.visible_roots(config, [], True)) == (0, 1, 0, 1)
    assert c.project_argument(config, " p ") == "p" and c.project_argument(config, "auto") == "auto"
    assert c.scope_argument(config, "p, q") == ["p", "q"] and c.scope_argument(config, "current") == [] and c.search_ids(config, "p", c.scope_argument(config, "all")) == ["p", "q"]
    assert c.search_ids(config, "shared", ["q"]) == ["q"]
    for f, bad in ((c.project_argument, ""), (c.project_argument, "zz"), (c.scope_argument, "p,all"), (c.scope_argument, " ")):
        with pytest.raises(c.ConfigError):
            f(config, bad)
    config.isolation = False
    assert c.visible_roots(config) == 1
    with pytest.raises(c.ConfigError):
        c.project_argument(config, "p")


def test_polling_sees_edits_and_deletes():
    calls, state = [], {"roots": ["a"]}

    def refresh(name):
        calls.append(name)
        if len(calls) == 2:
            state["roots"] = ["a", "b"]
            raise OSError("for once")
        return {"seen": 1}

    told = []
    assert indexer.poll(refresh, lambda: state["roots"], 0, lambda: len(calls) >= 4, lambda n, counts: told.append((n, counts))) == 3
    assert calls == ["a", "a", "a", "b"] and told[1] == ("a", {"error": "for once"})


def test_commands(spark, engine, tmp_path, capsys):
    path = str(tmp_path / "c.json")
    c.save(engine.config, path)
    run = lambda *args: cli.main([path, *args], spark)
    assert json.loads(run("refresh", "v"))["documents"] == 2
    assert "hits: 1" in run("search", "headerField", "--root", "v") and "hits: 1" in capsys.readouterr().out
    os.unlink(str(tmp_path / "v/b.md"))
    write(str(tmp_path / "v/c.md"), "a new okapi file\n")
    assert run("watch", "--rounds", "1", "--seconds", "0").startswith("v: ")
    assert "hits: 1" in run("search", "okapi") and '"index": "ready"' in run("status")
    run("off")
    with pytest.raises(c.ConfigError):
        run("search", "okapi")
    run("on")
    with pytest.raises(c.ConfigError):
        run("project", "p")
