import json
import os

import pytest

from loomdex.plans.engine import Engine
from loomdex.sources import config as c
from loomdex.sources import files
from loomdex.sources.index_store import DOCS, TERMS, IndexBusy, IndexStore


def write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


def doc(i, path="p.md"):
    return (i, path, "/" + path, "original", "t", [], "h", None, None, None, 1.0, 1, "f")


def store(spark, tmp_path):
    return IndexStore(spark, str(tmp_path / "index"), "src", per_bucket=2)


def frames(spark, ids, word="w"):
    return spark.createDataFrame([doc(i) for i in ids], DOCS), spark.createDataFrame([(word, i, 1, ["body"], [1]) for i in ids] + [(f"own{i}", i, 1, ["body"], [1]) for i in ids], TERMS)


def test_generations(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.generation() is None and s.docs().count() == 0
    first = s.commit(*frames(spark, ["a", "b", "c"]))
    assert first.doc_count == 3 and s.get_postings(["w"]).count() == 3
    second = s.commit(*frames(spark, ["b"], "v"), spark.createDataFrame([("c",)], "doc_id string"))
    assert second.doc_count == 2 and {r.doc_id for r in s.get_postings(["w"]).collect()} == {"a"}
    assert {r.term for r in s.get_postings(["v", "ownb", "ownc"]).collect()} == {"v", "ownb"}
    assert s.docs(first.generation).count() == 3  # still pinned
    staged = s.stage(*frames(spark, ["z"]))
    assert s.docs().count() == 2 and staged.doc_count == 3
    s.activate(staged)
    assert s.doc_ids().count() == 3 and s.docs(first.generation).count() == 3  # falls back to the current one
    assert s.commit(None, None).generation == staged.generation  # nothing to do
    with pytest.raises(ValueError):
        IndexStore(spark, s.folder.base, "other").commit(None, None)


def test_a_broken_manifest_is_absent(spark, tmp_path):
    s = store(spark, tmp_path)
    s.commit(*frames(spark, ["a"]))
    write(str(tmp_path / "index/generations/1.json"), "{")
    assert s.generation() is None and s.docs().count() == 0


def test_locks(spark, tmp_path):
    s = store(spark, tmp_path)
    with s.lock():
        with pytest.raises(IndexBusy):
            s.commit(None, None)
    import socket

    write(str(tmp_path / "index/lock"), json.dumps({"pid": 2**22 + 5, "token": "x", "host": socket.gethostname(), "at": 0}))
    with s.lock():
        pass
    write(str(tmp_path / "index/lock"), json.dumps({"pid": 1, "token": "x", "host": "elsewhere", "at": 0}))
    with pytest.raises(IndexBusy), s.lock():
        pass


@pytest.fixture
def vault(tmp_path):
    root = tmp_path / "vault"
    write(str(root / "a.md"), "# Alpha\r\nheaderField is &lt;observed.FullName&gt;\n离职 标记\n")
    write(str(root / "sub/b.md"), "plain notes on tokens\n")
    write(str(root / "_c.txt"), "underscore file with tokens\n")
    write(str(root / ".git/x.md"), "hidden tokens")
    write(str(root / "skip/x.md"), "excluded tokens")
    write(str(root / "bad.md"), b"\xff\xfe\0a", "wb")
    write(str(root / "big.md"), "x" * (1024 * 1024 + 1))
    os.symlink(str(root / "a.md"), str(root / "link.md"))
    return root


def engine(spark, vault, tmp_path, **more):
    write(str(tmp_path / "notes/.keep"), "")
    return Engine(spark, c.parse({"version": 2, "roots": [{"name": "v", "path": str(vault), "exclude": ["skip"]}, {"name": "n", "path": str(tmp_path / "notes"), "writable": True}], **more}))


def test_walk_and_reads(spark, vault):
    budget = files.Budget()
    found = {x[0] for x in files.walk(str(vault), budget, exclude=["skip"])}
    assert found == {"a.md", "sub/b.md", "_c.txt", "bad.md"} and budget.reasons == ["too-large"]
    read = {r.rel_path: r.reason for r in files.read_contents(files.listing(spark, "v", str(vault), exclude=["skip"])).collect()}
    assert read == {"a.md": None, "sub/b.md": None, "_c.txt": None, "bad.md": "binary"}
    small = files.Budget(entries=1)
    list(files.walk(str(vault), small))
    assert small.truncated and small.reasons == ["entries"]


def test_index_search_update_and_delete(spark, vault, tmp_path):
    e = engine(spark, vault, tmp_path)
    assert e.refresh("v")["updated"] == 3
    (hit,) = e.search("headerField observed.FullName", "v").hits.collect()
    assert hit.title == "Alpha" and hit.rel_path == "a.md" and hit.snippets[0].line == 2 and hit.snippets[0].text == "headerField is <observed.FullName>"
    assert [h.rel_path for h in e.search("离职", "v").hits.collect()] == ["a.md"]
    assert {h.rel_path for h in e.search("tokens").hits.collect()} == {"sub/b.md", "_c.txt"}
    assert [h.rel_path for h in e.search('"notes on"', "v").hits.collect()] == ["sub/b.md"]
    assert "hits: 2" in e.search("tokens").text()
    assert e.refresh("v")["updated"] == 0
    write(str(vault / "a.md"), "# Beta\nnew words here\n")
    os.unlink(str(vault / "sub/b.md"))
    assert e.search("headerField", "v").hits.count() == 0  # stale, so indexed again
    counts = e.refresh("v")
    assert counts["documents"] == 2 and [h.title for h in e.search("words", "v").hits.collect()] == ["Beta"]
    assert [s["documents"] for s in e.status()][0] == 2


def test_notes(spark, vault, tmp_path):
    e = engine(spark, vault, tmp_path)
    path = e.write_note("A lesson", "remember the zebra")
    assert "/lessons/" in path and [h.kind for h in e.search("zebra").hits.collect()] == ["lesson"]
    ref = e.record_read(str(vault / "a.md"))
    digest = e.write_note("About alpha", "alpha digest with giraffe", read_ref=f"readRef = {ref.id}")
    assert e.write_note("About alpha", "again", read_ref=ref.id) == digest and "giraffe" in open(digest).read()
    (hit,) = e.search("giraffe").hits.collect()
    assert hit.kind == "digest" and hit.source_path == str(vault / "a.md")
    for title, body in (("", "x"), ("t", ""), ("t", "x" * 20_000), ("t", "password = hunter2hunter2")):
        with pytest.raises(ValueError):
            e.write_note(title, body)
    write(str(vault / "a.md"), "changed")
    with pytest.raises(ValueError):
        e.write_note("About alpha", "x", read_ref=ref.id)
    assert e.search("giraffe").hits.count() == 0  # its source has changed
    assert e.record_read(str(vault / "skip/x.md")) is None and e.record_read(str(vault / "a.md"), whole=False) is None


def test_isolation(spark, vault, tmp_path):
    e = engine(spark, vault, tmp_path, isolation=True, projects=[{"id": "p", "name": "P", "workspaces": ["/w"]}], bindings=[{"root": "v", "path": "sub", "scope": {"projects": ["p"]}}])
    assert e.search("tokens", "v", project_ids=[]).hits.count() == 0
    assert [h.rel_path for h in e.search("tokens", "v", project_ids=["p"]).hits.collect()] == ["sub/b.md"]
    assert c.workspace_project(e.config, "/w/x") == "p" and c.workspace_project(e.config, "/x") is None


def _model(text, error):
    return json.dumps({"summary": text[:9], "aliases": ["nickname"], "rules": []})


def test_enrichment(spark, vault, tmp_path):
    e = engine(spark, vault, tmp_path)
    e.refresh("v")
    assert e.prepare("v")[0] == "created" and e.prepare("v")[0] == "reused"
    assert e.enrich("v", _model, retries=0).count() == 3
    assert {h.kind for h in e.search("nickname", "v").hits.collect()} == {"derived"}
    e.refresh("v")
    assert e.search("nickname", "v").hits.count() == 3  # a walk doesn't take derived notes away
    write(str(vault / "a.md"), "other")
    assert e.prepare("v")[0] == "updated"


@pytest.mark.parametrize(
    "raw",
    [
        [],
        {"roots": [{"name": "a", "path": "rel"}]},
        {"roots": [{"name": "a", "path": "/a"}, {"name": " a", "path": "/b"}]},
        {"roots": [{"name": "a", "path": "/a", "writable": True}, {"name": "b", "path": "/b", "writable": True}]},
        {"roots": [{"name": "a", "path": "/a", "exclude": [1]}]},
        {"roots": [], "projects": []},
        {"version": 2, "roots": [], "projects": [{"id": "all", "name": "x", "workspaces": []}]},
        {"version": 2, "roots": [], "projects": [{"id": "a", "name": "x", "workspaces": ["/w"]}, {"id": "b", "name": "x", "workspaces": ["/w"]}]},
        {"version": 2, "roots": [{"name": "a", "path": "/a"}], "bindings": [{"root": "b", "path": ".", "scope": "shared"}]},
        {"version": 2, "roots": [{"name": "a", "path": "/a"}], "bindings": [{"root": "a", "path": "../x", "scope": "shared"}]},
        {"version": 2, "roots": [{"name": "a", "path": "/a"}], "bindings": [{"root": "a", "path": ".", "scope": {"projects": ["p"]}}]},
        {"roots": [], "enrich": {"provider": "p", "model": "m", "retries": 9}},
    ],
)
def test_bad_configurations(raw):
    with pytest.raises(c.ConfigError):
        c.parse(raw)


def test_configurations_are_saved_whole(tmp_path):
    raw = {"version": 2, "roots": [{"name": "a", "path": "~/a"}], "projects": [{"id": "p", "name": "P", "workspaces": ["~/w"]}], "bindings": [{"root": "a", "path": "x/", "scope": {"projects": ["p", "p"]}}], "other": 7, "enrich": {"provider": "p", "model": "m"}}
    path = str(tmp_path / "c.json")
    write(path, json.dumps(raw))
    config = c.load(path)
    c.change_root(config, "add", "b", "/b")
    c.change_root(config, "set_writable", "b")
    c.save(config, path)
    again = c.load(path)
    assert again.writable.name == "b" and again.bindings[0].path == "x" and again.bindings[0].scope.projects == ("p",) and again.rest == {"other": 7} and again.enrich["concurrency"] == 8
    assert json.load(open(path + ".bak"))["other"] == 7
    c.change_root(again, "remove", "a")
    assert not again.bindings and c.new_project_id("My App!", set()) == "my-app" and c.new_project_id("all", set()).startswith("p-")
