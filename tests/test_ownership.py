import pytest
from pyspark.sql import functions as F

from loomdex.operators import ownership as o

ROOTS = [("r", "/r", ["secret"]), ("inner", "/r/sub", [])]


def resolve(spark, bindings, path):
    roots = spark.createDataFrame(ROOTS, o.ROOTS)
    rows = spark.createDataFrame([(r, p, s) for r, p, s in bindings], o.BINDINGS)
    return o.resolve(spark.createDataFrame([(path,)], "path string"), roots, rows).first()


SHARED, NONE = ("shared", []), ("unassigned", [])
P = lambda *ids: ("projects", list(ids))


@pytest.mark.parametrize(
    "bindings, path, excluded, conflict, kind, projects",
    [
        ([], "/r/a.md", False, False, "unassigned", []),
        ([("r", ".", SHARED)], "/r/a.md", False, False, "shared", []),
        ([("r", ".", SHARED)], "/elsewhere/a.md", False, False, "unassigned", []),
        ([("r", ".", SHARED)], "/r-sibling/a.md", False, False, "unassigned", []),
        ([("r", ".", SHARED), ("r", "d", P("a"))], "/r/d/x.md", False, False, "projects", ["a"]),
        ([("r", "d", P("a")), ("r", "d/x.md", P("b"))], "/r/d/x.md", False, False, "projects", ["b"]),
        ([("r", ".", SHARED)], "/r/secret/x.md", True, False, "unassigned", []),
        ([("r", "sub", P("a")), ("inner", ".", P("b"))], "/r/sub/x.md", True, True, "unassigned", []),
        ([("r", "sub", P("a", "b")), ("inner", ".", P("b", "a"))], "/r/sub/x.md", False, False, "projects", ["a", "b"]),
        ([("r", ".", P("a"))], "/r/lessons/x.md", False, False, "unassigned", []),
        ([("r", "lessons/x.md", P("a"))], "/r/lessons/x.md", False, False, "projects", ["a"]),
        ([("r", "di", P("a"))], "/r/dir/x.md", False, False, "unassigned", []),
        ([("r", ".", NONE)], "/r/a.md", False, False, "unassigned", []),
    ],
)
def test_resolution(spark, bindings, path, excluded, conflict, kind, projects):
    r = resolve(spark, bindings, path)
    assert (r.excluded, r.conflict, r.kind, sorted(r.projects)) == (excluded, conflict, kind, projects)


def test_documents_inherit(spark):
    roots = spark.createDataFrame(ROOTS, o.ROOTS)
    bindings = spark.createDataFrame([("r", "d", P("a"))], o.BINDINGS)
    rows = [
        ("/r/digests/1.md", "digest", "/r/d/x.md", None),
        ("/r/digests/2.md", "digest", None, None),
        ("/r/lessons/3.md", "lesson", None, ("projects", ["z"])),
        ("/r/d/4.md", "original", None, None),
        ("/r/d/5.md", "lesson", None, ("shared", [])),
    ]
    docs = spark.createDataFrame(rows, f"path string, kind string, source_path string, scope {o.SCOPE}")
    got = {r.path[-4]: (r.own_excluded, r.own_kind, r.own_projects) for r in o.document_ownership(docs, roots, bindings).collect()}
    assert got == {"1": (False, "projects", ["a"]), "2": (True, "unassigned", []), "3": (False, "projects", ["z"]), "4": (False, "projects", ["a"]), "5": (False, "projects", ["a"])}


def test_visibility(spark):
    rows = [(False, "shared", []), (False, "unassigned", []), (False, "projects", ["a"]), (True, "shared", [])]
    df = spark.createDataFrame(rows, "x boolean, kind string, projects array<string>")
    see = lambda *a: [r.v for r in df.select(o.is_visible(F.col("x"), F.col("kind"), F.col("projects"), *a).alias("v")).collect()]
    assert see(False, []) == [True, True, True, False]
    assert see(True, ["a"]) == [True, False, True, False]
    assert see(True, []) == [True, False, False, False]


def test_workspaces(spark):
    projects = spark.createDataFrame([("a", ["/w"]), ("b", ["/w/deep", "/t"]), ("c", ["/t"])], "id string, workspaces array<string>")
    cwd = spark.createDataFrame([("/w/x",), ("/w/deep/y",), ("/t/z",), ("/none",)], "cwd string")
    got = {r.cwd: (r.project_id, r.ambiguous) for r in o.match_workspace(cwd, projects).collect()}
    assert got == {"/w/x": ("a", False), "/w/deep/y": ("b", False), "/t/z": (None, True), "/none": (None, False)}
    assert [(r.workspace, r.ids) for r in o.workspace_conflicts(projects).collect()] == [("/t", ["b", "c"])]


def test_references(spark):
    roots = spark.createDataFrame(ROOTS, o.ROOTS)
    bindings = spark.createDataFrame([("r", ".", P("a")), ("gone", ".", SHARED), ("r", "sub", SHARED), ("inner", ".", P("a"))], o.BINDINGS)
    projects = spark.createDataFrame([("b",)], "id string")
    assert {(r.root, r.missing) for r in o.unknown_references(bindings, roots, projects).collect()} == {("gone", "root"), ("r", "a"), ("inner", "a")}
    assert [r.target for r in o.binding_conflicts(roots, bindings).collect()] == ["/r/sub"]
