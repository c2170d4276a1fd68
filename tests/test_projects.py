import json

from meterline.operators import selection
from meterline.plans import projects
from meterline.sources import projects as source


def test_state_membership_and_merge(spark, tmp_path):
    state = {
        "local-projects": {"a": {"id": "a", "name": "Alpha", "rootPaths": ["/w//a/"]}, "b": {"id": "b", "name": "Beta", "rootPaths": ["/w/b"]}},
        "thread-project-assignments": {"direct": {"projectId": "a"}, "other": {"projectId": "b"}, "nowhere": {"projectId": "a"}},
        "projectless-thread-ids": ["loose"],
    }
    path = tmp_path / "state.json"
    path.write_text(json.dumps(state))
    read = source.read_state(spark, str(path))
    roots = spark.createDataFrame([("direct", "/else"), ("fall", "/w/a/x"), ("loose", "/w/a"), ("other", "/w/a/y"), ("outside", "/w/ab"), ("nowhere", None)], "id string, cwd string")
    refs = spark.createDataFrame([("1", "ALPHA", None, False), ("2", "/w/a/", None, True), ("3", "nothing like it", None, False), ("4", "", "other", False), ("5", "/w/zz", None, True)], "ref string, ref_text string, thread_id string, is_path boolean")
    found = projects.resolved(refs, source.projects(read), roots, source.assignments(read))
    got = {r["ref"]: (r["resolver"], r["target"], r["error"]) for r in found.collect()}
    assert got == {"1": ("project_name", "Alpha", None), "2": ("source_root_path", "Alpha", None), "3": (None, None, "not found"), "4": ("thread_assignment", "Beta", None), "5": ("path", "/w/zz", None)}
    chosen = projects.members(found.filter("ref = '1'"), roots, source.assignments(read), source.projectless(read))
    assert {(r["id"], r["membership"]) for r in chosen.collect()} == {("direct", "direct"), ("fall", "fallback"), ("loose", "projectless"), ("other", "other_project")}
    counts = selection.selection_counts(chosen).first()
    assert (counts["direct_assignments"], counts["workspace_fallbacks"], counts["projectless_exclusions"], counts["other_project_exclusions"]) == (1, 1, 1, 1)
    bound = spark.createDataFrame([("1", "outside")], "ref string, thread_id string")
    assert projects.required_thread(bound, found, chosen).count() == 1


def test_broken_state_is_no_metadata(spark, tmp_path):
    path = tmp_path / "state.json"
    path.write_text("{")
    assert source.projects(source.read_state(spark, str(path))).count() == 0


def test_exact_folder_scope(spark):
    roots = spark.createDataFrame([(1, "/a"), (2, "/a"), (3, "/a"), (4, "/a/b")], "id int, cwd string")
    ids = lambda n: spark.createDataFrame([(n,)], "id int")
    found = selection.cwd_membership(roots, spark.createDataFrame([("/a",)], "target string"), ids(1), ids(2))
    assert {(r["id"], r["membership"]) for r in found.collect()} == {(1, "other_project"), (2, "projectless_member"), (3, "fallback")}


def test_ids_in_order(spark):
    roots = spark.createDataFrame([("a",), ("b",)], "id string")
    wanted = spark.createDataFrame([(0, "b"), (1, "x"), (2, "b"), (3, "a")], "position int, id string")
    got, missing = selection.by_ids(roots, wanted)
    assert [r["id"] for r in got.collect()] == ["b", "a"] and [r["id"] for r in missing.collect()] == ["x"]


def test_root_folder_holds_every_path(spark):
    from meterline.operators import selection

    roots = spark.createDataFrame([(1, "/"), (2, "/a/b"), (3, "x"), (4, None)], "id int, cwd string")
    paths = spark.createDataFrame([("all", "/"), ("a", "/a")], "target string, root_path string")
    assert {(r["target"], r["id"]) for r in selection.beneath(roots, paths).collect()} == {("all", 1), ("all", 2), ("a", 2)}


def test_owners_and_missing_roots(spark):
    from meterline.operators import selection
    from meterline.plans import projects

    roots = spark.createDataFrame([("p", "/a"), ("q", "/a"), ("q", "/b")], "project_id string, root_path string")
    asked = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "root_path string")
    assert {tuple(r) for r in selection.path_owners(roots, asked).collect()} == {("/a", 2, None), ("/b", 1, "q"), ("/c", 0, None)}
    found = spark.createDataFrame([("q", "q", ["/a", "/b"])], "target string, project_id string, paths array<string>")
    known = spark.createDataFrame([("/a", False), ("/b", True)], "root_path string, root_exists boolean")
    assert projects.missing_roots(found, known).first()["missing_source_roots"] == 1
