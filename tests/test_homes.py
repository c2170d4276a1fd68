"""Several homes with the same ids, worksets that open no other file, and files that could not be read."""

import json

import pytest
from test_logs import CATALOG, context, end, meta, start, usage

from meterline.plans import report, workset
from meterline.sources import catalog, logs


def write(home, **sessions):
    for name, (rows, folder) in sessions.items():
        (home / folder).mkdir(parents=True, exist_ok=True)
        (home / folder / f"{name}.jsonl").write_text("\n".join(rows) + "\n")


def session(id_, tokens, parent=None, bad=False):
    more = {"source": {"subagent": {"thread_spawn": {"parent_thread_id": parent}}}} if parent else {"source": "cli"}
    return [*(["{broken"] if bad else []), meta(id_, **more), context("t"), start("t"), usage((tokens, 0, 1)), end("t")]


@pytest.fixture
def prices(spark, tmp_path):
    (tmp_path / "prices.json").write_text(json.dumps(CATALOG))
    return catalog.checked(catalog.read_catalog(spark, str(tmp_path / "prices.json")))


def test_homes_keep_their_sessions_links_and_warnings(spark, tmp_path, prices):
    a, b = tmp_path / "a", tmp_path / "b"
    write(a, one=(session("r", 10), "sessions"), two=(session("c", 1, "r"), "archived_sessions"))
    write(b, one=(session("r", 200, bad=True), "sessions"), two=(session("d", 30, "c"), "sessions"), three=(session("gone", 5, "r"), "sessions"))
    rows = logs.records(logs.read_homes(spark, str(a), str(b)))
    facts = report.facts_of(rows, prices)
    roots = facts.rollouts.filter("parent_id IS NULL").select("id")
    parts = report.tree_report(facts, roots, scan=logs.scan_quality(rows, "home"))
    got = {(x["home"], x["root_id"]): x for x in logs.with_homes(parts["tree"]).collect()}
    assert {k: (x["input_tokens"], x["rollout_count"], x["incomplete_input"]) for k, x in got.items()} == {(str(a), "r"): (11, 2, False), (str(b), "r"): (205, 2, True)}
    notes = {x["home"]: x["incomplete_input_warnings"] for x in logs.with_homes(parts["warnings"]).collect()}
    assert notes == {str(a): [], str(b): [report.SCAN_MALFORMED]}


def test_workset_opens_no_other_file(spark, tmp_path):
    home = tmp_path / "h"
    names = {f"s{k}": (session(f"s{k}", k), "sessions") for k in range(12)}
    write(home, **names, loose=(session("loose", 1), "sessions"))
    path = lambda n: str(home / "sessions" / f"{n}.jsonl")
    threads = spark.createDataFrame([(f"s{k}", path(f"s{k}"), '{"subagent":"review"}' if k in (2, 3) else "cli") for k in range(12)], "id string, rollout_path string, source string")
    edges = spark.createDataFrame([("s1", "s2"), ("s2", "s7"), ("s8", "s9")], "parent_thread_id string, child_thread_id string")
    rows = workset.targeted_records(spark, str(home), threads, edges, spark.createDataFrame([("s1",)], "id string"))
    opened = {f.rpartition("/")[2] for f in rows.inputFiles()}
    assert opened == {f"{n}.jsonl" for n in ("s1", "s2", "s7", "s3", "loose")}
    assert {x["id"] for x in logs.rollouts(rows).collect()} == {"s1", "s2", "s7", "s3", "loose"}
    assert logs.read_workset(spark, spark.createDataFrame([("/nowhere/x.jsonl",)], "path string")).count() == 0


def test_files_without_lines_are_unread(spark, tmp_path):
    write(tmp_path / "h", a=(session("a", 1), "sessions"), b=(session("b", 1), "sessions"))
    (tmp_path / "h" / "sessions" / "empty.jsonl").write_text("")
    listed = logs.files(spark, str(tmp_path / "h"))
    lines = logs.read_lines(spark, str(tmp_path / "h"))
    assert listed.count() == 2 and logs.unread(listed, lines).count() == 0
    lost = logs.unread(listed, lines.filter("path NOT LIKE '%b.jsonl'")).collect()
    assert [x["path"] for x in lost] == [str(tmp_path / "h" / "sessions" / "b.jsonl")]
