"""Versioned tables, facts kept by file revision, and title batches that are run again."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_homes import prices, session, write  # noqa: F401

from meterline.plans import report, titles
from meterline.sources import logs, versions
from meterline.streaming import incremental


def test_versions_are_seen_whole_or_not(spark, tmp_path, monkeypatch):
    at, rows = str(tmp_path / "t"), lambda n: spark.range(n).withColumn("x", F.lit(n))
    assert versions.read(spark, at) is None and versions.number(spark, at) == 0
    assert versions.write(rows(2), at) == 1
    assert versions.write(versions.read(spark, at).union(rows(3)), at) == 2
    assert versions.read(spark, at).count() == 5 and versions.read(spark, at, 1).count() == 2
    with monkeypatch.context() as m:
        m.setattr(versions, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            versions.write(rows(9), at)
    assert versions.number(spark, at) == 2 and versions.read(spark, at).count() == 5
    with pytest.raises(versions.Conflict):
        versions.write(rows(9), at, after=1)
    assert versions.read(spark, at).count() == 5
    versions.keep(spark, at, 1)
    assert versions.read(spark, at).count() == 5 and len(os.listdir(tmp_path / "t" / "data")) == 1


def shown(facts):
    """Everything that reports read, by session."""
    used = facts.measures.groupBy("id").agg(F.sum("input").alias("input"), F.sum("cost").alias("cost"), F.sum("turns").alias("turns"))
    rows = facts.rollouts.join(used, "id", "left").join(facts.quality, "id", "left")
    return sorted((r["id"], r["parent_id"], r["kind"], r["input"], r["cost"], r["turns"], r["is_incomplete"]) for r in rows.collect())


def test_changed_logs_alone_are_read(spark, tmp_path, prices):  # noqa: F811
    home, store = tmp_path / "h", str(tmp_path / "store")
    folders = [f"{home}/{f}" for f in logs.FOLDERS]
    write(home, **{"a b+c": (session("r", 10), "sessions"), "child": (session("k", 5, "r"), "archived_sessions"), "other": (session("o", 7), "sessions")})
    refresh = lambda **more: [p.rpartition("/")[2] for p in incremental.refresh_facts(spark, store, *folders, **more)]
    assert refresh() == ["child.jsonl", "a b+c.jsonl", "other.jsonl"]
    whole = lambda: shown(report.facts_of(logs.records(logs.read_lines(spark, *folders)), prices))
    kept = lambda: shown(incremental.stored_facts(spark, store, prices))
    assert kept() == whole()
    assert refresh() == []
    write(home, child=(session("k", 900, "r", bad=True), "archived_sessions"))
    assert refresh() == ["child.jsonl"]
    now = kept()
    assert now == whole() and [(r[0], r[3], r[6]) for r in now] == [("k", 900, True), ("o", 7, False), ("r", 10, False)]
    assert incremental.stored_scan(spark, store).first()["n_malformed"] == 1
    os.remove(home / "sessions" / "other.jsonl")
    assert refresh() == []
    rest = kept()
    assert [r[0] for r in rest] == ["k", "r"]
    incremental.compact_facts(spark, store)
    assert kept() == rest and versions.read(spark, f"{store}/state").select("batch").distinct().count() == 1
    assert refresh(version=2) == ["child.jsonl", "a b+c.jsonl"] and refresh(version=2) == []


def test_file_that_grows_while_read_is_read_again(spark, tmp_path, prices, monkeypatch):  # noqa: F811
    home, store = tmp_path / "h", str(tmp_path / "store")
    write(home, a=(session("r", 10), "sessions"))
    listing = logs.files

    def later(*args, **more):
        if later.calls:
            write(home, a=(session("r", 12345), "sessions"))
        later.calls += 1
        return listing(*args, **more)

    later.calls = 0
    monkeypatch.setattr(logs, "files", later)
    assert len(incremental.refresh_facts(spark, store, f"{home}/sessions")) == 1
    assert versions.read(spark, f"{store}/state").first()["logic_version"] == incremental.UNSETTLED
    assert shown(incremental.stored_facts(spark, store, prices))[0][3] == 10
    assert len(incremental.refresh_facts(spark, store, f"{home}/sessions")) == 1
    assert shown(incremental.stored_facts(spark, store, prices))[0][3] == 12345


def test_title_batches_survive_a_restart(spark, tmp_path, prices, monkeypatch):  # noqa: F811
    home, at = tmp_path / "h", lambda n: str(tmp_path / n)
    write(home, root=(session("r", 1000), "sessions"), child=(session("k", 500, "r"), "sessions"), other=(session("o", 7), "sessions"))
    thread = "id string, title string, name string, history_mode string, updated_at timestamp, first_user_message string, source string"
    day = lambda c: c.withColumn("updated_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    rows = [("r", "Root", None, "legacy", None, None, "cli"), ("o", "Other", None, "legacy", None, None, "cli"), ("k", "Kid", None, "legacy", None, None, '{"subagent":"review"}')]
    versions.write(day(spark.createDataFrame(rows, thread)), at("threads"))
    (tmp_path / "lines").mkdir()
    append = lambda n, path: (tmp_path / "lines" / f"{n}.json").write_text(json.dumps({"path": str(home / "sessions" / path)}) + "\n")
    now = lambda: F.lit("2026-01-02 00:00:00").cast("timestamp")
    run = incremental.title_batches(at("store"), at("threads"), at("names"), at("proposals"), prices, [f"{home}/sessions"], ("input",), 60, now, 15, 500)
    go = lambda: incremental.refresh_titles(spark, at("lines"), "path string", at("ck"), run).awaitTermination(120)
    names = lambda: sorted((r["id"], r["name"]) for r in incremental.index_names(spark, at("names")).collect())
    count = lambda: spark.read.schema("id string").json(at("names")).count()
    titled = lambda: {r["id"]: r["title"] for r in versions.read(spark, at("threads")).collect()}

    append(1, "child.jsonl")
    with monkeypatch.context() as m:
        m.setattr(titles, "named", lambda *a: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivisionError|division"):
            go()
    assert titled()["r"] == "Root · ⇥1.5K" and names() == []
    go()
    assert names() == [("r", "Root · ⇥1.5K")] and count() == 1
    assert titled() == {"r": "Root · ⇥1.5K", "o": "Other", "k": "Kid"}
    before = versions.number(spark, at("threads"))
    run(spark.createDataFrame([(str(home / "sessions" / "child.jsonl"),)], "path string"), 0)
    assert count() == 1 and versions.number(spark, at("threads")) == before
    append(2, "other.jsonl")
    go()
    assert names() == [("o", "Other · ⇥7"), ("r", "Root · ⇥1.5K")] and count() == 2
