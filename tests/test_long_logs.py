"""Logs attributed in segments against the windows over whole files."""

import json
import random

import pytest
from test_logs import CATALOG, context, end, line, meta, records, start, usage

from meterline.operators import attribution, long_logs
from meterline.plans import report
from meterline.sources import catalog, logs


def random_files(seed, n):
    r = random.Random(seed)
    files = {}
    for k in range(n):
        rows = [meta()] * r.choice([1, 1, 1, 2])
        for at in range(r.randrange(60)):
            turn = r.choice(["a", "b", "c", None])
            stamp = r.choice([f"2026-01-01T00:{at // 60:02d}:{at % 60:02d}Z", None, "bad"]) if r.random() < 0.2 else f"2026-01-01T00:{at // 60:02d}:{at % 60:02d}Z"
            total = None if r.random() < 0.3 else (r.randrange(40), r.randrange(3), r.randrange(9))
            rows.append(r.choice([context(turn, r.choice("xyz")), start(turn or "q", stamp), end(turn, stamp), end(None, stamp), usage((r.randrange(4), 0, 1), total, stamp), usage((-1, 0, 0)), "{broken", line("session_meta", {"id": "r"}, stamp)]))
        files[f"f{k}"] = rows
    return files


@pytest.mark.parametrize(("seed", "lines"), [(1, 1), (2, 3), (3, 7), (4, 1000)])
def test_segments_equal_whole_files(spark, seed, lines):
    events = logs.log_events(records(spark, **random_files(seed, 25))).cache()
    whole, parts = attribution.attributed(events), long_logs.attributed(events, lines)
    assert sorted(whole.columns) == sorted(parts.columns)
    shown = lambda df: sorted(str(tuple(x)) for x in df.select(*whole.columns).collect())
    assert shown(parts) == shown(whole)
    assert shown_rows(attribution.rollout_stats(parts)) == shown_rows(attribution.rollout_stats(whole))


def shown_rows(df):
    return sorted(map(str, df.collect()))


def test_no_task_holds_a_long_file(spark):
    """One file of 40,000 lines: no window or join of the segment scan is dealt by the file alone."""
    rows = [("f", 1, meta())] + [("f", k, (start(f"t{k}"), context(f"t{k}"), usage((5, 0, 1), (k, 0, k)), end(f"t{k - 3}"))[k % 4]) for k in range(2, 40_002)]
    events = logs.log_events(logs.records(spark.createDataFrame(rows, "path string, line_no long, raw string").repartition(8)))
    seen = long_logs.attributed(events, 1000)
    assert seen.count() == len(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = seen.groupBy(long_logs.F.spark_partition_id().alias("p")).count().collect()
        assert max(r["count"] for r in held) < 0.6 * len(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_are_numbered_without_a_shuffle_of_lines(spark, tmp_path):
    folder = tmp_path / "sessions"
    folder.mkdir()
    for name, n in (("long", 2000), ("short", 3), ("empty", 0)):
        (folder / f"{name}.jsonl").write_text("\n".join(f"{name} {k}" for k in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = logs.read_lines(spark, str(folder))
        got = rows.collect()
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 2003 and all(r["raw"].split()[1] == str(r["line_no"]) for r in got)
    assert "row_number" not in plan


def test_facts_of_long_and_short_files(spark, tmp_path):
    (tmp_path / "prices.json").write_text(json.dumps(CATALOG))
    prices = catalog.checked(catalog.read_catalog(spark, str(tmp_path / "prices.json")))
    folder = tmp_path / "home" / "sessions"
    folder.mkdir(parents=True)
    for name, turns in (("a", 3), ("b", 200)):
        rows = [meta(name)]
        for k in range(turns):
            rows += [context(f"t{k}"), start(f"t{k}"), usage((7, 0, 2)), end(f"t{k}")]
        (folder / f"{name}.jsonl").write_text("\n".join(rows) + "\n")
    read = logs.records(logs.read_homes(spark, str(tmp_path / "home")))
    own = lambda facts: (shown_rows(facts.usage), shown_rows(facts.turns), shown_rows(facts.ends), shown_rows(facts.quality))
    assert own(report.facts_of(read, prices, long_bytes=5000)) == own(report.facts_of(read, prices))
