"""Small session logs with known results, and the sequential reading of the same rules."""

import json
import random

import pytest

from meterline.operators import attribution, tree
from meterline.plans import report
from meterline.sources import logs


def line(kind, payload=None, at=None):
    out = {"type": kind}
    if at:
        out["timestamp"] = at
    if payload is not None:
        out["payload"] = payload
    return json.dumps(out)


def meta(id_="r", at="2026-01-01T00:00:00Z", **more):
    return line("session_meta", {"id": id_, **more}, at)


def context(turn=None, model="m1", **more):
    return line("turn_context", {**({"turn_id": turn} if turn else {}), "model": model, **more})


def start(turn, at="2026-01-01T00:00:01Z"):
    return line("event_msg", {"type": "task_started", "turn_id": turn}, at)


def end(turn=None, at="2026-01-01T00:00:04Z", name="task_complete"):
    return line("event_msg", {"type": name, **({"turn_id": turn} if turn else {})}, at)


def usage(last, total=None, at="2026-01-01T00:00:02Z"):
    keys = ("input_tokens", "cached_input_tokens", "output_tokens")
    own = lambda v: dict(zip(keys, v, strict=True)) | {"total_tokens": v[0] + v[2]} if isinstance(v, tuple) else v
    info = {"last_token_usage": own(last)} | ({"total_token_usage": own(total)} if total is not None else {})
    return line("event_msg", {"type": "token_count", "info": info}, at)


def records(spark, **files):
    rows = [(p, n, raw) for p, raws in files.items() for n, raw in enumerate(raws, 1)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "path string, line_no long, raw string")
    return logs.records(df).withColumn("mtime", F.lit("2026-01-02").cast("timestamp"))


def stats(spark, *raws):
    seen = attribution.attributed(logs.log_events(records(spark, f=raws))).cache()
    return attribution.rollout_stats(seen).first(), seen


def test_growth_of_totals_is_what_was_used(spark):
    # totals grow, stand still, are left out, fall in one field alone, and grow again from there
    seen = [((9, 3, 2), (60, 9, 8)), ((1, 1, 1), (60, 9, 8)), ((4, 2, 1), None), ((8, 6, 3), (75, 15, 11)), ((5, 4, 2), (90, 14, 12)), ((2, 2, 2), (91, 16, 12))]
    got, rows = stats(spark, meta(), context("t"), start("t"), *(usage(last, total) for last, total in seen))
    expected = [(9, 3, 2), (4, 2, 1), (15, 6, 3), (5, 4, 2), (1, 2, 0)]
    used = rows.filter("usage IS NOT NULL").orderBy("line_no").select("usage.input", "usage.cached", "usage.output")
    assert [tuple(r) for r in used.collect()] == expected
    assert (got["input"], got["cached"], got["output"]) == tuple(map(sum, zip(*expected, strict=True)))


def test_who_is_charged(spark):
    use = usage((11, 4, 13))
    cases = {
        "end_of_another_turn": ([meta(), context("p", "mp"), context("q", "mq"), start("p"), end("q"), use], "mp", False),
        "own_end": ([meta(), context("p", "mp"), start("p"), end("p"), use], None, True),
        "unknown_start_ends_a_turn": ([meta(), context("p", "mp"), start("p"), start("zz"), use], None, True),
        "context_comes_later": ([meta(), start("p"), use, context("p", "late")], "late", False),
        "loose_context_after_an_end": ([meta(), context("p", "mp"), start("p"), end("p"), context(None, "loose"), use], "loose", False),
        "turn_clears_loose_context": ([meta(), context(None, "loose"), context("p", "mp"), use], None, True),
        "loose_context_of_two_metas": ([meta("v"), meta("w"), context(None, "loose"), use], None, True),
    }
    seen = attributed_files(spark, {k: raws for k, (raws, _, _) in cases.items()})
    charged = {r["path"]: r["for_model"] for r in seen.filter("usage IS NOT NULL").collect()}
    assert charged == {k: model for k, (_, model, _) in cases.items()}
    found = {r["path"]: (r["is_incomplete"], r["unattributed_tokens"]) for r in attribution.rollout_stats(seen).collect()}
    assert found == {k: (lost, 24 if k == "loose_context_of_two_metas" else 0) for k, (_, _, lost) in cases.items()}


def attributed_files(spark, files):
    return attribution.attributed(logs.log_events(records(spark, **files))).cache()


def test_sums_beyond_bigint_are_incomplete(spark):
    big = (1 << 62) + 5
    got, _ = stats(spark, meta(), context("t"), start("t"), usage({"input_tokens": big}), usage({"input_tokens": big}))
    assert (got["input"], got["is_incomplete"]) == ((1 << 63) - 1, True)


def test_attribution_takes_one_shuffle(spark):
    events = logs.log_events(records(spark, f=[meta(), context("t"), start("t"), usage((1, 0, 0)), end("t")]))
    plan = attribution.rollout_stats(attribution.attributed(events))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_attribution_sorts_by_turn_and_by_line_only(spark):
    plan = attribution.attributed(logs.log_events(records(spark, f=[meta(), usage((1, 0, 0))])))._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count(" Sort [") <= 2


def test_missing_folders_are_empty_and_homes_stay_apart(spark, tmp_path):
    for home, when in (("one", 5), ("two", 9)):
        (tmp_path / home / "sessions").mkdir(parents=True)
        (tmp_path / home / "sessions" / f"{when}.jsonl").write_text(meta("same") + "\n" + meta("other") + "\n")
    rows = logs.records(logs.read_homes(spark, str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "none")))
    found = logs.newest_per_id(logs.rollouts(rows), "home").collect()
    assert sorted((r["home"].rsplit("/")[-1], r["id"]) for r in found) == [("one", "same"), ("two", "same")]
    assert logs.read_homes(spark, str(tmp_path / "none")).count() == 0


def test_thread_table_sources(spark):
    threads = spark.createDataFrame([("a", "cli", "/f/a", "/w"), ("b", '{"subagent":"review"}', "/f/b", None), ("c", "not json", "/f/c", None), ("d", None, "/f/d", None)], "id string, source string, rollout_path string, cwd string")
    assert {r["id"] for r in logs.root_hints(threads).collect()} == {"a", "c"}
    files = logs.rollouts(records(spark, **{"/f/x": [meta("x")], "/f/a": [meta("a")], "/f/y": [meta("y", source={"subagent": "review"})]}))
    assert {(r["id"], r["path"]) for r in logs.root_hints(threads, files).collect()} == {("a", "/f/a"), ("c", "/f/c"), ("x", "/f/x")}
    with pytest.raises(ValueError, match="first_user_message"):
        logs.checked_threads(threads)


def test_durations_and_models(spark):
    got, seen = stats(spark, meta(), context("a"), context("b", "m2", effort="high"), start("a"), end("a"), start("b"), end(None, "2026-01-01T00:00:03Z"), end("b"))
    assert (got["seconds"], got["ended_turns"], got["turns"]) == (5.0, 2, 2)
    assert {(r["model"], r["effort"]) for r in attribution.turns(seen).collect()} == {("m1", "unknown"), ("m2", "high")}


def test_bad_lines_times_and_numbers(spark):
    bad = usage({"input_tokens": -1})
    got, _ = stats(spark, meta(at="nope"), "not json", "", '{"type":"event_msg"} 2', bad, usage({"input_tokens": "3"}), usage({"input_tokens": 1.0}), usage(None))
    assert (got["malformed_lines"], got["invalid_usage"], got["is_incomplete"]) == (3, 4, True)


@pytest.mark.parametrize(("at", "incomplete"), [("2026-13-01", True), (None, False)])
def test_event_time_falls_back_to_the_session(spark, at, incomplete):
    got, seen = stats(spark, meta(at="2026-03-01T23:30:00-05:00"), context("t"), start("t"), usage((1, 0, 0), at=at))
    event = attribution.usage_events(seen).first()
    assert str(event["at_date"]) == "2026-03-01" and got["is_incomplete"] == incomplete


def sequential(events):
    """The rules read line by line: usage by model, unattributed, ended turns, seconds."""
    contexts = {e[1]: e[2] for e in events if e[0] == "context" and e[1]}
    active = legacy = previous = None
    used, lost, ended, seconds, starts = {}, 0, 0, 0, {}
    for at, e in enumerate(events):
        if e[0] == "context":
            legacy = None if e[1] else e[2]
        elif e[0] == "start":
            active = e[1] if e[1] in contexts else None
            if active:
                legacy = None
                starts[active] = at
        elif e[0] == "end":
            turn = e[1] or active
            if turn in starts:
                ended, seconds = ended + 1, seconds + at - starts.pop(turn)
            if turn == active:
                active = None
            if turn is None:
                legacy = None
        elif e[0] == "usage":
            last, total = e[1], e[2]
            n = total - previous if total is not None and previous is not None and total >= previous else last
            previous = total if total is not None else previous
            model = contexts.get(active) or legacy
            if n and model:
                used[model] = used.get(model, 0) + n
            elif n:
                lost += 1
    return used, lost, ended, seconds


def test_windows_equal_sequential_reading(spark):
    r = random.Random(5)
    files, expected = {}, {}
    for k in range(40):
        events = []
        for _ in range(r.randrange(1, 25)):
            turn = r.choice(["a", "b", "c", None])
            events.append(r.choice([("context", turn, r.choice("xyz")), ("start", turn or "q"), ("end", turn), ("usage", r.randrange(4), r.choice([None, r.randrange(30)]))]))
        expected[f"f{k}"] = sequential(events)
        stamp = lambda n: f"2026-01-01T00:{n // 60:02d}:{n % 60:02d}Z"
        made = {"context": lambda e, n: context(e[1], e[2]), "start": lambda e, n: start(e[1], stamp(n)), "end": lambda e, n: end(e[1], stamp(n)), "usage": lambda e, n: usage((e[1], 0, 0), None if e[2] is None else (e[2], 0, 0), stamp(n))}
        files[f"f{k}"] = [meta(), *(made[e[0]](e, n) for n, e in enumerate(events))]
    seen = attribution.attributed(logs.log_events(records(spark, **files))).cache()
    used = {}
    for row in attribution.usage_events(seen).groupBy("path", "model").sum("input").collect():
        used.setdefault(row["path"], {})[row["model"]] = row["sum(input)"]
    ends = {}
    for row in attribution.turn_ends(seen).collect():
        n, total = ends.get(row["path"], (0, 0))
        ends[row["path"]] = (n + 1, total + row["seconds"])
    lost = {row["path"]: row["count"] for row in seen.filter("usage IS NOT NULL AND for_model IS NULL").groupBy("path").count().collect()}
    for path, (tokens, n_lost, ended, seconds) in expected.items():
        assert used.get(path, {}) == tokens
        assert lost.get(path, 0) == n_lost
        assert ends.get(path, (0, 0)) == (ended, seconds)


SOURCES = [
    ('"cli"', "root", None), ('{"subagent":"review"}', "code_review", None), ('{"subagent":{"thread_spawn":{"parent_thread_id":"p"}}}', "subagent", "p"),
    ('{"subagent":{"other":"guardian"}}', "security_review", None), ('{"subagent":{"review":"x"}}', "code_review", None), ('{"subagent":{"compact":"x"}}', "compaction", None),
    ('{"internal":"memory_consolidation"}', "memory_consolidation", None), ('{"internal":"q"}', "internal:q", None), ('{"subagent":{}}', "subagent", None), ('{"subagent":7}', "subagent", None), ('{"subagent":{"z":"l","b":1}}', "subagent:b", None), ("null", "root", None),
]


def test_kinds_and_parents(spark):
    files = {f"f{k}": [f'{{"type":"session_meta","payload":{{"id":"i{k}","source":{s}}}}}'] for k, (s, _, _) in enumerate(SOURCES)}
    found = {r["id"]: (r["kind"], r["parent_id"]) for r in logs.rollouts(records(spark, **files)).collect()}
    assert found == {f"i{k}": (kind, parent) for k, (_, kind, parent) in enumerate(SOURCES)}


def test_first_meta_newest_file_and_scan_counters(spark):
    files = {"a": ["bad", meta("x"), meta("y")], "b": [meta("x")], "c": ["bad", "bad"]}
    rows = records(spark, **files)
    assert {(r["path"], r["id"]) for r in logs.newest_per_id(logs.rollouts(rows)).collect()} == {("b", "x")}
    assert tuple(logs.scan_quality(rows).first()) == (3, 0)


def test_cycles_end(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("d", None)], "id string, parent_id string")
    got = {(r[0], r[1]) for r in tree.descendants(links, links).select("root_id", "member_id").collect()}
    assert got == {("a", "b"), ("b", "a")}


def test_lines_of_split_files_keep_their_order(spark, tmp_path):
    folder = tmp_path / "sessions" / "2026"
    folder.mkdir(parents=True)
    (folder / "one.jsonl").write_text("".join(f'{{"n":{n}}}\n' for n in range(3000)))
    (folder / "other.txt").write_text("no\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = logs.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 3000 and all(r["raw"] == f'{{"n":{r["line_no"] - 1}}}' for r in rows)


CATALOG = {
    "as_of": "2026-08-01", "source": "test", "proxies": {"p": "m1", "q": "m1"}, "undated_proxies": ["q"],
    "histories": {"m1": [{"effective_from": "2026-01-01", "input": 2, "cached_input": 0.5, "cache_write_input": None, "output": 10}, {"effective_from": "2026-02-01", "input": 1, "cached_input": 0.1, "cache_write_input": 3, "output": 5}]},
}


@pytest.fixture(scope="module")
def price_catalog(spark, tmp_path_factory):
    from meterline.sources import catalog

    path = tmp_path_factory.mktemp("catalog") / "prices.json"
    path.write_text(json.dumps(CATALOG))
    return catalog.checked(catalog.read_catalog(spark, str(path)))


def test_prices_by_date_proxy_and_gap(spark, price_catalog):
    from meterline.operators.aggregates import dollars
    from meterline.operators.pricing import priced
    from meterline.sources import catalog

    rows = [(1, "m1", "2026-01-31", 10, 0, 0, 1), (2, "m1", "2026-02-01", 10, 0, 0, 1), (3, "m1", "2025-12-31", 10, 0, 0, 1), (4, "p", "2026-01-05", 10, 4, 3, 0), (5, "q", "2026-01-05", 10, 0, 0, 0), (6, "zz", None, 10, 0, 0, 0), (7, "m1", None, 10, 20, 0, 0)]
    events = spark.createDataFrame(rows, "k int, model string, d string, input long, cached long, cache_write long, output long").selectExpr("*", "to_date(d) AS at_date")
    from pyspark.sql import functions as F

    got = {r["k"]: (round(r["c"] * 1e6, 4), r["f"]) for r in priced(events, catalog.price_points(price_catalog), catalog.proxies(price_catalog)).select("k", dollars(F.col("cost_millionths")).alias("c"), F.col("is_fully_priced").alias("f")).collect()}
    assert got == {1: (30, True), 2: (15, True), 3: (0, False), 4: (8, False), 5: (10, True), 6: (0, False), 7: (2, True)}


def test_tree_report_and_json(spark, price_catalog):
    child = {"source": {"subagent": {"other": "guardian"}}, "parent_thread_id": "r"}
    rows = records(spark, f=[meta("r", cwd="/w"), context("t"), start("t"), usage((100, 0, 0)), end("t")], g=[meta("k", **child), context("u", "mystery"), start("u"), usage((20, 0, 0))])
    facts = report.facts_of(rows, price_catalog)
    roots = spark.createDataFrame([("r",)], "id string")
    parts = report.tree_report(facts, roots, logs.scan_quality(rows))
    whole, own = parts["tree"].first(), parts["rollout"].first()
    assert (whole["rollout_count"], whole["estimated_cost_usd"], whole["unpriced_models"], whole["input_tokens"]) == (2, None, {"mystery": 20}, 120)
    assert (own["rollout_count"], own["estimated_cost_usd"], own["total_subagent_spawns"], own["majority_turn_model"]) == (1, 0.0002, 1, "m1")
    assert {r["rollout_type"] for r in parts["by_kind"].collect()} == {"root", "security_review"}
    made = json.loads(report.json_reports(parts, price_catalog).first()["json"])
    assert made["tree"]["incomplete_input"] is True and "incomplete_input" not in made["rollout"]
    assert made["rollout"]["rollout_id"] == "r" and made["rollout"]["thread_name"] is None and made["by_model"]["m1"]["turns"] == 1
    assert made["pricing"]["model_proxies"] == {"p": "m1", "q": "m1"} and set(made["by_rollout_type"]) == {"root", "security_review"}


def test_unread_descendants_and_bad_index(spark, price_catalog):
    rows = records(spark, f=[meta("r")], g=[meta("k", parent_thread_id="r", source={"subagent": "review"})])
    facts = report.facts_of(rows, price_catalog)
    facts.quality = facts.quality.filter("id = 'r'")
    roots = spark.createDataFrame([("r",)], "id string")
    index = logs.records(spark.createDataFrame([(1, '{"id":"r","thread_name":"N","updated_at":"2026-01-01T00:00:00Z"}'), (2, "broken")], "line_no long, raw string"))
    parts = report.tree_report(facts, roots, None, logs.session_names(index), logs.index_quality(index))
    whole, own = parts["tree"].first(), parts["rollout"].first()
    assert (whole["incomplete_input"], whole["estimated_cost_usd"], own["incomplete_input"]) == (True, None, False)
    assert own["thread_name"] is None
    assert parts["warnings"].first()["incomplete_input_warnings"] == [report.UNREAD % "k", report.INDEX_MALFORMED]
    parts = report.tree_report(facts, roots, None, logs.session_names(index), logs.index_quality(index.limit(1)))
    assert parts["rollout"].first()["thread_name"] == "N"


def test_bundles_hold_many_logs_in_few_files(spark, tmp_path):
    lines = [(f"u{n}", k, f'{{"n":{n},\t"k":{k}}}' if k else "") for n in range(200) for k in range(4)]
    folder = str(tmp_path / "bundles")
    logs.write_bundles(spark.createDataFrame(lines, "path string, line_no long, raw string").repartition(4), folder)
    assert len(list((tmp_path / "bundles").glob("*.txt"))) <= 4  # one file for each log before
    got = {}
    for r in logs.read_bundles(spark, folder).orderBy("path", "line_no").collect():
        got.setdefault(r["path"], []).append((r["line_no"], r["raw"]))
    assert {p: [raw for _, raw in rows] for p, rows in got.items()} == {p: [x[2] for x in lines if x[0] == p] for p in {x[0] for x in lines}}
    assert all([n for n, _ in rows] == list(range(rows[0][0], rows[0][0] + 4)) for rows in got.values())
