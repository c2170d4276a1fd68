"""Closures against a plain walk: chains, cycles, several parents, hot parents."""

import os
import random
import re

import pytest

from meterline.operators import tree
from meterline.plans import adapters, report


def walk(links, roots):
    """``{(root, member): depth}`` by breadth first."""
    below, out = {}, {}
    for child, parent in links:
        if child is not None and parent is not None:
            below.setdefault(parent, []).append(child)
    for root in set(roots) - {None}:
        level, depth, seen = [root], 0, {root}
        while level:
            out |= {(root, m): depth for m in level}
            level = sorted({c for m in level for c in below.get(m, [])} - seen)
            seen |= set(level)
            depth += 1
    return out


def found(df):
    rows = df.collect()
    assert len(rows) == len({(r[0], r[1]) for r in rows})
    return {(r["root_id"], r["member_id"]): r["depth"] for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_closure_equals_walk(spark, seed):
    r = random.Random(seed)
    n = 60
    links = [(i, r.choice([None, i, *([r.randrange(n)] * 4)])) for i in range(n)] + [(r.randrange(n), r.randrange(n)) for _ in range(seed * 6)] + [(None, 3), (5, 999)]
    roots = [r.randrange(n) for _ in range(8)] + [None, 12345]
    table, tops = spark.createDataFrame(links, "id long, parent_id long"), spark.createDataFrame([(x,) for x in roots], "id long")
    expected = walk(links, roots)
    assert found(tree.closure(table, tops)) == expected
    assert {x["id"] for x in tree.reached(table, tops).collect()} == {m for _, m in expected}


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    real = tree.stored
    monkeypatch.setattr(tree, "stored", lambda df, name: written.append(name) or real(df, name))
    n = 5000
    links = spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id")
    got = tree.closure(links, spark.createDataFrame([(0,), (4000,)], "id long"))
    assert got.count() == n + 1000 and got.selectExpr("max(depth)").first()[0] == n - 1
    assert written.count("jumps") <= 14


def test_pointers_are_deleted(spark):
    folder = spark.conf.get("spark.checkpoint.dir") + "/meterline"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    links = spark.createDataFrame([(i, i // 3) for i in range(1, 200)], "id long, parent_id long")
    got = tree.closure(links, spark.createDataFrame([(0,)], "id long"))
    assert got.count() == 200
    left = set(os.listdir(folder)) - before
    assert left and not [x for x in left if x.startswith("jumps")]


def test_pointers_of_reached_ids_are_not_doubled(spark, monkeypatch):
    rows = []
    real = tree.stored

    def counted(df, name):
        made = real(df, name)
        rows.extend([made.count()] if name == "jumps" else [])
        return made

    monkeypatch.setattr(tree, "stored", counted)
    n = 2000
    links = spark.range(n).selectExpr("id", "explode(array(id - 1, id - 2, id - 3)) AS parent_id").filter("parent_id >= 0")
    got = tree.reached(links, spark.range(0, n, 20).select("id"))
    assert got.count() == n and got.distinct().count() == n
    # twice the links at most; before, each round doubled the pointers of all ids
    assert max(rows) <= 2 * links.count()


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "id long, parent_id long"), spark.createDataFrame([(1, None)], "id long, parent_id long")
    assert tree.closure(none, none.select("id")).count() == 0
    assert found(tree.closure(none, some.select("id"))) == {(1, 1): 0}
    assert tree.related(some, none.select("id")).count() == 0


def test_spawn_edges_and_file_links_together(spark):
    files = spark.createDataFrame([("a", None), ("b", "a"), ("c", None), ("d", "c")], "id string, parent_id string")
    edges = spark.createDataFrame([("b", "c"), ("a", "b"), ("d", "a"), (None, "d")], "parent_thread_id string, child_thread_id string")
    got = tree.closure(tree.all_links(files, edges), spark.createDataFrame([("a",)], "id string"))
    assert found(got) == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3}


def test_reports_compute_only_wanted_parts(spark):
    facts = adapters.facts(spark, "/root/testdata/sf0.001")
    roots = facts.rollouts.filter("kind = 'root'").select("id")
    every = report.tree_report(facts, roots)
    for part in ("rollout", "tree", "by_model", "by_kind"):
        made = report.tree_report(facts, roots, wanted=(part,))
        assert set(made) == {part, "warnings"}
        assert sorted(map(str, made[part].collect())) == sorted(map(str, every[part].select(*made[part].columns).collect()))
    # totals by model make no grouping sets, and requests are dealt by session once: before, their sums were dealt again
    made = report.tree_report(facts, roots, wanted=("by_model",))["by_model"]
    plan = re.sub(r"#\d+L?", "", made._jdf.queryExecution().executedPlan().toString())
    assert "Expand" not in plan and "hashpartitioning(id, 4)" in plan and "hashpartitioning(id, model" not in plan
