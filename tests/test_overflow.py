"""Sums beyond BIGINT: requests left out of a file, capped trees and projects."""

import random

import pytest
from test_logs import meta, records, usage

from meterline.operators import attribution
from meterline.plans import projects
from meterline.sources import logs

MAX = (1 << 63) - 1


def greedy(requests):
    sums, out = [0, 0, 0], []
    for k, r in enumerate(requests):
        if all(s + x <= MAX for s, x in zip(sums, r, strict=True)):
            sums = [s + x for s, x in zip(sums, r, strict=True)]
        else:
            out.append(k)
    return out, sums[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_requests_that_do_not_fit_are_left_out(spark, seed):
    r = random.Random(seed)
    files = {f"f{k}": [tuple(r.choice([0, 1, MAX // 2, MAX // 3, MAX // r.randint(1, 40), r.randrange(1000)]) for _ in range(2)) + (1,) for _ in range(r.randrange(1, 30))] for k in range(12)}
    context = '{"type":"turn_context","payload":{"model":"m"}}'
    raws = {p: [meta(), context, *(usage((a, b, c)) .replace(f'"total_tokens": {a + c}', '"total_tokens": 0') for a, b, c in rows)] for p, rows in files.items()}
    seen = attribution.without_overflow(attribution.attributed(logs.log_events(records(spark, **raws)))).cache()
    got = {}
    for row in seen.filter("left_out").collect():
        got.setdefault(row["path"], []).append(row["line_no"] - 3)
    stats = {x["path"]: x for x in attribution.rollout_stats(seen).collect()}
    for path, rows in files.items():
        out, total = greedy(rows)
        assert sorted(got.get(path, [])) == out
        assert stats[path]["input"] == total and stats[path]["is_incomplete"] == bool(out)


def test_unattributed_tokens_that_do_not_fit(spark):
    raws = [meta(), meta(), *(usage((0, 0, n)) for n in (MAX - 5, 9, 5, 1))]
    seen = attribution.without_overflow(attribution.attributed(logs.log_events(records(spark, f=raws))))
    assert [x["line_no"] for x in seen.filter("left_out").collect()] == [4, 6]
    quality = attribution.rollout_quality(seen).first()
    assert quality["unattributed_tokens"] == MAX and quality["is_incomplete"]


def test_project_sums_stop_at_the_largest_number(spark):
    counts = ", ".join(f"{c} long" for c in projects.COUNTS)
    row = lambda i, n: (i, 1, *([n] * len(projects.COUNTS)), 1.0, 0.5, 0.5, None, False, {"m": n})
    trees = spark.createDataFrame([row("a", MAX), row("b", MAX), row("c", 1)], f"root_id string, rollout_count long, {counts}, total_turn_duration_seconds double, estimated_cost_usd double, known_model_cost_usd double, unattributed_usage_tokens long, incomplete_input boolean, unpriced_models map<string,long>")
    chosen = spark.createDataFrame([("p", "a", "direct"), ("p", "b", "direct"), ("q", "c", "direct")], "target string, id string, membership string")
    got = {x["target"]: x for x in projects.merged(trees, chosen).collect()}
    assert got["p"]["input_tokens"] == got["p"]["turns"] == got["p"]["unpriced_models"]["m"] == MAX and got["p"]["incomplete_input"]
    assert got["q"]["input_tokens"] == 1 and not got["q"]["incomplete_input"]
    models = spark.createDataFrame([("a", "m", MAX, MAX, 0, 0, 0, 0, 1.0, 1.0, 1.0), ("b", "m", 1, MAX, 0, 0, 0, 0, 1.0, 1.0, 1.0)], "root_id string, model string, turns long, input_tokens long, input_cache_write_tokens long, input_cache_read_tokens long, reasoning_tokens long, output_tokens long, total_turn_duration_seconds double, estimated_cost_usd double, known_model_cost_usd double")
    merged = projects.merged_models(models, chosen).first()
    assert merged["turns"] == merged["input_tokens"] == MAX
