import pytest
from pyspark.sql import functions as F

from meterline.functions import formatting as X
from meterline.functions import titles as T
from meterline.operators import selection
from meterline.plans import titles
from meterline.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("n", "text"),
    [(0, "0"), (999, "999"), (1000, "1K"), (1049, "1K"), (1050, "1.1K"), (999_949, "999.9K"), (999_950, "1M"), (999_949_999, "999.9M"), (999_950_000, "1B"), (1_500_000_000_000, "1500B"), ((1 << 63) - 1, "9223372036.9B")],
)
def test_compact_counts(spark, n, text):
    assert one(spark, X.compact_count(F.lit(n).cast("long"))) == text


@pytest.mark.parametrize(("s", "text"), [(0.0, "0.0s"), (59.96, "60.0s"), (60.0, "1m"), (3661.5, "1h 1m 1.5s"), (90000.0, "1d 1h")])
def test_durations(spark, s, text):
    assert one(spark, X.duration(F.lit(s))) == text


def test_costs_and_text(spark):
    assert one(spark, X.title_cost(F.lit(1234.567), F.lit(True))) == "$1,234.57+"
    assert one(spark, X.report_cost(F.lit(None).cast("double"), F.lit(1234.5))) == "$1234.50+"
    assert one(spark, X.safe_text(F.lit("\t a \x07b\n"))) == "a b"
    assert one(spark, X.nonblank(F.lit("  \n"))) is None


@pytest.mark.parametrize(
    ("title", "base", "signs"),
    [("a · $1.00", "a", ["$"]), ("a · $01.00", "a · $01.00", []), ("a · $1,00.00", "a · $1,00.00", []), ("a · $1,234.50+ · ⇄1.5K", "a", ["$", "⇄"]), ("a · 5 · ⇥5", "a · 5", ["⇥"]), ("a · ⇄0K", "a · ⇄0K", []), ("a · ↦1.0K", "a · ↦1.0K", []), ("a · ↦0.5K", "a · ↦0.5K", []), ("a · ⇥1.5", "a · ⇥1.5", [])],
)
def test_metric_grammar(spark, title, base, signs):
    assert one(spark, T.without_metrics(F.lit(title))) == base
    assert one(spark, T.metric_signs(F.lit(title))) == signs


@pytest.mark.parametrize(("title", "width", "text"), [("abc", 12, "abc · $1.00"), ("abcdefgh", 12, "abc… · $1.00"), ("ab  cdefgh", 12, "ab… · $1.00"), ("abc", 9, None), ("  ", 30, None), ("abc · $9.00", 30, "abc · $1.00")])
def test_composition(spark, title, width, text):
    assert one(spark, T.composed(F.lit(title), F.lit("$1.00"), width)) == text


@pytest.mark.parametrize(
    ("mode", "title", "name", "prompt", "index", "text"),
    [("paginated", "t", " n ", "p", "i", "n"), ("paginated", "t", " ", "p\n q", "i", "p q"), ("legacy", "t", "n", "p", "i", "t"), ("legacy", "p", "n", "p", "i", "i"), ("legacy", "p", "n", "p", None, "p"), ("legacy", None, "n", None, None, "Untitled")],
)
def test_base_names(spark, mode, title, name, prompt, index, text):
    c = lambda v: F.lit(v).cast("string")
    assert one(spark, T.base_name(c(mode), c(title), c(name), c(prompt), c(index))) == text


def test_high_water_mark(spark):
    rows = spark.createDataFrame([(1, "a · $1.00", 5, 5), (2, "a · $1.00", 4, 5), (3, "a", 9, 5), (4, None, None, 5)], "id int, index_name string, index_at int, updated_at int")
    assert [r["id"] for r in rows.filter(selection.needs_update(("cost",), 20)).orderBy("id").collect()] == [2, 3, 4]
    assert [r["id"] for r in rows.filter(selection.needs_update(("cost",), 20, F.lit(6))).orderBy("id").collect()] == [1, 2, 3, 4]


def test_apply_and_append(spark, tmp_path):
    threads = spark.createDataFrame([(1, "a", "n"), (2, "b", "n")], "id int, title string, name string")
    made = spark.createDataFrame([(1, "new")], "id int, new_title string")
    assert {tuple(r) for r in titles.applied(threads, made).collect()} == {(1, "new", "new"), (2, "b", "n")}
    with pytest.raises(ValueError):
        titles.applied(threads, spark.createDataFrame([(9, "x")], "id int, new_title string"))
    path = str(tmp_path / "index")
    titles.append_names(made, F.lit("2026-01-01 00:00:00").cast("timestamp"), path)
    assert spark.read.json(path).first().asDict() == {"id": 1, "thread_name": "new", "updated_at": "2026-01-01T00:00:00Z"}


def test_failure_streaks(spark):
    results = ["ordinary", "ordinary", "success", "ordinary", "ordinary", "ordinary", "resume", "severe", "ordinary"]
    runs = spark.createDataFrame([("j", n, r) for n, r in enumerate(results)], "job string, run_no int, result string")
    got = [(r["consecutive_failures"], r["is_paused"]) for r in selection.failure_streaks(runs).orderBy("run_no").collect()]
    assert got == [(1, False), (2, False), (0, False), (1, False), (2, False), (3, True), (0, False), (1, True), (1, False)]


def test_revisions(spark):
    files = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 1)], "path string, mtime int, size int")
    state = spark.createDataFrame([("a", 1, 1, 1), ("b", 1, 1, 1), ("c", 1, 1, 0)], "path string, mtime int, size int, logic_version int")
    changed = incremental.changed_files(files, state)
    assert {r["path"] for r in changed.collect()} == {"b", "c"}
    after = spark.createDataFrame([("b", 2, 1), ("c", 9, 1)], "path string, mtime int, size int")
    assert {tuple(r) for r in incremental.next_state(state, changed, after).collect()} == {("a", 1, 1, 1), ("b", 2, 1, 1)}


def test_streaming_refresh(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"path":"p","at":"2026-01-01T00:00:00Z","total":5}\n{"path":"p","at":"2026-01-01T00:10:00Z","total":9}\n')
    seen = []
    q = incremental.refresh_titles(spark, str(tmp_path / "in"), "path string, at timestamp, total long", str(tmp_path / "ck"), lambda df, n: seen.extend(r["total"] for r in df.collect()))
    q.awaitTermination(60)
    assert sorted(seen) == [5, 9]
    stream = incremental.running_usage(spark.readStream.schema("path string, at timestamp, total long").json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("usage_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["total"], r["n_lines"]) for r in spark.table("usage_now").collect()] == [(9, 2)]
