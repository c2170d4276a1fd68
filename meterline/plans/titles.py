"""Title proposals and the two writes that apply them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.records import source_is_root
from meterline.functions.shared import stored
from meterline.functions.titles import base_name, composed, metrics_text
from meterline.operators.selection import idle, needs_update
from meterline.plans.report import Facts, tree_report
from meterline.sources import logs


def proposals(selected: DataFrame, trees: DataFrame, metrics: Sequence[str], width: int) -> DataFrame:
    """``id, old_title, new_title, error`` for selected sessions with their ``index_name``, and tree totals ``root_id``.

    A title that can't fit has ``error`` too_narrow and no new title.  This listing changes nothing.
    """
    rows = selected.join(trees.withColumnRenamed("root_id", "id"), "id")
    base = base_name(F.col("history_mode"), F.col("title"), F.col("name"), F.col("first_user_message"), F.col("index_name"))
    suffix = metrics_text(metrics, F.col("input_tokens"), F.col("output_tokens"), F.col("known_model_cost_usd"), F.col("estimated_cost_usd").isNull())
    made = rows.select("id", base.alias("old_title"), composed(base, suffix, width).alias("new_title"))
    return made.withColumn("error", F.when(F.col("new_title").isNull(), "too_narrow"))


def with_index(threads: DataFrame, names: DataFrame) -> DataFrame:
    """Threads with ``index_name, index_at`` of the session index ``id, name, updated_at``; null where it has none."""
    return threads.join(names.select("id", F.col("name").alias("index_name"), F.col("updated_at").alias("index_at")), "id", "left")


def title_chain(
    threads: DataFrame,
    names: DataFrame,
    facts: Facts,
    metrics: Sequence[str],
    width: int,
    now: Column,
    idle_minutes: int,
    limit: int | None,
    scan: DataFrame | None = None,
) -> DataFrame:
    """Proposals for the newest idle root sessions that need one, from the thread table to the composed title.

    Threads meet the session index, the idle ones that need an update are selected, only their trees are totalled, and
    each gets its title.  Which threads are roots follows from their ``source``.
    """
    roots = logs.checked_threads(threads).filter(source_is_root(F.col("source")))
    chosen = stored(idle(with_index(roots, names), needs_update(metrics, width), now, idle_minutes, limit), "chosen")
    trees = tree_report(facts, chosen.select("id"), scan, wanted=("tree",))["tree"]
    return proposals(chosen, trees, metrics, width)


def named(made: DataFrame, updated_at: Column) -> DataFrame:
    """The records of the session index that the proposals add: ``id, thread_name, updated_at``, all with one timestamp."""
    stamp = F.date_format(updated_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return made.filter("new_title IS NOT NULL").select("id", F.col("new_title").alias("thread_name"), stamp.alias("updated_at"))


def append_names(made: DataFrame, updated_at: Column, path: str) -> None:
    """Append the new names to the session index as JSON lines."""
    named(made, updated_at).write.mode("append").json(path)


def applied(threads: DataFrame, made: DataFrame) -> DataFrame:
    """The next snapshot of the thread table with new titles and names; every proposal must match one thread."""
    good = made.filter("new_title IS NOT NULL").select("id", "new_title")
    wrong = good.join(threads.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").filter("coalesce(n, 0) <> 1").select("id").limit(5).collect()
    if wrong:
        raise ValueError("proposals that don't match one thread: " + ", ".join(str(r["id"]) for r in wrong))
    rows = threads.join(good, "id", "left")
    return rows.withColumn("title", F.coalesce("new_title", "title")).withColumn("name", F.coalesce("new_title", "name")).drop("new_title").select(*threads.columns)
