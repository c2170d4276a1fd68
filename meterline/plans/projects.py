"""Project reports: which project a reference means, its sessions, and the merged totals of their trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meterline.functions import formatting as X
from meterline.functions.records import total_or_max
from meterline.operators import aggregates as A
from meterline.operators import selection as S
from meterline.operators.matching import fuzzy_pairs
from meterline.sources.projects import clean_path

#: Warnings; fixed values of the report format.
UNREAD_ROOT = "selected root rollout could not be read"
MISSING_ROOTS = "%d configured Desktop Project source root(s) unavailable; direct assignments and recorded workspace roots remain included"
OUTSIDE = "thread is outside the project"
#: Memberships whose sessions count.
IS_MEMBER = "membership IN ('direct', 'fallback', 'projectless_member')"
COUNTS = ("input_tokens", "input_cache_write_tokens", "input_cache_read_tokens", "reasoning_tokens", "output_tokens", "turns", "completed_or_aborted_turns", "incomplete_turns")


def resolved(references: DataFrame, projects: DataFrame, roots: DataFrame, assigned: DataFrame) -> DataFrame:
    """What each reference ``ref, ref_text, thread_id, is_path`` means: ``resolver, target, project_id, paths, error``.

    In order: a project's name; for an empty text the thread's assignment, then the thread's folder; the owner of a
    path, then the path itself; a close project name; a close folder of an earlier session.  The first rank with a
    match decides; several matches in it are an error that lists them.  ``is_path`` says that the text is an
    existing folder (paths are checked at ingest).
    """
    r, p = references.alias("r"), projects
    text = F.col("ref_text")
    row = lambda rank, resolver, target, project, paths: [F.col("ref"), F.lit(rank).alias("rank"), F.lit(resolver).alias("resolver"), target.alias("target"), project.alias("project_id"), paths.alias("paths")]
    nothing = F.lit(None).cast("string")
    named = r.join(p, (text != "") & X.ascii_equal(F.col("name"), text)).select(*row(1, "project_name", F.col("name"), F.col("project_id"), F.col("root_paths")))
    threads = r.filter((text == "") & F.col("thread_id").isNotNull()).join(roots.select(F.col("id").alias("thread_id"), "cwd"), "thread_id")
    owned = threads.join(assigned.select(F.col("id").alias("thread_id"), "project_id"), "thread_id").join(p, "project_id").select(*row(2, "thread_assignment", F.col("name"), F.col("project_id"), F.col("root_paths")))
    folder = threads.filter("cwd IS NOT NULL").select(*row(3, "thread_cwd", F.col("cwd"), nothing, F.array("cwd")))
    given = r.filter((text != "") & F.col("is_path")).withColumn("path", clean_path(text))
    each = p.select("project_id", "name", F.explode("root_paths").alias("path"))
    owner = given.join(each, "path").select(*row(4, "source_root_path", F.col("name"), F.col("project_id"), F.array("path")))
    plain = given.select(*row(5, "path", F.col("path"), nothing, F.array("path")))
    loose = r.filter((text != "") & ~F.col("is_path"))
    near = fuzzy_pairs(loose.select(text.alias("reference")), p.select(F.col("name").alias("candidate")))
    close = loose.join(near, text == F.col("reference")).join(p, F.col("candidate") == F.col("name")).select(*row(6, "fuzzy_project_name", F.col("name"), F.col("project_id"), F.col("root_paths")))
    folders = roots.filter("cwd IS NOT NULL").select("cwd").distinct()
    near = fuzzy_pairs(loose.select(text.alias("reference")), folders.select(F.col("cwd").alias("candidate")))
    past = loose.join(near.withColumnRenamed("candidate", "cwd"), text == F.col("reference")).select(*row(7, "fuzzy_historical_cwd", F.col("cwd"), nothing, F.array("cwd")))
    found = named
    for part in (owned, folder, owner, plain, close, past):
        found = found.unionByName(part)
    # of each rank the number of matches and its first six by name: a reference may match any number of folders
    first = W.partitionBy("ref", "rank").orderBy("target", "project_id")
    few = found.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= 6)
    few = few.groupBy("ref", "rank").agg(F.array_sort(F.collect_list("target")).alias("names"), F.min_by(F.struct("resolver", "target", "project_id", "paths"), "_place").alias("x"))
    best = found.groupBy("ref", "rank").agg(F.count(F.lit(1)).alias("n")).join(few, ["ref", "rank"])
    first = best.groupBy("ref").agg(F.min_by(F.struct("n", "names", "x"), "rank").alias("b"))
    several = F.col("b.n") > 1
    one = lambda c: F.when(~several, F.col(f"b.x.{c}")).alias(c)
    error = F.when(F.col("b").isNull(), "not found").when(several, F.concat(F.lit("ambiguous: "), X.short_list(F.col("b.names"))))
    return references.join(first, "ref", "left").select("ref", F.col("b.x.resolver").alias("resolver"), one("target"), one("project_id"), one("paths"), error.alias("error"))


def members(found: DataFrame, roots: DataFrame, assigned: DataFrame, loose: DataFrame) -> DataFrame:
    """``target, id, membership`` of every resolved reference; a thread's folder takes exact matches only."""
    good = found.filter("error IS NULL")
    exact = good.filter("resolver = 'thread_cwd'").select("target").distinct()
    paths = good.filter("resolver <> 'thread_cwd'").select("target", "project_id", F.explode("paths").alias("root_path")).distinct()
    return S.membership(roots, paths, assigned, loose).unionByName(S.cwd_membership(roots, exact, assigned, loose))


def required_thread(references: DataFrame, found: DataFrame, chosen: DataFrame) -> DataFrame:
    """References whose ``thread_id`` is outside their project, which a name or path must hold: ``ref, error``."""
    bound = references.filter("thread_id IS NOT NULL").join(found.filter("resolver IN ('project_name', 'source_root_path', 'path')").select("ref", "target"), "ref")
    inside = chosen.filter("membership IN ('direct', 'fallback')").select("target", F.col("id").alias("thread_id"))
    return bound.join(inside, ["target", "thread_id"], "left_anti").select("ref", F.lit(OUTSIDE).alias("error"))


def _overflows(*columns: str) -> Column:
    """Whether a sum passes the largest BIGINT: it stops there, and what it belongs to is incomplete."""
    return reduce(lambda a, b: a | b, (F.try_sum(c).isNull() & (F.count(c) > 0) for c in columns))


def merged(trees: DataFrame, chosen: DataFrame) -> DataFrame:
    """Totals of each target over the (rounded) trees of its sessions, with the counters of its selection.

    The estimate is null if any tree's is; sums stop at the largest BIGINT, which makes the target incomplete; trees
    inside another selected tree count twice.  Sessions without tree make the target incomplete, but leave its cost.
    """
    return _merged_trees(trees, chosen).join(S.selection_counts(chosen), "target", "left")


def _merged_trees(trees: DataFrame, chosen: DataFrame) -> DataFrame:
    own = chosen.filter(IS_MEMBER)
    rows = own.join(trees.withColumnRenamed("root_id", "id").withColumn("_read", F.lit(True)), "id", "left")
    read = F.col("_read").isNotNull()
    money = lambda c: F.col(c).cast("decimal(38,8)")
    sums = rows.groupBy("target").agg(
        *(F.coalesce(total_or_max(F.col(c)), F.lit(0).cast("bigint")).alias(c) for c in ("rollout_count", *COUNTS)),
        F.round(F.coalesce(F.sum("total_turn_duration_seconds"), F.lit(0.0)), 3).alias("total_turn_duration_seconds"),
        F.when(F.count_if(read & F.col("estimated_cost_usd").isNull()) == 0, F.coalesce(F.sum(money("estimated_cost_usd")), F.lit(0)).cast("double")).alias("estimated_cost_usd"),
        F.coalesce(F.sum(money("known_model_cost_usd")), F.lit(0)).cast("double").alias("known_model_cost_usd"),
        total_or_max(F.col("unattributed_usage_tokens")).alias("unattributed_usage_tokens"),
        (F.bool_or(F.coalesce("incomplete_input", F.lit(True))) | _overflows(*COUNTS, "unattributed_usage_tokens")).alias("incomplete_input"),
        F.count_if(F.coalesce("incomplete_input", F.lit(True))).alias("incomplete_root_reports"),
        F.count_if(read & (F.size("unpriced_models") > 0)).alias("unpriced_root_reports"),
        A.warnings(F.when(~read, F.lit(UNREAD_ROOT))).alias("incomplete_input_warnings"),
    )
    lost = rows.filter("unpriced_models IS NOT NULL").select("target", F.explode("unpriced_models").alias("model", "n")).groupBy("target", "model").agg(total_or_max(F.col("n")).alias("n"))
    lost = lost.groupBy("target").agg(A.sorted_map(F.col("model"), F.col("n"), F.lit(True)).alias("unpriced_models"))
    return sums.join(lost, "target", "left")


def merged_models(by_model: DataFrame, chosen: DataFrame) -> DataFrame:
    """Totals by target and model over the (rounded) model rows of its sessions' trees; the estimate is null if any is."""
    own = chosen.filter(IS_MEMBER)
    rows = own.select("target", F.col("id").alias("root_id")).join(by_model, "root_id")
    money = lambda c: F.col(c).cast("decimal(38,8)")
    counts = ("turns", "input_tokens", "input_cache_write_tokens", "input_cache_read_tokens", "reasoning_tokens", "output_tokens")
    return rows.groupBy("target", "model").agg(
        *(total_or_max(F.col(c)).alias(c) for c in counts),
        F.round(F.sum("total_turn_duration_seconds"), 3).alias("total_turn_duration_seconds"),
        F.when(F.count_if(F.col("estimated_cost_usd").isNull()) == 0, F.sum(money("estimated_cost_usd")).cast("double")).alias("estimated_cost_usd"),
        F.sum(money("known_model_cost_usd")).cast("double").alias("known_model_cost_usd"),
    )


def merged_warnings(warnings: DataFrame, chosen: DataFrame) -> DataFrame:
    """``target, warnings``: different warnings of the trees of a target's sessions, in order."""
    own = chosen.filter(IS_MEMBER).select("target", F.col("id").alias("root_id"))
    each = own.join(warnings, "root_id").select("target", F.explode("incomplete_input_warnings").alias("w"))
    return each.groupBy("target").agg(A.warnings(F.col("w")).alias("warnings"))


def missing_roots(found: DataFrame, known_paths: DataFrame) -> DataFrame:
    """``target, missing_source_roots``: root paths of projects that ``known_paths(root_path, root_exists)`` says are gone."""
    paths = found.filter("project_id IS NOT NULL").select("target", F.explode("paths").alias("root_path"))
    return paths.join(known_paths, "root_path", "left").groupBy("target").agg(F.count_if(~F.coalesce("root_exists", F.lit(True))).alias("missing_source_roots"))
