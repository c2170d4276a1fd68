"""The report of a project as one answer: its selection, totals, models, warnings and prices, and its JSON and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.shared import stored
from meterline.operators import selection as S
from meterline.plans import projects as P
from meterline.plans import report as R

#: What identifies a scope; references that mean the same share one.
SCOPE = ("resolver", "target", "project_id", "paths")
SELECTED = ("direct_assignments", "workspace_fallbacks", "projectless_threads", "projectless_exclusions", "other_project_exclusions")
ROOT_COUNTS = ("incomplete_root_reports", "unpriced_root_reports")
STATS = (
    "rollout_count", "majority_turn_model", "majority_reasoning_level", "input_tokens", "input_cache_write_tokens", "input_cache_read_tokens", "reasoning_tokens", "output_tokens", "turns",
    "completed_or_aborted_turns", "incomplete_turns", "total_turn_duration_seconds", "estimated_cost_usd", "known_model_cost_usd", "unpriced_models", "unattributed_usage_tokens", "incomplete_input",
)


def scoped_members(scopes: DataFrame, roots: DataFrame, assigned: DataFrame, loose: DataFrame) -> DataFrame:
    """``scope, id, membership`` of each of ``scopes(scope, resolver, target, project_id, paths)``.

    A thread's folder takes the sessions of exactly that folder, any other scope those assigned or beneath its paths.
    """
    folders = scopes.filter("resolver = 'thread_cwd'").select("scope", "target")
    paths = scopes.filter("resolver <> 'thread_cwd'").select(F.col("scope").alias("target"), "project_id", F.explode("paths").alias("root_path")).distinct()
    inside = S.membership(roots, paths, assigned, loose).withColumnRenamed("target", "scope")
    exact = S.cwd_membership(roots, folders.select("target").distinct(), assigned, loose).join(folders, "target")
    return inside.unionByName(exact.select("scope", "id", "membership"))


def project_report(
    references: DataFrame,
    found: DataFrame,
    roots: DataFrame,
    assigned: DataFrame,
    loose: DataFrame,
    facts: R.Facts,
    known_paths: DataFrame | None = None,
    scan: DataFrame | None = None,
    index: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The reports of all resolved references at once; only the trees of their sessions are totalled.

    ``references(ref, thread_id, ...)`` and ``found`` of :func:`projects.resolved`.  Returns ``references`` (``ref, scope,
    error``), and by ``scope``: ``selection``, ``tree``, ``by_model``, ``warnings``.  References of the same meaning
    share a scope, which is reported once.  A scope without sessions has zeros.  ``known_paths(root_path, root_exists)``
    tells which root paths of projects are gone; they are counted, with a warning after the others.  A reference whose
    thread is outside its project has an error; its scope is reported for those it serves beside it.
    """
    found = stored(found.withColumn("scope", F.when(F.col("error").isNull(), F.xxhash64(F.to_json(F.struct(*SCOPE))))), "scopes")
    good = found.filter("error IS NULL")
    scopes = good.select("scope", *SCOPE).dropDuplicates(["scope"])
    chosen = stored(scoped_members(scopes, roots, assigned, loose), "chosen")
    by_target = chosen.withColumnRenamed("scope", "target")
    wanted = chosen.filter(P.IS_MEMBER).select("id").distinct()
    parts = R.tree_report(facts, wanted, scan, None, index, ("tree", "by_model"))
    sums = stored(P._merged_trees(parts["tree"], by_target), "project").withColumnRenamed("target", "scope")
    base = scopes.select("scope").join(sums, "scope", "left")
    zero = F.lit(0).cast("bigint")
    whole = base.withColumns(
        {c: F.coalesce(c, zero) for c in ("rollout_count", *P.COUNTS)}
        | {"total_turn_duration_seconds": F.coalesce("total_turn_duration_seconds", F.lit(0.0)), "known_model_cost_usd": F.coalesce("known_model_cost_usd", F.lit(0.0))}
        | {"estimated_cost_usd": F.when(F.col("rollout_count").isNull(), F.lit(0.0)).otherwise(F.col("estimated_cost_usd"))}
        | {"incomplete_input": F.coalesce("incomplete_input", F.lit(False)), "unpriced_models": F.coalesce("unpriced_models", F.map_from_entries(F.array().cast("array<struct<key:string,value:bigint>>")))}
        | {c: F.lit(None).cast("string") for c in ("majority_turn_model", "majority_reasoning_level")}
    )
    counts = S.selection_counts(by_target).withColumnRenamed("target", "scope")
    gone = _gone(scopes, known_paths).withColumnRenamed("n", "missing_source_roots")
    chosen_rows = scopes.select("scope", "target", "resolver").join(gone, "scope", "left").join(counts, "scope", "left").join(sums.select("scope", *ROOT_COUNTS), "scope", "left")
    numbers = ("missing_source_roots", *SELECTED, *ROOT_COUNTS)
    picked = chosen_rows.select("scope", "target", "resolver", *(F.coalesce(c, zero).alias(c) for c in numbers))
    told = P.merged_warnings(parts["warnings"], by_target).withColumnRenamed("target", "scope")
    none = F.array().cast("array<string>")
    notes = base.select("scope", F.coalesce("incomplete_input_warnings", none).alias("_own")).join(told, "scope", "left").join(gone, "scope", "left")
    every = F.array_sort(F.array_union("_own", F.coalesce("warnings", none)))
    lost = F.when(F.col("missing_source_roots") > 0, F.array(F.format_string(P.MISSING_ROOTS, "missing_source_roots")))
    notes = notes.select("scope", F.concat(every, F.coalesce(lost, none)).alias("incomplete_input_warnings"))
    models = P.merged_models(parts["by_model"], by_target).withColumnRenamed("target", "scope")
    return {"references": _answers(references, found, chosen), "selection": picked, "tree": whole.select("scope", *STATS), "by_model": models, "warnings": notes}


def _gone(scopes: DataFrame, known_paths: DataFrame | None) -> DataFrame:
    """``scope, n``: root paths of the scope's project that don't exist."""
    paths = scopes.filter("project_id IS NOT NULL").select("scope", F.explode("paths").alias("root_path"))
    if known_paths is None:
        return paths.select("scope", F.lit(0).cast("bigint").alias("n")).distinct()
    lost = known_paths.filter(~F.col("root_exists")).select("root_path").distinct()
    return paths.join(lost, "root_path").groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


def _answers(references: DataFrame, found: DataFrame, chosen: DataFrame) -> DataFrame:
    """``ref, scope, error``; a name or path must hold the thread that a reference names."""
    bound = found.filter("error IS NULL AND resolver IN ('project_name', 'source_root_path', 'path')").select("ref", "scope").join(references.filter("thread_id IS NOT NULL").select("ref", F.col("thread_id").alias("id")), "ref")
    outside = bound.join(chosen.filter(P.IS_MEMBER).select("scope", "id"), ["scope", "id"], "left_anti").select("ref", F.lit(P.OUTSIDE).alias("_outside"))
    rows = found.select("ref", "scope", "error").join(outside, "ref", "left")
    error = F.coalesce("error", "_outside")
    return rows.select("ref", F.when(error.isNull(), F.col("scope")).alias("scope"), error.alias("error"))


def project_json(parts: dict[str, DataFrame], price_catalog: DataFrame) -> DataFrame:
    """``ref, json, error``: each reference's report as one JSON text, or why there is none."""
    own = ("target", "resolver", "missing_source_roots", *SELECTED, *ROOT_COUNTS)
    picked = parts["selection"].select("scope", F.to_json(F.struct(*own)).alias("s"))
    whole = parts["tree"].select("scope", R.stats_json(list(STATS)).alias("t"))
    joined = picked.join(whole, "scope").join(R.models_json(parts["by_model"], "scope"), "scope", "left").join(parts["warnings"], "scope").join(F.broadcast(R.pricing_json(price_catalog)))
    text = F.concat(
        F.lit('{"selection":'), F.col("s"), F.lit(',"tree":'), F.col("t"), F.lit(',"by_model":'), R.json_object(F.col("m")), F.lit(',"pricing":'), F.col("p"),
        F.lit(',"incomplete_input_warnings":'), F.to_json("incomplete_input_warnings"), F.lit("}"),
    )
    return parts["references"].join(joined.select("scope", text.alias("json")), "scope", "left").select("ref", "json", "error")


def project_tables(parts: dict[str, DataFrame]) -> DataFrame:
    """The readable rows of each scope (:func:`report.readable_tables`): the project, its models, and their Total."""
    return R.readable_tables({"Project": parts["tree"]}, parts["by_model"], "scope")
