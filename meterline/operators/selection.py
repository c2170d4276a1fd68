"""Selection of sessions: by id, by title, idle ones that need an update, projects' members, run streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meterline.functions.titles import ends_in
from meterline.operators.matching import containing
from meterline.sources.projects import ancestors


def by_ids(roots: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The roots of ``wanted(position, id)`` in order, each once; and the ids that are no roots."""
    first = wanted.groupBy("id").agg(F.min("position").alias("position"))
    return roots.join(first, "id").orderBy("position"), wanted.select("id").distinct().join(roots.select("id"), "id", "left_anti")


def title_matches(roots: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, id`` of every session whose title, name or index name holds the text of ``queries(query)``, any case.

    An empty query is held by every session that has any of the three.
    """
    texts = roots.select("id", F.explode(F.array(*(F.lower(c) for c in ("title", "name", "index_name")))).alias("text")).filter("text IS NOT NULL")
    asked = queries.filter("query IS NOT NULL").select("query", F.lower("query").alias("part")).distinct()
    met = asked.join(containing(asked, texts), "part").join(texts, "text").select("query", "id")
    empty = asked.filter("part = ''").select("query", (F.length("part") == 0).alias("_any")).join(texts.select("id", (F.length("text") >= 0).alias("_any")), "_any").select("query", "id")
    return met.unionByName(empty).distinct()


def by_title(roots: DataFrame, queries: DataFrame, most: int | None = 5) -> DataFrame:
    """``query, n_matches, id, matches`` for ``queries(query)``: titles, names or index names that hold the text.

    ``id`` is set only if exactly one session matches; otherwise ``matches`` has the first ``most`` ids in order (and
    ``, ...`` if there are more; None: all of them).  :func:`title_matches` has them as rows.
    """
    met = title_matches(roots, queries)
    if most is None:
        first = met.groupBy("query").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    else:
        first = met.withColumn("_place", F.row_number().over(W.partitionBy("query").orderBy("id"))).filter(F.col("_place") <= most + 1)
        first = first.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("_place", "id")))["id"].alias("ids"))
    found = queries.select("query").distinct().join(met.groupBy("query").agg(F.count(F.lit(1)).alias("n")), "query", "left").join(first, "query", "left")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    texts = F.transform("ids", lambda x: x.cast("string"))
    listed = F.array_join(texts if most is None else F.slice(texts, 1, most), ", ")
    if most is not None:
        listed = F.concat(listed, F.when(F.size("ids") > most, ", ...").otherwise(""))
    return found.select("query", n.alias("n_matches"), F.when(n == 1, F.get("ids", F.lit(0))).alias("id"), F.when(n != 1, F.coalesce(listed, F.lit(""))).alias("matches"))


def needs_update(metrics: Sequence[str], width: int, reprice_before: Column | None = None) -> Column:
    """False only for a session whose index name has the metrics, fits, and is as new as its work and any cut-off."""
    ok = ends_in(F.col("index_name"), metrics) & (F.length("index_name") <= width) & (F.col("index_at") >= F.col("updated_at"))
    if reprice_before is not None:
        ok = ok & (F.col("index_at") >= reprice_before)
    return ~F.coalesce(ok, F.lit(False))


def idle(roots: DataFrame, needed: Column, now: Column, idle_minutes: int, limit: int | None) -> DataFrame:
    """The newest sessions that are idle and need an update; filters come before the limit (None: all), ids break ties."""
    cutoff = now - F.make_dt_interval(mins=F.lit(idle_minutes))
    found = roots.filter((F.col("updated_at") <= cutoff) & needed)
    return found if limit is None else found.orderBy(F.col("updated_at").desc(), "id").limit(limit)


def beneath(roots: DataFrame, paths: DataFrame) -> DataFrame:
    """Roots whose folder is one of ``paths(target, root_path)`` or below it: ``target`` and the root's columns.

    Folders meet by equality with the ancestors of each root's folder, so there is no pairwise comparison.
    """
    up = roots.filter("cwd IS NOT NULL").withColumn("_above", F.explode(ancestors(F.col("cwd"))))
    return up.join(paths.select("target", F.col("root_path").alias("_above")), "_above").drop("_above").distinct()


def membership(roots: DataFrame, paths: DataFrame, assigned: DataFrame, loose: DataFrame) -> DataFrame:
    """``target, id, membership`` of every root that concerns a target.

    ``paths(target, project_id, root_path)``: project_id null for plain paths.  In order: assigned to the project:
    direct; beneath and neither assigned nor projectless: fallback; beneath and projectless: projectless; beneath
    and assigned elsewhere: other_project.  Roots without folder are left out.
    """
    known = roots.filter("cwd IS NOT NULL").select("id", "cwd").join(assigned.select("id", F.col("project_id").alias("_assigned")), "id", "left").join(loose.select("id", F.lit(True).alias("_loose")), "id", "left")
    under = beneath(known, paths).select("target", "id", "_assigned", "_loose", F.lit(True).alias("_beneath"))
    direct = known.join(paths.filter("project_id IS NOT NULL").select("target", F.col("project_id").alias("_assigned")).distinct(), "_assigned").select("target", "id", "_assigned", "_loose", F.lit(False).alias("_beneath"))
    both = under.unionByName(direct).groupBy("target", "id").agg(F.max("_assigned").alias("_assigned"), F.bool_or("_loose").alias("_loose"), F.bool_or("_beneath").alias("_beneath"))
    own = paths.groupBy("target").agg(F.max("project_id").alias("_own"))
    kind = F.when(F.col("_assigned") == F.col("_own"), "direct").when(F.coalesce("_loose", F.lit(False)), "projectless").when(F.col("_assigned").isNull(), "fallback").otherwise("other_project")
    return both.join(own, "target").select("target", "id", kind.alias("membership"))


def cwd_membership(roots: DataFrame, folders: DataFrame, assigned: DataFrame, loose: DataFrame) -> DataFrame:
    """``target, id, membership`` of roots in exactly the folders ``folders(target)``; here projectless ones belong."""
    known = roots.join(folders, F.col("cwd") == F.col("target")).join(assigned.select("id", F.lit(True).alias("_assigned")), "id", "left").join(loose.select("id", F.lit(True).alias("_loose")), "id", "left")
    kind = F.when(F.col("_assigned"), "other_project").when(F.col("_loose"), "projectless_member").otherwise("fallback")
    return known.select("target", "id", kind.alias("membership"))


def selection_counts(members: DataFrame) -> DataFrame:
    """Counters of a selection by target."""
    n = lambda k: F.count_if(F.col("membership") == k)
    return members.groupBy("target").agg(n("direct").alias("direct_assignments"), n("fallback").alias("workspace_fallbacks"), n("projectless_member").alias("projectless_threads"), n("projectless").alias("projectless_exclusions"), n("other_project").alias("other_project_exclusions"))


def path_owners(roots: DataFrame, paths: DataFrame) -> DataFrame:
    """``root_path, n_owners, project_id``: the project of a source root; null if several own it."""
    found = paths.join(roots, "root_path", "left").groupBy("root_path").agg(F.count_distinct("project_id").alias("n_owners"), F.min("project_id").alias("project_id"))
    return found.withColumn("project_id", F.when(F.col("n_owners") == 1, F.col("project_id")))


def failure_streaks(runs: DataFrame) -> DataFrame:
    """Run log ``job, run_no, result`` with ``consecutive_failures`` (3 at most) and ``is_paused``.

    Ordinary failures in a row count up; a severe one counts 1 and pauses at once; a success or a resume resets.
    A paused job leaves no records until it is resumed, so what follows a severe failure starts anew.
    """
    by = W.partitionBy("job").orderBy("run_no")
    cut = F.col("result") != "ordinary"
    rows = runs.withColumn("_island", F.count_if(cut).over(by.rowsBetween(W.unboundedPreceding, 0)))
    streak = F.count_if(~cut).over(W.partitionBy("job", "_island").orderBy("run_no").rowsBetween(W.unboundedPreceding, 0))
    n = F.when(F.col("result") == "severe", 1).otherwise(F.least(streak, F.lit(3)))
    rows = rows.withColumn("consecutive_failures", n.cast("int"))
    return rows.withColumn("is_paused", (F.col("result") == "severe") | (F.col("consecutive_failures") == 3)).drop("_island")


def failure_class(code: Column) -> Column:
    """``disk_full``, ``incompatible_schema`` and ``permission_denied`` are severe; any other error is ordinary."""
    return F.when(code.isNull(), "success").when(code.isin("disk_full", "incompatible_schema", "permission_denied"), "severe").otherwise("ordinary")
