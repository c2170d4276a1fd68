"""Session trees: descendants over parent links, worksets and link checks.

Closures double their reach: after ``k`` rounds each session knows its ancestor at distance ``2^k``, and what was found
within that distance is joined once with what lies as far again.  A chain of ``n`` links takes ``log2(n)`` rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.shared import dropped, stored


def all_links(rollouts: DataFrame, spawned: DataFrame | None = None) -> DataFrame:
    """``id, parent_id`` of the files' own links and of a thread store's spawn edges ``parent_thread_id, child_thread_id``.

    Either source may know a link that the other lacks; where both name a parent, both links hold.
    """
    links = rollouts.select("id", "parent_id")
    if spawned is not None:
        links = links.unionByName(spawned.select(F.col("child_thread_id").alias("id"), F.col("parent_thread_id").alias("parent_id")))
    return links.filter("id IS NOT NULL AND parent_id IS NOT NULL").distinct()


def _jumps(links: DataFrame) -> DataFrame:
    """``id, above``: ancestors at distance 1; a link to itself leads nowhere new."""
    return stored(links.filter("parent_id IS NOT NULL AND parent_id <> id").select("id", F.col("parent_id").alias("above")).distinct(), "jumps")


def _doubled(jumps: DataFrame) -> DataFrame:
    """Ancestors at twice the distance."""
    further = jumps.select(F.col("id").alias("above"), F.col("above").alias("_top"))
    return stored(jumps.join(further, "above").select("id", F.col("_top").alias("above")).distinct(), "jumps")


def closure(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``root_id, member_id, depth`` of each root (depth 0) and all its descendants, cycles included once.

    ``links(id, parent_id)`` may hold cycles and ids with several parents; ``depth`` is the shortest way; ``roots(id)``
    are the starting points.  Depths are filled without gaps, so a round that finds no new member is the last one.
    """
    jumps, distance = _jumps(links), 1
    seen = stored(roots.filter("id IS NOT NULL").select(F.col("id").alias("root_id"), F.col("id").alias("member_id"), F.lit(0).alias("depth")).distinct(), "tree")
    while True:
        below = seen.join(jumps, F.col("member_id") == F.col("above")).select("root_id", F.col("id").alias("member_id"), (F.col("depth") + distance).alias("depth"))
        fresh = stored(below.groupBy("root_id", "member_id").agg(F.min("depth").alias("depth")).join(seen.select("root_id", "member_id"), ["root_id", "member_id"], "left_anti"), "tree")
        if fresh.isEmpty():
            dropped(jumps, fresh)
            return seen
        seen, old, distance = seen.unionByName(fresh), jumps, 2 * distance
        jumps = _doubled(old)
        dropped(old)


def descendants(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``root_id, member_id`` without the roots themselves."""
    return closure(links, roots).filter("member_id <> root_id").select("root_id", "member_id")


def reached(links: DataFrame, seed: DataFrame) -> DataFrame:
    """``id`` of the seed and of everything below it, each once; no pairs of seed and member are made, however seeds are nested.

    Pointers ``id, above`` are kept of ids that are not reached yet alone.  Those that lead to an id reached last say what
    is reached next; the others are doubled: a pointer to an id that is still open takes over where that one leads.  A way
    to the seed halves each round, and the more is reached, the fewer pointers are left.
    """
    fresh = stored(seed.filter("id IS NOT NULL").select("id").distinct(), "reached")
    first = _jumps(links)
    jumps, seen = stored(first.join(fresh, "id", "left_anti"), "jumps"), fresh
    dropped(first)
    while True:
        last = fresh.select(F.col("id").alias("above"))
        fresh, old = stored(jumps.join(last, "above", "left_semi").select("id").distinct(), "reached"), jumps
        if fresh.isEmpty():
            dropped(jumps, fresh)
            return seen
        seen = seen.unionByName(fresh)
        left = stored(old.join(fresh, "id", "left_anti"), "jumps")
        further = left.select(F.col("id").alias("above"), F.col("above").alias("_top"))
        doubled = left.join(further, "above").filter("id <> _top").select("id", F.col("_top").alias("above"))
        near = left.join(fresh.select(F.col("id").alias("above")), "above", "left_semi").select("id", "above")
        jumps = stored(doubled.unionByName(near).distinct(), "jumps")
        dropped(old, left)


def related(files: DataFrame, seed: DataFrame) -> DataFrame:
    """Ids of a workset by fixed point: a file belongs if its parent does, or if its parent has no file.

    ``files(id, parent_id)``, ``seed(id)``.
    """
    known = files.select(F.col("id").alias("parent_id"))
    loose = files.filter("parent_id IS NOT NULL").join(known, "parent_id", "left_anti").select("id")
    return reached(files, seed.select("id").union(loose))


def orphans(threads: DataFrame, edges: DataFrame) -> DataFrame:
    """Threads that are no roots by their source and that no edge leads to."""
    own = threads.filter(F.contains("source", F.lit('"subagent"')))
    return own.join(edges.select(F.col("child_thread_id").alias("id")), "id", "left_anti")
