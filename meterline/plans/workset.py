"""Which log files an answer needs, from the thread store alone, so that no others are opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.operators import tree
from meterline.sources import logs


def targeted_paths(threads: DataFrame, edges: DataFrame, listed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``path`` of the files behind ``wanted(id)`` and everything spawned below, with those the store can't place.

    ``threads(id, rollout_path, source)``, ``edges(parent_thread_id, child_thread_id)``, ``listed(path, ...)`` of
    :func:`logs.files`.  Subagents that no edge leads to and files that the thread table doesn't list may belong to any
    tree, so they are always read.
    """
    links = tree.all_links(threads.select("id", F.lit(None).cast(threads.schema["id"].dataType).alias("parent_id")), edges)
    ids = tree.reached(links, wanted.select("id"))
    loose = tree.orphans(threads, edges).select("id")
    stored = threads.withColumn("path", logs.plain_path(F.col("rollout_path")))
    known = stored.join(ids.unionByName(loose).distinct(), "id", "left_semi").select("path")
    others = logs.unlisted(listed, stored.drop("rollout_path").withColumnRenamed("path", "rollout_path")).select("path")
    return known.filter("path IS NOT NULL").unionByName(others).distinct()


def targeted_records(spark: SparkSession, home: str, threads: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Log records of the targeted files of one home; other logs are not opened."""
    listed = logs.files(spark, *(f"{home}/{f}" for f in logs.FOLDERS))
    return logs.records(logs.read_workset(spark, targeted_paths(threads, edges, listed, wanted)))
