"""Incremental analysis by file revision, and the periodic jobs on appended lines."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions.shared import stored
from meterline.operators import attribution, tree
from meterline.plans import titles
from meterline.plans.report import Facts, facts_from
from meterline.sources import logs, versions

#: Version of the analysis rules; facts of another version are derived anew.
LOGIC_VERSION = 1
#: Recorded for files that changed while they were read: their facts serve until they are derived anew.
UNSETTLED = -1
_STATE = "path string, mtime timestamp, size long, logic_version int, batch string"


def changed_files(files: DataFrame, state: DataFrame, version: int = LOGIC_VERSION, refresh: bool = False) -> DataFrame:
    """Files ``path, mtime, size`` whose revision or rules differ from ``state(path, mtime, size, logic_version)``."""
    if refresh:
        return files
    same = state.filter(F.col("logic_version") == version).select("path", "mtime", "size")
    return files.join(same, ["path", "mtime", "size"], "left_anti")


def next_state(state: DataFrame, changed: DataFrame, after: DataFrame, version: int = LOGIC_VERSION) -> DataFrame:
    """State after an analysis; a file that changed while it was read (``after`` differs) is not recorded."""
    settled = changed.join(after.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi")
    kept = state.join(changed.select("path"), "path", "left_anti")
    return kept.unionByName(settled.select("path", "mtime", "size", F.lit(version).alias("logic_version")))


def refresh_facts(spark: SparkSession, store: str, *folders: str, version: int = LOGIC_VERSION, refresh: bool = False) -> list[str]:
    """Bring the facts in ``store`` up to the log files below ``folders``; the paths that were read are returned.

    Only files whose revision or rules changed are opened.  What is derived from them is a batch of its own; a state
    table says which batch holds a file's facts, and its next version (``versions.write``) puts the batch in place of
    the older facts at once: a job that fails before leaves what was there.  Files that are gone lose their facts.  The
    list of changed files is on the driver, as Spark's own listing of them is; their lines are not.
    """
    listed, before = stored(logs.files(spark, *folders), "listing"), versions.number(spark, f"{store}/state")
    state = versions.read(spark, f"{store}/state")
    state = spark.createDataFrame([], _STATE) if state is None else state
    changed = stored(changed_files(listed, state, version, refresh), "changed")
    gone = state.join(listed.select("path"), "path", "left_anti")
    if changed.isEmpty() and gone.isEmpty():
        return []
    batch, read = uuid.uuid4().hex, sorted(r["path"] for r in changed.select("path").toLocalIterator())
    rows = logs.records(logs.read_workset(spark, changed))
    rows = rows.withColumn("path", logs.decoded(logs.plain_path(F.col("path"))))
    logs.rollouts(rows).write.parquet(f"{store}/sessions/batch={batch}")
    attribution.without_overflow(stored(attribution.attributed(logs.log_events(rows)), "attributed")).write.parquet(f"{store}/attributed/batch={batch}")
    logs.scan_quality(rows, "path").write.parquet(f"{store}/scan/batch={batch}")
    same = logs.files(spark, *folders).select("path", "mtime", "size", F.lit(True).alias("_same"))
    known = changed.join(same, ["path", "mtime", "size"], "left")
    own = F.when(F.col("_same"), F.lit(version)).otherwise(F.lit(UNSETTLED))
    fresh = known.select("path", "mtime", "size", own.alias("logic_version"), F.lit(batch).alias("batch"))
    kept = state.join(changed.select("path"), "path", "left_anti").join(listed.select("path"), "path", "left_semi")
    versions.write(kept.unionByName(fresh), f"{store}/state", before)
    return read


def live(spark: SparkSession, store: str, name: str) -> DataFrame:
    """The rows of ``sessions``, ``attributed`` or ``scan`` that the current state names; batches without any aren't read."""
    state = versions.read(spark, f"{store}/state")
    used = [r["batch"] for r in state.select("batch").distinct().toLocalIterator()]
    rows = spark.read.option("basePath", f"{store}/{name}").parquet(*(f"{store}/{name}/batch={b}" for b in used))
    return rows.join(state.select("path", "batch"), ["path", "batch"], "left_semi").drop("batch")


def stored_facts(spark: SparkSession, store: str, price_catalog: DataFrame) -> Facts:
    """Facts of all files of a store; prices are always applied anew."""
    return facts_from(live(spark, store, "sessions"), live(spark, store, "attributed"), price_catalog)


def stored_scan(spark: SparkSession, store: str) -> DataFrame:
    """The scan counters of the store's home (``logs.scan_quality``)."""
    zero = F.lit(0).cast("bigint")
    return live(spark, store, "scan").agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("n_malformed", "n_oversized")))


def compact_facts(spark: SparkSession, store: str) -> None:
    """Put all live facts into one batch; older batches stay until no reader of an older state is left."""
    batch, before = uuid.uuid4().hex, versions.number(spark, f"{store}/state")
    for name in ("sessions", "attributed", "scan"):
        live(spark, store, name).write.parquet(f"{store}/{name}/batch={batch}")
    versions.write(versions.read(spark, f"{store}/state").withColumn("batch", F.lit(batch)), f"{store}/state", before)


def touched_roots(sessions: DataFrame, paths: DataFrame) -> DataFrame:
    """``id`` of the sessions of ``paths(path)`` and of everything above them, whose totals the lines may change."""
    own = sessions.join(paths.select("path").distinct(), "path", "left_semi").select("id")
    up = sessions.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"), F.col("id").alias("parent_id"))
    return tree.reached(up, own)


def title_batches(
    store: str,
    threads: str,
    names: str,
    proposals: str,
    price_catalog: DataFrame,
    folders: Sequence[str],
    metrics: Sequence[str],
    width: int,
    now: Callable[[], Column],
    idle_minutes: int,
    limit: int | None,
) -> Callable[[DataFrame, int], None]:
    """What :func:`refresh_titles` runs for each batch of lines ``path``.

    The facts in ``store`` are brought up to date; the batch's paths lead to sessions and those above them; the threads
    among these that are idle and need a title get one.  ``threads`` is a versioned table, ``names`` and ``proposals``
    are folders with a part for each batch.  Proposals are written once for a batch id, then the next version of the
    threads, then the names; a batch that is run again takes up where it stopped and adds nothing twice.
    """

    def run(lines: DataFrame, batch_id: int) -> None:
        spark = lines.sparkSession
        mine, done = f"{proposals}/batch={batch_id}", f"{names}/batch={batch_id}"
        if _finished(spark, done):
            return
        if not _finished(spark, mine):
            refresh_facts(spark, store, *folders)
            facts = stored_facts(spark, store, price_catalog)
            paths = lines.select(logs.plain_path(F.col("path")).alias("path"))
            touched = touched_roots(live(spark, store, "sessions"), paths)
            table = versions.read(spark, threads).join(touched, "id", "left_semi")
            made = titles.title_chain(table, index_names(spark, names), facts, metrics, width, now(), idle_minutes, limit, stored_scan(spark, store))
            made.withColumn("named_at", now()).write.mode("overwrite").parquet(mine)
        made = spark.read.parquet(mine)
        table = versions.read(spark, threads)
        versions.write(titles.applied(table, made), threads)
        titles.named(made, F.col("named_at")).write.mode("overwrite").json(done)

    return run


def index_names(spark: SparkSession, names: str) -> DataFrame:
    """Latest names of an index that :func:`title_batches` writes."""
    schema = "id string, thread_name string, updated_at timestamp, batch long"
    if not logs.present(spark, [names]):
        return spark.createDataFrame([], "id string, name string, updated_at timestamp")
    rows = spark.read.schema(schema).json(names).select("id", F.col("thread_name").alias("name"), "updated_at", F.col("batch").alias("line_no"))
    return logs.latest_name(rows)


def _finished(spark: SparkSession, folder: str) -> bool:
    return bool(logs.present(spark, [f"{folder}/_SUCCESS"]))


def refresh_titles(spark: SparkSession, lines_folder: str, schema: str, checkpoint: str, batch: Callable[[DataFrame, int], None]):
    """Start a query that hands each batch of newly appended line files to ``batch`` and then stops.

    ``batch`` runs the title plan on the sessions that the lines belong to (:func:`title_batches`).  Files must be appended
    as new ones; a scheduler starts the query every few minutes.
    """
    lines = spark.readStream.schema(schema).json(lines_folder)
    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_usage(lines: DataFrame) -> DataFrame:
    """Streaming per-session totals of appended usage lines ``path, at, total`` within a day's lateness.

    Totals only grow between resets, so the largest one of each hour is the session's state in it; the batch plan
    stays the authority, as contexts may come after their turns.
    """
    timed = lines.withWatermark("at", "1 day")
    return timed.groupBy("path", F.window("at", "1 hour")).agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("n_lines"))
