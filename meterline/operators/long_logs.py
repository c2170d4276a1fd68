"""Attribution of logs that are too long for one task: a scan in segments.

A file's lines are cut into segments of equal length.  Each segment is read on its own with an open start: what was set
last before it (active turn, model of loose contexts, running total) is unknown.  A small table with one row for each
segment says what the segment sets and which turns it ends; a running combination of those rows gives every segment its
start, and the same windows as for short logs then run inside segments only.  Facts of the whole file and contexts of a
turn are aggregated first and joined, so no task ever holds a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meterline.functions.shared import computed, stored
from meterline.operators import attribution as A

#: Lines of a segment.
SEGMENT = 100_000
_KEY = ["path", "_seg"]


def _segments() -> tuple[W, W]:
    """Rows before a segment in its file, and all up to it."""
    by = W.partitionBy("path").orderBy("_seg")
    return by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.unboundedPreceding, 0)


def _with_contexts(events: DataFrame, lines: int) -> DataFrame:
    """Events with ``_seg`` and the last context of their turn, wherever in the file it stands."""
    kind = F.col("kind")
    contexts = events.filter((kind == "context") & F.col("turn_id").isNotNull()).groupBy("path", F.col("turn_id").alias("_key"))
    contexts = contexts.agg(F.max(F.struct("line_no", "model", "effort")).alias("_context"))
    rows = events.withColumn("_seg", F.floor(F.col("line_no") / lines))
    # rows without turn meet no context: they are dealt by segment, not by file
    rows = rows.withColumn("_key", F.coalesce("turn_id", F.concat(F.lit("\0"), F.col("_seg").cast("string"))))
    rows = rows.join(contexts, ["path", "_key"], "left")
    return rows.withColumns({"_model": F.col("_context.model"), "_effort": F.col("_context.effort")}).drop("_context", "_key")


def _file_facts(events: DataFrame) -> DataFrame:
    meta = F.col("kind") == "meta"
    timed = F.when(meta & F.col("at").isNotNull(), F.struct("line_no", "at", "at_date"))
    facts = events.groupBy("path").agg(F.count_if(meta).alias("n_meta"), F.max(timed).alias("s"), F.bool_or(F.when(meta, F.col("bad_time"))).alias("bad_session_time"))
    return facts.select("path", "n_meta", F.col("s.at").alias("session_at"), F.col("s.at_date").alias("session_date"), "bad_session_time")


def _carried_turns(parts: DataFrame) -> DataFrame:
    """``path, _seg, _carried``: the turn that is active where a segment begins.

    ``parts(path, _seg, _part, opened, null_end, ends)``: part 0 is what stands before a segment's first start.
    """
    closed = F.col("null_end") | F.coalesce(F.array_contains("ends", F.col("opened.turn_id")), F.lit(False))
    last = F.max_by(F.struct(F.when(~closed, F.col("opened")).alias("turn")), F.when(F.col("_part") > 0, F.col("_part")))
    head = F.max(F.when(F.col("_part") == 0, F.struct("null_end", "ends")))
    rows = parts.groupBy(*_KEY).agg(F.max(F.col("_part") > 0).alias("starts"), last.alias("out"), head.alias("head"))
    before, _ = _segments()
    rows = rows.withColumn("in", F.last(F.when(F.col("starts"), F.col("out")), ignorenulls=True).over(before)["turn"])
    # segments that begin under the same start share it until one of them ends the turn
    rows = rows.withColumn("_group", F.coalesce(F.count_if("starts").over(before), F.lit(0).cast("bigint")))
    hit = F.coalesce(F.col("head.null_end") | F.coalesce(F.array_contains("head.ends", F.col("in.turn_id")), F.lit(False)), F.lit(False))
    earlier = W.partitionBy("path", "_group").orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    ended = F.coalesce(F.bool_or(hit).over(earlier), F.lit(False))
    return rows.select(*_KEY, F.when(~ended, F.col("in")).alias("_carried"))


def _last_set(value: Column) -> Column:
    """The last non-null struct of a segment."""
    return F.max_by(value, F.when(value.isNotNull(), F.col("line_no")))


def attributed(events: DataFrame, lines: int = SEGMENT) -> DataFrame:
    """The rows and columns of :func:`attribution.attributed`, for files of any length."""
    names = events.columns
    rows = stored(_with_contexts(events, lines), "long_events")
    kind = F.col("kind")
    inside = W.partitionBy(*_KEY).orderBy("line_no")
    so_far, before = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("is_start", (kind == "start") & F.col("_model").isNotNull()).withColumn("_part", F.count_if(kind == "start").over(so_far))
    part = W.partitionBy(*_KEY, "_part").orderBy("line_no")
    opened = F.when(F.col("is_start"), F.struct("turn_id", F.col("_model").alias("model")))
    ends = kind == "end"
    parts = rows.groupBy(*_KEY, "_part").agg(
        F.max(opened).alias("opened"), F.bool_or(ends & F.col("turn_id").isNull()).alias("null_end"), F.collect_set(F.when(ends, F.col("turn_id"))).alias("ends")
    )
    starts = _carried_turns(parts).join(_file_facts(events), "path")
    rows = rows.join(starts, _KEY)
    first = F.first(opened).over(part.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_opened", F.when(F.col("_part") > 0, first).otherwise(F.col("_carried")))
    closes = ends & (F.col("turn_id").isNull() | F.col("turn_id").eqNullSafe(F.col("_opened.turn_id")))
    closed = F.coalesce(F.bool_or(closes).over(part.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("_active", F.when(~closed, F.col("_opened"))).withColumn("active", F.col("_active.turn_id"))
    nothing = F.struct(F.lit(None).cast("string").alias("m"))
    sets = (
        F.when((kind == "context") & F.col("turn_id").isNotNull(), nothing)
        .when((kind == "context") & (F.col("n_meta") == 1), F.struct(F.col("model").alias("m")))
        .when(F.col("is_start") | (ends & F.coalesce("turn_id", "active").isNull()), nothing)
    )
    counted = (kind == "usage") & ~F.col("is_invalid")
    total = F.when(counted & F.col("total").isNotNull(), F.struct(F.col("total").alias("t")))
    rows = stored(rows.withColumns({"_sets": sets, "_total": total}), "long_turns")
    earlier, _ = _segments()
    summary = rows.groupBy(*_KEY).agg(_last_set(F.col("_sets")).alias("s"), _last_set(F.col("_total")).alias("t"))
    carry = summary.select(*_KEY, F.last("s", ignorenulls=True).over(earlier).alias("_sets_before"), F.last("t", ignorenulls=True).over(earlier).alias("_total_before"))
    rows = rows.join(carry, _KEY)
    legacy = F.coalesce(F.last("_sets", ignorenulls=True).over(so_far), F.col("_sets_before"))["m"]
    previous = F.coalesce(F.last("_total", ignorenulls=True).over(before), F.col("_total_before"))["t"]
    rows = rows.withColumns({"_legacy": legacy, "_previous": previous})
    rows = computed(rows, _delta=F.when(counted, A.usage_delta(F.col("last"), F.col("total"), F.col("_previous"))))
    rows = computed(rows, usage=F.when(A.has_tokens(F.col("_delta")), F.col("_delta")))
    rows = rows.withColumn("for_model", F.when(F.col("usage").isNotNull(), F.coalesce("_active.model", "_legacy")))
    return rows.select(*names, "n_meta", "session_at", "session_date", "bad_session_time", "_model", "_effort", "is_start", "active", "usage", "for_model")
