"""From log events to priced requests: per-request usage, the active turn, the model, and turn durations.

All state machines are windows inside one file, so they share one shuffle by path: contexts and session facts too are
windows over the whole file, not joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meterline.functions.records import FIELDS, capped_minus, total_or_max
from meterline.functions.shared import computed, stored


def usage_delta(last: Column, total: Column, previous: Column) -> Column:
    """Usage of one request: the growth of the running total, or ``last`` where the total is absent or was reset."""
    reset = F.lit(False)
    for f in FIELDS:
        reset = reset | (total[f] < previous[f])
    grown = F.struct(*(capped_minus(total[f], previous[f]).alias(f) for f in FIELDS))
    return F.when(total.isNotNull() & previous.isNotNull() & ~reset, grown).otherwise(last)


def has_tokens(usage: Column) -> Column:
    """Whether any of the five counted fields is above 0 (the stated total is not one of them)."""
    return F.greatest(*(usage[f] for f in FIELDS[:5])) > 0


def with_file_facts(events: DataFrame) -> DataFrame:
    """Events with what holds for the whole file.

    ``n_meta, session_at, session_date, bad_session_time`` of its meta lines, and ``_model, _effort`` of the last context
    of the event's turn, wherever in the file it stands.
    """
    # in the order of turns, so that one sort serves the facts of the file and of its turns
    whole = W.partitionBy("path").orderBy("turn_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turn, kind = W.partitionBy("path", "turn_id"), F.col("kind")
    timed = F.when((kind == "meta") & F.col("at").isNotNull(), F.struct("line_no", "at", "at_date"))
    context = F.when((kind == "context") & F.col("turn_id").isNotNull(), F.struct("line_no", "model", "effort"))
    rows = events.select(
        "*",
        F.count_if(kind == "meta").over(whole).alias("n_meta"),
        F.max(timed).over(whole).alias("_session"),
        F.bool_or(F.when(kind == "meta", F.col("bad_time"))).over(whole).alias("bad_session_time"),
    ).withColumn("_context", F.max(context).over(turn))
    found = {"session_at": "_session.at", "session_date": "_session.at_date", "_model": "_context.model", "_effort": "_context.effort"}
    return rows.withColumns({c: F.col(x) for c, x in found.items()}).drop("_session", "_context")


def attributed(events: DataFrame) -> DataFrame:
    """Events with ``active`` (turn at the time), ``usage`` (this request's), ``for_model`` and ``is_start``.

    A start with a turn that has a context somewhere in the file is the active turn until an end of that turn; any
    other start leaves none.  Usage goes to the active turn's model, else to a context without turn id that still
    holds, which only counts in files with one meta line.
    """
    by = W.partitionBy("path").orderBy("line_no")
    before, so_far = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.unboundedPreceding, 0)
    rows = with_file_facts(events)
    kind, known = F.col("kind"), F.col("_model").isNotNull()
    rows = rows.withColumn("is_start", (kind == "start") & known)
    rows = rows.withColumn("_segment", F.count_if(kind == "start").over(so_far))
    # a segment is what follows a start: its windows are windows of the file, which keep the sort
    opened = F.when(F.col("is_start"), F.struct("turn_id", F.col("_model").alias("model")))
    rows = rows.withColumn("_opened", F.last(F.when(kind == "start", F.struct(opened.alias("o"))), ignorenulls=True).over(so_far)["o"])
    closes = (kind == "end") & (F.col("turn_id").isNull() | F.col("turn_id").eqNullSafe(F.col("_opened.turn_id")))
    last_closed = F.last(F.when(closes, F.col("_segment")), ignorenulls=True).over(before)
    closed = F.coalesce(last_closed == F.col("_segment"), F.lit(False))
    rows = rows.withColumn("_active", F.when(~closed, F.col("_opened"))).withColumn("active", F.col("_active.turn_id"))
    # what sets or clears the model of contexts without turn id
    sets = (
        F.when((kind == "context") & F.col("turn_id").isNotNull(), F.struct(F.lit(None).cast("string").alias("m")))
        .when((kind == "context") & (F.col("n_meta") == 1), F.struct(F.col("model").alias("m")))
        .when(F.col("is_start") | ((kind == "end") & F.coalesce("turn_id", "active").isNull()), F.struct(F.lit(None).cast("string").alias("m")))
    )
    rows = rows.withColumn("_legacy", F.last(sets, ignorenulls=True).over(so_far)["m"])
    counted = (kind == "usage") & ~F.col("is_invalid")
    previous = F.last(F.when(counted, F.col("total")), ignorenulls=True).over(before)
    rows = rows.withColumn("_previous", previous)
    rows = computed(rows, _delta=F.when(counted, usage_delta(F.col("last"), F.col("total"), F.col("_previous"))))
    rows = computed(rows, usage=F.when(has_tokens(F.col("_delta")), F.col("_delta"))).drop("_delta", "_previous")
    rows = rows.withColumn("for_model", F.when(F.col("usage").isNotNull(), F.coalesce("_active.model", "_legacy")))
    return rows.drop("_segment", "_opened", "_active", "_legacy")


def without_overflow(rows: DataFrame) -> DataFrame:
    """Attributed rows with ``left_out``: requests that would take a sum of their file beyond the largest BIGINT.

    Requests are added in line order; one that no longer fits in any of its five sums is left out whole, as is an
    unattributed one that doesn't fit in theirs, and later ones that fit are still added.  Left-out rows lose their
    ``usage`` and ``for_model``.  Only files that overflow are looked at by request: each round finds a file's first
    overflow and with it every later request that is larger than the room that is left, which can only shrink.
    """
    known, lost = F.col("for_model").isNotNull(), F.col("for_model").isNull() & (F.col("n_meta") > 1)
    none = F.lit(0).cast("bigint")
    sums = {f: F.when(known, F.col(f"usage.{f}")).otherwise(none) for f in FIELDS[:5]} | {"lost": F.when(lost, F.col("usage.total")).otherwise(none)}
    own = rows.filter(F.col("usage").isNotNull() & (known | lost)).select("path", "line_no", *(v.cast("decimal(20,0)").alias(f) for f, v in sums.items()))
    limit = F.lit((1 << 63) - 1).cast("decimal(30,0)")
    any_over = lambda over: reduce(lambda a, b: a | b, map(over, sums))
    full = own.groupBy("path").agg(*(F.sum(f).alias(f) for f in sums)).filter(any_over(lambda f: F.col(f) > limit)).select("path")
    left, out = stored(own.join(full, "path", "left_semi"), "overflow"), None
    so_far = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    while True:
        running = left.select("*", *(F.sum(f).over(so_far).alias(f"_{f}") for f in sums)).filter(any_over(lambda f: F.col(f"_{f}") > limit))
        room = F.struct(*(((limit - F.col(f"_{f}") + F.col(f)).alias(f)) for f in sums))
        first = stored(running.groupBy("path").agg(F.min("line_no").alias("_line"), F.min_by(room, "line_no").alias("_room")), "overflow")
        if first.isEmpty():
            break
        gone = (F.col("line_no") == F.col("_line")) | ((F.col("line_no") > F.col("_line")) & any_over(lambda f: F.col(f) > F.col(f"_room.{f}")))
        bad = stored(left.join(first, "path").filter(gone).select("path", "line_no"), "overflow")
        out = bad if out is None else out.unionByName(bad)
        left = stored(left.join(bad, ["path", "line_no"], "left_anti"), "overflow")
    if out is None:
        return rows.withColumn("left_out", F.lit(False))
    marked = rows.join(out.withColumn("_out", F.lit(True)), ["path", "line_no"], "left").withColumn("left_out", F.coalesce("_out", F.lit(False))).drop("_out")
    return marked.withColumns({c: F.when(~F.col("left_out"), F.col(c)) for c in ("usage", "for_model")}).select(*rows.columns, "left_out")


def usage_events(rows: DataFrame) -> DataFrame:
    """One row for each attributed request: ``path, line_no, model, at, at_date`` and the five token fields.

    Requests without a (good) time take the session's.
    """
    own = rows.filter("for_model IS NOT NULL")
    return own.select("path", "line_no", F.col("for_model").alias("model"), F.coalesce("at", "session_at").alias("at"), F.when(F.col("at").isNotNull(), F.col("at_date")).otherwise(F.col("session_date")).alias("at_date"), *(F.col(f"usage.{f}").alias(f) for f in FIELDS[:5]))


def turns(rows: DataFrame) -> DataFrame:
    """``path, line_no, turn_id, model, effort`` of every valid start, repeats included."""
    return rows.filter("is_start").select("path", "line_no", "turn_id", F.col("_model").alias("model"), F.col("_effort").alias("effort"))


def with_ends(rows: DataFrame) -> DataFrame:
    """Rows with ``ended_turn, ended_model, seconds`` on every end that closes a timed start, else null.

    The latest timed start of the turn counts, and the first end uses it up (seconds null: untimed end).
    """
    ends = (F.col("kind") == "end") & F.coalesce("turn_id", "active").isNotNull()
    starts = F.col("is_start") & F.col("at").isNotNull()
    rows = rows.withColumn("_turn", F.when(ends, F.coalesce("turn_id", "active")).when(starts, F.col("turn_id")))
    # other rows form parts of their own, so that ends and starts alone follow one another; those of a long file several
    loose = F.when(F.col("_turn").isNull(), F.floor(F.col("line_no") / 100_000))
    by = W.partitionBy("path", "_turn", "_loose").orderBy("line_no")
    rows = rows.withColumn("_loose", loose)
    began = F.lag(F.when(starts, F.struct("at", F.col("_model").alias("model")))).over(by)
    rows = rows.withColumn("_began", began).withColumn("_began", F.when(ends, F.col("_began")))
    seconds = (F.unix_micros("at") - F.unix_micros("_began.at")) / F.lit(1e6)
    closes = F.col("_began").isNotNull()
    ended = {"ended_turn": F.when(closes, F.col("_turn")), "ended_model": F.col("_began.model"), "seconds": seconds}
    return rows.withColumns(ended).drop("_turn", "_began", "_loose")


def turn_ends(rows: DataFrame) -> DataFrame:
    """``path, line_no, turn_id, model, seconds`` of every end that closes a timed start."""
    own = with_ends(rows).filter("ended_turn IS NOT NULL")
    return own.select("path", "line_no", F.col("ended_turn").alias("turn_id"), F.col("ended_model").alias("model"), "seconds")


def _quality(rows: DataFrame) -> list[Column]:
    lost = F.col("usage").isNotNull() & F.col("for_model").isNull()
    untimed = F.col("bad_time") & (F.col("is_start") | (F.col("kind") == "end") | F.col("for_model").isNotNull())
    left_out = F.col("left_out") if "left_out" in rows.columns else F.lit(False)
    incomplete = F.col("kind").isin("malformed", "oversized") | F.col("is_invalid") | lost | untimed | left_out
    tokens = F.when(lost & (F.col("n_meta") > 1), F.col("usage.total"))
    # a sum beyond the largest BIGINT stops there, and the file is incomplete
    above = lambda c: F.try_sum(c).isNull() & (F.count(c) > 0)
    full = above(tokens)
    for f in FIELDS[:5]:
        full = full | above(F.when(F.col("for_model").isNotNull(), F.col(f"usage.{f}")))
    return [
        F.count_if(F.col("kind") == "malformed").alias("malformed_lines"),
        F.count_if(F.col("kind") == "oversized").alias("oversized_lines"),
        F.count_if("is_invalid").alias("invalid_usage"),
        F.coalesce(total_or_max(tokens), F.lit(0).cast("bigint")).alias("unattributed_tokens"),
        (F.bool_or(incomplete | F.coalesce("bad_session_time", F.lit(False))) | full).alias("is_incomplete"),
    ]


def rollout_quality(rows: DataFrame) -> DataFrame:
    """``path, malformed_lines, oversized_lines, invalid_usage, unattributed_tokens, is_incomplete`` of each file."""
    return rows.groupBy("path").agg(*_quality(rows))


def rollout_stats(rows: DataFrame) -> DataFrame:
    """One row for each file: quality, known usage, turns, ended turns and turn seconds."""
    zero = F.lit(0).cast("bigint")
    used = lambda f: F.when(F.col("for_model").isNotNull(), F.col(f"usage.{f}"))
    return with_ends(rows).groupBy("path").agg(
        *_quality(rows),
        *(F.coalesce(total_or_max(used(f)), zero).alias(f) for f in FIELDS[:5]),
        F.count_if("is_start").alias("turns"),
        F.count("ended_turn").alias("ended_turns"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"),
    )
