"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

The mix is a row of slots of ``BLOCK`` words each.  Slot ``t`` takes the point ``t * STEP mod CYCLE``, a golden-ratio
sequence in whole numbers, and, through the cumulative targets, a source; the r-th slot of a source takes the r-th of
its blocks.  A source's blocks cut its stream, its documents shuffled by a hash and repeated for as many epochs as its
target needs (three at most).  What is taken of a document follows from the slots that its blocks are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meterline.llm.common import numbered_copies, saved, words_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Words of a block, whatever the input's size; a source's taken words are within a few blocks of its target.
BLOCK = 16
#: Points are whole numbers below CYCLE; STEP is the odd number next to CYCLE / golden ratio.
CYCLE, STEP = 1 << 31, 1_327_217_885
#: Equal parts of the cycle, so that a source meets only the points near its own, and slots that are ranked together.
BINS, CHUNK = 1024, 1 << 17
#: Documents are put in order by the MD5 of their id; a source's running sums go by its first three hex digits.
BUCKET_DIGITS = 3


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, place``: size in words (null text: 0), place the hash that orders a source."""
    size = F.size(words_of(F.col("text"))).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), _place(F.col("doc_id")).alias("place"))


def _place(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each source: ``source, source_no, source_size, target``.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes.  A target
    stops at ``max_epochs`` times its source's size; the excess goes to the others by weight until none is above.
    That is ``least(cap, weight * level)`` with the level that uses everything up, which is the largest of
    ``(total - caps before) / weights from here on`` in order of ``cap / weight``.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    turn = ((F.col("source_no") - 1) % len(weights) + 1).cast("int")
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn))
    each = each.withColumn("cap", F.col("source_size") * max_epochs)
    order, every = W.orderBy(F.col("cap") / F.col("weight"), "source_no"), W.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("source_size").over(every) - before
    each = each.withColumn("level", left / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(every))
    return each.select("source", "source_no", "source_size", target.alias("target"))


def schedule(aims: DataFrame, n_slots: int) -> DataFrame:
    """``source_no, slot, rank``: the slots in mix order and their ranks (from 0) in their source.

    ``aims`` has ``source_no, target``.  A source with a target but no slot gets one at the end.
    """
    wanted = aims.select("source_no", F.round("target").cast("decimal(20,0)").alias("words")).filter("words > 0")
    upto = F.sum("words").over(W.orderBy("source_no").rowsBetween(W.unboundedPreceding, 0))
    cut = wanted.withColumn("upto", upto).withColumn("total", F.sum("words").over(W.partitionBy()))
    edge = lambda words: F.expr(f"({words}) * cast({CYCLE} as decimal(10,0)) div total")
    cut = cut.select("source_no", edge("upto - words").alias("lo"), edge("upto").alias("hi"))
    # a source meets only the points of the bins that its range overlaps
    width = CYCLE // BINS
    bins = F.sequence(F.expr(f"lo div {width}"), F.least(F.expr(f"hi div {width}"), F.lit(BINS - 1).cast("long")))
    cut = cut.withColumn("bin", F.explode(bins))
    slots = aims.sparkSession.range(n_slots).withColumnRenamed("id", "slot")
    slots = slots.withColumn("point", (F.col("slot") % CYCLE * STEP) % CYCLE).withColumn("bin", F.expr(f"point div {width}"))
    hits = slots.join(cut, "bin").filter("point >= lo AND point < hi")
    hits = hits.select("slot", "source_no", F.expr(f"slot div {CHUNK}").alias("chunk"))
    # ranks by chunk: counts before the chunk plus the place in it, so that no source is one window
    before = W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = hits.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    place = F.row_number().over(W.partitionBy("source_no", "chunk").orderBy("slot"))
    ranked = hits.withColumn("place", place).join(counts, ["source_no", "chunk"])
    ranked = ranked.select("source_no", "slot", (F.col("earlier") + F.col("place") - 1).alias("rank"))
    none = wanted.join(counts.select("source_no").distinct(), "source_no", "left_anti")
    return ranked.unionByName(none.select("source_no", (F.lit(n_slots) + F.col("source_no")).alias("slot"), F.lit(0).cast("long").alias("rank")))


def _offsets(rows: DataFrame) -> DataFrame:
    """Adds ``start``, the document's place in its source's stream, by two-level running sums."""
    rows = rows.withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    before = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = W.partitionBy("source_no", "bucket").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, ["source_no", "bucket"]).withColumn("start", F.col("earlier") + F.col("before"))
    return rows.drop("bucket", "place", "earlier", "before")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK
) -> DataFrame:
    """The mix as pieces: ``slot, epoch, doc_id, source, size, source_size, target, start, from_word, n_words``.

    In slot order the pieces give the mix; a piece takes ``n_words`` words of its document from word ``from_word``
    in its given epoch.  ``start`` tells equal rows of one source apart.  Every input row has a piece at least:
    one of 0 words and null slot if the mix takes nothing of it (empty or null text, or beyond the target).
    A null source is a source of its own; null ids are allowed; long texts span blocks; extra columns are ignored; an
    empty table gives no rows.
    """
    sizes = saved(sized(docs), "mix_sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    aims = saved(targets(sizes, weights, max_epochs), "mix_targets")
    plan = saved(schedule(aims, max(1, (total + block // 2) // block)), "mix_schedule")
    # ranks of a source have no gaps, so its last one tells which blocks are given slots
    given = plan.groupBy("source_no").agg((F.max("rank") + 1).alias("blocks"))
    aims = aims.join(given, "source_no", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0).cast("long")))
    known = sizes.join(aims.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    known = _offsets(known).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    # the document's places in the repeated stream, then the blocks that each overlaps
    begin = F.col("start") + F.col("epoch") * F.col("source_size")
    known = known.withColumn("begin", begin).withColumn("end", F.least(begin + F.col("size"), F.col("blocks") * block))
    live = F.col("begin") < F.col("end")
    known = known.filter(live | (F.col("epoch") == 0))
    ranks = F.when(live, F.expr(f"sequence(begin div {block}, (end - 1) div {block})"))
    pieces = known.withColumn("rank", F.explode_outer(ranks)).join(plan, ["source_no", "rank"], "left")
    lo = F.greatest(F.col("begin"), F.col("rank") * block)
    hi = F.least(F.col("end"), (F.col("rank") + 1) * block)
    words = F.when(F.col("slot").isNotNull(), hi - lo).otherwise(F.lit(0).cast("long"))
    keep = ("slot", "epoch", "doc_id", "source", "size", "source_size", "target", "start")
    return pieces.select(*keep, (lo - F.col("begin")).alias("from_word"), words.alias("n_words"))


def taken(pieces: DataFrame) -> DataFrame:
    """One row for each input row: ``doc_id, source, size, source_size, target, taken``."""
    row, facts = ("source", "doc_id", "size", "start"), ("source_size", "target")
    # rows without words share a start, so they are told apart by nothing; they have one piece each and stay as they are
    some = pieces.filter("size > 0").groupBy(*row).agg(*(F.first(c).alias(c) for c in facts), F.sum("n_words").alias("taken"))
    none = pieces.filter("size = 0").select(*row, *facts, F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).select("doc_id", "source", "size", *facts, "taken")


def in_epochs(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, whole and with all their columns: one row for each epoch that takes words of it.

    Columns of any name pass through; of rows with equal id, source and size, those of smaller text come first.
    """
    row = ("doc_id", "source", "size", "start")
    # a document that an epoch takes words of is in all epochs before it
    epochs = mix(docs, **options).filter("n_words > 0").groupBy(*row).agg((F.max("epoch") + 1).alias("n"))
    # equal ids are numbered on both sides, so that repeated rows meet one partner each
    same = W.partitionBy("doc_id", "source", "size").orderBy("start")
    epochs = epochs.select(*(F.col(c).alias(f"mix_{c}") for c in row[:3]), F.row_number().over(same).alias("mix_no"), "n")
    size = F.size(words_of(F.col("text"))).cast("long")
    held = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", size.alias("size"), "text")
    held = held.filter("size > 0")
    held = held.withColumn("no", F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy("text"))).drop("text")
    on = F.col("no") == F.col("mix_no")
    for c in row[:3]:
        on = on & F.col(c).eqNullSafe(F.col(f"mix_{c}"))
    return numbered_copies(held.join(epochs, on), "n", "copy").select("doc.*")
