"""Price of each request at the list rate of its date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.records import capped_minus
from meterline.sources.catalog import RATES, dated


def priced(events: DataFrame, points: DataFrame, proxy: DataFrame) -> DataFrame:
    """Events ``model, at_date, input, cached, cache_write, output`` with ``cost_millionths, is_fully_priced, unpriced_tokens``.

    A proxy is priced as its target.  The rate is the latest one from or before the event's own date; the newest
    one for undated models and events without date.  Costs are DECIMAL, so sums don't depend on their order.
    Cached and cache-written tokens are part of the input.  A missing rate matters only for tokens above 0.
    """
    rates = dated(points).select(F.col("model").alias("_target"), "effective_from", "effective_to", "is_newest", *(F.col(r).alias(f"_{r}") for r in RATES))
    named = proxy.select(F.col("model").alias("_model"), F.col("target").alias("_to"), "is_undated")
    rows = events.join(named, F.col("model") == F.col("_model"), "left").withColumn("_target_of", F.coalesce("_to", "model"))
    # an interval makes the as-of lookup an equi-join with a residual range
    undated = F.coalesce("is_undated", F.lit(False)) | F.col("at_date").isNull()
    valid = F.when(undated, F.col("is_newest")).otherwise((F.col("at_date") >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col("at_date") < F.col("effective_to"))))
    rows = rows.join(rates, (F.col("_target_of") == F.col("_target")) & valid, "left")
    room = F.coalesce(F.try_add(F.col("cached"), F.col("cache_write")), F.lit((1 << 63) - 1))
    tokens = {"input": capped_minus(F.col("input"), room), "cached": F.col("cached"), "cache_write": F.col("cache_write"), "output": F.col("output")}
    cost, full = F.lit(0).cast("decimal(38,6)"), F.col("_target").isNotNull()
    for r in RATES:
        cost = cost + F.coalesce(tokens[r].cast("decimal(19,0)") * F.col(f"_{r}"), F.lit(0).cast("decimal(37,6)"))
        full = full & (F.col(f"_{r}").isNotNull() | (tokens[r] <= 0))
    rows = rows.withColumn("cost_millionths", cost.cast("decimal(38,6)")).withColumn("is_fully_priced", full)
    both = F.coalesce(F.try_add(F.col("input"), F.col("output")), F.lit((1 << 63) - 1))
    rows = rows.withColumn("unpriced_tokens", F.when(~full, both))
    return rows.drop("_model", "_to", "is_undated", "_target_of", "_target", "effective_from", "effective_to", "is_newest", *(f"_{r}" for r in RATES))
