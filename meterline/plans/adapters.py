"""Projections of plain business tables into the canonical tables of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meterline.functions.records import FIELDS, USAGE_TYPE
from meterline.operators import pricing
from meterline.plans.report import Facts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in order: ``path, n`` and the event's columns."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.withColumn("n", n).withColumn("path", F.concat(F.lit("u"), F.col("user_id").cast("string"))).withColumn("tokens", F.round(F.col("value") * 100).cast("long"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a session log of each user.

    signup starts a turn (with a context line before it unless the id divides by 5), purchase ends one, view and
    click report tokens, error is a context without turn or a malformed line.
    """
    e = numbered(spark, sf_dir)
    usage = lambda name: f"named_struct('input', {name}, 'cached', {name} div 4, 'cache_write', 0L, 'output', {name} div 10, 'reasoning', {name} div 20, 'total', {name} + {name} div 10)"
    e = e.withColumn("small", F.col("tokens") % 1000)
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end").when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "context").otherwise("malformed")).otherwise("usage")
    own = e.withColumn("kind", kind).select(
        "path",
        (2 * F.col("n")).alias("line_no"),
        "kind",
        F.when(F.col("kind") == "start", F.col("event_id")).when((F.col("kind") == "end") & (F.col("event_id") % 3 == 0), F.col("event_id") - 1).cast("string").alias("turn_id"),
        F.when(F.col("kind") == "context", "legacy").alias("model"),
        F.when(F.col("kind") == "context", "unknown").alias("effort"),
        F.col("ts").cast("timestamp").alias("at"),
        F.to_date("ts").alias("at_date"),
        F.lit(False).alias("bad_time"),
        F.when(F.col("kind") == "usage", F.expr(usage("small"))).cast(USAGE_TYPE).alias("last"),
        F.when(F.col("kind") == "usage", F.expr(usage("tokens"))).cast(USAGE_TYPE).alias("total"),
        F.lit(False).alias("is_invalid"),
    )
    none = lambda c: F.lit(None).cast(own.schema[c].dataType).alias(c)
    contexts = e.filter("event_type = 'signup' AND event_id % 5 <> 0").select("path", (2 * F.col("n") - 1).alias("line_no"), F.lit("context").alias("kind"), F.col("event_id").cast("string").alias("turn_id"), F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("model"), F.concat(F.lit("e"), (F.col("event_id") % 3).cast("string")).alias("effort"), none("at"), none("at_date"), F.lit(False).alias("bad_time"), none("last"), none("total"), F.lit(False).alias("is_invalid"))
    metas = e.select("path", "user_id").distinct().withColumn("line_no", F.explode(F.sequence(F.lit(-1).cast("long"), F.when(F.col("user_id") % 4 == 0, F.lit(0)).otherwise(-1).cast("long"))))
    metas = metas.select("path", "line_no", F.lit("meta").alias("kind"), none("turn_id"), none("model"), none("effort"), none("at"), none("at_date"), F.lit(False).alias("bad_time"), none("last"), none("total"), F.lit(False).alias("is_invalid"))
    return own.unionByName(contexts).unionByName(metas)


def log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same logs as JSON lines: ``path, line_no, raw``."""
    rows = log_events(spark, sf_dir)
    used = lambda c: F.struct(*(F.col(f"{c}.{f}").alias(n) for f, n in zip(FIELDS, ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"), strict=True)))
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("path").alias("id"), F.lit("cli").alias("source")).alias("payload")))
    context = F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct("turn_id", "model", "effort").alias("payload")))
    event = lambda payload: F.to_json(F.struct(F.lit("event_msg").alias("type"), stamp, payload.alias("payload")))
    raw = (
        F.when(F.col("kind") == "meta", meta)
        .when(F.col("kind") == "context", context)
        .when(F.col("kind") == "start", event(F.struct(F.lit("task_started").alias("type"), "turn_id")))
        .when(F.col("kind") == "end", event(F.struct(F.lit("task_complete").alias("type"), "turn_id")))
        .when(F.col("kind") == "usage", event(F.struct(F.lit("token_count").alias("type"), F.struct(used("last").alias("last_token_usage"), used("total").alias("total_token_usage")).alias("info"))))
        .otherwise('{"type": broken')
    )
    return rows.select("path", "line_no", raw.alias("raw"))


def price_points(spark: SparkSession) -> DataFrame:
    """Two points for each brand ``n`` of 1 to 25 but those that divide by 7."""
    n = spark.range(1, 26).filter("id % 7 <> 0").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(1))))
    rate = F.col("id").cast("decimal(18,6)") * F.when(F.col("p") == 0, F.lit("0.25")).otherwise(F.lit("0.20")).cast("decimal(4,2)")
    money = lambda c: c.cast("decimal(18,6)")
    return n.select(
        F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("model"),
        F.col("p").alias("position"),
        F.when(F.col("p") == 0, F.lit("1997-01-01")).otherwise(F.lit("2000-01-01")).cast("date").alias("effective_from"),
        money(rate).alias("input"),
        F.when(F.col("id") % 5 != 0, money(rate * F.lit("0.1").cast("decimal(3,1)"))).alias("cached"),
        F.when(F.col("id") % 3 != 0, money(rate * F.lit("1.25").cast("decimal(4,2)"))).alias("cache_write"),
        money(rate * F.lit(6).cast("decimal(3,0)")).alias("output"),
    )


def proxies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Brand#7", "Brand#8", False), ("Brand#14", "Brand#13", True)], "model string, target string, is_undated boolean")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as requests: the part's brand is the model, the ship date the day, the order its session's."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("model")), "l_partkey")
    part = lambda c: F.round(F.col("l_quantity") * F.col(c) * 1000).cast("long")
    return items.select("l_orderkey", "l_partkey", "l_linenumber", "model", F.col("l_shipdate").alias("at"), F.to_date("l_shipdate").alias("at_date"), (F.col("l_quantity") * 1000).cast("long").alias("input"), part("l_discount").alias("cached"), part("l_tax").alias("cache_write"), F.round(F.col("l_extendedprice") / 10).cast("long").alias("output"), F.lit(0).cast("long").alias("reasoning"))


def priced_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.priced(usage(spark, sf_dir), price_points(spark), proxies(spark))


def links(spark: SparkSession, sf_dir: str, cyclic: bool = False) -> DataFrame:
    """Customers as sessions in trees of 50: ``id, parent_id, kind, n_nationkey``."""
    pos = F.expr("c_custkey % 50")
    top = F.col("c_custkey") + 49 if cyclic else F.lit(None).cast("long")
    parent = F.when(pos == 0, top).otherwise(F.expr("(c_custkey div 50) * 50 + (c_custkey % 50 - 1) div 3"))
    kind = F.when(pos == 0, "root").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), parent.alias("parent_id"), kind.alias("kind"), F.lit(None).cast("string").alias("cwd"), F.col("c_nationkey").alias("nation"))


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    """Customers as sessions, their orders as turns (those with status F ended), line items as requests."""
    rows = links(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    # requests meet their orders before they are priced: prices are wider than what they are made of; sessions hold few
    # requests and turns of a model here, so these are dealt by session as they are, and nothing is dealt again
    sessions = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"))
    used = usage(spark, sf_dir).drop("l_partkey", "l_linenumber", "at").join(sessions, "l_orderkey").drop("l_orderkey").repartition("id")
    used = pricing.priced(used, price_points(spark), proxies(spark))
    dealt = orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("effort"), ((F.col("o_orderkey") % 1000) * 0.5).alias("seconds")).repartition("id")
    turns, ends = dealt.drop("seconds"), dealt.filter("effort = 'F'").drop("effort")
    quality = rows.select("id", F.when(F.col("id") % 97 == 0, 1000).otherwise(0).cast("long").alias("unattributed_tokens"), (F.col("id") % 53 == 0).alias("is_incomplete"))
    return Facts(rows.drop("nation"), used, turns, ends, quality)
