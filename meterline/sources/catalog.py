"""Price catalogs: rates by model and start date, proxies, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RATES = ("input", "cached", "cache_write", "output")
POINT = "struct<effective_from:date,input:decimal(18,6),cached_input:decimal(18,6),cache_write_input:decimal(18,6),output:decimal(18,6)>"
SCHEMA = f"as_of string, source string, histories map<string,array<{POINT}>>, proxies map<string,string>, undated_proxies array<string>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog file as one row."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def price_points(catalog: DataFrame) -> DataFrame:
    """``model, position, effective_from`` and the four rates (null: no price)."""
    rows = catalog.select(F.explode("histories").alias("model", "points")).select("model", F.posexplode("points").alias("position", "p"))
    return rows.select("model", "position", "p.effective_from", F.col("p.input").alias("input"), F.col("p.cached_input").alias("cached"), F.col("p.cache_write_input").alias("cache_write"), F.col("p.output").alias("output"))


def proxies(catalog: DataFrame) -> DataFrame:
    """``model, target, is_undated``."""
    rows = catalog.select(F.explode("proxies").alias("model", "target"), F.coalesce("undated_proxies", F.array().cast("array<string>")).alias("u"))
    return rows.select("model", "target", F.array_contains("u", F.col("model")).alias("is_undated"))


def undated(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.explode("undated_proxies").alias("model"))


def dated(points: DataFrame) -> DataFrame:
    """Points with ``effective_to`` (null: still valid) and ``is_newest``."""
    by = W.partitionBy("model").orderBy("effective_from")
    end = F.lead("effective_from").over(by)
    return points.withColumn("effective_to", end).withColumn("is_newest", F.col("effective_to").isNull())


def problems(points: DataFrame, proxy: DataFrame, undated_models: DataFrame) -> DataFrame:
    """``problem, model`` of every fault: negative rates, dates out of order, proxies without target, stray undated."""
    name = lambda df, text: df.select(F.lit(text).alias("problem"), "model").distinct()
    negative = points.filter(" OR ".join(f"coalesce({r} < 0, false)" for r in RATES))
    before = F.lag("effective_from").over(W.partitionBy("model").orderBy("position"))
    disorder = points.withColumn("_before", before).filter("_before >= effective_from")
    dangling = proxy.join(points.select(F.col("model").alias("target")), "target", "left_anti")
    stray = undated_models.join(proxy.select("model"), "model", "left_anti")
    return name(negative, "negative rate").unionByName(name(disorder, "dates not increasing")).unionByName(name(dangling, "unknown proxy target")).unionByName(name(stray, "undated model is no proxy"))


def checked(catalog: DataFrame) -> DataFrame:
    """The catalog if it has no faults; else an error that names them."""
    found = problems(price_points(catalog), proxies(catalog), undated(catalog)).limit(10).collect()
    if found:
        raise ValueError("price catalog: " + "; ".join(f"{r['problem']}: {r['model']}" for r in found))
    return catalog
