"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, even where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def numbered_copies(df: DataFrame, n: str, number: str, chunk: int = 1_000) -> DataFrame:
    """Each row ``n`` times, numbered from 1, in chunks, so that no array grows with ``n``."""
    many, first = F.col(n).cast("long"), F.col("_first_copy")
    df = df.withColumn("_first_copy", F.explode(F.sequence(F.lit(1).cast("long"), many, F.lit(chunk).cast("long"))))
    return df.withColumn(number, F.explode(F.sequence(first, F.least(many, first + (chunk - 1))))).drop("_first_copy")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``; an error where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/meterline/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside lose their shuffle files when they end, as nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    A lost executor then costs a re-read, not a recomputation, and every later plan sees the same rows.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with shuffles_deleted(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of a table that is broadcast.
FEW_ROWS = 1_000_000


def counted_small(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once, to be broadcast if it is counted to have few rows; else joins shuffle it."""
    df = saved(df, name)
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*frames: DataFrame) -> None:
    """Delete the files behind frames made by :func:`saved` that no later plan reads."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/meterline/" in folder:
                removed(df.sparkSession, folder)
