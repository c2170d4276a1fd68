"""Project state: projects and their root paths, assignments, sessions without project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STATE = "struct<`local-projects`:map<string,struct<id:string,name:string,rootPaths:array<string>>>,`thread-project-assignments`:map<string,struct<projectId:string>>,`projectless-thread-ids`:array<string>>"


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """One row with ``state``: null where the file can't be parsed (metadata unavailable)."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.from_json("value", _STATE).alias("state"))


def projects(state: DataFrame) -> DataFrame:
    """``project_id, name, root_paths``."""
    return state.select(F.explode(F.col("state.`local-projects`")).alias("key", "p")).select(F.col("p.id").alias("project_id"), "p.name", F.transform(F.col("p.rootPaths"), clean_path).alias("root_paths"))


def project_roots(state: DataFrame) -> DataFrame:
    """``project_id, name, root_path``, a row for each root path."""
    return projects(state).select("project_id", "name", F.explode("root_paths").alias("root_path"))


def assignments(state: DataFrame) -> DataFrame:
    """``id, project_id``."""
    return state.select(F.explode(F.col("state.`thread-project-assignments`")).alias("id", "a")).select("id", F.col("a.projectId").alias("project_id"))


def projectless(state: DataFrame) -> DataFrame:
    return state.select(F.explode(F.col("state.`projectless-thread-ids`")).alias("id")).distinct()


def clean_path(path: Column) -> Column:
    """A path without doubled or trailing slashes and ``.`` parts (text only; links are not followed)."""
    single = F.regexp_replace(F.regexp_replace(path, r"(/\.)+(?=/|$)", ""), "/{2,}", "/")
    return F.when(F.length(single) > 1, F.regexp_replace(single, "/$", "")).otherwise(single)


def ancestors(path: Column) -> Column:
    """The path and every folder above it, up to ``/``, as an array."""
    parts = F.split(path, "/")
    above = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(above(n) == "", "/").otherwise(above(n)))
    return F.array_distinct(folders)
