"""Tables kept in versions: a new one is written whole beside the others, and becomes the current one by one rename."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_DATA, _HEADS = "data", "heads"


class Conflict(RuntimeError):
    """Another writer made the version first."""


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _heads(spark: SparkSession, folder: str) -> dict[int, str]:
    where, fs = _at(spark, f"{folder}/{_HEADS}")
    if not fs.exists(where):
        return {}
    names = (f.getPath().getName() for f in fs.listStatus(where))
    return {int(n): f"{folder}/{_HEADS}/{n}" for n in names if n.isdigit()}


def number(spark: SparkSession, folder: str) -> int:
    """Number of the current version; 0 before the first."""
    return max(_heads(spark, folder), default=0)


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """The current (or the given) version of a table; None where there is none."""
    heads = _heads(spark, folder)
    if not heads:
        return None
    head = heads[version or max(heads)]
    data = spark.read.text(head).first()["value"]
    return spark.read.parquet(f"{folder}/{_DATA}/{data}")


def write(df: DataFrame, folder: str, after: int | None = None) -> int:
    """Write the version that follows ``after`` (default: the current one) and return its number.

    The data lies in a folder of its own that no reader looks at until a small file that names it is renamed to the
    version's number, so a reader sees the old table or the new one, and a job that fails before leaves the old one.
    ``df`` may be made from the current version.  If the number is taken meanwhile, nothing changes and
    :class:`Conflict` is raised.  File systems whose rename is a copy need a lock around this.
    """
    spark = df.sparkSession
    after = number(spark, folder) if after is None else after
    data = f"{after + 1}-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{_DATA}/{data}")
    _publish(spark, folder, after + 1, data)
    return after + 1


def _publish(spark: SparkSession, folder: str, version: int, data: str) -> None:
    draft, fs = _at(spark, f"{folder}/drafts/{data}")
    out = fs.create(draft)
    out.write(bytearray(data.encode()))
    out.close()
    head, _ = _at(spark, f"{folder}/{_HEADS}/{version}")
    fs.mkdirs(head.getParent())
    jvm = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
    options[0] = getattr(jvm, "Options$Rename").NONE
    try:
        jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, head, options)
    except Exception as e:
        if fs.exists(head):
            raise Conflict(f"version {version} of {folder} is there already") from e
        raise


def keep(spark: SparkSession, folder: str, newest: int) -> None:
    """Delete all versions but the ``newest`` ones, with data that no version names (of failed writers; none may run)."""
    heads = _heads(spark, folder)
    stay = sorted(heads)[-newest:]
    named = {spark.read.text(heads[v]).first()["value"] for v in stay}
    for v in set(heads) - set(stay):
        where, fs = _at(spark, heads[v])
        fs.delete(where, False)
    where, fs = _at(spark, f"{folder}/{_DATA}")
    for found in fs.listStatus(where):
        if found.getPath().getName() not in named:
            fs.delete(found.getPath(), True)
