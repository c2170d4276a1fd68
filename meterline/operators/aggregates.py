"""Aggregates of reports: sums that keep their gaps, majorities, maps and short lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complete_sum(value: Column) -> Column:
    """The sum, or null if any value is null."""
    return F.when(F.count_if(value.isNull()) == 0, F.coalesce(F.sum(value), F.lit(0).cast("decimal(38,6)")))


def dollars(millionths: Column, digits: int = 8) -> Column:
    """Money from summed millionths: DOUBLE, rounded half away from zero."""
    return F.round(millionths.cast("decimal(30,6)") * F.lit("0.000001").cast("decimal(6,6)"), digits).cast("double")


def majority(key: Column, n: Column) -> Column:
    """The key of the largest count; of equal counts, the smallest key."""
    return F.min_by(F.when(n > 0, key), F.when(n > 0, F.struct((-n).alias("n"), key.alias("k"))))


def sorted_map(key: Column, value: Column, when: Column) -> Column:
    """Map in key order of the rows that satisfy ``when``."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.when(when, F.struct(key.alias("key"), value.alias("value"))))))


def warnings(text: Column) -> Column:
    """Distinct warnings in order."""
    return F.array_sort(F.collect_set(text))
