"""Typed reads of log records held as VARIANT values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("input", "cached", "cache_write", "output", "reasoning", "total")
#: JSON names of the token fields; fixed values of the log format.
JSON_FIELDS = {
    "input": "input_tokens",
    "cached": "cached_input_tokens",
    "cache_write": "cache_write_input_tokens",
    "output": "output_tokens",
    "reasoning": "reasoning_output_tokens",
    "total": "total_tokens",
}
USAGE_TYPE = "struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ">"
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_MAX = (1 << 63) - 1


def parsed(raw: Column) -> Column:
    """The one JSON value of a line as VARIANT; null if the line is blank, malformed or has more after it."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    alone = lambda w: F.when(F.try_variant_get(w, "$[1]", "variant").isNull(), F.try_variant_get(w, "$[0]", "variant"))
    return F.when(F.is_valid_utf8(raw), once(wrapped, alone))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind_of(v: Column) -> Column:
    """Type name of a VARIANT value: BIGINT, STRING, OBJECT<...>, VOID for JSON null; null if absent."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def text_at(v: Column, path: str) -> Column:
    """The string at a path; null if it is absent or of another type."""
    return F.when(kind_of(at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def first_text(v: Column, *paths: str) -> Column:
    """The string at the first path that is present at all, whatever its type."""
    out = F.lit(None).cast("string")
    for path in reversed(paths):
        out = F.when(at(v, path).isNotNull(), text_at(v, path)).otherwise(out)
    return out


def usage_at(v: Column, path: str) -> Column:
    """Token fields of an object, an array in the order of ``FIELDS``; absent ones are 0.

    Null if the value or any present field is not as it must be (a JSON integer of 0 or more).
    """
    number = lambda x: F.try_variant_get(x, "$", "bigint")
    count = lambda x: F.when(x.isNull(), F.lit(0).cast("bigint")).when((kind_of(x) == "BIGINT") & (number(x) >= 0), number(x))
    values = F.transform(F.array(*(at(v, f"{path}.{JSON_FIELDS[f]}") for f in FIELDS)), count)
    valid = lambda found: F.when(F.forall(found, lambda x: x.isNotNull()), found)
    return F.when(is_object(at(v, path)), once(values, valid))


def as_usage(values: Column) -> Column:
    """The array of :func:`usage_at` as a struct."""
    return F.when(values.isNotNull(), F.struct(*(F.get(values, F.lit(k)).alias(f) for k, f in enumerate(FIELDS))))


def rfc3339(text: Column) -> Column:
    """The instant of a timestamp text; null if it is malformed."""
    return F.when(text.rlike(_RFC3339), F.try_to_timestamp(F.upper(text)))


def own_date(text: Column) -> Column:
    """The calendar date in the timestamp's own offset."""
    return F.when(rfc3339(text).isNotNull(), F.try_to_date(F.substring(text, 1, 10)))


def rollout_kind(source: Column) -> Column:
    """Kind of a session from its ``source`` value (VARIANT): root, subagent, code_review and so on."""
    internal, sub = text_at(source, "$.internal"), at(source, "$.subagent")
    fields = F.try_variant_get(source, "$.subagent", "map<string,variant>")
    smallest = F.array_min(F.map_keys(fields))
    key = F.when(kind_of(sub) == "STRING", F.try_variant_get(source, "$.subagent", "string")).otherwise(smallest)
    value = F.try_element_at(fields, smallest)
    label = F.when(kind_of(value) == "STRING", F.try_variant_get(value, "$", "string"))
    label = F.when(is_object(sub), label)
    spawned = (
        F.when(key.isNull() | (key == "thread_spawn"), "subagent")
        .when(key == "review", "code_review")
        .when(key == "compact", "compaction")
        .when(key == "memory_consolidation", "memory_consolidation")
        .when((key == "other") & label.eqNullSafe(F.lit("guardian")), "security_review")
        .otherwise(F.concat(F.lit("subagent:"), F.coalesce(label, key)))
    )
    known = F.when(internal == "memory_consolidation", internal).otherwise(F.concat(F.lit("internal:"), internal))
    return F.when(~is_object(source), "root").when(internal.isNotNull(), known).when(sub.isNull(), "root").otherwise(spawned)


def parent_id(payload: Column) -> Column:
    return F.coalesce(text_at(payload, "$.parent_thread_id"), text_at(payload, "$.source.subagent.thread_spawn.parent_thread_id"))


def source_is_root(text: Column) -> Column:
    """Whether a stored source text is a root's; text that is not JSON counts as one, null does not."""
    v = parsed(text)
    return F.when(text.isNotNull(), F.when(v.isNull(), True).otherwise(rollout_kind(v) == "root")).otherwise(False)


def capped_minus(a: Column, b: Column) -> Column:
    """Subtraction that stops at 0."""
    return F.greatest(a - b, F.lit(0).cast("bigint"))


def total_or_max(c: Column) -> Column:
    """Sum of a count column that stops at the largest BIGINT."""
    return F.coalesce(F.try_sum(c), F.when(F.count(c) > 0, F.lit(_MAX)))
