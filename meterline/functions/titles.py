"""Session titles that end in metrics: grammar, suffix tests and bounded composition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterline.functions.formatting import compact_count, nonblank, squeezed, title_cost

SEPARATOR = " · "
#: Signs of the metrics in a title; fixed values of the format.
SIGNS = {"cost": "$", "total": "⇄", "input": "⇥", "output": "↦"}
_COST = r"\$(?:0|[1-9]\d{0,2}(?:,\d{3})*)\.\d{2}\+?"
_COUNT = r"(?:0|[1-9]\d{0,2}[KMB]?|[1-9]\d{0,2}\.[1-9][KMB])"
METRIC = rf"(?:{_COST}|[⇄⇥↦]{_COUNT})"
SUFFIX = rf"(?: · {METRIC})+\z"


def without_metrics(title: Column) -> Column:
    """The title without its trailing metrics."""
    return F.regexp_replace(title, SUFFIX, "")


def metric_signs(title: Column) -> Column:
    """Signs of the trailing metrics, in order (empty without any)."""
    tail = F.regexp_extract(title, rf"({SUFFIX})", 1)
    return F.regexp_extract_all(tail, F.lit(r" · ([$⇄⇥↦])"), 1)


def ends_in(title: Column, metrics: Sequence[str]) -> Column:
    """Whether the trailing metrics are exactly these, in order."""
    return metric_signs(title) == F.array(*(F.lit(SIGNS[m]) for m in metrics))


def metrics_text(metrics: Sequence[str], input_tokens: Column, output_tokens: Column, known_cost: Column, lower_bound: Column) -> Column:
    """The metrics of a title, joined by the separator."""
    total = F.coalesce(F.try_add(input_tokens, output_tokens), F.lit((1 << 63) - 1))
    text = {
        "cost": lambda: title_cost(known_cost, lower_bound),
        "total": lambda: F.concat(F.lit(SIGNS["total"]), compact_count(total)),
        "input": lambda: F.concat(F.lit(SIGNS["input"]), compact_count(input_tokens)),
        "output": lambda: F.concat(F.lit(SIGNS["output"]), compact_count(output_tokens)),
    }
    return F.concat_ws(SEPARATOR, *(text[m]() for m in metrics))


def composed(title: Column, suffix: Column, width: int) -> Column:
    """``base · suffix`` of at most ``width`` characters, the base cut with an ellipsis; null if it can't fit."""
    rtrim = lambda c: F.regexp_replace(c, r"(?U)\s+\z", "")
    base = rtrim(without_metrics(title))
    room = F.lit(width) - F.length(suffix) - len(SEPARATOR)
    cut = rtrim(F.substring(base, F.lit(1), F.greatest(room - 1, F.lit(0))))
    fitted = F.when((room < 0) | (base == ""), None).when(F.length(base) <= room, base).when((room >= 2) & (cut != ""), F.concat(cut, F.lit("…")))
    return F.concat(fitted, F.lit(SEPARATOR), suffix)


def base_name(history_mode: Column, title: Column, name: Column, prompt: Column, index_name: Column) -> Column:
    """The name that a title is built on.

    Paginated sessions: name, prompt, title.  Others: a title that is not the prompt, the index's name, prompt, title.
    """
    t, p = nonblank(title), nonblank(prompt)
    last = squeezed(F.coalesce(p, t, F.lit("Untitled")))
    own = F.when(~t.eqNullSafe(p), t)
    return F.when(history_mode == "paginated", F.coalesce(nonblank(name), last)).otherwise(F.coalesce(own, nonblank(index_name), last))
