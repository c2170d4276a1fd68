"""Text forms of numbers, durations, costs and names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY, _HOUR, _MINUTE = 86_400, 3_600, 60


def compact_count(n: Column) -> Column:
    """``950``, ``1.5K``, ``2M``, ``3.1B``: one half-up decimal, none if it is 0; 1000.0 moves up a unit, never past B."""
    n = n.cast("long")

    def scaled(size: int, unit: str) -> tuple[Column, Column]:
        whole = ((n - n % size) / size).cast("long")
        tenths = whole * 10 + F.floor(((n % size) * 10 + size // 2) / size).cast("long")
        decimal = F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise("")
        return tenths, F.concat(F.floor(tenths / 10).cast("string"), decimal, F.lit(unit))

    (k, k_text), (m, m_text), (_, b_text) = scaled(10**3, "K"), scaled(10**6, "M"), scaled(10**9, "B")
    return F.when(n < 1_000, n.cast("string")).when((n < 1_000_000) & (k < 10_000), k_text).when((n < 1_000_000_000) & (m < 10_000), m_text).otherwise(b_text)


def title_cost(cost: Column, lower_bound: Column) -> Column:
    """``$1,234.56``, with ``+`` for a lower bound; cents are rounded half away from zero."""
    cents = F.round(cost * 100).cast("long")
    whole = ((cents - cents % 100) / 100).cast("long")
    return F.concat(F.lit("$"), F.format_number(whole, 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.when(lower_bound, F.lit("+")).otherwise(""))


def report_cost(estimated: Column, known: Column) -> Column:
    """``$1234.56`` of the complete estimate, or the known cost with ``+``; no grouping, half-even decimals."""
    fixed = lambda c: F.concat(F.lit("$"), F.call_function("format_number", c, F.lit("0.00")))
    return F.when(estimated.isNotNull(), fixed(estimated)).otherwise(F.concat(fixed(known), F.lit("+")))


def grouped_count(n: Column) -> Column:
    """``1,234,567``."""
    return F.format_number(n.cast("long"), 0)


def duration(seconds: Column) -> Column:
    """``1d 2h 3m 4.5s``; parts that are 0 are left out, seconds are shown if above 0 or alone."""
    days = F.floor(seconds / _DAY).cast("long")
    after = seconds - days * _DAY
    hours = F.floor(after / _HOUR).cast("long")
    after = after - hours * _HOUR
    minutes = F.floor(after / _MINUTE).cast("long")
    rest = after - minutes * _MINUTE
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    alone = (days <= 0) & (hours <= 0) & (minutes <= 0)
    return F.concat_ws(" ", part(days, "d"), part(hours, "h"), part(minutes, "m"), F.when((rest > 0) | alone, F.concat(F.call_function("format_number", rest, F.lit("0.0")), F.lit("s"))))


def safe_text(s: Column) -> Column:
    """Runs of white space and control characters as one blank, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)[\s\p{Cntrl}]+", " "))


def squeezed(s: Column) -> Column:
    """Runs of (Unicode) white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def nonblank(s: Column) -> Column:
    """The text without white space at its ends; null if nothing is left."""
    bare = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    return F.when(bare != "", bare)


def search_key(s: Column) -> Column:
    """Lower case, letters and numbers only."""
    return F.regexp_replace(F.lower(s), r"[^\p{IsAlphabetic}\p{N}]", "")


def fuzzy_match(reference: Column, candidate: Column) -> Column:
    """Whether the candidate's key holds the reference's, or is within a fifth of the longer one's bytes (at least 1)."""
    r, c = search_key(reference), search_key(candidate)
    most = F.greatest(F.floor(F.greatest(F.octet_length(r), F.octet_length(c)) / 5), F.lit(1))
    return (r != "") & (F.contains(c, r) | (F.levenshtein(r, c) <= most))


def ascii_equal(a: Column, b: Column) -> Column:
    """Equality that ignores the case of A-Z only."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low(a) == low(b)


def short_list(values: Column, most: int = 5) -> Column:
    """The first names of an array in order, comma-separated, with ``, ...`` if there are more."""
    return F.concat(F.array_join(F.slice(F.array_sort(values), 1, most), ", "), F.when(F.size(values) > most, F.lit(", ...")).otherwise(""))
