"""Quality rules as a bitmask ledger, with DataFrame functions only.

Each rule is evaluated once.  The ledger stores one bit for each failed rule beside the measurements; a policy is
a versioned mask over these bits, so changing a policy or measuring an ablation never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import SPACE, let, words_of

WINDOW = 8

#: Rules in bit order; a bit keeps its meaning for ever, new rules are appended.
RULES = ("too_few_words", "repeated_windows", "mean_word_length", "symbols", "repeated_lines", "shouting", "few_letters")


@dataclass(frozen=True)
class Policy:
    """A named version of a policy: a document is kept if no rule in ``rules`` failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_windows"))
POLICIES = (BASE, Policy("v1", RULES[:5]), Policy("v2", RULES))


def window_hashes(words: Column) -> Column:
    """64-bit hashes of the 8-word windows in order; fewer words give an empty array.

    Windows are compared inside one text only, where a collision of 64-bit hashes is out of reach.
    """
    at = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= WINDOW, at(h)).otherwise(F.array().cast("array<bigint>")))


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur at least twice, given the window hashes."""
    pairs = F.array_sort(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("i")))

    def positions(p: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(p, k)["h"] == F.get(p, j)["h"], F.lit(False))
        kept = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda k: same(k, k + 1) | same(k, k - 1))
        return F.array_sort(F.transform(kept, lambda k: F.get(p, k)["i"]))

    def total(at: Column) -> Column:
        # each window adds what it covers beyond the one before it
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), step, lambda acc: acc["n"])

    return let(let(pairs, positions), total)


def repeated_words(words: Column) -> Column:
    """Words in 8-word windows found twice or more in the text, first occurrences included."""
    return let(window_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))


def measured(docs: DataFrame, *keep: Column) -> DataFrame:
    """``doc_id`` (or the columns ``keep``) and the measurements, each taken once from the whole text (null: empty)."""
    keep = keep or (F.col("doc_id"),)
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.regexp_replace(text, SPACE + "+", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACE + "+", "") != "")
    taken = docs.select(
        *keep,
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.struct(
            F.length(bare).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            F.length(F.regexp_replace(bare, r"\P{L}+", "")).cast("long").alias("n_letters"),
            F.length(F.regexp_replace(bare, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        ).alias("m"),
    )
    return taken.select(*taken.columns[: len(keep)], "w.*", "m.*")


def failures() -> dict[str, Column]:
    """The failure condition of each rule over the measurements."""
    n = F.col("n_words")
    return {
        "too_few_words": n < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * n,
        "mean_word_length": (2 * F.col("word_chars") < 5 * n) | (F.col("word_chars") > 12 * n),
        "symbols": 10 * F.col("n_symbols") > n,
        "repeated_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "shouting": 2 * F.col("n_upper") > F.col("n_letters"),
        "few_letters": 2 * F.col("n_letters") < F.col("word_chars"),
    }


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``failed_bits`` (long), one row for each input row.

    Null texts count as empty and fail ``too_few_words``; texts of any length are measured whole; extra columns are
    ignored; repeated rows give equal rows; an empty table gives no rows.
    """
    return measured(docs).withColumn("failed_bits", failed_bits())


def failed_bits() -> Column:
    """The ledger's mask: bit k is set if rule k failed."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(failures()[rule], F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def passed(docs: DataFrame, policy: Policy = POLICIES[-1]) -> DataFrame:
    """The documents that a policy keeps, with all their columns, whatever their names."""
    rows = measured(docs, F.struct(*docs.columns).alias("_doc")).withColumn("failed_bits", failed_bits())
    return rows.filter(keeps(BASE) & keeps(policy)).select("_doc.*")


def keeps(policy: Policy) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``base_failed`` and the policy's verdict ``kept``."""
    return rows.withColumn("base_failed", ~keeps(BASE)).withColumn("kept", keeps(BASE) & keeps(policy))


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that come back if it alone is removed."""
    masked = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    seen = rows.groupBy(masked.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    bit = {r: F.lit(1 << RULES.index(r)).cast("long") for r in policy.rules}
    bits, zero = F.col("bits"), F.lit(0).cast("long")
    many = lambda holds: F.coalesce(F.sum(F.when(holds, F.col("n"))), zero)
    one = lambda r: F.struct(
        F.lit(policy.version).alias("policy"),
        F.lit(r).alias("rule"),
        many(bits.bitwiseAND(bit[r]) != 0).alias("n_failed"),
        many(bits == bit[r]).alias("n_recovered"),
    )
    return seen.agg(F.array(*map(one, policy.rules)).alias("all")).select(F.explode("all").alias("x")).select("x.*")
