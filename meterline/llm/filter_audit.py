"""Audit of how filters interact: what each one removes at every place of every order, and its Shapley share.

Every document is judged once by each filter into a mask of failure bits.  All figures of a part follow from three
games over the coalitions of filters: how many documents (all, good, toxic) a coalition removes.  Steps of an order are
differences of coalitions; Shapley shares come from the Hart-Mas-Colell potential

    P(S) = (v(S) + sum of P(S without i) for i in S) / |S|,    share of i = P(all) - P(all without i)

computed by recursion over the coalitions in rising order of their masks, in whole numbers: every P times the least
common multiple of the sizes is one.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filters of the audit; bit k of a mask is the k-th one.
FILTERS = "ABCDE"
SAME_TEXT = 1 << FILTERS.index("E")
SYMBOLS = "#$%&*|"
_BLANKS = " \t\n\x0b\x0c\r"


def text_failures(text: Column) -> Column:
    """Failure bits of the filters A to D, which look at one text alone (null: empty).

    A: under 100 words; B: under 80 % of the words distinct; C: over 10 % of the code points are A-Z; D: a symbol.
    """
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(_BLANKS))
    words = F.when(bare != "", F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    seen = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("d"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (
        seen["n"] < 100,
        100 * seen["d"].cast("long") < 80 * seen["n"].cast("long"),
        100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        text.rlike(f"[{SYMBOLS}]"),
    )
    mask = F.lit(0)
    for k, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << k).otherwise(0)
    return mask


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, n_good, n_toxic``: documents of each language (null: empty) by the filters that they fail.

    E fails where a smaller id has the same text, anywhere in the table; rows without id have no smaller one, are
    nobody's and never fail it, and repeated rows of the smallest id don't either.  A document is good (toxic) if any of
    its label rows says so.  Only digests, masks and ids are shuffled; equal texts fold before they meet, so no group of
    copies is gathered.
    """
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    judged = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), digest.alias("digest"), text_failures(F.col("text")).alias("own"))
    kinds = ("part", "digest", "own", "good", "toxic")
    named = judged.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    nameless = judged.filter("doc_id IS NULL").withColumns({c: F.lit(0) for c in ("good", "toxic")})
    # an id's rows with their number, then each kind's number and its smallest id: both fold before the shuffle
    by_id = named.groupBy(*kinds, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    folded = by_id.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    least = folded.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    folded = folded.join(least, "digest")
    firsts = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.array(F.struct(F.col("own").alias("mask"), firsts.cast("long").alias("n")), F.struct((F.col("own") + SAME_TEXT).alias("mask"), (F.col("n") - firsts).alias("n")))
    rows = folded.select("part", "good", "toxic", F.inline(split))
    rows = rows.unionByName(nameless.select("part", "good", "toxic", F.col("own").alias("mask"), F.lit(1).cast("long").alias("n"))).filter("n > 0")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))


def games(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part, n_docs, removed, good, toxic``: for each coalition (array index: its mask) what it removes."""
    coalition = F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("coalition")
    hit = F.when(F.col("mask").bitwiseAND(F.col("coalition")) != 0, 1).otherwise(0)
    sums = found.select("*", coalition).groupBy("part", "coalition").agg(
        F.sum("n").alias("n_docs"), F.sum(F.col("n") * hit).alias("removed"), F.sum(F.col("n_good") * hit).alias("good"), F.sum(F.col("n_toxic") * hit).alias("toxic")
    )
    # one row for each coalition, so the arrays have 32 entries, whatever the part's size
    rows = F.array_sort(F.collect_list(F.struct("coalition", "removed", "good", "toxic")))
    whole = sums.groupBy("part").agg(F.max("n_docs").alias("n_docs"), rows.alias("g"))
    return whole.select("part", "n_docs", *(F.col(f"g.{c}").alias(c) for c in ("removed", "good", "toxic")))


def potentials(value: Column, n: int) -> Column:
    """Potential of every coalition of ``n`` players times ``lcm(1..n)``, by recursion: subsets have smaller masks."""
    scale = lcm(*range(1, n + 1))

    def grown(known: Column, s: Column) -> Column:
        total = F.get(value, s) * scale
        for i in range(n):
            total = total + F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, s - (1 << i))).otherwise(F.lit(0).cast("long"))
        return F.concat(known, F.array(F.call_function("div", total, F.bit_count(s).cast("long"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n) - 1)), F.array(F.lit(0).cast("long")), grown)


def audit(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step: see the columns at the end.

    ``found`` is the table of :func:`failures`; an empty one gives no rows.  ``shapley`` is the filter's number of
    removals summed over all orders, which is its Shapley share times the number of orders.
    """
    n, every = len(filters), (1 << len(filters)) - 1
    rows = games(found, filters).withColumn("potential", potentials(F.col("removed"), n))
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(filters)))).alias("filter_order")
    rows = rows.select("*", orders)
    rows = rows.select("*", F.posexplode(F.split("filter_order", "")).alias("pos", "filter"))
    bits = lambda text: F.aggregate(F.split(text, ""), F.lit(0), lambda m, c: m + F.when(c != "", F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(filters), c) - 1)).otherwise(0))
    rows = rows.withColumns({"bit": bits(F.col("filter")), "before": bits(F.expr("left(filter_order, pos)"))})
    bit, before, after = F.col("bit"), F.col("before"), F.col("before") + F.col("bit")
    here = lambda game: F.get(game, after) - F.get(game, before)
    share = (F.get("potential", F.lit(every)) - F.get("potential", every - bit)) * (factorial(n) // lcm(*range(1, n + 1)))
    return rows.select(
        "part",
        "filter_order",
        (F.col("pos") + 1).cast("int").alias("step"),
        (F.col("n_docs") - F.get("removed", after)).alias("kept"),
        here("removed").alias("removed"),
        (F.get("removed", bit) - here("removed")).alias("redundant"),
        (F.get("removed", F.lit(every)) - F.get("removed", every - bit)).alias("unique_fails"),
        here("good").alias("good_lost"),
        here("toxic").alias("toxic_lost"),
        share.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over whole ``docs(doc_id, text, lang)`` with ``labels(doc_id, quality, toxic)``.

    Null texts are empty, null languages are the part of the empty name, unlabelled documents are neither good nor
    toxic; other columns are ignored.
    """
    return audit(failures(docs, labels))
