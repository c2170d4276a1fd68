"""Text joins by inverted indexes of character n-grams: substrings and close spellings without comparing all pairs.

Both sides are folded to different texts first, so a title that many sessions share is compared once.  A part meets only
those that have its rarest n-gram, a spelling those that have one of its segments at a place that its edits allow, and
every pair that meets is tested exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions import formatting as X

#: Longest n-gram of the indexes.
LONGEST = 3


def _grams(text: Column, size: int | Column) -> Column:
    """Different n-grams of a text; none if it is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - size + 1
    places = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))


def _postings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``gram, text`` for the grams of ``wanted(gram)``: all others are dropped where they are made."""
    every = F.concat(*(_grams(F.col("text"), q) for q in range(1, LONGEST + 1)))
    return texts.select("text", F.explode(every).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")


def _different(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(F.col(column).alias("text")).distinct()


def containing(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """``part, text`` for different ``parts(part)`` and ``texts(text)`` where the text holds the part.

    A part meets the texts that have its rarest n-gram (three characters, or all of a shorter part).  Empty and null
    parts meet nothing here.
    """
    own = _different(parts, "part").filter("text <> ''").withColumnRenamed("text", "part")
    size = F.least(F.length("part"), F.lit(LONGEST))
    grams = own.select("part", F.explode(_grams(F.col("part"), size)).alias("gram"))
    every = _different(texts, "text")
    many = _postings(every, grams).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram of no text sorts first, and then nothing is met
    rarest = grams.join(many, "gram", "left").groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return _postings(every, rarest).join(rarest, "gram").filter(F.contains("text", F.col("part"))).select("part", "text")


def _limit(a: Column, b: Column) -> Column:
    """Edits that still count as close: a fifth of the longer one's bytes, one at least."""
    return F.greatest(F.floor(F.greatest(F.octet_length(a), F.octet_length(b)) / 5), F.lit(1))


def _likely(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """``longer, shorter`` that may be close spellings, where the first has as many bytes or more; pairs may repeat.

    The longer one is cut into one segment more than its ``k`` edits, so the other text has one of them whole.  Of the
    first such segment, ``i`` edits or more are before it, as many at least as it is shifted, and behind it as many at
    least as the ends are shifted; together no more than ``k``.  Only pairs whose places allow that are compared, so the
    digits of two numbers that many texts have in other places cost no edit distance.
    """
    text, k = F.col("text"), F.greatest(F.floor(F.octet_length("text") / 5), F.lit(1)).cast("int")
    # edits are fewer than characters, but for a single one, which the other text then has
    count = F.least(k + 1, F.length(text))
    bound = lambda i: F.floor(i * F.length(text) / count).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("i"), bound(i).alias("at"), F.substring(text, bound(i) + 1, bound(i + 1) - bound(i)).alias("segment")))
    cut = longer.filter("text <> ''").select(text.alias("longer"), F.length(text).alias("size"), k.alias("k"), F.explode(cut).alias("x")).select("longer", "size", "k", "x.*")
    # segments have five characters at most, as there is an edit for every five bytes
    places = lambda q: F.when(F.length(text) >= q, F.sequence(F.lit(1), F.greatest(F.length(text) - (q - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    of = lambda q: F.transform(places(q), lambda i: F.struct((i - 1).alias("place"), F.substring(text, i, F.lit(q)).alias("segment")))
    every = F.concat(*map(of, range(1, 6)))
    held = shorter.select(text.alias("shorter"), F.length(text).alias("other_size"), F.explode(every).alias("x")).select("shorter", "other_size", "x.*")
    held = held.join(cut.select("segment").distinct(), "segment", "left_semi")
    shift = F.col("place") - F.col("at")
    able = F.greatest(F.abs(shift), F.col("i")) + F.abs(shift + F.col("size") - F.col("other_size")) <= F.col("k")
    fits = F.octet_length("shorter") <= F.octet_length("longer")
    return cut.join(held, "segment").filter(able & fits).select("longer", "shorter")


def _close_to_longer(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """``longer, shorter`` of close spellings where the first has as many bytes or more."""
    return _likely(longer, shorter).filter(F.levenshtein("longer", "shorter") <= _limit(F.col("longer"), F.col("shorter"))).distinct()


def close(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """``ref_key, key`` of different search keys ``references(ref_key)``, ``candidates(key)`` that match with confidence.

    The candidate holds the reference, or their edit distance is within a fifth of the longer one's bytes (one at
    least).  Empty references match nothing.
    """
    refs, keys = _different(references, "ref_key").filter("text <> ''"), _different(candidates, "key")
    held = containing(refs.withColumnRenamed("text", "part"), keys).select(F.col("part").alias("ref_key"), F.col("text").alias("key"))
    by_ref = _close_to_longer(refs, keys).select(F.col("longer").alias("ref_key"), F.col("shorter").alias("key"))
    by_key = _close_to_longer(keys, refs).select(F.col("shorter").alias("ref_key"), F.col("longer").alias("key"))
    # one character or none: one edit apart, whatever they are
    tiny = lambda df, name: df.filter(F.length("text") <= 1).select(F.col("text").alias(name), (F.length("text") <= 1).alias("_tiny"))
    single = tiny(refs, "ref_key").join(tiny(keys, "key"), "_tiny").select("ref_key", "key")
    return held.unionByName(by_ref).unionByName(by_key).unionByName(single).distinct()


def fuzzy_pairs(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """``reference, candidate`` of different texts that match with confidence once normalised (``search_key``)."""
    r = references.filter("reference IS NOT NULL").select("reference", X.search_key(F.col("reference")).alias("ref_key")).distinct()
    c = candidates.filter("candidate IS NOT NULL").select("candidate", X.search_key(F.col("candidate")).alias("key")).distinct()
    return r.join(close(r, c), "ref_key").join(c, "key").select("reference", "candidate")
