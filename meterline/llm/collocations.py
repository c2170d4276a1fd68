"""Phrases whose words stand together more often than their parts would, by best-first growth with admissible bounds.

A phrase of ``k`` words that occurs ``a`` times scores ``min over cuts of floor(1000 a n / (l r))``, where ``l`` and
``r`` count the part before and after the cut and ``n`` all words of the language.  As ``a <= r``, no phrase that
begins with the word ``w`` can score above ``floor(1000 n / f(w))``: prefixes are opened in falling order of that bound,
and none below the score of the last place that surviving phrases already fill.  Growth is by whole levels of one Spark
job each; a prefix grows only from counted prefixes that are frequent themselves.

A phrase is dropped if a longer one of the same count holds it.  Then every occurrence has the same word before it, or
every one the same word after it, so the neighbours of its own occurrences decide, whether or not the longer phrase was
opened.

Texts are read once and written as chunks of word numbers with their dictionaries.  Words are 64-bit hashes in keys;
counts meet by whole keys.  What tasks must know of other tasks (frequent words, open prefixes) is a bitmap of bounded
size: a false hit there costs a row, never a result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from meterline.llm.common import dropped, saved

#: Least occurrences of a phrase, most words of one, and phrases reported of each language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Bounds down to which first words are opened, one batch after another.
BATCHES = (50_000, 0)
#: Tokens of a chunk, words of a task's dictionary, pairs that a task holds, and the sizes of bitmaps (log2 of bits: 16 MB at most).
CHUNK, VOCABULARY, PAIRS = 1 << 18, 60_000, 1 << 19
#: Rows that Spark hands to a task at once: documents, and chunks of a megabyte.
AT_ONCE = 16
LEAST_BITS, MOST_BITS = 16, 27
#: A-Z lower-cased, tabs as blanks, piece ends as a byte that no UTF-8 text has.
_END = b"\xff"
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _END * 10)


def pieces(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text in order, with ``_END`` between pieces."""
    return text.translate(_BYTES).replace(_END, b" \xff ").split()


def word_hash(word: bytes) -> int:
    """Signed 64-bit hash of a word; 0 stands for the end of a piece."""
    h = xxhash.xxh3_64_intdigest(word) or 1
    return h - (1 << 64) if h >> 63 else h


def _packed(ids: np.ndarray) -> bytes:
    """Word numbers byte by byte: the leading ones, mostly 0, compress well."""
    return np.ascontiguousarray(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data.as_buffer(), np.uint8).reshape(4, -1).T).view("<i4").ravel()


@F.pandas_udf(T.BinaryType())
def word_key(words: pd.Series) -> pd.Series:
    """Hash of a word as the 8 bytes that stand for it in keys."""
    return words.map(lambda w: np.int64(word_hash(bytes(w))).tobytes())


class _Numbering:
    """Numbers of the words of one language within a task, and the chunk that is being filled."""

    def __init__(self) -> None:
        self.renew()
        self.parts, self.size = [], 0

    def renew(self) -> None:
        self.number = defaultdict(count(1).__next__, {_END: 0})
        self.counts, self.known = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def add(self, text: bytes) -> None:
        words = pieces(text)
        if words:
            words.append(_END)
            self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
            self.size += len(words)

    def chunk(self, lang: str) -> dict:
        """The filled chunk as a row; its words are counted."""
        ids = np.concatenate(self.parts)
        self.parts, self.size = [], 0
        used, own = np.unique(np.append(ids, 0), return_inverse=True)
        n = np.bincount(ids, minlength=len(self.number) + 1)
        n[: len(self.counts)] += self.counts
        self.counts = n
        hashes = self.hashes()[used]
        return {"lang": lang, "ids": _packed(own[:-1]), "hashes": hashes.tobytes()}

    def hashes(self) -> np.ndarray:
        """Hash of each word number so far; only new ones are computed."""
        if len(self.known) < len(self.number):
            words = list(self.number)[len(self.known) :]
            self.known = np.concatenate([self.known, np.fromiter(map(word_hash, words), np.int64, len(words))])
        return self.known

    def words(self, lang: str, at_once: int = 1 << 16) -> Iterator[dict[str, list]]:
        """Counted words as columns, a part at a time."""
        names = iter(self.number)
        next(names)
        for lo in range(1, len(self.number), at_once):
            own = list(islice(names, at_once))
            hi = lo + len(own)
            yield {"lang": [lang] * len(own), "word": own, "n": self.counts[lo:hi]}


_STREAM = pa.schema([("lang", pa.string()), ("ids", pa.binary()), ("hashes", pa.binary()), ("word", pa.binary()), ("n", pa.int64())])


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside hand few rows at once to Python, so that neither side holds a whole partition."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def streams(docs: DataFrame) -> DataFrame:
    """Chunks ``lang, ids, hashes`` of word numbers with their dictionaries, and counts ``lang, word, n`` of words.

    Both kinds of rows come from one reading of whole texts (null: empty, null language: ``und``).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Numbering] = defaultdict(_Numbering)
        row = lambda x: pa.RecordBatch.from_pydict({f.name: pa.array(x[f.name], f.type) if f.name in x else pa.nulls(len(x["lang"]), f.type) for f in _STREAM}, schema=_STREAM)
        one = lambda x: row({k: [v] for k, v in x.items()})
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = open_[lang]
                own.add(text.as_buffer().to_pybytes())
                if own.size >= CHUNK:
                    yield one(own.chunk(lang))
                    if len(own.number) > VOCABULARY:
                        yield from map(row, own.words(lang))
                        own.renew()
        for lang, own in open_.items():
            if own.size:
                yield one(own.chunk(lang))
            if len(own.number) > 1:
                yield from map(row, own.words(lang))

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(read, "lang string, ids binary, hashes binary, word binary, n long")


_ODD, _SALT = np.uint64(0x9E3779B97F4A7C15), 0x2545F491


def gram_hash(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of phrases of one language, given as one array of word hashes for each place."""
    h = np.full(len(words[0]), xxhash.xxh64_intdigest(lang.encode(), _SALT), np.uint64)
    for w in words:
        h = (h ^ w.view(np.uint64)) * _ODD
        h ^= h >> np.uint64(31)
    return h


@dataclass
class Bits:
    """Bitmap of hashed phrases: no false misses."""

    log2: int
    data: np.ndarray  # uint64

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h >> np.uint64(64 - self.log2)
        return (self.data[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def hashed(rows: DataFrame) -> DataFrame:
    """``h``: hash of each phrase of ``rows(lang, key)``."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, own in _by_lang(b.column(0)):
                keys = b.column(1).take(pa.array(own)).to_pylist()
                for size in {len(k) for k in keys}:
                    words = np.frombuffer(b"".join(k for k in keys if len(k) == size), np.int64).reshape(-1, size // 8)
                    h = gram_hash(lang, [np.ascontiguousarray(words[:, j]) for j in range(size // 8)])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return rows.select("lang", "key").mapInArrow(hashes, "h long")


def bits_of(rows: DataFrame, n: int | None = None) -> Bits:
    """Bitmap of the hashes ``rows(h)``: about 32 bits for each of ``n``, up to the size that is the bound."""
    log2 = min(MOST_BITS, max(LEAST_BITS, int(rows.count() if n is None else n).bit_length() + 5))
    slot = F.call_function("shiftrightunsigned", F.col("h"), F.lit(64 - log2))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    # at most 2^(log2 - 6) rows of 16 bytes, whatever the input
    got = rows.groupBy(F.floor(slot / 64).alias("at")).agg(F.bit_or(mask).alias("bits")).toPandas()
    data = np.zeros(1 << (log2 - 6), np.uint64)
    data[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return Bits(log2, data)


def _by_lang(column: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    names = np.array(column.to_pylist(), object)
    for lang in dict.fromkeys(names):
        yield lang, np.flatnonzero(names == lang)


@dataclass
class Search:
    """What one pass over the chunks counts: phrases of ``sizes`` words whose parts are in the bitmaps given.

    ``words``: every word; ``firsts``: the first word; ``prefix``: all words but the last; ``suffix``: all but the first,
    unless the second word is in ``unopened``; ``whole``: the phrase itself.
    """

    sizes: tuple[int, ...]
    words: Bits
    firsts: Bits | None = None
    prefix: Bits | None = None
    suffix: Bits | None = None
    unopened: Bits | None = None
    whole: Bits | None = None
    neighbours: bool = False


def _places(lang: str, ids: np.ndarray, hashes: np.ndarray, size: int, s: Search):
    """Places in a chunk where a phrase of the search begins, and the hashes of words ``lo`` to ``hi`` from a place on."""
    single = gram_hash(lang, [hashes])
    known = s.words.has(single)
    known[hashes == 0] = False
    good = known[ids]
    at = np.flatnonzero(reduce(np.logical_and, (good[j : len(good) - size + 1 + j] for j in range(size))) if len(ids) >= size else [])
    if s.firsts is not None:
        at = at[s.firsts.has(single)[ids[at]]]
    part = lambda a, lo, hi: gram_hash(lang, [hashes[ids[a + j]] for j in range(lo, hi)])
    if s.prefix is not None:
        at = at[s.prefix.has(part(at, 0, size - 1))]
    if s.suffix is not None:
        fits = s.suffix.has(part(at, 1, size))
        at = at[fits | s.unopened.has(single)[ids[at + 1]]] if s.unopened is not None else at[fits]
    if s.whole is not None:
        at = at[s.whole.has(part(at, 0, size))]
    return at, part


def _counted(lang: str, ids: np.ndarray, hashes: np.ndarray, size: int, s: Search) -> list:
    """Columns ``key, a`` (and least and greatest neighbour on each side) of one chunk."""
    at, _ = _places(lang, ids, hashes, size, s)
    if not len(at):
        return [np.zeros((0, size), np.int64), *(np.zeros(0, np.int64) for _ in range(5 if s.neighbours else 1))]
    group = ids[at].astype(np.int64)
    for j in range(1, size):  # exact: numbers of the words so far, and of the next one
        group = np.unique(group << 32 | ids[at + j], return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    own = at[order[starts]]
    columns = [np.stack([hashes[ids[own + j]] for j in range(size)], 1), np.diff(np.append(starts, len(order)))]
    if s.neighbours:
        ends = np.concatenate([[0], hashes[ids], [0]])
        for near in (ends[at], ends[at + size + 1]):
            columns += [np.minimum.reduceat(near[order], starts), np.maximum.reduceat(near[order], starts)]
    return columns


def _summed(slots: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different slots in order, and their summed counts."""
    order = np.argsort(slots, kind="stable")
    starts = np.flatnonzero(np.diff(slots[order], prepend=slots[order[:1]] - 1))
    return slots[order[starts]], np.add.reduceat(n[order], starts)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers of 8 bytes, byte by byte, so that leading zeros stand together and cost nothing once compressed."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def hot_pairs(chunks: DataFrame, search: Search, tokens: int) -> DataFrame:
    """``h``: hashes, cut to a prefix, under which the pairs of a search together reach the least count.

    No frequent pair is missing.  Pairs are counted by that prefix alone (8 bits more than there are tokens), as sorted
    differences of 2 or 3 bytes each, not as rows; each range of prefixes has about a million pairs, whatever the input.
    """
    bits = min(62, max(LEAST_BITS, tokens.bit_length() + 8))  # no fewer than the bitmap made of them has
    ranges = max(6, tokens.bit_length() - 20)
    context = chunks.sparkSession.sparkContext.broadcast(search)

    def count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, parts, waiting = context.value, [], 0
        for batch in batches:
            for lang, ids, hashes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                ids, hashes = _unpacked(ids), np.frombuffer(hashes.as_buffer(), np.int64)
                at, part = _places(lang, ids, hashes, 2, s)
                if len(at):
                    parts.append(np.unique((part(at, 0, 2) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True))
                    waiting += len(parts[-1][0])
                if waiting > PAIRS:
                    yield from folded(parts)
                    parts, waiting = [], 0
        if parts:
            yield from folded(parts)

    def folded(parts: list) -> Iterator[pa.RecordBatch]:
        slots, n = _summed(*map(np.concatenate, zip(*parts, strict=True)))
        cuts = np.flatnonzero(np.diff(slots >> (bits - ranges), prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(slots)], strict=True):
            first = slots[lo] >> (bits - ranges)
            yield pa.RecordBatch.from_pydict({"range": [int(first)], "slots": [_planes(np.diff(slots[lo:hi], prepend=first << (bits - ranges)))], "n": [_planes(n[lo:hi])]})

    def add(key: tuple, t: pa.Table) -> pa.Table:
        first = key[0].as_py() << (bits - ranges)
        slots, n = _summed(np.concatenate([first + np.cumsum(_numbers(x)) for x in t["slots"].to_pylist()]), np.concatenate([_numbers(x) for x in t["n"].to_pylist()]))
        return pa.table({"h": pa.array((slots[n >= LEAST].astype(np.uint64) << np.uint64(64 - bits)).view(np.int64))})

    return chunks.mapInArrow(count_all, "range long, slots binary, n binary").groupBy("range").applyInArrow(add, "h long")


def counted(chunks: DataFrame, search: Search) -> DataFrame:
    """``lang, key, a`` (and ``l_min, l_max, r_min, r_max``) of the phrases of a search with the least count."""
    names = ["a", "l_min", "l_max", "r_min", "r_max"] if search.neighbours else ["a"]
    context = chunks.sparkSession.sparkContext.broadcast(search)

    def count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = context.value
        for batch in batches:
            for lang, ids, hashes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                ids, hashes = _unpacked(ids), np.frombuffer(hashes.as_buffer(), np.int64)
                for size in s.sizes:
                    keys, *columns = _counted(lang, ids, hashes, size, s)
                    if len(keys):
                        data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * size), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())])
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(keys)), data.cast(pa.binary()), *map(pa.array, columns)], ["lang", "key", *names])

    found = chunks.mapInArrow(count_all, "lang string, key binary, " + ", ".join(f"{c} long" for c in names))
    sides = [(F.min if c.endswith("min") else F.max)(c).alias(c) for c in names[1:]]
    return found.groupBy("lang", "key").agg(F.sum("a").alias("a"), *sides).filter(F.col("a") >= LEAST)


def _dropped() -> Column:
    """Whether all occurrences have one and the same word before them, or after them."""
    return ((F.col("l_min") == F.col("l_max")) & (F.col("l_min") != 0)) | ((F.col("r_min") == F.col("r_max")) & (F.col("r_min") != 0))


def scored(phrases: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``phrases(lang, key, a)`` with ``l, r, score`` of the lowest-scoring cut; ``counts(lang, key, f)``, ``totals(lang, n)``."""
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(8), F.octet_length("key") - 8, F.lit(8))).alias("cut"))
    cuts = cuts.withColumns({"_left": F.expr("substring(key, 1, cut)"), "_right": F.expr("substring(key, cut + 1, length(key))")})
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("key").alias(side), F.col("f").alias(name)), ["lang", side])
    # whole numbers of up to 38 digits: 1000 a n and l r pass 64 bits
    value = F.call_function("div", (whole("a") * whole("n") * 1000).cast("decimal(38,0)"), (whole("l") * whole("r")).cast("decimal(38,0)"))
    cuts = cuts.join(totals, "lang").withColumn("score", value)
    best = F.min(F.struct("score", "cut", "l", "r")).alias("b")
    rest = [c for c in phrases.columns if c not in ("lang", "key")]
    return cuts.groupBy("lang", "key").agg(best, F.first("n").alias("n"), *(F.first(c).alias(c) for c in rest)).select("lang", "key", *rest, "n", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language of ``docs(text, lang)``.

    Null texts are empty, null languages ``und``; repeated rows count each; texts are read whole; other columns are
    ignored.  A language without phrase of the least count has no rows, nor has an empty table.
    """
    spark = docs.sparkSession
    with _small_batches(spark):
        stream = saved(streams(docs), "phrase_streams")
    chunks, words = stream.filter("ids IS NOT NULL").select("lang", "ids", "hashes"), stream.filter("word IS NOT NULL")
    every = saved(words.groupBy("lang", "word").agg(F.sum("n").alias("f")), "phrase_words")
    totals = saved(every.groupBy("lang").agg(F.sum("f").alias("n")), "phrase_totals")
    bound = F.expr("1000 * cast(n AS decimal(38,0)) div f")
    known = saved(every.filter(F.col("f") >= LEAST).join(totals, "lang").select("lang", word_key("word").alias("key"), "word", "f", bound.alias("bound")), "phrase_vocabulary")
    frequent, counts = bits_of(hashed(known)), known.select("lang", "key", "f")
    made = [stream, every, totals, known]

    def keep(df: DataFrame, name: str) -> DataFrame:
        with _small_batches(spark):
            made.append(saved(df, name))
        return made[-1]

    tokens = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # pairs: first words in falling order of their bound, until the last place is settled
    pairs, floor_, above = None, totals.select("lang", F.lit(0).cast("long").alias("least")), None
    for cut in BATCHES:
        firsts = known.filter(F.col("bound") >= cut) if above is None else known.filter((F.col("bound") >= cut) & (F.col("bound") < above))
        firsts = keep(firsts.join(floor_, "lang").filter("bound >= least").select("lang", "key"), "phrase_firsts")
        above = cut
        if firsts.isEmpty():
            continue
        hot = keep(hot_pairs(chunks, Search((2,), frequent, firsts=bits_of(hashed(firsts))), tokens), "phrase_hot_pairs")
        near = keep(scored(counted(chunks, Search((2,), frequent, whole=bits_of(hot), neighbours=True)), counts, totals), "phrase_scored_pairs")
        pairs = near if pairs is None else pairs.unionByName(near)
        pairs = keep(pairs.dropDuplicates(["lang", "key"]), "phrase_all_pairs")
        last = pairs.filter(~_dropped()).withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.col("score").desc())))
        floor_ = keep(totals.select("lang").join(last.filter(F.col("place") == top).select("lang", F.col("score").alias("least")), "lang", "left").select("lang", F.coalesce("least", F.lit(0)).alias("least")), "phrase_floor")
    if pairs is None or pairs.isEmpty():
        dropped(*made)
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")

    # longer ones: from prefixes whose bound reaches the floor
    bounds = known.select("lang", F.col("key").alias("first"), "bound").join(floor_, "lang")
    unopened = keep(bounds.filter("bound < least").select("lang", F.col("first").alias("key")), "phrase_unopened")
    closed = None if unopened.isEmpty() else bits_of(hashed(unopened))
    levels, parent = [], pairs.select("lang", "key", "a")
    shorter = bits_of(hashed(parent))
    for size in range(3, LONGEST + 1):
        open_ = parent.withColumn("first", F.expr("substring(key, 1, 8)")).join(bounds.filter("bound >= least"), ["lang", "first"]).select("lang", "key")
        grown = keep(counted(chunks, Search((size,), frequent, prefix=bits_of(hashed(open_)), suffix=shorter, unopened=closed, neighbours=True)), "phrase_level")
        if grown.isEmpty():
            break
        levels.append(grown)
        parent = grown.select("lang", "key", "a")
        # suffixes of the next level that begin with an opened word were counted at this one
        shorter = bits_of(hashed(parent))
    counts = reduce(DataFrame.unionByName, (x.select("lang", "key", F.col("a").alias("f")) for x in (pairs, *levels)), counts)
    whole = pairs
    if levels:
        longer = reduce(DataFrame.unionByName, levels)
        after = longer.select("lang", "key", F.explode(F.sequence(F.lit(9), F.octet_length("key") - 15, F.lit(8))).alias("at"))
        needed = after.select("lang", F.expr("substring(key, at, length(key))").alias("key")).distinct()
        missing = keep(needed.join(counts.select("lang", "key"), ["lang", "key"], "left_anti"), "phrase_suffixes")
        if not missing.isEmpty():
            more = counted(chunks, Search(tuple(range(2, LONGEST)), frequent, whole=bits_of(hashed(missing))))
            counts = counts.unionByName(keep(more.join(missing, ["lang", "key"], "left_semi").select("lang", "key", F.col("a").alias("f")), "phrase_more"))
        whole = pairs.unionByName(scored(longer, counts, totals))
    by = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    best = keep(whole.filter((F.octet_length("key") == 8 * LONGEST) | ~_dropped()).withColumn("_place", F.rank().over(by)).filter(F.col("_place") <= top).drop("_place"), "phrase_best")
    texts = best.select("lang", "key", F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("key") - 7, F.lit(8)), lambda i: F.call_function("substring", F.col("key"), i, F.lit(8)))).alias("pos", "_word"))
    texts = texts.join(known.select("lang", F.col("key").alias("_word"), "word"), ["lang", "_word"]).groupBy("lang", "key").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("word").cast("string").alias("word")))).alias("w"))
    texts = texts.select("lang", "key", F.array_join(F.col("w.word"), " ").alias("phrase"))
    place = F.row_number().over(by.orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    ranked = best.join(texts, ["lang", "key"]).withColumn("rank", place).filter(F.col("rank") <= top)
    found = saved(ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"), "phrases")
    dropped(*made)
    return found
