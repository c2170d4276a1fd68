"""One document of each class of near copies: SimHash candidates, verified by the overlap of their word shingles.

Two texts are linked if the Jaccard similarity of their whole shingle sets is ``PERCENT`` or more and their SimHash
fingerprints are near: those of their distinct words within ``DISTANCE`` bits and those of their distinct shingles
within ``SHINGLE_DISTANCE``.  A changed word changes ``SHINGLE`` shingles but one word, so similar texts are nearer
each other in the first, which is searched by pigeonhole; the second leaves out texts that only share their words.
No pair of less similarity is linked; few similar pairs have fingerprints further apart (README: measured share).

A cloud of texts near in words but below ``PERCENT`` would make all its pairs.  So the search also compares parity
sketches (odd sketches): a bit for each bucket of hashed shingles tells whether an odd number of them is there, and
the bits in which two sketches differ are no more than the shingles that only one of the sets has.  That is exact for
sets below ``WHOLE``; larger ones are sketched by a hashed share of their shingles, with ``SIGMA`` deviations to spare.

Sets of ``PERCENT`` similarity differ in size by no more than that, so a text is looked up among sets of its band of
sizes only.  The number of partitions is fixed: a text's probes do not grow with the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import dropped, saved
from meterline.llm.components import components
from meterline.llm.simhash import LOWER, SEED, Sized, hashes, linked, majority_bits, planned, share_of

SHINGLE = 5
#: Least Jaccard similarity of near copies, in percent.
PERCENT = 80
#: Bits in which the fingerprints of the words of near copies may differ.
DISTANCE = 7
#: Bits in which the fingerprints of their shingles may differ: 9.7 are expected at 80 percent, with a deviation of 2.9.
SHINGLE_DISTANCE = 20
#: Partitions of the words' fingerprints.  More would ask with fewer probes and compare more texts for each.
PARTITIONS = 5
#: Bits of a parity sketch, in words of 64; sets of so many shingles or more halve those that are sketched.
PARITY_WORDS, WHOLE = 8, 512
#: Deviations by which a sketched share of two sets may differ more than expected of similar ones.
SIGMA = 6


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles; none without words."""
    parts = list(hashes(text, shingle))
    return np.unique(np.concatenate(parts).astype(np.uint64)) if parts else np.zeros(0, np.uint64)


def word_set(text: str | None) -> np.ndarray:
    """Hashes of a whole text's distinct words."""
    import xxhash

    words = set((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split())
    return np.array([xxhash.xxh64_intdigest(w, SEED) for w in sorted(words)], np.uint64)


def sketch(text: str | None, shingle: int = SHINGLE, own: np.ndarray | None = None) -> tuple[int, int, int, int]:
    """Name (a hash) and size of a text's shingle set, fingerprints of its words and of its shingles."""
    import xxhash

    own = shingle_set(text, shingle) if own is None else own
    fp, wide = (majority_bits([s.astype(">u8")]) for s in (word_set(text), own))
    return xxhash.xxh64_intdigest(own.tobytes()), len(own), fp, wide


def level(size: int) -> int:
    """How often the shingles of a set are halved for its sketch."""
    return max(0, size.bit_length() - WHOLE.bit_length() + 1)


def parity(own: np.ndarray, halved: int) -> np.ndarray:
    """The parity sketch of those shingles of a set that ``halved`` bits of their hashes choose."""
    bits = 64 * PARITY_WORDS
    chosen = own[(own >> np.uint64(32)) & np.uint64((1 << halved) - 1) == 0]
    odd = np.bincount((chosen % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


#: Of a text: name and size of its set, fingerprints, and sketches at its own level and, as a partner may be one
#: level above, at the next.
SKETCH = "set long, size long, fp long, wide long, level long, odd array<long>, next array<long>"


def sketch_row(text: str | None, shingle: int = SHINGLE) -> tuple:
    """The values of ``SKETCH`` for a text."""
    own = shingle_set(text, shingle)
    marks, halved = np.array(sketch(text, shingle, own), np.uint64).view(np.int64), level(len(own))
    return *marks.tolist(), halved, *(parity(own, k).view(np.int64) for k in (halved, halved + 1))


def _sketches(shingle: int):
    @F.pandas_udf(SKETCH)
    def sketches(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SKETCH.split(", ")]
        for part in parts:
            yield pd.DataFrame([sketch_row(t, shingle) for t in part], columns=names)

    return sketches


def alike(a: Column, b: Column, percent: int) -> Column:
    """Whether sizes and parity sketches allow a similarity of ``percent``."""
    sized = 100 * F.least(a["size"], b["size"]) >= percent * F.greatest(a["size"], b["size"])
    halved = F.greatest(a["level"], b["level"])
    one, two = (F.when(x["level"] == halved, x["odd"]).otherwise(x["next"]) for x in (a, b))
    differ = F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    most = (a["size"] + b["size"]) * (100 - percent) / (100 + percent)
    share = most / F.pow(F.lit(2.0), halved)
    # half a shingle more than allowed is still less than one
    return sized & (differ <= F.when(halved == 0, most + 0.5).otherwise(share + SIGMA * F.sqrt(share) + SIGMA))


def sized(percent: int) -> Sized:
    """Bands in which a size grows by the most that a similarity of ``percent`` allows.

    A set is stored in its own band and the one below; logarithms are rounded, so at an edge in one more.
    """
    width = math.log(100 / min(percent, 99)) if percent else math.inf
    at = F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / F.lit(width)
    return Sized("size", F.floor(at), F.sequence(F.floor(at - 1 - 1e-6), F.floor(at)))


def _sets(shingle: int):
    @F.pandas_udf("array<long>")
    def sets(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([shingle_set(t, shingle).view(np.int64) for t in part])

    return sets


def _similar(percent: int):
    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)]
        every = a.map(len).to_numpy(np.int64) + b.map(len).to_numpy(np.int64) - np.array(both, np.int64)
        return pd.Series(100 * np.array(both, np.int64) >= percent * every)

    return similar


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of sets that are similar; whole sets are made of those in a pair alone."""
    # sets are folded on each side first, so a set of many pairs is moved once
    one, two = (pairs.select(F.col(k).alias("set")).distinct() for k in ("a", "b"))
    named = one.union(two).distinct()
    texts = named.join(nodes.select(F.col("node").alias("set"), F.col("tie").alias("_tie")), "set")
    known = docs.select(F.xxhash64("text").alias("_tie"), "text").join(texts, "_tie")
    # equal texts give equal sets, of which one is enough
    known = known.groupBy("set").agg(F.min("text").alias("text"))
    known = saved(known.select("set", _sets(shingle)("text").alias("own")), "candidate_sets")
    one, two = (known.select(F.col("set").alias(k), F.col("own").alias(f"own_{k}")) for k in ("a", "b"))
    made = pairs.join(one, "a").join(two, "b").filter(_similar(percent)("own_a", "own_b")).select("a", "b")
    made = saved(made, "similar_pairs")
    dropped(known)
    return made


def _classes(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, tie, set`` of every row, where tie is a hash of the text, and ``(node, root)`` of sets with a link."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), _sketches(shingle)("text").alias("x"))
    rows = saved(rows.select("doc_id", "tie", "x.*"), "sketches")
    sets = rows.groupBy("set").agg(*(F.min(c).alias(c) for c in ("tie", "size", "fp", "wide", "level", "odd", "next")))
    nodes = saved(sets.withColumnRenamed("set", "node"), "shingle_sets")

    def likely(a: Column, b: Column) -> Column:
        return (F.bit_count(a["wide"].bitwiseXOR(b["wide"])) <= SHINGLE_DISTANCE) & alike(a, b, percent)

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = saved(pairs, "candidates")
        made = _verified(docs, nodes, wanted, shingle, percent)
        dropped(wanted)
        return made

    bands = sized(percent)
    plan = planned(nodes.select("fp").distinct(), DISTANCE, parts=PARTITIONS, share=share_of(nodes, bands))
    return rows.select("doc_id", "tie", "set"), linked(nodes.drop("tie"), plan, verify, likely, bands)


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each class, with all its columns: the one of smallest id (null last; ties by a text hash).

    A class is what links of ``percent`` similarity or more reach.  Texts without words are one class; a text of
    fewer words than a shingle has one shingle, all its words.  Repeated rows stay once; texts are read whole; columns
    of any name pass through; an empty table gives no rows.
    """
    rows, roots = _classes(docs, shingle, percent)
    rows = rows.join(roots, F.col("set") == F.col("node"), "left")
    rows = rows.select("doc_id", "tie", F.coalesce("root", "set").alias("root"))
    folded = saved(rows.groupBy("root", "doc_id", "tie").agg(F.count(F.lit(1)).alias("n")), "class_rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("x")
    stays = F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("tie") == F.col("x.tie"))
    marked = folded.join(folded.groupBy("root").agg(least), "root").withColumn("stays", stays)
    # few rows go or are repeated: naming them spares moving all texts
    other = marked.filter("NOT stays OR n > 1").select(F.col("doc_id").alias("id"), "tie", "stays")
    other = saved(other, "class_changes")
    held = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_tie"))
    same: Column = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_tie") == F.col("tie"))
    repeated = held.join(other.filter("stays"), same, "left_semi").dropDuplicates(["own_id", "own_tie"])
    return held.join(other, same, "left_anti").unionByName(repeated).select("doc.*")
