"""Removal of repeated byte strings by ranks of anchored positions at growing lengths.

Naming every byte position at every offset would move far more rows than there is text.  Two strings of
``length`` bytes are equal only if they have their anchor at the same place (the smallest hashed ``GRAM``-byte
gram inside, leftmost of equals), so positions are ranked in nodes: runs of window starts with one anchor.

Each round names a node by pairs of ranks, the rank of what all its windows share (its core) and the rank of all
its bytes (its span), lets Spark bring equal pairs together, and reranks at a longer shared length:

This stands in for prefix doubling over all positions, whose sorted rank pairs would be many times the text.

1. nodes are whole runs of an anchor, the core is the anchor's gram,
2. nodes are groups of ``STEP`` neighbouring windows, the core has ``length - STEP + 1`` bytes,
3. nodes are single windows of ``length`` bytes, the threshold.

A core found once is unique and drops out.  A span found before is repeated as a whole.  If all nodes of a core
have one span, nothing is left to tell apart; else the first node of each span goes to the next round.  The first
occurrence of any window is always the first of its span, so no link is lost by dropping the others.

Ranks are 64-bit hashes, cores and spans by two polynomials of different bases.  Spans are only compared within one
core, so a false removal takes two different spans of one core with equal span hashes; in the last round, where core
and span are the same bytes, both hashes would have to agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.llm.common import dropped, saved

LENGTH = 100
GRAM = 32
STEP = 8
#: Window starts handled at a time in one document.
CHUNK = 1 << 20
#: Bases of the polynomials of cores and of spans.
_POWERS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_U = np.uint64
#: ``place`` holds a node's first window start, and in its two low bytes how far the last one and the anchor are.
_NODES = "id long, tie long, place long, core long, span long"


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (one to one)."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class Ranker:
    """Hashed ranks of byte strings, of two kinds: polynomial prefix sums modulo 2**64, mixed."""

    def __init__(self, seed: int = 1):
        self.values = np.random.default_rng(seed).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
        self.up = self.down = [np.ones(1, np.uint64)] * 2

    def load(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(self.up[0]) < n:
            ones = np.ones(1, np.uint64)
            step = lambda x: np.multiply.accumulate(np.append(ones, np.full(1 << n.bit_length(), x, np.uint64)))
            self.up = [step(_U(x)) for x in _POWERS]
            self.down = [step(_U(pow(x, -1, 1 << 64))) for x in _POWERS]
        self.sums = []
        for values, up in zip(self.values, self.up, strict=True):
            sums = np.zeros(n, np.uint64)
            np.cumsum(values[data] * up[: n - 1], dtype=np.uint64, out=sums[1:])
            self.sums.append(sums)

    def rank(self, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
        sums = self.sums[kind]
        return _mixed((sums[end] - sums[start]) * self.down[kind][start])


def anchored(ranker: Ranker, n: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start, and gram rank of each node of the ``n`` loaded bytes."""
    at = np.arange(n - gram + 1)
    grams, width = ranker.rank(at, at + gram), length - gram + 1
    low = _U((1 << 24) - 1)
    least, size = (grams & ~low) | at.astype(np.uint64), 1
    count = len(least) - width + 1
    while size * 2 <= width:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < width:
        least = np.minimum(least[:count], least[width - size : width - size + count])
    where = (least & low).astype(np.int64)
    lo = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    hi = np.concatenate((lo[1:], [count])) - 1
    anchor = where[lo]
    return anchor, lo, hi, grams[anchor]


def _span(ranker: Ranker, anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Rank of a node's bytes together with where its windows lie about the anchor."""
    place = ((anchor - lo) * (2 * length) + (anchor - hi)).astype(np.uint64)
    return _mixed(ranker.rank(lo, hi + length, 1) ^ _mixed(place + _U(1)))


def _first_nodes(data: np.ndarray, ranker: Ranker, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    for at in range(0, len(data) - length + 1, CHUNK):
        part = data[at : at + CHUNK + length - 1]
        ranker.load(part)
        anchor, lo, hi, core = anchored(ranker, len(part), length, gram)
        yield anchor + at, lo + at, hi + at, core, _span(ranker, anchor, lo, hi, length)


def _split_nodes(data: np.ndarray, nodes: np.ndarray, ranker: Ranker, length: int, step: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Nodes ``(anchor, lo, hi)`` cut into groups of ``step`` windows, in line with the anchor."""
    nodes = nodes[np.argsort(nodes[:, 1], kind="stable")]
    for at in range(0, int(nodes[:, 1].max()) + 1, CHUNK):
        own = nodes[(nodes[:, 1] >= at) & (nodes[:, 1] < at + CHUNK)]
        if not len(own):
            continue
        # a node that starts in this chunk ends at most ``length`` windows later
        ranker.load(data[at : at + CHUNK + 2 * length])
        anchor, lo, hi = own.T - at
        first, last = (anchor - hi) // step, (anchor - lo) // step
        n = last - first + 1
        row = np.repeat(np.arange(len(own)), n)
        group = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        a = anchor[row]
        high = np.minimum(hi[row], a - group * step)
        low = np.maximum(lo[row], a - group * step - step + 1)
        begin = a - group * step
        core = _mixed(ranker.rank(begin, begin - step + 1 + length) ^ _mixed(group.astype(np.uint64) + _U(1)))
        yield a + at, low + at, high + at, core, _span(ranker, a, low, high, length)


def _table(parts: list[tuple]) -> pa.RecordBatch:
    sizes = [len(p[2][0]) for p in parts]
    columns = [np.repeat(np.array([p[k] for p in parts], np.int64), sizes) for k in (0, 1)]
    anchor, lo, hi, core, span = (np.concatenate([p[2][k] for p in parts]) for k in range(5))
    columns += [lo << 16 | (hi - lo) << 8 | (anchor - lo), core.view(np.int64), span.view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "tie", "place", "core", "span"])


def _flush(made: Iterator[tuple], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for x in made:
        held.append(x)
        n += len(x[2][0])
        if n >= rows:
            yield _table(held)
            held, n = [], 0
    if held:
        yield _table(held)


def _bytes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8)


def anchor_nodes(texts: DataFrame, length: int, gram: int, only_cores: bool = False) -> DataFrame:
    """Nodes of the first round of ``texts(id, tie, text)``."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker()

        def made():
            for b in batches:
                for key, tie, text in zip(b["id"], b["tie"], b["text"], strict=True):
                    data = _bytes(text)
                    if len(data) >= length:
                        for x in _first_nodes(data, ranker, length, gram):
                            yield key.as_py(), tie.as_py(), x

        for out in _flush(made()):
            yield out.select(["core"]) if only_cores else out

    return texts.mapInArrow(nodes, "core long" if only_cores else _NODES)


def split_nodes(texts: DataFrame, contested: DataFrame, length: int, step: int) -> DataFrame:
    """Nodes of a later round: the contested ones, cut into groups of ``step`` windows."""
    by_text = contested.groupBy("id", "tie").agg(F.collect_list(F.array("anchor", "lo", "hi")).alias("nodes"))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker()

        def made():
            for b in batches:
                for key, tie, text, found in zip(b["id"], b["tie"], b["text"], b["nodes"], strict=True):
                    own = found.values.flatten().to_numpy().reshape(-1, 3)
                    for x in _split_nodes(_bytes(text), own, ranker, length, step):
                        yield key.as_py(), tie.as_py(), x

        yield from _flush(made())

    return texts.join(by_text, ["id", "tie"]).select("id", "tie", "text", "nodes").mapInArrow(nodes, _NODES)


def ranked(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(covered, contested)``: nodes whose windows all occur earlier, and first nodes to be told apart further."""
    classes = nodes.groupBy("core", "span").agg(F.min(F.struct("id", "tie", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
    cores = classes.groupBy("core").agg(F.count(F.lit(1)).alias("spans"), F.sum("n").alias("total")).filter("total > 1")
    classes = classes.join(cores, "core").filter("n > 1 OR spans > 1").select("core", "span", "first", "spans")
    # classes are distinct keys, so hashing them spares sorting the many nodes
    seen = saved(nodes.join(classes.hint("shuffle_hash"), ["core", "span"]).select("id", "tie", "place", (F.struct("id", "tie", "place") == F.col("first")).alias("is_first"), "spans"), "ranked_nodes")
    lo = F.shiftright("place", 16)
    back = lambda bits: lo + F.shiftright("place", bits).bitwiseAND(F.lit(255).cast("long"))
    first = seen.filter("is_first AND spans > 1").distinct()
    return seen.filter("NOT is_first").select("id", "tie", lo.alias("lo"), back(8).alias("hi")), first.select("id", "tie", back(0).alias("anchor"), lo.alias("lo"), back(8).alias("hi"))


def repeated_ranges(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """``id, tie, lo, hi``: runs of starts of ``length``-byte strings that also start earlier.

    ``texts(id, tie, text)`` has binary texts, equal ones where keys are equal; earlier is smaller ``(id, tie)``, or an earlier
    start in the same text.
    """
    if length - gram > 255:
        raise ValueError("at most 255 bytes may be longer than a gram")
    counts = anchor_nodes(texts, length, gram, True).groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    repeated = saved(counts.filter("n > 1").select("core"), "repeated_cores")
    nodes = saved(anchor_nodes(texts, length, gram).join(repeated.hint("shuffle_hash"), "core"), "anchor_nodes")
    dropped(repeated)
    covered, contested = ranked(nodes)
    found = [covered]
    for size in (step, 1):
        dropped(nodes)
        nodes = saved(split_nodes(texts, contested, length, size), "split_nodes")
        covered, contested = ranked(nodes)
        found.append(covered)
    dropped(nodes)
    return found[0].unionByName(found[1]).unionByName(found[2])


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row for each input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (and ``kept_text``).

    A byte goes if a ``length``-byte string over it also starts earlier: in a row of smaller ``doc_id`` (null ids
    come first; different texts of one id in order of a hash), or earlier in the same text.  Strings never cross
    rows and are judged on the input.  ``spans`` lists the removed runs as ``[start, end)``.  Rows of equal id and
    text are one document and get equal results.  Null texts are empty; texts shorter than ``length`` lose nothing;
    extra columns are ignored; an empty table gives no rows.  Ids must be whole numbers.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be a whole number, as its order decides what is earlier")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    ranges = repeated_ranges(rows.select("id", "tie", "text"), length, gram)
    by_text = saved(ranges.groupBy("id", "tie").agg(F.collect_list(F.array("lo", "hi")).alias("ranges")), "removed_ranges")
    marked = rows.join(by_text, ["id", "tie"], "left").select("doc_id", "text", "ranges")
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.list_(pa.int64()))} | ({"kept_text": pa.binary()} if with_text else {})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for data, found in zip(b["text"], b["ranges"], strict=True):
                data = data.as_buffer()
                spans = merged(found.values.flatten().to_numpy().reshape(-1, 2), length) if found.is_valid else np.zeros((0, 2), np.int64)
                edges = [0, *spans.reshape(-1).tolist(), len(data)]
                kept = b"".join(bytes(data[x:y]) for x, y in zip(edges[::2], edges[1::2], strict=True))
                made.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans.tolist(), kept))
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *columns], names=["doc_id", *kinds])

    extra = ", kept_text binary" if with_text else ""
    return marked.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>{extra}")


def merged(ranges: np.ndarray, length: int) -> np.ndarray:
    """Byte runs ``[start, end)`` covered by the strings of all ranges of starts."""
    if not len(ranges):
        return ranges
    lo, hi = ranges[np.argsort(ranges[:, 0], kind="stable")].T
    end = np.maximum.accumulate(hi + length)
    new = np.concatenate(([True], lo[1:] > end[:-1]))
    return np.stack((lo[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(lo) - 1]))]), axis=1)
