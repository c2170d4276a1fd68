"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are cut into m partitions.  If a fingerprint has thresholds t_1..t_m, each -1 or more, with sum
(distance - m + 1), then whatever is within ``distance`` of it is within t_i of it in some partition i.  Correlated
bits share a partition, and a dynamic program gives each fingerprint the thresholds of its smallest estimated
cost in probes and candidates, so that fingerprints in a crowded part of one partition search in the others.  The
same estimate chooses m.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.llm.common import dropped, saved
from meterline.llm.components import components

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Fingerprints (those of smallest hash) from which bit correlations and crowded values are estimated.
SAMPLE = 20_000
#: Crowded values of a partition that the estimates tell apart; all others count as evenly spread.
CROWDED = 128
#: Estimated cost of one probe, which is shuffled, in candidates, which are only compared.
PROBE = 30
#: Most probes of one partition; larger thresholds are never planned, and the others make up for them.
MOST_PROBES = 1 << 20
#: Fingerprints of one key with which all others of the key are compared first, which joins large clouds of near copies.
HUBS = 4
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def hashes(text: str | None, shingle: int = SHINGLE, block: int = 200_000) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a whole text, in blocks; a text of fewer words is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # splits at x20 and x09-x0D
    if not words:
        return
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[len(words) - n :].tolist()
    for at in range(0, n, block):
        ends = zip(first[at : at + block], last[at : at + block], strict=True)
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in ends], ">u8")


def fingerprint(text: str | None, shingle: int = SHINGLE, block: int = 200_000) -> int:
    """SimHash of the whole text over XXH64 of its word shingles; 0 without words."""
    return majority_bits(hashes(text, shingle, block))


def majority_bits(blocks: Iterable[np.ndarray]) -> int:
    """The bits set in over half of big-endian 64-bit hashes."""
    counts, n = np.zeros((8, 8), np.int64), 0
    for h in blocks:
        n += len(h)
        for k, column in enumerate(h.view(np.uint8).reshape(-1, 8).T):
            counts[k] += np.bincount(column, minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.reshape(64) > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series(np.array([fingerprint(t) for t in part], np.uint64).view(np.int64))


def as_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


@dataclass(frozen=True)
class Partition:
    """Bit numbers (0 the lowest) and what is known of the values that they take."""

    bits: tuple[int, ...]
    crowded: np.ndarray
    shares: np.ndarray

    def value(self, fps: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fps), np.uint64)
        for k, b in enumerate(self.bits):
            out |= (fps >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
        return out

    def masks(self, distance: int) -> np.ndarray:
        """All changes of at most so many bits."""
        return _masks(len(self.bits), distance)


@lru_cache(maxsize=256)
def _masks(bits: int, distance: int) -> np.ndarray:
    """Made when a worker first needs them: wide partitions have many, and few fingerprints take large thresholds."""
    out = [sum(1 << k for k in c) for d in range(distance + 1) for c in combinations(range(bits), d)]
    return np.array(out, np.uint64)


def _ball(bits: int, distance: int) -> int:
    return sum(comb(bits, d) for d in range(distance + 1))


@dataclass(frozen=True)
class Plan:
    """Partitions and, for the number of fingerprints, how candidates are estimated."""

    partitions: tuple[Partition, ...]
    distance: int
    n: int

    def keys(self, fps: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
        """The keys that fingerprints of equal thresholds look up, a row for each."""
        out = [np.zeros((len(fps), 0), np.uint64)]
        for i, (p, t) in enumerate(zip(self.partitions, thresholds, strict=True)):
            if t >= 0:
                out.append((p.value(fps)[:, None] ^ p.masks(int(t))[None, :]) + np.uint64(i << 40))
        return np.concatenate(out, axis=1).view(np.int64)

    @property
    def spare(self) -> int:
        return self.distance - len(self.partitions) + 1

    @property
    def possible(self) -> bool:
        """Whether thresholds of at most ``MOST_PROBES`` probes each add up to what the distance needs."""
        most = [max(t for t in range(self.distance + 1) if _ball(len(p.bits), t) <= MOST_PROBES) for p in self.partitions]
        return sum(most) >= self.spare

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """Estimated cost of probes and candidates, by partition, threshold (from -1) and fingerprint."""
        out = np.zeros((len(self.partitions), self.distance + 2, len(fps)))
        for i, p in enumerate(self.partitions):
            far = np.bitwise_count(p.value(fps)[:, None] ^ p.crowded[None, :])
            even = (1 - p.shares.sum()) * self.n / 2.0 ** len(p.bits)
            for t in range(self.distance + 1):
                ball = _ball(len(p.bits), t)
                hot = ((far <= t) * p.shares).sum(axis=1) * self.n
                out[i, t + 1] = ball * (PROBE + even) + hot if ball <= MOST_PROBES else np.inf
        return out

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """The thresholds of least estimated cost for each fingerprint, by dynamic programming over partitions."""
        return self._best(fps)[0]

    def estimate(self, fps: np.ndarray) -> float:
        """Mean cost of a fingerprint at its best thresholds."""
        return float(self._best(fps)[1].mean()) if len(fps) else 0.0

    def _best(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cost, m = self.costs(fps), len(self.partitions)
        # thresholds count from -1, so m of them with sum `spare` are m numbers from 0 with sum `distance + 1`
        total = self.spare + m
        best = np.full((total + 1, len(fps)), np.inf)
        best[0] = 0
        picks = []
        for i in range(m):
            none = np.full(len(fps), np.inf)
            sums = [[best[s - t] + cost[i, t] if t <= s else none for t in range(cost.shape[1])] for s in range(total + 1)]
            options = np.array(sums)
            picks.append(options.argmin(axis=1))
            best = options.min(axis=1)
        left, out = np.full(len(fps), total), np.empty((len(fps), m), np.int64)
        for i in range(m - 1, -1, -1):
            t = picks[i][left, np.arange(len(fps))]
            out[:, i] = t - 1
            left = left - t
        return out, best[total]


def grouped_bits(fps: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """The 64 bits in m groups of even size; each group grows by the bit most correlated with it."""
    bits = (fps[:, None] >> np.arange(64, dtype=np.uint64)[None, :] & np.uint64(1)).astype(float)
    bits -= bits.mean(axis=0)
    scale = np.sqrt((bits * bits).sum(axis=0))
    near = np.abs(bits.T @ bits) / np.maximum(np.outer(scale, scale), 1e-9)
    np.fill_diagonal(near, 0)
    free, groups = set(range(64)), []
    for k in range(m):
        size = len(free) // (m - k)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (near[b, rest].sum(), -b))]
        free.discard(group[0])
        while len(group) < size:
            nxt = max(sorted(free), key=lambda b: (near[b, group].sum(), -b))
            group.append(nxt)
            free.discard(nxt)
        groups.append(tuple(sorted(group)))
    return groups


def planned(fps: DataFrame, distance: int = DISTANCE, sample: int = SAMPLE, parts: int | None = None, share: float = 1.0) -> Plan:
    """Partitions for the distinct fingerprints ``fps(fp)``, from their number and a bounded sample.

    Probes of a fingerprint grow with the number of fingerprints, unless the number of ``parts`` is given.  ``share``
    says with how much of the table a fingerprint is compared (see ``Sized``).
    """
    if not 1 <= distance <= 14:
        raise ValueError("distance must be 1 to 14 bits")
    n = round(fps.count() * share)
    some = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    seen = np.array([r[0] for r in some], np.int64).view(np.uint64)
    plans = [plan_of(seen, m, distance, n) for m in ([parts] if parts else range(2, distance + 2))]
    return min((p for p in plans if p.possible), key=lambda p: p.estimate(seen[:1000]))


def plan_of(seen: np.ndarray, m: int, distance: int, n: int) -> Plan:
    """The plan of ``m`` partitions for ``n`` fingerprints of which some were seen."""
    parts = []
    for bits in grouped_bits(seen if len(seen) > 1 else np.zeros(2, np.uint64), m):
        p = Partition(bits, np.zeros(0, np.uint64), np.zeros(0))
        value, counts = np.unique(p.value(seen), return_counts=True)
        # crowded: at least twice as many as an even spread would give, and more than one
        hot = np.argsort(-counts, kind="stable")[:CROWDED]
        hot = hot[counts[hot] > max(1.0, 2 * len(seen) / 2.0 ** len(bits))]
        parts.append(Partition(bits, value[hot], counts[hot] / max(1, len(seen))))
    return Plan(tuple(parts), distance, n)


def probes_of(plan: Plan):
    """UDF: the keys that a fingerprint looks up, each a partition (from bit 40 on) and a value, and its thresholds.

    Thresholds are packed, four bits each, as one more than they are.
    """

    @F.pandas_udf("reach long, keys array<long>")
    def probes(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out, reach = np.empty(len(part), object), np.zeros(len(part), np.int64)
            for at in range(0, len(part), 2000):
                fps = part.to_numpy(np.int64)[at : at + 2000].view(np.uint64)
                chosen, which = np.unique(plan.thresholds(fps), axis=0, return_inverse=True)
                for k, thresholds in enumerate(chosen):
                    own = np.flatnonzero(which.reshape(-1) == k)
                    reach[at + own] = sum(int(t + 1) << 4 * i for i, t in enumerate(thresholds))
                    for row, keys in zip(own, plan.keys(fps[own], thresholds), strict=True):
                        out[at + row] = keys
            yield pd.DataFrame({"reach": reach, "keys": out})

    return probes


def keys_of(plan: Plan, fp: Column) -> Column:
    """The keys under which a fingerprint is stored, one for each partition."""
    bit = lambda b, k: F.shiftleft(F.shiftright(fp, b).bitwiseAND(F.lit(1).cast("long")), k)
    value = lambda p: sum(bit(b, k) for k, b in enumerate(p.bits))
    return F.array(*(F.lit(i << 40).cast("long") + value(p) for i, p in enumerate(plan.partitions)))


#: A condition on two nodes beside their distance.
Also = Callable[[Column, Column], Column]


class Sized(NamedTuple):
    """Bands of sizes, for nodes that link to some sizes only.

    A node asks in its ``own`` band for nodes of its ``size`` or more; it is stored in the bands ``held``, which are the
    own ones of all smaller nodes that may link to it.
    """

    size: str
    own: Column
    held: Column


def _banded(keys: Column, bands: Column) -> Column:
    """Every key in every band, the band from bit 48 on."""
    return F.flatten(F.transform(bands, lambda b: F.transform(keys, lambda k: F.shiftleft(b, 48) + k)))


def share_of(nodes: DataFrame, sized: Sized) -> float:
    """The share of the nodes that a node meets in its band, on average."""
    own = nodes.groupBy(sized.own.alias("band")).agg(F.count(F.lit(1)).cast("double").alias("asking"))
    held = nodes.select(F.explode(sized.held).alias("band")).groupBy("band").agg(F.count(F.lit(1)).cast("double").alias("stored"))
    met = own.join(held, "band").agg(F.sum(F.col("asking") * F.col("stored")), F.sum("asking")).first()
    return met[0] / met[1] ** 2 if met[1] else 1.0


def _keyed(nodes: DataFrame, keys: Column, side: str, known: DataFrame | None = None, *more: str) -> DataFrame:
    """``(side, root, key)`` rows of nodes, each a struct; the root is null where it is not ``known(node, root)``."""
    rows = nodes if known is None else nodes.join(known.select("node", "root"), "node", "left")
    root = [] if known is None else [F.col("root").alias(f"root_{side}")]
    held = F.struct("node", *(c for c in nodes.columns if c not in ("node", "keys", *more)))
    return rows.select(held.alias(side), *root, *more, F.explode(keys).alias("key"))


def _first_find(plan: Plan) -> Column:
    """Whether no partition before the key's own finds the pair too, so that each pair is made once."""
    found, part = F.col("a.fp").bitwiseXOR(F.col("b.fp")), F.shiftright("key", 40).bitwiseAND(F.lit(255).cast("long"))
    first = F.lit(True)
    for i, p in enumerate(plan.partitions):
        mask = F.lit(int(np.uint64(sum(1 << b for b in p.bits)).view(np.int64)))
        most = F.shiftright("reach", 4 * i).bitwiseAND(F.lit(15).cast("long"))
        first = first & ((part <= i) | (F.bit_count(found.bitwiseAND(mask)) >= most))
    return first


def _near(plan: Plan, also: Also | None, sized: Sized | None = None) -> Column:
    a, b = F.col("a"), F.col("b")
    ordered = a["node"] < b["node"]
    if sized:
        ordered = (a[sized.size] < b[sized.size]) | ((a[sized.size] == b[sized.size]) & ordered)
    near = ordered & (F.bit_count(a["fp"].bitwiseXOR(b["fp"])) <= plan.distance)
    return near & also(a, b) if also else near


def links(
    nodes: DataFrame, plan: Plan, known: DataFrame | None = None, also: Also | None = None, sized: Sized | None = None
) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of ``nodes(node, fp, ...)`` with fingerprints within the plan's distance.

    A fingerprint's own probes find all its neighbours, so each pair is taken from its smaller member's probes.  The
    distance, and what ``also`` says of the two structs, is checked inside the join, so candidates are never written.
    Pairs of one root in ``known(node, root)`` are left out, and with ``sized`` those whose sizes never link; the
    smaller of a pair then probes.
    """
    probing = nodes.withColumn("x", probes_of(plan)("fp")).select(*nodes.columns, "x.*")
    asked, kept = F.col("keys"), keys_of(plan, F.col("fp"))
    if sized:
        asked, kept = _banded(asked, F.array(sized.own)), _banded(kept, sized.held)
    one = _keyed(probing, asked, "a", known, "reach")
    two = _keyed(nodes, kept, "b", known)
    near = _near(plan, also, sized)
    if known is not None:
        near = near & F.coalesce(F.col("root_a") != F.col("root_b"), F.lit(True))
    pairs = one.join(two, "key").filter(near & _first_find(plan))
    return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))


def stars(nodes: DataFrame, plan: Plan, also: Also | None = None, sized: Sized | None = None) -> DataFrame:
    """Those pairs of ``links`` between the nodes of a key and ``HUBS`` of them: a few for each node."""
    kept = keys_of(plan, F.col("fp"))
    stored = _keyed(nodes, _banded(kept, sized.held) if sized else kept, "own")
    hubs = F.array_distinct(F.array(*(F.min_by("own", F.xxhash64("own.node", F.lit(k))) for k in range(HUBS))))
    found = stored.groupBy("key").agg(hubs.alias("hubs"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = found.select("key", F.explode("hubs").alias("hub"))
    pairs = stored.join(found, "key").select(F.least("own", "hub").alias("a"), F.greatest("own", "hub").alias("b"))
    return pairs.filter(_near(plan, also)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def linked(
    nodes: DataFrame, plan: Plan, verify: Callable[[DataFrame], DataFrame] | None = None, also: Also | None = None, sized: Sized | None = None
) -> DataFrame:
    """``(node, root)`` of every node with a link, over those pairs of ``links`` that ``verify`` leaves.

    Stars come first; then every pair that is not inside one class already, so a large cloud of near copies does not
    cost all its pairs, and no link between classes is lost.
    """
    found = roots = None
    for last in (False, True):
        pairs = links(nodes, plan, roots, also, sized) if last else stars(nodes, plan, also, sized)
        new = saved(verify(pairs) if verify else pairs, "links")
        found, before = found.unionByName(new) if last else new, roots
        roots = saved(components(found), "classes")
    dropped(before)
    return roots


def _classes(docs: DataFrame, distance: int) -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    rows = saved(docs.select("doc_id", fingerprints("text").alias("fp")), "fingerprints")
    fps = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    roots = linked(fps.select(F.col("fp").alias("node"), "fp"), planned(fps, distance))
    known = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = saved(known.join(ids, "root").select("fp", "component_id"), "fingerprint_classes")
    dropped(fps, roots)
    return rows.join(classes, "fp")


def near_classes(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row for each input row: ``doc_id, fp, component_id``.

    ``component_id`` is the smallest id that the row reaches over links of fingerprints (null only if none has an
    id).  Texts without words (null, empty, blank) have fingerprint 0 and are linked like any other.  Equal
    fingerprints are one node, so groups of copies of any size cost nothing; rows may be repeated; extra columns are
    ignored; an empty table gives no rows; a text of any length is read whole, in blocks.
    """
    return _classes(docs, distance).select("doc_id", "fp", "component_id")
