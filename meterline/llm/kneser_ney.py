"""Interpolated Kneser-Ney character models, one for each class, over shared sorted hash arrays.

A text becomes 16-bit symbols, the UTF-16 units of its lower-case letters, so that letters of every script have symbols
of their own; runs of anything else are one blank.  An n-gram of up to four symbols is the integer of its symbols.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import cache

import numpy as np

#: Bits of a symbol, and the symbols that are no letters (the second is no character).
BITS = 16
BLANK, START = 0x20, 0xFFFF
_ODD = np.uint64(0x9E3779B97F4A7C15)


def hashed(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-gram codes (a bijection, so keys never collide)."""
    h = codes.astype(np.uint64) * _ODD
    h ^= h >> np.uint64(32)
    return h * _ODD


class HashArray:
    """Sorted 64-bit hashes with a directory of their leading bits; ``find`` is one jump and a short walk."""

    def __init__(self, codes: np.ndarray):
        h = hashed(codes)
        self.order = np.argsort(h)
        self.keys = h[self.order]
        bits = max(1, int(len(codes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        ends = np.append(self.starts[1:], len(codes))
        self.walk = int((ends - self.starts).max(initial=0))

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Place of each code in the sorted arrays, -1 where it is absent."""
        h = hashed(codes)
        at, found = self.starts[(h >> self.shift).astype(np.int64)], np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return found
        last = np.int32(len(self.keys) - 1)
        for k in range(self.walk):
            i = np.minimum(at + np.int32(k), last)
            hit = self.keys[i] == h
            found[hit] = i[hit]
        return found


def _units(c: str) -> list[int]:
    """UTF-16 units of a character's lower-case letter; a blank if it is no letter."""
    if not c.isalpha():
        return [BLANK]
    return np.frombuffer(c.lower()[0].encode("utf-16-le", "surrogatepass"), np.uint16).tolist()


@cache
def _table() -> np.ndarray:
    """The symbols of the code points below 65,536."""
    return np.array([_units(chr(c))[0] for c in range(1 << 16)], np.uint16)


def encode(text: str) -> np.ndarray:
    """Symbols of a whole text, runs of blanks as one, none in front."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _table()[np.minimum(points, (1 << 16) - 1)]
    high = np.flatnonzero(points >> 16)
    if len(high):
        kinds, which = np.unique(points[high], return_inverse=True)
        units = [_units(chr(c)) for c in kinds]
        out[high] = np.array([u[0] for u in units], np.uint16)[which]
        # letters beyond 65,535 have a second unit, put in behind the first
        second = np.array([u[1] if len(u) > 1 else BLANK for u in units], np.uint16)[which]
        two = second != BLANK
        out = np.insert(out, high[two] + 1, second[two])
    blank = out == BLANK
    blank[1:] &= blank[:-1].copy()
    blank[:1] = out[:1] == BLANK
    return out[~blank]


def ngrams(symbols: Sequence[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of several texts, each led in by START symbols, and where each text's codes begin."""
    lead = np.full(order - 1, START, np.uint16)
    parts = [x for s in symbols for x in (lead, s)]
    flat = np.concatenate(parts).astype(np.uint64) if parts else np.zeros(0, np.uint64)
    code = flat.copy()
    for k in range(1, order):
        code[k:] |= flat[:-k] << np.uint64(BITS * k)
    lengths = np.array([len(s) for s in symbols], np.int64)
    ends = np.cumsum(lengths + order - 1)
    inside = np.ones(len(flat), bool)
    for k in range(order - 1):
        inside[ends - lengths - 1 - k] = False
    return code[inside], np.concatenate(([0], np.cumsum(lengths)))[:-1]


def suffix(codes: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` symbols of n-grams."""
    return codes & np.uint64((1 << BITS * n) - 1)


def context(codes: np.ndarray) -> np.ndarray:
    """All symbols of n-grams but the last."""
    return codes >> np.uint64(BITS)


class _Level:
    """Discounted counts of one order of one class."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.index = HashArray(codes)
        self.counts = counts[self.index.order].astype(np.float64)
        n1, n2 = (counts == 1).sum(), (counts == 2).sum()
        self.discount = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 else 0.5
        before, inverse = np.unique(context(codes), return_inverse=True)
        self.context = HashArray(before)
        self.total = np.bincount(inverse, counts, len(before))[self.context.order]
        self.types = np.bincount(inverse, minlength=len(before))[self.context.order]

    def parts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probability, and weight of the order below."""
        at, ctx = self.index.find(codes), self.context.find(context(codes))
        if not len(self.counts):
            return np.zeros(len(codes)), np.ones(len(codes))
        total = np.where(ctx >= 0, self.total[ctx], 1.0)
        p = np.where(at >= 0, np.maximum(self.counts[at] - self.discount, 0), 0) / total
        return p, np.where(ctx >= 0, self.discount * self.types[ctx] / total, 1.0)


class KneserNey:
    """Models of all classes: ``cross_entropy`` gives nats a symbol of each text under each class.

    ``counts`` has the n-grams of each class, as codes with their counts.  Tables of log probabilities are kept for
    ``GROUP`` classes at a time, over the n-grams that those have, so that they grow with the n-grams alone.
    """

    GROUP = 16

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int):
        if not 1 <= order <= 64 // BITS:
            raise ValueError(f"order must be 1 to {64 // BITS}")
        self.order, self.classes = order, sorted(counts)
        self.levels = []
        for name in self.classes:
            codes, n = counts[name]
            codes = codes.astype(np.uint64)
            levels = [_Level(codes, np.asarray(n))]
            for k in range(order - 1, 0, -1):
                # below the top, a gram counts the different symbols seen before it
                codes, n = np.unique(suffix(codes, k), return_counts=True)
                levels.append(_Level(codes, n))
            self.levels.append(levels[::-1])
        self.tables = []
        for at in range(0, len(self.classes), self.GROUP):
            own = slice(at, min(at + self.GROUP, len(self.classes)))
            every = np.unique(np.concatenate([counts[c][0] for c in self.classes[own]]).astype(np.uint64))
            index = HashArray(every)
            self.tables.append((own, index, self.log_p(every, own)[index.order]))

    def log_p(self, codes: np.ndarray, own: slice = slice(None)) -> np.ndarray:
        """Log probabilities of the last symbols, a column for each class, by the full recursion."""
        levels_of = self.levels[own]
        out = np.empty((len(codes), len(levels_of)), np.float32)
        for k, levels in enumerate(levels_of):
            p = np.full(len(codes), 2.0**-BITS)
            for n, level in enumerate(levels, 1):
                seen, below = level.parts(suffix(codes, n))
                p = seen + below * p
            out[:, k] = np.log(p)
        return out

    def cross_entropy(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a symbol (a row for each text, a column for each class) and symbols of each text."""
        symbols = [encode(t) for t in texts]
        lengths = np.array([len(s) for s in symbols], np.int64)
        out = np.zeros((len(texts), len(self.classes)))
        some = np.flatnonzero(lengths)
        if len(some):
            codes, starts = ngrams([symbols[i] for i in some], self.order)
            for own, index, table in self.tables:
                at = index.find(codes)
                logs = table[at]
                missing = np.flatnonzero(at < 0)
                if len(missing):
                    new, inverse = np.unique(codes[missing], return_inverse=True)
                    logs[missing] = self.log_p(new, own)[inverse]
                out[some, own] = -np.add.reduceat(logs, starts, axis=0, dtype=np.float64) / lengths[some, None]
        return out, lengths


def batches(texts: Sequence[str], chars: int = 1_000_000) -> Iterable[slice]:
    """Runs of texts of about so many characters together (one longer text is a run of its own)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))
