"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter

import pytest
from oracle import available, compare
from test_llm import EDGES, SCHEMA

from meterline.llm import collocations, queries


def plain(docs, least, top):
    """Ranked phrases from ``(text, lang)`` pairs, by counting everything."""
    out = []
    for lang in {g if g is not None else "und" for _, g in docs}:
        grams = Counter()
        for text, g in docs:
            if (g if g is not None else "und") != lang:
                continue
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
                words = [w for w in re.split(r"[ \t]+", piece) if w]
                for k in range(1, 6):
                    grams.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        n = sum(c for g, c in grams.items() if len(g) == 1)
        often = {g: c for g, c in grams.items() if c >= least}
        held = set()
        for g, c in often.items():
            held |= {g[i:j] for i in range(len(g)) for j in range(i + 2, len(g) + 1) if (i, j) != (0, len(g)) and often[g[i:j]] <= c}
        rows = []
        for g, a in often.items():
            if len(g) > 1 and g not in held:
                score, _, left, right = min((1000 * a * n // (often[g[:k]] * often[g[k:]]), k, often[g[:k]], often[g[k:]]) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def spoken(seed, n):
    """Texts of a small vocabulary with repeated phrases, odd separators and frequent words."""
    r = random.Random(seed)
    words = ["the", "The", "of", "a", "été", "x1", "ß", *(f"w{k}" for k in range(30))]
    fixed = [" ".join(r.choice(words) for _ in range(r.randint(2, 8))) for _ in range(12)]
    texts = []
    for _ in range(n):
        parts = [r.choice(fixed) if r.random() < 0.4 else r.choice(words[:7] if r.random() < 0.5 else words) for _ in range(r.randint(0, 40))]
        texts.append("".join(p + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "\x0b", "! "]) for p in parts))
    return texts


@pytest.mark.parametrize(("seed", "top", "batches"), [(1, 2000, (50_000, 0)), (2, 12, (30_000, 9_000, 0)), (3, 3, (20_000, 12_000, 4_000, 0))])
def test_phrases_equal_plain_count(spark, monkeypatch, seed, top, batches):
    monkeypatch.setattr(collocations, "LEAST", 4)
    monkeypatch.setattr(collocations, "BATCHES", batches)
    monkeypatch.setattr(collocations, "CHUNK", 300)
    monkeypatch.setattr(collocations, "VOCABULARY", 12)
    r = random.Random(seed)
    docs = [(t, r.choice(["en", "en", "en", "fr", None])) for t in spoken(seed, 160)] + [("the the the the the. " * 5, "en"), ("", "de"), (None, "de")]
    rows = [(k, t, g, "s", 1, "x", 1) for k, (t, g) in enumerate(docs)]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(docs, 4, top)


def test_partitions_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST", 2)
    docs = [(t, "en") for t in ("a b", "a b", "rare", "a", "b", "")]
    rows = [(k, t, g, "s", 1, "x", 1) for k, (t, g) in enumerate(docs)]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert sorted(map(tuple, got.collect())) == plain(docs, 2, 2000)


def test_large_counts_stay_exact(spark):
    big = 3_000_000_000_000
    key = lambda *w: b"".join(x.to_bytes(8, "little") for x in w)
    phrases = spark.createDataFrame([("en", key(1, 2), big)], "lang string, key binary, a long")
    counts = spark.createDataFrame([("en", key(1), big + 7), ("en", key(2), big + 1)], "lang string, key binary, f long")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    assert collocations.scored(phrases, counts, totals).first()["score"] == 1000 * big * 10**15 // ((big + 7) * (big + 1))


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame(EDGES, SCHEMA)).filter("lang = 'und'").count() == 0


@pytest.mark.skipif(not available(), reason="driver tables are absent")
def test_query_equals_sql(spark):
    compare(spark, queries.QUERIES["op12_collocations"], queries.SQL["op12_collocations"])
