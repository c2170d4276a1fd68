"""The audit of filters against a plain walk through every order."""

from collections import Counter
from itertools import permutations

import pytest
from oracle import available, compare
from test_llm import EDGES, SCHEMA

from meterline.llm import filter_audit, queries
from meterline.llm.filter_audit import FILTERS


def plain(docs, labels):
    """Rows of the audit from lists of ``(doc_id, text, lang)`` and ``(doc_id, quality, toxic)``."""
    marks = {}
    for i, q, t in labels:
        good, toxic = marks.get(i, (0, 0))
        marks[i] = (good | (q == 1), toxic | (t == 1))
    judged = []
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
        fails |= {"D"} if set(text) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (x or "") == text for j, x, _ in docs) else set()
        judged.append((lang or "", fails, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    shapley, out = Counter(), []
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        for order in permutations(FILTERS):
            left = own
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                shapley[part, f] += len(gone)
                here = [j for j in own if f in j[1]]
                left = [j for j in left if f not in j[1]]
                out.append((part, "".join(order), step, len(left), len(gone), len(here) - len(gone), sum(len(j[1]) == 1 for j in here), sum(j[2] for j in gone), sum(j[3] for j in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_of_edge_rows(spark):
    long = " ".join(f"W{k}" for k in range(150))
    more = [(20, long, "en"), (21, long, "fr"), (22, long, "en"), (22, long, "en"), (23, "# " + long.lower(), "en"), (24, long.lower(), ""), (None, long, "en")]
    docs = [(e[0], e[1], e[2]) for e in EDGES] + more
    table = spark.createDataFrame([(i, t, g, "s", 1, "x", 1) for i, t, g in docs], SCHEMA)
    labels = [(1, 1, 0), (1, 0, 1), (22, 1, None), (23, None, 1), (None, 1, 1), (5, 0, 0)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, filter_audit.filter_audit(table, marked).collect()))
    assert got == plain(docs, labels)
    assert len(got) == 600 * len({g or "" for _, _, g in docs})


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "a", "en", "s", 1, "x", 1)], SCHEMA)
    assert filter_audit.filter_audit(some, labels).filter("good_lost + toxic_lost > 0").count() == 0


@pytest.mark.parametrize("n", [1, 3, 4])
def test_potentials_give_shapley_shares(spark, n):
    from math import factorial, lcm

    from pyspark.sql import functions as F

    value = [0, *((k * k * 7 + 3 * k) % 23 for k in range(1, 1 << n))]
    row = spark.createDataFrame([(value,)], "v array<long>").select(filter_audit.potentials(F.col("v"), n).alias("p")).first()
    for i in range(n):
        total = 0
        for order in permutations(range(n)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += value[before + (1 << i)] - value[before]
        every = (1 << n) - 1
        assert (row["p"][every] - row["p"][every - (1 << i)]) * factorial(n) // lcm(*range(1, n + 1)) == total


@pytest.mark.skipif(not available(), reason="driver tables are absent")
def test_query_equals_sql(spark):
    compare(spark, queries.QUERIES["op11_filter_audit"], queries.SQL["op11_filter_audit"])
