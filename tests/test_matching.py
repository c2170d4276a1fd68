"""Text joins by n-grams against comparing every pair."""

import random

import pytest
from pyspark.sql import functions as F

from meterline.functions import formatting as X
from meterline.operators import matching, selection


def words(seed, n, letters):
    r = random.Random(seed)
    made = ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 9, 10, 11, 14, 20, 33]))) for _ in range(n)]
    for w in list(made):  # edited copies, some just within and some just beyond the limit
        for _ in range(3):
            x = list(w)
            for _ in range(r.randint(0, max(1, len(w.encode()) // 5) + 1)):
                at = r.randrange(len(x) + 1)
                x[at : at + r.randint(0, 1)] = [r.choice(letters)] * r.randint(0, 1)
            made.append("".join(x))
    return made


@pytest.mark.parametrize("letters", ["abcdefgh", "ab", "aé語", "aбв😀", "語漢字"])
def test_close_equals_every_pair(spark, letters):
    refs = spark.createDataFrame([(w,) for w in words(1, 14, letters) + [None]], "ref_key string")
    keys = spark.createDataFrame([(w,) for w in words(1, 14, letters)[7:] + words(2, 10, letters) + [None, None]], "key string")
    got = sorted(map(tuple, matching.close(refs, keys).collect()))
    limit = F.greatest(F.floor(F.greatest(F.octet_length("ref_key"), F.octet_length("key")) / 5), F.lit(1))
    near = F.contains("key", F.col("ref_key")) | (F.levenshtein("ref_key", "key") <= limit)
    expected = sorted(map(tuple, refs.filter("ref_key <> ''").distinct().crossJoin(keys.filter("key IS NOT NULL").distinct()).filter(near).collect()))
    assert got == expected and expected


def test_numbers_in_other_places_are_not_compared(spark):
    keys = spark.range(1000, 9000).select(F.concat(F.lit("home0"), F.col("id").cast("string")).alias("text"))
    refs = spark.range(1000, 2000).select(F.concat(F.lit("zzz"), F.col("id").cast("string")).alias("text"))
    # each number shares three digits with dozens of the others
    assert matching._likely(refs, keys).count() + matching._likely(keys, refs).count() < 2000


def test_no_nested_loop_and_hot_texts_fold(spark):
    texts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "the common title").otherwise(F.concat(F.lit("Title of "), F.col("id").cast("string"))).alias("candidate"))
    refs = spark.createDataFrame([("Commontitle",), ("title of 17",), ("nothing like it",)], "reference string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = matching.fuzzy_pairs(refs, texts)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Broadcast" not in plan
        plain = refs.crossJoin(texts.distinct()).filter(X.fuzzy_match(F.col("reference"), F.col("candidate")))
        assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_title_lists_are_short(spark):
    rows = [(k, f"Plan {k}", None, "Índex" if k == 3 else None) for k in range(9)] + [(9, None, None, None)]
    roots = spark.createDataFrame(rows, "id long, title string, name string, index_name string")
    asked = spark.createDataFrame([("PLAN",), ("plan 4",), ("índ",), ("n ",), ("zz",), ("",), (None,)], "query string")
    got = {r["query"]: tuple(r)[1:] for r in selection.by_title(roots, asked).collect()}
    assert got["PLAN"] == (9, None, "0, 1, 2, 3, 4, ...") and got["n "] == got[""] == got["PLAN"]
    assert got["plan 4"] == (1, 4, None) and got["índ"] == (1, 3, None) and got["zz"] == (0, None, "") and got[None][0] == 0
    assert selection.title_matches(roots, asked).filter("query = ''").count() == 9


def test_title_lists_may_be_whole(spark):
    roots = spark.range(12).select("id", F.concat(F.lit("Plan "), F.col("id").cast("string")).alias("title"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("index_name"))
    asked = spark.createDataFrame([("PLAN",), ("plan 11",), ("zz",)], "query string")
    got = {r["query"]: tuple(r)[1:] for r in selection.by_title(roots, asked, None).collect()}
    assert got == {"PLAN": (12, None, ", ".join(map(str, range(12)))), "plan 11": (1, 11, None), "zz": (0, None, "")}
