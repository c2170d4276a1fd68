"""Preference formatting: the common turns of a chosen and a rejected conversation once, then both completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.llm.common import let, saved

LEARN = "assistant"


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation as an array of ``role, content`` by turn (ties by role, then text).

    Null roles are ``unknown``, null texts empty; turns without number come first; rows without ``conv_id`` are
    conversations of one turn each, as nothing joins them.  Texts are kept whole; extra columns are ignored; an empty
    table gives no rows.
    """
    said = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    # array_sort puts null numbers last, so absence is the first key
    keyed = F.struct(F.col("turn").isNotNull().alias("known"), said.alias("x"))
    known = F.col("conv_id").isNotNull()
    rows = conversations.filter(known).groupBy("conv_id").agg(F.array_sort(F.collect_list(keyed)).alias("turns"))
    rows = rows.unionByName(conversations.filter(~known).select("conv_id", F.array(keyed).alias("turns")))
    plain = lambda t: F.struct(t["x"]["role"].alias("role"), t["x"]["content"].alias("content"))
    return rows.select("conv_id", F.transform("turns", plain).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")


def rendered(part: Column) -> Column:
    """Text of an array of turns: a header line, the content and an end mark for each."""
    return F.array_join(F.transform(part, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["content"], F.lit("<|end|>\n"))), "")


def learned(part: Column) -> Column:
    """``start:length`` spans (characters, comma-separated) of the rendered turns that carry loss.

    These are contents and end marks of assistant turns; headers, other turns and the whole prompt are masked.
    """
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head, body = F.length(t["role"]) + 5, F.length(t["content"]) + 7
        span = F.concat((acc["at"] + head).cast("string"), F.lit(":"), body.cast("string"))
        spans = F.when(t["role"] == LEARN, F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + head + body + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(part, empty, step, lambda acc: F.array_join(acc["spans"], ","))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pair_id, n_prompt_turns, prompt`` and, for chosen and rejected each, ``*_completion`` and ``*_spans``.

    ``pairs`` has ``pair_id`` and two arrays of ``role, content`` structs.  Equal conversations have empty
    completions; null arrays count as empty; repeated pairs give equal rows; texts are kept whole; extra columns are
    ignored; an empty table gives no rows.
    """
    empty = F.array().cast("array<struct<role:string,content:string>>")
    rows = pairs.select("pair_id", F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"))
    cut = rows.withColumn("n", common_turns(F.col("chosen"), F.col("rejected")))
    after = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    return cut.select(
        "pair_id",
        F.col("n").alias("n_prompt_turns"),
        rendered(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"),
        let(after("chosen"), lambda p: F.struct(rendered(p).alias("text"), learned(p).alias("spans"))).alias("c"),
        let(after("rejected"), lambda p: F.struct(rendered(p).alias("text"), learned(p).alias("spans"))).alias("r"),
    ).select("pair_id", "n_prompt_turns", "prompt", F.col("c.text").alias("chosen_completion"), F.col("c.spans").alias("chosen_spans"), F.col("r.text").alias("rejected_completion"), F.col("r.spans").alias("rejected_spans"))


def swapped_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: chosen is the conversation, rejected has another's last answer.

    The last assistant turn is replaced by the one of the conversation whose number differs in the lowest bit;
    where either has none, rejected equals chosen.  ``conv_id`` must be a whole number.
    """
    if not isinstance(conversations.schema["conv_id"].dataType, T.IntegralType):
        raise TypeError("conv_id must be a whole number, as its lowest bit names the partner")
    talks = saved(turns(conversations), "conversations")
    said = F.filter("turns", lambda t: t["role"] == LEARN)
    last = talks.filter(F.exists("turns", lambda t: t["role"] == LEARN)).select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("_for"), F.element_at(said, -1)["content"].alias("_answer"))
    rows = talks.join(last, talks["conv_id"] == last["_for"], "left")
    place = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"] == LEARN), True) + 1
    other = lambda t, i: F.when(F.col("_answer").isNotNull() & (i + 1 == place), F.struct(t["role"].alias("role"), F.col("_answer").alias("content"))).otherwise(t)
    return rows.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.transform("turns", other).alias("rejected"))
