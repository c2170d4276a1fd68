"""URL filter: rule prefixes first, then a weighted URL vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms that reject alone, and terms of which several different ones reject.
STRICT = ("adult", "casino", "porn", "porno", "xxx", "viagra", "cialis", "poker", "escort", "escorts", "hentai", "nsfw", "warez", "jackpot", "roulette", "sexcam", "camgirls")
SOFT = ("adults", "ads", "bet", "bets", "betting", "bonus", "cheap", "click", "coupon", "deal", "deals", "farm", "free", "loan", "loans", "nude", "pill", "pills", "prize", "promo", "sex", "sexy", "spam", "torrent", "win", "winner")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct ``rule, verdict`` of the longest of a few rules that fits (of equal lengths the smaller text), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def ruled(seen: DataFrame, rules: DataFrame) -> DataFrame:
    """``seen(host, path, ...)`` with ``found``, the longest fitting rule of a table ``verdict, host, path`` of any size.

    A host's suffixes meet the rules' hosts by equality, once for each different host and path.
    """
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))
    pages = seen.select("host", "path").distinct().withColumn("tail", F.explode(tails))
    known = rules.select("verdict", F.col("host").alias("tail"), F.col("path").alias("start"))
    text = F.concat("tail", "start")
    hits = pages.join(known, "tail").filter(F.startswith("path", F.col("start")))
    best = F.min_by(F.struct(text.alias("rule"), "verdict"), F.struct(-F.length(text), text))
    return seen.join(hits.groupBy("host", "path").agg(best.alias("found")), ["host", "path"], "left")


HITS = T.StructType([T.StructField("strict", T.ArrayType(T.StringType())), T.StructField("soft", T.ArrayType(T.StringType()))])


def vocabulary_hits(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT):
    """Arrow-batched UDF: distinct strict and soft terms of a URL, each with no ASCII letter or digit beside it."""
    terms = {**{w: 1 for w in soft}, **{w: 2 for w in strict}}

    @F.pandas_udf(HITS)
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w, kind in terms.items():
            machine.add_word(w, (w, kind))
        if terms:
            machine.make_automaton()
        inner = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in urls:
            out = []
            for url in batch:
                found: dict[int, set[str]] = {1: set(), 2: set()}
                low = "" if url is None else url.lower()
                for end, (w, kind) in machine.iter(low) if terms else ():
                    start = end - len(w) + 1
                    if (start == 0 or low[start - 1] not in inner) and (end + 1 == len(low) or low[end + 1] not in inner):
                        found[kind].add(w)
                out.append((sorted(found[2]), sorted(found[1])))
            yield pd.DataFrame(out, columns=["strict", "soft"])

    return hits


def vocabulary_of(terms: DataFrame, most: int = 1_000_000) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a table ``term, is_strict``, lower-cased; more than ``most`` are an error."""
    rows = terms.filter("term <> ''").select(F.lower("term").alias("t"), "is_strict").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms don't fit an automaton in every worker")
    return tuple(sorted(r["t"] for r in rows if r["is_strict"])), tuple(sorted(r["t"] for r in rows if not r["is_strict"]))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule] | DataFrame = (),
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_needed: int = 2,
) -> DataFrame:
    """One row for each row of ``pages(page_id, url)``: ``page_id, host, path, rule, verdict, strict_hits, soft_hits``.

    A fitting rule decides (the longest); else one strict term or ``soft_needed`` different soft terms block.  A table
    of rules is joined; a few given as values are tested in turn.
    Null urls, and urls without ``://``, have empty host and path, fit no rule, and are judged by the vocabulary
    alone (null: no hit, allowed).  Repeated rows are judged alike, urls of any length whole; extra columns are
    ignored; an empty table gives no rows.
    """
    url = F.col("url")
    hits = vocabulary_hits(strict, soft)(url)
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), hits.alias("hits"))
    if isinstance(rules, DataFrame):
        seen = ruled(seen, rules)
    else:
        seen = seen.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    blocked = (F.size("hits.strict") >= 1) | (F.size("hits.soft") >= soft_needed)
    judged = F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))
    return seen.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), judged).alias("verdict"),
        F.col("hits.strict").alias("strict_hits"),
        F.col("hits.soft").alias("soft_hits"),
    )
