"""Main text of web pages: marked regions first, then what a host repeats on different pages.

A page is read as a stream of lines: blocks of text, cut at sentence ends outside the article.  Elements that are no
article by their name or by the words of their class, id or role are left out with all they hold.  Of the rest, the
lines of all pages of a host form one text, of which a suffix array finds the long runs that different pages share.
It is kept as deep as that question needs: suffixes are grouped by the lines that hold their first ``LONG`` words, and
a run of that length or more is repeated exactly where its suffixes' groups have several pages.  Covered lines go,
runs of one page stay.

Inside an ``article`` or ``main`` element, which says that its text is the page's own, a run goes only if nearly all
pages of the host have it: printed twice is no boilerplate.  A page with such an element has no other text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import counted_small, dropped, saved
from meterline.llm.url_filter import host_of

#: Words of a long run; pages and share of a host's different pages that repeat it outside and inside an article.
LONG = 6
OUTSIDE, INSIDE = (3, 0.05), (10, 0.9)

#: Elements whose text is never read.
RAW = "script style noscript template title textarea iframe noembed noframes xmp object svg math canvas select"
#: Elements that are no article, and words of a class, id or role that say the same.
ASIDE = frozenset("head nav header footer aside form menu dialog button fieldset datalist".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu menubar nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer sidebar aside complementary contentinfo widget related recommended recommendations share sharing social cookie cookies consent "
    "notice notices alert newsletter subscribe subscription signup login search comment comments reply replies respond disqus discussion popup modal overlay "
    "dialog form copyright pager pagination toolbar".split()
)
#: Elements that say that they hold the page's own text, and elements that begin and end a block.
MAIN = frozenset(("article", "main"))
BLOCKS = MAIN | ASIDE | frozenset(
    "html body address blockquote center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_RAW = "|".join(RAW.split())
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-z/!?][^>]*\Z",
    re.IGNORECASE | re.DOTALL,
)
_MARK = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
_SENTENCE = re.compile(r"(?<=[.!?;:|·•])\s+")


def marked(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is no article, and whether it says that it is one."""
    if name in ASIDE:
        return True, False
    own = name in MAIN
    if "=" in attributes and name not in ("html", "body"):
        for key, value in _MARK.findall(attributes):
            value = entities.unescape(value.strip("\"'"))
            if key.lower() == "itemprop":
                own |= value == "articleBody"
            elif key.lower() == "role" and value == "main":
                own = True
            elif name not in MAIN and any(w.lower() in MARKS for w in _WORD.findall(value)):
                return True, False
    return False, own


def blocks(page: str) -> tuple[list[str], bool]:
    """Blocks of a page in order, and whether they come from an article element.

    Character references are decoded, white space (as ``str.split`` has it) inside a block is one blank, empty blocks
    are left out.  Tags that are never closed, closed twice or cut off at the end of the page do no harm.
    """
    found: dict[bool, list[str]] = {True: [], False: []}
    stack: list[tuple[str, bool, bool]] = []  # name, no article, article
    hidden = main = 0
    text: list[str] = []

    def end_block() -> None:
        nonlocal text
        if text:
            line = " ".join("".join(text).split())
            if line:
                found[main > 0].append(line)
            text = []

    def pop_to(depth: int) -> None:
        nonlocal hidden, main
        for _, no, yes in stack[depth:]:
            hidden -= no
            main -= yes
        del stack[depth:]

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at and not hidden:
            text.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name, closing = name.lower(), bool(m[2] or m[5])
        block = name in BLOCKS
        if name == "br":
            text.append(" ")
            continue
        if block:
            end_block()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
                if not block and stack[depth][0] in BLOCKS:
                    break
        elif name not in VOID:
            if block:  # a block ends an open paragraph, an item the item before it
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == "p" or (stack[depth][0] == name and name in ("li", "dt", "dd", "tr", "td", "th")):
                        pop_to(depth)
                        break
                    if stack[depth][0] in BLOCKS:
                        break
            attributes = m[4] or m[7] or ""
            if not attributes.endswith("/") or block:
                no, yes = marked(name, attributes)
                stack.append((name, no, yes))
                hidden += no
                main += yes
    if not hidden:
        text.append(entities.unescape(page[at:]))
    end_block()
    return (found[True], True) if found[True] else (found[False], False)


def lines(page: str) -> tuple[list[str], bool]:
    """The token stream of a page: blocks of an article whole, other blocks by sentences."""
    found, own = blocks(page)
    return (found, own) if own else ([s for b in found for s in _SENTENCE.split(b)], own)


def suffixes(stream: list[str], long: int = LONG) -> Iterator[tuple[int, int, int]]:
    """``(first line, lines, hash)`` of the first ``long`` words of every suffix that has so many, by whole lines."""
    sizes = [s.count(" ") + 1 for s in stream]
    end = held = 0
    for start in range(len(stream)):
        while end < len(stream) and held < long:
            held += sizes[end]
            end += 1
        if held < long:
            return
        yield start, end - start, xxhash.xxh3_64_intdigest("\n".join(stream[start:end]).encode("utf-8", "surrogatepass")) - (1 << 63)
        held -= sizes[start]


def host_suffixes(pages: DataFrame) -> DataFrame:
    """``host, page, own, run, at, lines``: suffixes of the different pages of each host; ``page`` is a hash of the html."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for host, page, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stream, own = lines(text)
                for at, n, run in suffixes(stream):
                    for column, value in zip(out, (host, page, own, run, at, n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["host", "page", "own", "run", "at", "lines"])

    seen = pages.filter("host <> '' AND html <> ''").select("host", F.xxhash64("html").alias("page"), "html")
    return seen.mapInArrow(read, "host string, page long, own boolean, run long, at int, lines int").distinct()


def repeated(suffix: DataFrame, n_pages: DataFrame) -> DataFrame:
    """``host, own, run``: runs that enough different pages of their host share; ``n_pages(host, n)``."""
    runs = suffix.groupBy("host", "own", "run").agg(F.count_distinct("page").alias("pages"))
    (least_out, share_out), (least_in, share_in) = OUTSIDE, INSIDE
    enough = F.when(F.col("own"), F.greatest(F.lit(least_in), F.ceil(F.col("n") * share_in))).otherwise(F.greatest(F.lit(least_out), F.ceil(F.col("n") * share_out)))
    # runs of fewer pages than any host asks for go before the join
    return runs.filter(F.col("pages") >= min(least_out, least_in)).join(n_pages, "host").filter(F.col("pages") >= enough).select("host", "own", "run")


def extracted(pages: DataFrame) -> DataFrame:
    """``pages(url, html, ...)`` with ``text``: the main text, blocks joined by one blank (null html: empty).

    Pages without host are compared with no others.  Copies of a page (same html on the same host) count once and get
    the same text; repeated rows stay; an empty table gives no rows.  Only hashes of lines are shuffled, not pages.
    """
    rows = pages.withColumns({"_host": host_of(F.col("url")), "_html": F.coalesce("html", F.lit(""))})
    seen = rows.select(F.col("_host").alias("host"), F.col("_html").alias("html"))
    suffix = saved(host_suffixes(seen), "page_suffixes")
    n_pages = suffix.groupBy("host").agg(F.count_distinct("page").alias("n"))
    runs = saved(repeated(suffix, n_pages), "page_runs")
    hits = suffix.join(runs, ["host", "own", "run"]).select(F.col("host").alias("_host"), F.col("page").alias("_page"), F.explode(F.expr("sequence(at, at + lines - 1)")).alias("at"))
    gone = counted_small(hits.groupBy("_host", "_page").agg(F.collect_set("at").alias("_gone")), "page_gone")
    dropped(suffix, runs)
    rows = rows.withColumn("_page", F.xxhash64("_html")).join(gone, ["_host", "_page"], "left")

    @F.pandas_udf("string")
    def main_text(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for text, covered in zip(part["_html"], part["_gone"], strict=True):
                if covered is None:
                    out.append(" ".join(blocks(text)[0]))
                else:
                    covered = set(covered.tolist())
                    out.append(" ".join(s for k, s in enumerate(lines(text)[0]) if k not in covered))
            yield pd.Series(out, dtype=object)

    return rows.withColumn("text", main_text(F.struct("_html", "_gone"))).drop("_host", "_html", "_page", "_gone")


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``; see :func:`extracted`."""
    found = extracted(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
