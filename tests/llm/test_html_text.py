"""Main text of pages: templates with a known article, a second reader for the driver's pages, and broken markup."""

import html
import random
import re
from html.parser import HTMLParser

import pytest
from oracle import SF_DIR, available

from meterline.llm import html_text, queries

ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>bold</b>ly said.<br>Next&nbsp;line<p>Second \n  one.</article>"
TEXT = "Title & more First boldly said. Next line Second one."


def text_of(page):
    return " ".join(html_text.blocks(page)[0])


@pytest.mark.parametrize(
    "around",
    [
        "%s", "<nav><ul><li>Home<li>News</ul></nav>%s<footer>&copy; us</footer>", "<div class='ad'>Buy <p>now</div>%s", '<div id="site-header"><p>Logo</div><main>%s</main><aside>More</aside>',
        "<!-- <p>old</p> -->%s<script>var t='</p>';if(a<b){}</script><style>p{}</style>", "<form><p>Name<input></form>%s<section class=\"post-comments\"><article><p>Great!</article></section>",
        "<div role=navigation>Up</div>%s<div class=cookieNotice>We use cookies", "%s<noscript><p>enable</noscript><div hidden class='share'>x</div></body></html>", "<title>T</title>%s<p>later <footer", "<DIV CLASS=\"SideBar\">x</DIV>%s",
    ],
)
def test_article_without_its_surroundings(around):
    assert text_of(f"<!DOCTYPE html><html lang=en><head><meta charset=utf-8></head><body class='has-sidebar'>{around % ARTICLE}") == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("plain & simple &lt;b&gt;", "plain & simple <b>"), ("<p>a<p>b</p></p>c", "a b c"), ("a<br>b<i>c</i>d", "a bcd"), ("<p>x</p", "x"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<div><span>a</div>b</span>c", "a bc"), ("<ul><li>a<li>b</ul>", "a b"), ("<p>a</p><script>never closed <p>b", "a"), ("<p>a<!-- never closed <p>b", "a"), ("<p title='x>y'>a</p>", "a"), ("<p title='open>a</p><p>b</p>", "a b"),
        ("&amp;amp; &#233; &#xE9; &nosuch; &copy", "&amp; é é &nosuch; ©"), ("<table><tr><td>a<td>b</table>", "a b"), ("<p>a</nav></div></p>b", "a b"), ("<?xml x?><p>a", "a"),
    ],
)
def test_markup(page, text):
    assert text_of(page) == text


def test_long_pages_take_linear_time():
    import time

    began = time.time()
    for page in ("<p " + "'" * 200_000, '<p a="' * 100_000, "<" * 200_000, "<b>" * 100_000 + "x", "<!--" * 100_000, "&" * 200_000, "<p>a " * 100_000, "<script>" * 50_000):
        text_of(page)
    assert time.time() - began < 30


def brute(pages):
    """Lines to drop of ``(host, html)`` pages by comparing every run of whole lines with every other page's."""
    streams = {}
    for host, page in pages:
        if host and page:
            streams.setdefault(host, {})[page] = html_text.lines(page)
    out = []
    for host, page in pages:
        stream, own = html_text.lines(page or "")
        gone = set()
        if host and page:
            others = streams[host]
            several = [p for p in others if next(html_text.suffixes(others[p][0]), None)]
            for i in range(len(stream)):
                for j in range(i + 1, len(stream) + 1):
                    run = stream[i:j]
                    if sum(len(s.split(" ")) for s in run) >= html_text.LONG:
                        same = sum(any(s[k : k + len(run)] == run for k in range(len(s))) for s, o in others.values() if o == own)
                        least, share = html_text.INSIDE if own else html_text.OUTSIDE
                        if same >= max(least, -(-len(several) * int(share * 100) // 100)):
                            gone |= set(range(i, j))
                        break
        out.append(" ".join(s for k, s in enumerate(stream) if k not in gone))
    return out


def generated(seed):
    r = random.Random(seed)
    say = lambda n: " ".join(f"w{r.randint(0, 4000)}" for _ in range(n))
    top, foot, note = "One two three. Home. News. Sport. Weather today here.", "All rights reserved by the people of this site. Terms.", "Please support our work with a gift of any size."
    pages = []
    for k in range(90):
        host = ["a.example", "b.example", "c.example", ""][min(k % 7, 3)] if k % 7 < 4 else "a.example"
        body = [f"<p>{say(r.randint(3, 12))}. {say(5)}.</p>" for _ in range(r.randint(0, 4))]
        if r.random() < 0.5:  # nothing marked: only repetition tells
            pages.append((host, f"<body><div>{top}</div>{''.join(body)}<div>{foot}</div></body>"))
        else:
            pages.append((host, f"<body><div>{top}</div><article>{''.join(body)}<p>{note}</p></article></body>"))
    return pages + [pages[0], pages[0], ("d.example", "<p>Printed on one page of its host only, so it stays.</p>"), ("d.example", None)]


def test_repeated_runs_equal_brute_force(spark):
    pages = generated(7)
    rows = [(k, f"http://{h}/x?y" if h else None, p, "clash") for k, (h, p) in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(table.repartition(5)).collect()}
    expected = brute(pages)
    assert [got[k] for k in range(len(pages))] == expected
    bare = next(t for t, (h, p) in zip(expected, pages, strict=True) if h == "a.example" and "<article>" not in p and "<p>" in p)
    assert "reserved" not in bare and "Weather" not in bare and bare
    assert expected[-2].startswith("Printed") and not expected[-1]


def test_edges(spark):
    rows = [(None, None, None), (1, "http://h.example/", ""), (1, "http://h.example/", ""), (2, "no host", "<p>alone &amp; kept</p>"), (3, "http://h.example/a", "<p>" + "long text " * 50_000)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got.collect()) == [(0, 0), (1, 0), (1, 0), (2, 12), (3, 499_999)]
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class Reader(HTMLParser):
    """A second reading of the driver's template: what stands inside the article element."""

    def __init__(self):
        super().__init__()
        self.inside, self.text = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.text.append(" " if tag in ("p", "h1", "br") else "")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.text.append(" " if tag in ("p", "h1") else "")

    def handle_data(self, data):
        if self.inside:
            self.text.append(data)


@pytest.mark.skipif(not available(), reason="driver tables are absent")
def test_query_equals_second_reading(spark):
    got = queries.QUERIES["op13_html_text"](spark, SF_DIR).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        reader = Reader()
        reader.feed(pages[r["page_id"]])
        reader.close()
        expected = " ".join("".join(reader.text).split())
        assert r["text"] == expected and r["n_chars"] == len(expected)
        assert re.sub(r"\s", "", html.unescape(r["url"])) == r["url"]
