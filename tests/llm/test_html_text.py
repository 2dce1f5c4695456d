"""Main text of pages against the pages' articles, and of difficult markup."""

import re
from collections import Counter
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonelens.llm import html_text, queries

from .conftest import SF

BODY = "<p>" + "Words of the article that go on for a while. " * 4 + "</p>"
TEXT = " ".join(("Words of the article that go on for a while. " * 4).split())


def test_op6_rows(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.QUERIES["op6_html_text"](spark, SF).collect()
    assert {r.page_id for r in rows} == pages.keys()
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.DOTALL)[1]
        article = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))
        assert r.text == " ".join(unescape(article).split()) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("<script>if (a<b) { '</p>' }", ""),
        ("<!-- <p>gone</p>", ""),
        (f"<div id=sidebar>x</div><div><h1>Title</h1>{BODY}<p>End.</p></div><div class='cookie-notice'>We use</div>", f"Title {TEXT} End."),
        (f"<body><header>Site</header><article><header><h1>Title</h1></header>{BODY}<aside>no</aside><p>d</article><footer>f</footer>", f"Title {TEXT} d"),
        (f"<article>{BODY}<section class=comments><p>first!</p></section></article><div>{'far away ' * 40}</div>", TEXT),
        (f"<nav><a href='/'>Home</a></nav><form><input name=q>search</form><main>{BODY}<div class=ad>Buy</div>{BODY}</main>", f"{TEXT} {TEXT}"),
        ("<article><p>a<b>b</b>c &amp; d &lt;e&gt; &#233; f\n\t g<br>h</article>", "abc & d <e> é f g h"),
        (f"<article class=comment>{BODY}</article><div>{BODY}</div>", TEXT),
        (f"<div>{BODY}<p hidden>not seen</p><p style='display: none'>nor this</p><ul><li>one<li>two</ul></div>", f"{TEXT} one two"),
        ("just text, 1 < 2, no markup <p", "just text, 1 < 2, no markup"),
        ("<p title='a > b'>x</p>", "x"),
    ],
)
def test_difficult_markup(html, text):
    assert html_text.main_text(html) == text


def test_runs_surge_and_dive():
    lengths = np.array([0, 3, 0, 0, 0, 0, 90, 0, 40, 5, 0, 0, 0, 7])
    assert [r[:2] for r in html_text.runs(lengths)] == [(1, 2), (6, 10), (13, 14)]
    assert html_text.runs(np.zeros(5, np.int64)) == []


def test_article_is_evidence_and_windows_decide():
    ads = "<aside>ad</aside>" * 5
    long = "<p>" + "The story itself, told at some length in a plain element. " * 15 + "</p>"
    story = " ".join(html_text.main_text(long).split())
    # A marked run without a surge goes; one behind blank lines with a surge stays.
    assert html_text.main_text(f"<article>{BODY}{ads}<p>By Ann</p>{ads}{BODY}</article>") == f"{TEXT} {TEXT}"
    # A marked teaser does not hide the text of the page.
    assert html_text.main_text(f"<div>{long}{long}</div>{ads}<article><p>Read more</p></article>") == f"{story} {story}"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<p>one</p><svg class="i"/><p>two</p><math/><p>three</p>', "one two three"),
        ("<p>one</p><object-view>two</object-view><title-bar>three</title-bar><select-box>four</select-box>", "one two three four"),
        ("<p>one</p><svg class='i'><title>no</title></svg><p>two</p>", "one two"),
        (f'<div class="has-sidebar"><div class="sidebar">links</div>{BODY}{BODY}</div><p>Imprint</p>', f"{TEXT} {TEXT} Imprint"),
        (f'<div class="sidebar">links</div><article class="post comments-open">{BODY}{BODY}</article>', f"{TEXT} {TEXT}"),
        (f'<section id="legal-history">{BODY}</section>', TEXT),
        (f'<form id="aspnetForm"><div class="menu">Home</div>{BODY}</form>', TEXT),
        (f'<div class="widget text">{BODY}</div><div class="widget text">{BODY}</div><div class="share">Share</div>', f"{TEXT} {TEXT}"),
        (f"<div>{BODY}</div><div class='comments'>{BODY}{BODY}</div>", TEXT),
    ],
)
def test_pages_do_not_vanish(html, text):
    assert html_text.main_text(html) == text


MENU = [f"Menu item {i}" for i in range(12)]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("".join(f"<div>{m}</div>" for m in MENU) + f"<h1>Title</h1>{BODY}<p>Short one.</p>{BODY}<div>Imprint</div><div>Contact</div>", f"Title {TEXT} Short one. {TEXT}"),
        ("<table>" + "".join(f"<tr><td>{m}</td></tr>" for m in MENU) + f"<tr><td>{TEXT}</td></tr><tr><td>Imprint</td></tr></table>", TEXT),
        ("<ul>" + "".join(f"<li>{m}</li>" for m in MENU) + f"</ul><ul><li>{TEXT}</li><li>{TEXT}</li></ul>", f"{TEXT} {TEXT}"),
        ("<table><tr><td>" + "".join(f"<div>{m}</div>" for m in MENU) + f"</td><td>{BODY}{BODY}</td></tr></table>", f"{TEXT} {TEXT}"),
        (f"{BODY}<ul>" + "".join(f"<li>{n}</li>" for n in "abcdef") + f"</ul>{BODY}" + "".join(f"<p><a href='/{m}'>{m}, told in a sentence of some length.</a></p>" for m in MENU), f"{TEXT} a b c d e f {TEXT}"),
        ("<div>Home</div><div>About</div><p>A short article here, that is all.</p><div>Imprint</div>", "A short article here, that is all."),
    ],
)
def test_pages_of_plain_markup(html, text):
    assert html_text.main_text(html) == text


def test_windows_decide(monkeypatch):
    """Without marks, and with windows that call nothing light, menus and footers come along."""
    page = "".join(f"<div>{m}</div>" for m in MENU) + f"{BODY}{BODY}" + "".join(f"<div>{m}</div>" for m in MENU)
    assert html_text.main_text(page) == f"{TEXT} {TEXT}"
    monkeypatch.setattr(html_text, "heavy_lines", lambda lengths, *_: lengths > 0)
    monkeypatch.setattr(html_text, "SHORT", 0)
    assert html_text.main_text(page) == " ".join([*MENU, TEXT, TEXT, *MENU])


def test_pages_without_their_marks(spark):
    """Articles found again in the given pages when every mark (article, class, id, role) is taken from them."""
    kept = given = found = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        bare = re.sub(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", r.html)
        bare = re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", bare)
        a, b = Counter(html_text.main_text(r.html).split()), Counter(html_text.main_text(bare).split())
        kept, given, found = kept + (a & b).total(), given + a.total(), found + b.total()
    assert kept >= 0.99 * given and kept >= 0.94 * found


def test_pages_awkward(spark):
    values = [(1, "u", None), (None, None, "<article>x</article>"), (2, "u", ""), (2, "u", ""), (3, "u", "<article>" + "<p>line</p>" * 50_000 + "</article>")]
    pages = spark.createDataFrame(values, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    rows = html_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 1), (1, 0), (2, 0), (2, 0), (3, 50_000 * 5 - 1)]
    assert html_text.extract(pages.limit(0)).count() == 0
