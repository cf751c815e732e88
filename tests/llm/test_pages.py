"""What decides the text of a page, and pages that are hard to read."""

import os
import random
import re
import time
import tracemalloc

import duckdb
import numpy as np
import pytest

from procurisk.llm import html_text

PAGES = "/root/testdata/sf0.01/pages.parquet"
needs_data = pytest.mark.skipif(not os.path.isfile(PAGES), reason="no test data")
P = "<p>This is a long enough paragraph, with commas, and full stops. It says something.</p>"
TEXT = P[3:-4]


@pytest.fixture(scope="module")
def pages():
    return [row[0] or "" for row in duckdb.sql(f"SELECT html FROM '{PAGES}' ORDER BY page_id").fetchall()]


def plain_article(page):
    """The blocks of the only article by a plain walk, without any ratio: the answer for the generated pages."""
    body = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    body = re.sub(r"<(script|style|form|aside|nav|div class=\"(?:ad|comments?|sidebar|cookie)[^\"]*\").*?</\1>", "", body, flags=re.DOTALL)
    found = re.split(r"</?(?:h1|h2|h3|p|ul|ol|li|div|blockquote|table|tr|td|figure|figcaption|pre|section)\b[^>]*>", body)
    texts = (" ".join(html_text.html.unescape(re.sub(r"<br[^>]*>", " ", x)).split()) for x in found)
    return [t for t in (re.sub(r"<!--.*?-->|</?[a-z][^>]*>", "", x).strip() for x in texts) if t]


@needs_data
def test_values_of_paths_decide(pages, monkeypatch):
    texts = [html_text.main_text(page) for page in pages]
    choose = np.random.default_rng(1)
    for values in (lambda page, _: choose.random(len(page.text)) * 20, lambda page, _: np.ones(len(page.text))):
        with monkeypatch.context() as changed:
            changed.setattr(html_text, "path_values", values)
            other = [html_text.main_text(page) for page in pages]
        assert sum(a != b for a, b in zip(texts, other)) > 0.9 * len(pages)


@needs_data
def test_against_a_plain_walk(pages):
    checked = 0
    for page in pages:
        if page.count("<article>") == 1 and not re.search(r"<article>.*<(?:div|form|aside|nav|table|ul)", page, re.DOTALL):
            text = html_text.main_text(page)
            assert re.sub(r"\s+", "", text) == re.sub(r"\s+", "", "".join(plain_article(page)))
            checked += 1
    assert checked > 0.3 * len(pages)


@needs_data
def test_without_article_elements(pages):
    """With plain divs in place of articles no heading of the article is lost."""
    for page in pages[:120]:
        heading = re.search(r"<article><h1>(.*?)</h1>", page, re.DOTALL)
        if heading:
            plain = page.replace("<article>", "<div>").replace("</article>", "</div>")
            title = " ".join(html_text.html.unescape(heading[1]).split())
            assert html_text.main_text(plain).split("\n\n")[0] == title


def test_content_that_is_kept():
    def article(body):
        return f"<html><body><div class=nav><a href=x>One</a></div><article><h1>Title</h1>{body}</article><footer>Imprint, all rights.</footer></body></html>"

    def text(body):
        return html_text.main_text(article(body)).split("\n\n")

    assert text(P + "<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be given.</p>") == ["Title", TEXT, "Let x=1 be given."]
    sources = text(P + "<h2>Sources</h2><ul><li><a href=q>First source</a></li><li><a href=r>Second</a></li></ul>")
    assert sources == ["Title", TEXT, "Sources", "First source", "Second"]
    for control in ("button", "select", "label"):
        assert text(f"{P}<{control}>Click{P}{P}") == ["Title", TEXT, TEXT, TEXT]
    assert text(f"<p data-x=it's>Whole paragraph, it is kept.</p>{P}<p>it's the end.</p>") == ["Title", "Whole paragraph, it is kept.", TEXT, "it's the end."]
    assert text(P).count("Imprint, all rights.") == 0
    assert html_text.main_text("<p>One word</p>") == "One word" and html_text.main_text("<nav><a href=x>Home</a></nav><footer>Imprint</footer>") == ""


def test_pages_without_any_names():
    links = "<div><a href=x>Home</a> <a href=y>About us</a></div>"
    page = f"<body>{links}<div>Buy now!</div><div><h2>Head line</h2>{P * 3}<ul><li>short item</li></ul></div><div>Copyright 2020 Some Company</div></body>"
    assert html_text.main_text(page).split("\n\n") == ["Head line", TEXT, TEXT, TEXT, "short item"]


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 50_000, "<p x=" + "'" * 200_000 + ">", "<a '" * 50_000, '<a ="' * 50_000, "<a =\"'" * 50_000, "<" * 200_000, "<a " * 70_000,
        "</" * 100_000, "<!" * 100_000, "<div>" * 20_000 + "</p>" * 100_000, "<span>" * 50_000 + "</div>" * 50_000,
        "<article class=ad>" * 50_000, "<ul><li>" * 30_000, "<button>" * 50_000, "<script " * 30_000, "<script>" + "</script " * 30_000,
    ],
)
def test_time_and_memory_are_linear(page):
    started = time.process_time()
    html_text.main_text(page + P)
    assert time.process_time() - started < 2
    tracemalloc.start()
    html_text.main_text(page + P)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6


def test_any_soup_is_read():
    choose = random.Random(8)
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "<li>", "<ul>", "</ul>", "<table><tr><td>", "</table>", "text, with a stop.", "<", ">", "'", '"',
            "<a href='x'>", "</a>", "&amp;", "&#x1F600;", "<br>", "<!--", "-->", "<script>", "</script>", "<article>", "</article>", "<form>", "\x00"]
    for _ in range(2000):
        assert isinstance(html_text.main_text("".join(choose.choice(bits) for _ in range(choose.randint(0, 40)))), str)
