"""The renderer against a second reading of the same pages: the standard library's parser, and no layout."""

import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lodeweave.llm import html_extraction as html

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"head", "script", "style", "template", "noscript", "title"}
WORD = re.compile(r"[^\W_]+")


class Visible(HTMLParser):
    """Text pieces outside hidden elements, by a stack of (name, displayed, visible) of well-nested pages.

    It does not know the standard's odd comments (``<!-->``), which have tests of their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out = [("", True, True)], []

    def handle_starttag(self, tag, attrs):
        given = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        style = dict(x.lower().replace(" ", "").split(":", 1) for x in given.get("style", "").split(";") if ":" in x)
        _, shown, visible = self.stack[-1]
        if self.stack[-1][0] == "details closed":
            shown = shown and tag == "summary"
        shown = shown and tag not in HIDDEN and (style["display"] != "none" if "display" in style else "hidden" not in given)
        visible = {"hidden": False, "visible": True}.get(style.get("visibility"), visible)
        if tag not in VOID:
            self.stack.append((f"{tag} closed" if tag == "details" and "open" not in given else tag, shown, visible))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if any(n.split()[0] == tag for n, _, _ in self.stack if n):
            while self.stack.pop()[0].split()[0] != tag:
                pass

    def handle_data(self, data):
        name, shown, visible = self.stack[-1]
        if shown and visible and name != "details closed":
            self.out.append(data)


def visible(page):
    parser = Visible()
    parser.feed(page or "")
    parser.close()
    return "".join(parser.out)


def letters(text):
    """What must be kept: how often each letter or number occurs; layout adds none of them but list numbers."""
    return Counter(c for c in text if c.isalnum())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_all_pages_keep_exactly_their_visible_text(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages, "page_id", "html").collect()}
    rows = pages.select("page_id", "html").collect()
    assert len(got) == len(rows) > 0
    for r in rows:
        want, have = letters(visible(r.html)), letters(got[r.page_id])
        extra = have - want
        assert not want - have, (r.page_id, want - have)
        assert all(c.isdigit() for c in extra) and ("<ol" in (r.html or "") or not extra), (r.page_id, extra)


def odd_page(r):
    """A well-nested page of random elements, styles, quotes and comments, with numbered words."""
    count = iter(range(10**6))
    word = lambda: f"w{next(count)}x"
    attributes = ["", " class=a'b", ' title="it\'s > here"', " title='say \"<b>\"'", " title=it's", " a=b/c", " hidden", " style=display:none", ' style="color:red; DISPLAY : none"', " style=visibility:hidden", ' style="visibility:visible"', " x=1 x=2", ' a="1"b=2', " =odd", " hidden style='display:block'"]

    def inside(depth):
        out = []
        for _ in range(r.randint(1, 4)):
            kind = r.random()
            if kind < 0.4 or depth > 6:
                out.append(r.choice([" ", "", "\n"]) + word() + r.choice([" ", "", " &amp; ", " < "]))
            elif kind < 0.5:
                out.append(r.choice(["<!-- hidden -->", "<!---->", "<!-- a > b -->", "<script>if (a<b) x='</p>'</script>", "<style>p{}</style>", "<br>", "<img alt=no>", "<wbr>", "<?php no ?>"]))
            elif kind < 0.6:
                out.append(f"<table{r.choice(attributes)}>" + "".join("<tr>" + "".join(f"<td{r.choice(attributes)} colspan={r.randint(0, 3)}>{inside(depth + 2)}</td>" for _ in range(r.randint(1, 3))) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.7:
                out.append("<ul>" + "".join(f"<li{r.choice(attributes)}>{inside(depth + 1)}</li>" for _ in range(r.randint(1, 3))) + "</ul>")
            elif kind < 0.75:
                out.append(f"<details{r.choice(['', ' open'])}><summary>{word()}</summary>{inside(depth + 1)}</details>")
            else:
                tag = r.choice(["div", "section", "span", "blockquote", "em", "pre", "article"])
                out.append(f"<{tag}{r.choice(attributes)}>{inside(depth + 1)}</{tag}>")
        return "".join(out)

    return inside(0)


def test_generated_pages_keep_exactly_their_visible_words():
    r = random.Random(9)
    for _ in range(1500):
        page = odd_page(r)
        found, want = Counter(re.findall(r"w\d+x", html.render(page))), Counter(re.findall(r"w\d+x", visible(page)))
        assert found == want, page


@pytest.mark.parametrize(("page", "text"), [
    ("<p title=it's>hello world</p><p>second</p><p>don't stop</p>", "hello world\n\nsecond\n\ndon't stop"),
    ("<a href=x title=it's>visible text</a> tail", "visible text tail"),
    ("<p class=a'b>one<p>two", "one\n\ntwo"),
    ("<div style=visibility:hidden>a<span style=visibility:visible>b</span>c</div>", "b"),
    ("<details>x<summary>s</summary>y<p>z</details>after", "s\nafter"), ("<details open><summary>s</summary>y</details>", "s\ny"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"), ("a<!-->b<!--->c<!-- x --!>d", "abcd"),
    ("<ol><li>a<li style=visibility:hidden>b<li>c</ol>", "1. a\n3. c"), ("a<plaintext>b</plaintext> <p>c", "a\n\nb</plaintext> <p>c"),
    ("<svg a=b/><text>q</text></svg>z", "q z"), ("<svg><g display=none><text>q</text></g><text>r</text></svg>z", "r z"),
    ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e</table>", "a | b | c\n  | d | e"),
    ("<i>a<div>b</i>c</div>d", "a\nbc\nd"), ("<p x='never closed>text", ""),
])
def test_rules_of_tags_and_visibility(page, text):
    assert html.render(page) == text


@pytest.mark.parametrize(("page", "words"), [
    ("<ul><li>x" * 8000, 8000), ("<div>" * 50_000 + "x", 1), ("<table><tr><td>" + "x" * 20_000 + "<td>x" + "<tr><td>x<td>x" * 3000, 26_001),
    ("<table><tr>" + "<td rowspan=9999>x" * 1000 + "<tr><td>x" * 3000, 4000), ("<table><tr><td>x<tr><td>x<td>" * 3000, 6000),
    ("<i>" * 20_000 + "<div>" * 20_000 + "</i>" * 20_000 + "x", 1), ("<table><tr>" + "<td>x" * 5000 + "<td>" + "x<br>" * 5000, 10_000),
])
def test_layout_is_linear_in_the_page(page, words):
    began = time.time()
    out = html.render(page)
    assert out.count("x") == words and len(out) < 25 * len(page) and time.time() - began < 20


def test_odd_rows_and_columns(spark):
    rows = [(None, "<p>a", "x"), (1, "<p>b", "x"), (1, "<p>b", "x"), (2, None, None), (3, "", "y"), (4, "<p>" + "long text " * 200_000, "z")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string").withColumns({"key": F.lit(1), "n_lines": F.lit("q")}).repartition(2)
    got = html.extract(df, "page_id", "html")
    assert got.columns == ["page_id", "text", "n_lines"]
    have = sorted((str(r.page_id), len(r.text), r.n_lines) for r in got.collect())
    assert have == [("1", 1, 1), ("1", 1, 1), ("2", 0, 0), ("3", 0, 0), ("4", 1_999_999, 1), ("None", 1, 1)]
