import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tetraflow.llm import html


class Plain(HTMLParser):
    """All text outside script, style and title."""

    def __init__(self):
        super().__init__()
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_no_visible_word_of_the_whole_table_is_lost(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    by_id = {r.page_id: r.html for r in pages.collect()}
    for r in html.extract(pages).collect():
        plain = Plain()
        plain.feed(by_id[r.page_id])
        plain.close()
        squeeze = lambda s: re.sub(r"[\s-]+", "", s)
        assert squeeze(r.text) == squeeze("".join(plain.out))


@pytest.mark.parametrize(
    "source,text",
    [
        (None, ""),
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a<div>b</div>c", "a\nb\nc"),
        ("a<br>b<br><br>c", "a\nb\nc"),
        ("x <b>y</b><i> z</i>", "x y z"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e", "- a\n- b\n  3. c\n  4. d\n\ne"),
        ("<ol reversed><li value=5>a<li>b</ol>", "5. a\n4. b"),
        ("<table><tr><th>Name<th>Qty<tr><td>apples<td>12<tr><td>fig<td>9</table>", "Name    Qty\napples  12\nfig     9"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td colspan=2>ab<td>z<tr><td>c<td>d<td>e</table>", "ab    z\nc  d  e"),
        ("<pre>\n a\n  b</pre>", " a\n  b"),
        ("a<script>x</p></script><style>q</style><!-- c --><p hidden>n<p style='Display : none'>m<p>b", "a\n\nb"),
        ("<title>t</title><head><meta x></head><body>ok</body>", "ok"),
        ("&lt;b&gt; &amp; &nbsp;&eacute; &bogus;", "<b> & \xa0é &bogus;"),
        ("<b>x</p>y</q>z", "xyz"),
        ("a <!-- unclosed", "a"),
        ("a < b > c <3", "a < b > c <3"),
        ("<textarea>\nt &amp; u</textarea>", "t & u"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ("<noscript>n</noscript><template>t</template><dialog>d</dialog>v", "v"),
    ],
)
def test_layout(source, text):
    assert html.render(source) == text


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "<p>x"), (3, "<p>x"), (3, "<p>x"), (4, "<p a='" * 3000), (5, "<table>" * 500 + "x"), (6, "w " * 200_000), (7, "<li>" * 2000 + "y")]
    pages = spark.createDataFrame([(a, b, 1) for a, b in rows], "page_id long, html string, text int")
    got = html.extract(pages).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(a) for a, _ in rows)
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "source,text",
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=t>x=2</annotation></math> holds", "so x=2 holds"),
        ("a<svg><title>t</title><desc>d</desc><defs><text>u</text></defs><text>one</text><text>two</text><path d='x'/><text>three</text></svg>b", "a one two three b"),
        ("<svg><defs/><text>seen</text></svg>", "seen"),
        ("<svg><defs><path></defs><p>after", "after"),
        ("<desc>d</desc><defs>e</defs>", "de"),
        ("<div>" * 200 + "<p hidden>no</p>yes" + "</div>" * 200 + "<p>end", "yes\n\nend"),
        ("<div>" * 200 + "<ul><li>a<li>b</ul>", "- a\n- b"),
        ("<b>" * 200 + "<i><b>x</b></i>" + "</b>" * 200 + "<p hidden>n", "x"),
    ],
)
def test_formulas_pictures_and_depth(source, text):
    assert html.render(source) == text


def test_deep_pages_end_in_time():
    for part in ("<ul><li>x", "<i>", "<p><b>", "<b><td></b>", "<table><tr><td>"):
        assert html.render(part * 3000 + "end").split()[-1].endswith("end")


@pytest.mark.parametrize(
    "source",
    ["<a '" * 500_000, "<a b='" * 300_001, "<a" * 1_000_000, "<a b=" * 300_000, "<" * 1_000_000, "</" * 500_000, "<!" * 500_000, "<p a='\"" * 200_000 + ">x", "<!--" * 300_000, "<a b=\"'" * 200_001 + ">" * 9, "&" * 500_000, "<b a=' " * 100_000 + "> x" * 100_000],
    ids=lambda s: s[:8],
)
def test_hostile_pages_take_linear_time(source):
    began = time.time()
    html.render(source)
    assert time.time() - began < 5


@pytest.mark.parametrize(
    "source",
    [
        "<table><tr><td>" + "w" * 20_000 + "<td>x" + "<tr><td>a<td>b" * 100_000 + "</table>",
        "<table><tr>" + "<td>" + "<td>".join("c" * 100 for _ in range(2000)) + "<tr><td colspan=1000><td>x" * 50_000 + "</table>",
        "<table>" + "<tr><td colspan=1000 rowspan=65534>x" * 20_000 + "</table>",
        "<table><tr>" + "<td>y" * 900 + "<td>" + "z<br>" * 100_000 + "</table>",
        "<ul><li>" * 300 + "x<br>" * 300_000,
    ],
    ids=["long cell", "spans", "rows", "tall cell", "indents"],
)
def test_layout_stays_in_proportion_to_the_page(source):
    began = time.time()
    assert len(html.render(source)) < 7 * len(source) + 20_000
    assert time.time() - began < 30


@pytest.mark.parametrize(
    "source,text",
    [
        ("<p a=\"x>y\" b='>'>in</p>", "in"),
        ("<p don't>text</p>more", "text\n\nmore"),
        ("<a href=\"broken>one</a> two <b>three</b>", "one two three"),
        ("text <a hre", "text"),
        ("a</>b</ >c<!doctype x>d<?php e?>f", "abcdf"),
        ("<p a = \"1>2\">x", "x"),
    ],
)
def test_tags_end_where_they_should(source, text):
    assert html.render(source) == text


@given(st.lists(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=5), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_tables_equal_a_plain_layout(rows):
    source = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows) + "</table>"
    widths = [max((len(r[i]) for r in rows if i < len(r)), default=0) for i in range(5)]
    assert html.render(source) == "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows)


_LISTS = st.recursive(st.text("xyz", min_size=1, max_size=4), lambda inner: st.lists(inner, min_size=1, max_size=4), max_leaves=12)


@given(st.lists(_LISTS, min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_lists_equal_a_plain_layout(tree):
    def source(items):
        return "<ul>" + "".join(f"<li>{x}</li>" if isinstance(x, str) else f"<li>head{source(x)}</li>" for x in items) + "</ul>"

    def plain(items, depth):
        out = []
        for x in items:
            out.append("  " * depth + "- " + (x if isinstance(x, str) else "head"))
            if not isinstance(x, str):
                out += plain(x, depth + 1)
        return out

    assert html.render(source(tree)) == "\n".join(plain(tree, 0))
