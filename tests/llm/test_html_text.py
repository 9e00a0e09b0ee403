"""Operator 3: layout by example, and all visible text against a plain parser."""

import random
import re
import time
from html.parser import HTMLParser

import pytest

from sievework.llm.html_text import extract_text, render

CASES = [
    (None, ""),
    ("", ""),
    ("plain", "plain"),
    ("a  b\n c", "a b c"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("a<br>b<br/><br>c", "a\nb\n\nc"),
    ("<b>bo</b>ld <i>x</i>", "bold x"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>a</li><li>b</li></ol>", "9. a\n10. b"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"),
    ("<table><tr><th colspan=2>head over all<tr><td>a<td>b</table>", "head over all\na  b"),
    ("<table><tr><td>x<br>y<td>z</table>", "x  z\ny"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("<head><title>t</title></head>x<script>if (a<b) '</p>'</script><style>p{}</style>y", "xy"),
    ("<div hidden>a</div><div style='color:red;display : NONE'>b</div><span style='visibility:hidden'>c</span>d", "d"),
    ("<details><summary>s</summary>h</details><details open><summary>t</summary>v</details>", "s\nt\nv"),
    ("<dialog>no</dialog><template>no</template><input type=hidden value=no><input type=submit value=Go>", "Go"),
    ("a &lt; b &amp; c < d &copy;", "a < b & c < d ©"),
    ("<dl><dt>t<dd>d</dl>", "t\n    d"),
    ("<p><b>x<p>y</b>z", "x\n\nyz"),
    ("</div></p>x</table></td>", "x"),
    ("<!-- a > b -->x<!doctype html><![CDATA[ y ]]>", "x y"),
    ("<p title='a>b' x=\"<p>\">t</p>", "t"),
    ("x<unclosed attr", "x"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<textarea>a\n b</textarea>", "a\n b"),
    ("日本<table><tr><td>日本<td>a<tr><td>x<td>b</table>", "日本\n\n日本  a\nx     b"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_layout(page, text):
    assert render(page) == text


class Plain(HTMLParser):
    """Every text outside hidden elements, without layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "template"):
            self.skip += 1
        elif tag in ("script", "style"):
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in ("head", "script", "style", "template") and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def letters(text):
    return re.sub(r"\s+", "", text)


def plain(page):
    p = Plain()
    p.feed(page)
    p.close()
    return letters("".join(p.out))


def test_pages_keep_all_visible_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_text(pages).collect()}
    for r in pages.collect():
        # list marks are ours: a line's leading "- " isn't in the page
        mine = "\n".join(re.sub(r"^ *- ", "", line) for line in got[r["page_id"]].split("\n"))
        assert letters(mine) == plain(r["html"]), r["page_id"]
    assert len(got) == pages.count()


def test_random_markup_never_fails_and_keeps_words():
    rng = random.Random(4)
    bits = ["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<span>", "</span>", "<br>", "<h2>", "</h2>", "<section>", "</section>", "<!-- c -->", "&amp;", "<dl>", "<dd>", "</dl>", "<a href='x'>", "</a>", "<blockquote>", "</blockquote>"]
    for _ in range(400):
        words = [f"w{i}w" for i in range(8)]
        page = "".join(rng.choice(bits) + (words[i // 3] if i % 3 == 0 else " ") for i in range(24))
        text = render(page)
        assert sorted(re.findall(r"w\dw", text)) == sorted(re.findall(r"w\dw", page)), page


def test_hostile_pages():
    for page in ("<div>" * 20000 + "x", "<" * 5000, "<p a='" * 3000, "<a " + "b" * 100000, "<li>" * 3000 + "y", "<table>" * 300 + "z", "&" * 10000, "<td>" * 1000 + "q", "\x00<p>\x00"):
        assert isinstance(render(page), str)
    assert render("<p>" + "long " * 200000).count("long") == 200000


def test_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "x"), (None, None, "y"), (2, "", "z")], "page_id long, html string, text string").repartition(2)
    assert sorted(map(str, map(tuple, extract_text(df).collect()))) == sorted(map(str, [(1, "a", 1), (1, "a", 1), (None, "", 0), (2, "", 0)]))
    assert extract_text(df.limit(0)).count() == 0


def test_visibility_and_display():
    hidden = "<div style='visibility:hidden'>a<b style='visibility:visible'>shown</b>c</div>"
    assert render(hidden) == "shown"
    assert render("<div style='display:none'>a<b style='visibility:visible;display:block'>b</b></div>x") == "x"
    assert render("<p style='display:none;display:block'>x</p>") == "x" and render("<p style='display:none!important;display:block'>x</p>") == ""
    assert render("<ul style='visibility:collapse'><li>a<li style='visibility:visible'>b</ul>") == "- b"


def test_rowspan_and_item_values():
    page = "<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>"
    assert render(page).split("\n") == ["a  b  c", "   d  e", "f  g  h"]
    assert render("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>").split("\n") == ["a  b", "   c", "   d"]
    assert render("<ol><li>a<li value=7>b<li>c</ol>").split("\n") == ["1. a", "7. b", "8. c"]


def test_padding_is_bounded():
    """A wide cell beside very many short ones, and a far column in every row."""
    pages = ["<table><tr><td>" + "w " * 20000 + "<td>x" + "<tr><td>a<td>b" * 4000 + "</table>"]
    pages.append("<table><tr>" + "<td>column" * 900 + "<tr><td>a<td colspan=898><td>z" * 2000 + "</table>")
    pages.append("<table><tr><td>" + "line<br>" * 3000 + "<td>" + "<tr><td><td>" + "r" * 90 + "</table>")
    for page in pages:
        text = render(page)
        assert len(text) < 12 * len(page)
        assert sorted("".join(text.split())) == sorted(re.sub(r"<[^>]*>|\s", "", page))


@pytest.mark.parametrize("shape", ["<div>{n}", "<b>{n}", "<ul><li>{n}", "<span>{n}", "<p><table><tr><td>{n}"])
def test_nesting_is_linear(shape):
    """A hundred thousand open elements, among them many tags that look for open ones."""
    tag = shape.replace("{n}", "")
    began = time.perf_counter()
    text = render("<a>" + tag * (100_000 // tag.count("<")) + "x" + "</a><li>y</i><p>z" * 1000)
    assert "x" in text and time.perf_counter() - began < 20 and len(text) < 2_000_000
    assert text.count("z") == 1000
