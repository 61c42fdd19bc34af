import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from ledgerloom.llm import html_text
from ledgerloom.llm.html_text import extract, report, visible_text

CASES = {
    "": "",
    "plain <b>bold</b> text": "plain bold text",
    "<p>one<p>two<div>three</div>four": "one\n\ntwo\n\nthree\nfour",
    "<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t='</p>';</script></head><body>yes</body></html>after": "yesafter",
    "<title>no</title>text <!-- gone --> more": "text more",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e": "- a\n- b\n  - c\n- d\n\ne",
    "<ol start=9><li>x<li>y</ol>": "9. x\n10. y",
    "<table><tr><th>name<th>n<tr><td>long name<td>7</table>": "name       n\nlong name  7",
    "<table><td>a</td><td colspan=2>b</td><tr><td rowspan=2>c<td>d<td>e<tr><td>f<td>g</table>z": "a  b\nc  d  e\n   f  g\n\nz",
    "<table><tr><td><table><tr><td>in</table></table>": "in",
    "<table>stray<tr><td>cell</table>": "stray\ncell",
    "<p hidden>no</p><p style='display: none'>no</p><p style='visibility:hidden'>no <b style='visibility:visible'>yes</b></p>": "yes",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>u</details>": "s\nt\nu",
    "<pre>  a\n    b</pre>": "  a\n    b",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "&lt;&amp;&eacute;&#233;&middot;": "<&éé·",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n    d\nu\n    e",
    "<blockquote>q</blockquote>r": "    q\n\nr",
    "a < b <c": "a < b <c",
    "<a href='x>y'>link</a>": "link",
    "<noscript>no</noscript><template>no</template><textarea>shown</textarea>": "shown",
    "<select><option>a<option>b</select>": "a\nb",
    "</p></td></table>x</b>": "x",
    "<script>never ends": "",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert visible_text(html) == CASES[html]


def test_deep_and_long_pages():
    assert visible_text("<div>" * 20000 + "deep") == "deep"
    assert visible_text("<ul><li>" * 50 + "deep").endswith("- deep")
    assert visible_text("<p>" + "word " * 100000).count("word") == 100000
    assert visible_text("<" * 50000) == "<" * 50000


def test_report(spark):
    rows = [(1, "u", None, "t"), (2, "u", "", "t"), (3, "u", "<p>a<p>b", "t"), (3, "u", "<p>a<p>b", "t"), (None, "u", "x", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, report(df).collect()), key=str)
    assert got == sorted([(1, None, None, None), (2, "", 0, 0), (3, "a\n\nb", 4, 3), (3, "a\n\nb", 4, 3), (None, "x", 1, 1)], key=str)
    assert extract(df, ["text", "page_id"]).columns == ["text", "page_id", "text"]
    assert report(df.where("false")).collect() == []


@pytest.mark.parametrize("cut", ["<b and then some thirty more characters, and no end", "<a href=\"" + "y " * 20000, "<b " + "word " * 20000])
def test_page_cut_in_a_tag_ends(cut):
    assert visible_text("<p>shown</p>" + cut).startswith("shown")


SHOWN = {
    "<tr><td>one</td><td>two</td></tr>": "one  two",
    "<table><tr><td>a</td></tr></table><tr><td>late</td></tr>": "a\n\nlate",
    "<svg><title>no</title><defs><text>no</text></defs><path d='m'/><text>Jan</text><text>Feb</text></svg>": "Jan\nFeb",
    "<svg><defs/><text>label</text></svg> after": "label after",
    "E = <math><semantics><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>no</annotation></semantics></math>": "E = mc2",
}


@pytest.mark.parametrize("html", SHOWN)
def test_rows_and_pictures_are_shown(html):
    assert visible_text(html) == SHOWN[html]


def test_every_visible_text_node_is_in_the_output():
    rng = random.Random(4)
    tags = "p div b ul ol li dl dt dd table tr td th tbody thead caption blockquote pre svg text g math mi h1 section a span select option".split()
    for _ in range(3000):
        bits, said = [], []
        for _ in range(rng.randint(1, 25)):
            tag = rng.choice(tags)
            bits.append(rng.choice([f"<{tag}>", f"<{tag}>", f"</{tag}>"]))
            if rng.random() < 0.6:
                said.append(f"w{len(said)}w")
                bits.append(said[-1])
        got = visible_text("".join(bits))
        assert all(got.count(w) == 1 for w in said), ("".join(bits), got)


LONG = 300_000


@pytest.mark.parametrize(
    "page",
    ["<a " + "x" * LONG, "<a " * (LONG // 3), "<a b='>'" * (LONG // 8), "<a " + "=" * LONG, "<script>" + "</script " * (LONG // 9), "<" * LONG, "<div>" * (LONG // 5), "<table>" + "<tr><td colspan=65534 rowspan=65534>x<td>y" * 3000],
)
def test_very_long_pages_end(page):
    start = time.perf_counter()
    visible_text(page)
    assert time.perf_counter() - start < 10


class Shown(HTMLParser):
    """The words of all text outside of elements that show none, by the standard library's tokens."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template") or "hidden" in dict(attrs):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_all_visible_words_of_made_pages():
    rng = random.Random(8)
    blocks = ["div", "p", "section", "span", "b", "ul", "li", "h2", "em", "blockquote"]

    def made(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if depth and kind < 0.5:
                tag = rng.choice(blocks)
                shut = "" if tag in ("p", "li") and rng.random() < 0.5 else f"</{tag}>"
                inside = f"w{rng.randrange(10**6)} &amp; x" if tag == "p" else made(depth - 1)
                out.append(f"<{tag}>{inside}{shut}")
            elif kind < 0.6:
                out.append(f"<table><tr><td>c{rng.randrange(10**6)}<td colspan=2>d{rng.randrange(10**6)}<tr><th>e{rng.randrange(10**6)}</table>")
            elif kind < 0.7:
                out.append(f"<script>var a = 'no{rng.randrange(99)}';</script><style>b {{}}</style>")
            elif kind < 0.75:
                out.append(f"<div hidden>gone{rng.randrange(99)}</div>")
            else:
                out.append(f" t{rng.randrange(10**6)} <br> é&lt;{rng.randrange(99)} ")
        return "".join(out)

    for _ in range(200):
        page = made(4)
        want = Shown()
        want.feed(page)
        got = Counter(w for w in visible_text(page).split() if not re.fullmatch(r"-|[0-9]+\.", w))
        assert got == Counter(want.words), page


def test_long_cells_push_aside_their_own_line_only():
    rows = [([f"k{k}"], 1, 1) for k in range(5000)]
    lines = html_text.set_table([[c, (["v"], 1, 1)] for c in rows] + [[(["x" * 499], 1, 1), (["v"], 1, 1)], [(["y" * 900], 1, 1), (["w"], 1, 1)]])
    assert {line.index("v") for line in lines[:5001]} == {502}
    assert lines[5001] == "y" * 900 + "  w"


def test_padding_is_bounded_line_by_line():
    wide = [(["c" * 30], 1, 4000) for _ in range(300)]
    lines = html_text.set_table([[*wide, (["end"], 1, 1)]] + [[(["t"], 1, 1)] for _ in range(3000)])
    assert lines[0].endswith("c  end") and set(lines[1:]) == {"t"}
