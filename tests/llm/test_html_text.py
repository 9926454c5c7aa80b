import re

import pytest

from dossier.llm import html_text
from dossier.llm.html_text import main_text, read_page, without


def page(article, nav="Home About", extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">{nav}</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>{extra}<article>{article}</article><footer>&copy; x</footer></body></html>'


def text(source):
    return "\n".join(read_page(source)[0])


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("plain &lt;b&gt; text", "plain <b> text"),
    (page("<h1>A &amp;amp; B</h1><p><b>one<br><p>two\n  three</p><p>four"), "A &amp; B\none\ntwo three\nfour"),
    (page("<p>a<script>x</script>b</p><aside>no</aside><div class='comments'><p>no</p></div><form><p>no</p></form><p>&eacute;&#233;&#xe9; &nbsp; x&am</p>"), "ab\nééé x&am"),
    (page("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><p>e <a title='x>y' href=q>f</a> g"), "a\nb\nc\nd\ne f g"),
    ("<div><header>H</header><p>body <i>text</i></p><div id=cookie-notice>no</div></div>", "body text"),
    ("<main><p>m</p></main><p>no</p>", "m"), ("<article><p>cut in the mid", "cut in the mid"), ("<p>a</p><p", "a"),
    ("<article><p>A <a title=it's>link</a> tail don't stop</p><p>more</p></article>", "A link tail don't stop\nmore"), ("<article><p>A <a title=it's>link</a> tail</p></article>", "A link tail"), ("<p a=x>y' q=\"1>2\" z</p>", "y' q=\"1>2\" z"),
    ("<article><h2 id='comments'>Comments on law</h2><div class='share-of-market'>Share</div><section class='related'><p>Long text about related things.</p></section><p>x</p></article>", "Comments on law\nShare\nLong text about related things.\nx"),
    ("<article><p>x</p><div class='related'><a href=a>More</a> <a href=b>Most</a></div><div class='story ad'>Buy</div><div class='comments'>no</div></article>", "x"), ("<div class='main-nav'>n</div><div class='x nav y'>n</div><p>t</p>", "t"),
    ("<b><article><p>one</b> two</p></article>", "one two"), ("<p>a<svg/>b <svg><text>no</text></svg>c", "ab c"), ("<p>a<!-->b--> c<!-- x --!>d", "ab--> cd"), ("<table><tr><td>a</div>b<td>c</table>d", "ab\nc\nd"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
    ("<p>a<script>if (x</b>) '</scripty>'</script >b", "ab"), ("<p title='x class=ad y'>kept</p>", "kept"), ("<article><video><p>no</p></video><p>yes</p></article>", "yes"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
])
def test_rules(source, want):
    assert text(source or "") == want


def test_time_in_proportion():
    import time

    spent = []
    for n in (20_000, 80_000):
        hard = ["<b>" * n + "<p>x" * n, "<div>" * n + "<p>x</p>" * n, "<b>" * n + "<td>x</td>" * n, "<p a='" * n, "<" * (8 * n), "<a b=" * n, "<!--" * n, "<b>" * n + "</i>" * n, "<ul><li>" * n]
        began = time.thread_time()
        for source in hard:
            read_page(source)
        spent.append(time.thread_time() - began)
    assert spent[1] < 10 * spent[0] + 1


def test_deleted_elements_take_what_they_hold():
    blocks, inner, keys, ups = read_page("<body><div>a<section>b<div>c</div></section></div><div>d</div></body>")
    assert blocks == ["a", "b", "c", "d"] and [ups[i] for i in inner] == [-1, inner[0], inner[1], -1]
    assert without(blocks, inner, keys, ups, {keys[inner[1]]}) == "a\nd" and without(blocks, inner, keys, ups, {keys[inner[0]]}) == "d"


def test_templates(spark, monkeypatch):
    rows = []
    for i in range(40):
        link = "<div><a href='/x'>More of this site</a></div>"
        rows.append((i, f"http://a.example/{i}", f"<body><div>Site name</div><p>Article {i}</p><div><span>Always here</span></div></body>"))
        rows.append((100 + i, f"https://b.example/{i}", page(f"<p>Same words</p><p>Only {i}</p>{link}")))
    rows += [(200, "http://c.example/", "<div>Site name</div><p>x</p>"), (201, None, "<p>x</p>"), (202, "nonsense", None), (None, "http://c.example/", ""), (202, "nonsense", None)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, host string")
    for most in (html_text.MOST_SENT, 0):
        monkeypatch.setattr(html_text, "MOST_SENT", most)
        got = {(r.page_id, r.url): r for r in main_text(df).collect()}
        assert len(got) == len(set(r[:2] for r in rows))
        for i in range(40):
            assert got[i, f"http://a.example/{i}"].text == f"Article {i}"
            assert got[100 + i, f"https://b.example/{i}"].text == f"Same words\nOnly {i}"
        assert got[200, "http://c.example/"].text == "Site name\nx" and got[201, None].text == "x" and got[202, "nonsense"].n_chars == 0
    assert main_text(df.limit(0)).count() == 0


def test_driver_pages_by_pattern(spark):
    """The test pages are simple enough for a pattern."""
    import html

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in df.collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p)))).strip() for p in parts]
        want[r.page_id] = "\n".join(p for p in parts if p)
    assert {r.page_id: r.text for r in main_text(df).collect()} == want
