"""Extraction on pages written for it, on broken and very large ones, and against plain patterns on the given table."""

import html
import re
import time

import pyarrow.parquet as pq
import pytest

from rillspark.llm import queries
from rillspark.llm.html_text import Page, extract_text, main_text

LONG = "This sentence, which is rather long, goes on about the matter at hand, and so does the next one."
MENU = "".join(f'<li><a href="/{i}">Entry {i}</a></li>' for i in range(12))

CASES = {
    "article": (f"<html><body><nav><ul>{MENU}</ul></nav><article><h1>Head &amp; tail</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; us</footer></body></html>", f"Head & tail {LONG} Short."),
    "no article element": (f'<body><div id="top-menu">{MENU}</div><div class="content"><h2>Title</h2><p>{LONG}</p><p>{LONG}</p><ul><li>one</li><li>two</li></ul></div><div class="sidebar"><p>{LONG}</p></div></body>', f"Title {LONG} {LONG} one two"),
    "unnamed link list": (f"<body><div><ul>{MENU}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG} {LONG}"),
    "sections are siblings": (f"<body><div id=x><h1>T</h1><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div><p>End.</p></div><div>{MENU}</div></body>", f"T {LONG} {LONG} {LONG} End."),
    "comments": (f'<main><article><p>{LONG}</p></article><section id="comments"><h2>3 comments</h2>' + f'<div class="comment-body"><p>{LONG} {LONG}</p></div>' * 9 + "</section></main>", LONG),
    "comments as articles": (f'<body><div class="post"><p>{LONG}</p><p>{LONG}</p></div>' + f'<article class="comment"><p>{LONG}</p></article>' * 5 + "</body>", f"{LONG} {LONG}"),
    "parts inside the article": (f'<article><header><h1>T</h1></header><div class="ad">Buy, buy, buy</div><p>{LONG}</p><aside>Also</aside><form><label>Name</label><input></form><div class="share-buttons">Like</div><footer>by me</footer></article>', f"T {LONG}"),
    "cookie notice": (f'<body><div class="cookie-notice"><p>{LONG}</p><p>{LONG}</p></div><div role="banner">Site, name</div><div role="main"><p>{LONG}</p>x</div></body>', f"{LONG} x"),
    "scripts and styles": (f'<body><script>var a = "</p><p>{LONG}";</script><style>p{{}}</style><noscript>Turn it on</noscript><p>{LONG}<!-- <p>no</p> --> a<b>b</b>c</p></body>', f"{LONG} abc"),
    "unclosed": (f"<body><div><p>{LONG}<p><b>Second<br>line<p>Third<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", f"{LONG} Second line Third one two a b c"),
    "stray ends": (f"<body></div></p></b><article></section><p>{LONG}</i></p></td></article></body></html>", LONG),
    "head without end": (f"<html><head><title>No</title><meta charset=x><body><p>{LONG}</p>", LONG),
    "references": (f"<article><p>{LONG} &lt;b&gt; &#233;&#x41; &nbsp; &hellip; &notaref; 3 < 4 &amp;amp;</p></article>", f"{LONG} <b> éA … ¬aref; 3 < 4 &amp;"),
    "quoted brackets": (f"""<article><p title="a > b" class='x'>{LONG}</p><a href=">">y</a></article>""", f"{LONG} y"),
    "unclosed quote": (f'<article><p class="x>{LONG}</p><p>more</p></article>', f"{LONG} more"),
    "wrapper with a name": (f'<body><div class="page menu-open"><h1>T</h1><p>{LONG}</p></div></body>', f"T {LONG}"),
    "all in a form": (f"<body><form><div><p>{LONG}</p></div></form></body>", LONG),
    "text alone": ("just text,\n no  markup", "just text, no markup"),
    "names of categories": (f'<body><article class="post-7 category-menu tag-ad has-sidebar"><p>{LONG}</p></article></body>', LONG),
    "nothing": ("<html><head><title>t</title></head><body><!-- x --></body></html>", ""),
    "empty": ("", ""),
    "open comment": (f"<p>{LONG}</p><!-- <p>gone</p>", LONG),
    "open tag": (f"<p>{LONG}</p><div class=", LONG),
    "table of data": (f"<article><p>{LONG}</p><table><thead><tr><th>a</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table></article>", f"{LONG} a 1 2"),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    source, want = CASES[name]
    assert main_text(source) == want


@pytest.mark.parametrize(
    "source",
    ["<div>" * 60_000 + LONG, "<b>" * 60_000 + LONG + "</b></i>" * 60_000, "<" * 300_000, "<b><div>" + "<i>" * 60_000 + "</b>" * 60_000, "<ul>" + "<b><li></li>" * 60_000, "<table><thead>" + "<td><div>" * 60_000,
     "<p>" + LONG * 20_000 + "</p>", '<a b="' * 60_000, "<!--" * 100_000, "</p>" * 100_000, "&amp" * 200_000, "<script>" * 60_000],
)
def test_time_grows_with_length(source):
    start = time.time()
    main_text(source)
    assert time.time() - start < 5


def test_tree():
    page = Page("<ul><li>a<ul><li>b</ul><li>c</ul><dl><dt>x<dd>y</dl>")
    assert [page.tag[page.parent[i]] for i in range(1, len(page.tag))] == ["#page", "ul", "li", "ul", "ul", "#page", "dl", "dl"]


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", CASES["article"][0], "x"), (1, "u", CASES["article"][0], "x"), (None, None, None, "y"), (2, "v", "", "z")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = CASES["article"][1]
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "u", want, len(want)), (1, "u", want, len(want)), (None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_query_equals_patterns_on_the_given_pages(spark):
    """The given pages have one article element each, so patterns find what tree scoring should."""
    path = "/root/testdata/sf0.01"
    pages = pq.read_table(f"{path}/pages.parquet").to_pylist()
    want = {}
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        want[p["page_id"], p["url"]] = " ".join(html.unescape(re.sub(r"</?(?:h1|p|br)\b[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in queries.op11_html_text(spark, path).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}
