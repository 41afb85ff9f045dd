import html
import re
from html.parser import HTMLParser

import pytest

from offerlake.llm import extraction, queries

FOLDER = "/root/testdata/sf0.01"
FILL = "The council met on Tuesday, and after a long debate it agreed to mend the bridge before winter comes."


class Article(HTMLParser):
    """A plain reading of pages whose main text is their only article: lines end at p and h1."""

    def __init__(self, source):
        super().__init__()
        self.inside, self.lines = False, [[]]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.handle_endtag(tag) if tag in ("p", "h1") else self.lines[-1].append(" " if tag == "br" else "")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.lines.append([])

    def handle_data(self, data):
        if self.inside:
            self.lines[-1].append(data)

    def text(self):
        return "\n".join(line for parts in self.lines if (line := " ".join("".join(parts).split())))


def text(body, winners=()):
    return extraction.main_text(f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>", list(winners))[0]


def test_query_equals_a_plain_reading(llm):
    want = {r.page_id: (r.url, Article(r.html or "").text()) for r in llm.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    found = queries.QUERIES["op13_html_extraction"](llm, FOLDER).collect()
    assert {r.page_id: (r.url, r.text) for r in found} == want and all(r.n_chars == len(r.text) for r in found)


def test_what_is_left_out():
    page = f"""
    <header class="site-header"><h1>Site name</h1><nav><a href="/">Home</a> <a href="/b">More</a></nav></header>
    <div id="cookie-notice">We use cookies on this site to make it better for you.</div>
    <div class="page has-sidebar"><article class="post-77">
      <header><p>Filed under news</p><h1>The &quot;bridge&quot;&nbsp;is   mended</h1></header>
      <p>{FILL} <b>Bold&amp;</b>&lt;i&gt;<br>next <span class="ad">Buy now!</span>line</p><script>var t = "</p>";</script>
      <ul class="share-buttons"><li><a href="#">Share</a></li></ul>
      <ul><li>one<li>two</ul><div>Bare text of a block</div>
      <table><tr><td>a<td>b<tr><td>c</table>
      <form><input><label>Your mail</label></form><!-- <p>hidden</p> -->
      <section id="comments"><h3>2 comments</h3><article class="comment"><p>{FILL} Nonsense, says a reader.</p></article></section>
    </article><aside class="sidebar"><h2>Most read</h2><p>{FILL}</p></aside></div>
    <footer>&copy; 2024</footer>"""
    assert text(page).split("\n") == ['The "bridge" is mended', f"{FILL} Bold&<i> next line", "one", "two", "Bare text of a block", "a b", "c"]


@pytest.mark.parametrize("body,want", [
    ("", ""), ("just text &amp more", "just text & more"), (f"<p>{FILL}<p>{FILL}", f"{FILL}\n{FILL}"), ("<p>a < b and c<d", "a < b and c"),
    ("<script>only()", ""), (f"<div class=x>{FILL}</div><!-- open <p>no", FILL), (f"<p title='a>b' class=it's>{FILL}</p>", FILL),
    (f"<div class='content'><h2>Head</h2><p>{FILL}</p></div><div class='related-posts'><a href='x'>{FILL}</a></div>", f"Head\n{FILL}"),
    (f"<main><p>{FILL}</p><template><p>no</p></template><noscript>no</noscript></main>", FILL),
    (f"<div role=navigation>{FILL}</div><p>One.</p>", "One."), ("<nav>Only a menu</nav>", ""), (f"<form id='aspnet'><h1>Head</h1><p>{FILL}</p></form>", f"Head\n{FILL}"),
])
def test_single_pages(body, want):
    assert text(body) == want


def test_hosts_decide(llm):
    """The path most pages of a host vote for is used where a page alone would choose another."""
    def page(n, main, side):
        return f"<body><div class='wrap'><div class='c{n} left'><p>{main}</p></div><div class='box right'><p>{side}</p></div></div></body>"

    rows = [(i, "http://Host.example/p", page(i, f"{FILL} " * 20 + str(i), "Short.")) for i in range(12)]
    rows += [(50, "http://host.example/odd", page(50, FILL, FILL * 2)), (51, "http://other.example/odd", page(51, FILL, FILL * 2))]
    rows += [(60, None, None), (61, "::bad url", ""), (62, "http://host.example/x", f"<p>{FILL}</p>"), (None, "http://host.example/n", "<nav>x</nav>"), (50, "http://host.example/odd", page(50, FILL, FILL * 2))]
    pages = llm.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    found = extraction.extract(pages).collect()
    texts = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and found[0].asDict().keys() == {"page_id", "url", "text", "n_chars", "path"}
    assert all(texts[i] == " ".join([FILL] * 20 + [str(i)]) for i in range(12))
    assert texts[50] == FILL and texts[51] != FILL and texts[62] == FILL
    assert texts[60] == texts[61] == texts[None] == ""
    assert extraction.extract(pages.limit(0)).count() == 0


def test_long_and_broken_pages_take_linear_time():
    for part in ("<div>", "<b>", "<p><b>", "<a href=\"", "<!--", "<", "<script>", "<table><td>", "<li>", "&amp", "x<br>", "</b>"):
        extraction.main_text(part * 60_000, [])
    long = "<article>" + "".join(f"<p>Line {i} &lt;{i}&gt;.</p>" for i in range(60_000)) + "</article>"
    assert extraction.main_text(long, [])[0] == "\n".join(f"Line {i} <{i}>." for i in range(60_000))
    assert html.unescape("&lt;") == "<" and re.fullmatch(extraction.TOKEN, "<p a='>'>")
