import html
import re
import time

import pytest

from pagegauge.llm import html_text

SITE = """<!doctype html><html><head><title>Not this</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><a href="/">Home</a></nav><div class="page"><aside>Elsewhere: a long list of other things to read</aside>{body}
<div id="comments"><div class="comment"><p>I have read this and I have a very long opinion on all of it, which I will now give in full length,
for all to see, again and again.</p></div></div></div><div class="cookie-notice">We use cookies.</div><footer>Imprint</footer>
<script>document.write("<p>no</p>")</script></body></html>"""


@pytest.mark.parametrize("body, want", [
    ("<article><h2>Head</h2><p>First  para\n graph &amp; more.<p>Second<br>one</article>", "Head\n\nFirst para graph & more.\n\nSecond one"),
    ("<div id=content><h2>Head</h2><p>A paragraph that is long enough to be the article of this page.</p><ul><li>One item</li><li>Two items</li></ul></div>",
     "Head\n\nA paragraph that is long enough to be the article of this page.\n\nOne item\n\nTwo items"),
    ("<main><p>Text before <b>bold <i>both</b> after</i> the form.</p><form><p>Sign up</p></form><blockquote>Quote</blockquote></main>",
     "Text before bold both after the form.\n\nQuote"),
    ("<article><header><h1>Title</h1></header><p>Body of it&nbsp;all &eacute; &#233; &#x1F642;</p><div class='ad'>Buy</div><footer>Tags</footer></article>",
     "Title\n\nBody of it all é é 🙂"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><p title=it's>one <a href='x>y'>two</a></article>", "a\n\nb\n\nc\n\none two"),
])
def test_pages(body, want):
    assert html_text.main_text(SITE.format(body=body)) == want


def test_given_pages(small):
    """The given pages name their article, so a plain cut of it is the whole answer."""
    for row in small("pages").collect():
        article = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        blocks = re.split(r"</?p>|</?h1>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        want = "\n\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)
        assert html_text.main_text(row.html) == want


@pytest.mark.parametrize("page", [
    "", "plain", "<" * 200_000, "<div " + 'a="b" ' * 100_000 + ">x", "<p>" + "<a href=\"x>y</a>" * 50_000, "<div>" * 50_000 + "x", "<b>" * 30_000 + "</i>" * 30_000,
    "<!--" * 50_000, "<script>" * 50_000, "<a b='" * 50_000, "<table>" + "<tr><td>x" * 20_000, "</p>" * 50_000, "&#x110000;&#0;&bogus;&amp", "<p\0x>y",
])
def test_strange_pages_take_linear_time(page):
    start = time.time()
    assert isinstance(html_text.main_text(page), str)
    assert time.time() - start < 10


def test_densest_subtree_wins():
    page = "<body><div><a href=1>x y</a><a href=2>z w</a></div><div><p>" + "words of text " * 20 + "</p><p>" + "more words " * 20 + "</p></div></body>"
    assert html_text.main_text(page) == ("words of text " * 20).strip() + "\n\n" + ("more words " * 20).strip()


def test_edges(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "just text", "x"), (3, "u", "<p>twice</p>", "x"), (3, "u", "<p>twice</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_text.extract(pages).collect() if r.url)
    assert got == [(0, "u", "just text", 9), (1, "u", "", 0), (3, "u", "twice", 5), (3, "u", "twice", 5)]
    assert html_text.extract(pages).count() == 5 and html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("before", [
    "<svg><path d=1>", "<template><div>no</div>", "<noscript><img src=x>", "<math><mi>", "<div><svg><g></div>", "<svg><title>t</title><path/></svg>",
    "<template><div>no</template>", "<noscript><p>no</noscript>", "<template></div></p><li>no</template>", "<svg><text>no</text></svg>", "<svg/>",
])
def test_markup_of_its_own_does_not_end_the_page(before):
    body = "words of text " * 20
    page = f"<html><head><noscript><div>no</div></noscript></head><body><div>{before}<article><p>{body}<p>x is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here</article></div></body>"
    assert html_text.main_text(page) == body.strip() + "\n\nx is E=m here"


@pytest.mark.parametrize("tag", ["svg", "template", "noscript", "math"])
def test_repeated_open_tags_take_linear_time(tag):
    start = time.time()
    html_text.main_text(f"<{tag}>" * 50_000 + "<p>x")
    html_text.main_text(f"<{tag}>" * 50_000 + f"<p>x</{tag}>")
    html_text.main_text(f"<{tag}><p>x</{tag}>" * 20_000)
    assert time.time() - start < 20
