"""Main text of pages: those of the tables, and layouts of other kinds."""

import html
import re
import time

import pytest

from corvane.llm.html_text import HtmlText, Weights, _labelled, extract, learn, main_text, op9_main_text, parse


def article(page):
    """The article of the tables' own template, read with its markup known."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|h2|ul|li|div|blockquote)\b[^>]*>", inside)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def test_pages(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = op9_main_text(spark, d).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


TEXT = "Some words of the main text that go on for a while, so that there is enough of it to tell."
CASES = {
    "article": (f"<nav><a href=x>Menu one</a> <a>two</a></nav><article><h1>T &amp; t</h1><p>{TEXT}<p>Second&nbsp;<b>bo</b>ld<br>line</article><footer>Foot of the page with several words in it</footer>", f"T & t\n\n{TEXT}\n\nSecond bold line"),
    "no article": (f"<body><div id=menu><ul><li><a>Home</a><li><a>News</a></ul></div><div class=content><h1>Title</h1><p>{TEXT}</p><p>{TEXT}</p><p>End.</p></div><div class='sidebar'><p>Popular and other words</p></div></body>", f"Title\n\n{TEXT}\n\n{TEXT}\n\nEnd."),
    "comments": (f"<main><article><p>{TEXT}</p><aside>Aside text here</aside><p>Tail.</p></article><section class=comments><p>{TEXT} I think so too, says a reader of this page.</p></section></main>", f"{TEXT}\n\nTail."),
    "inner parts": (f"<article><div class='cookie-notice'>We use cookies</div><p>{TEXT}</p><form>Sign <input> up</form><div class='advert'><p>Buy</p></div><script>var a='<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> --><ul><li>One</li><li>Two</li></ul><section id=comments><article>reader says</article></section></article>", f"{TEXT}\n\nOne\n\nTwo"),
    "only words": (TEXT, TEXT),
    "empty": ("", ""),
    "no words": ("<html><body><p> </p></body></html>", ""),
    "open end": (f"<article><p>{TEXT}<p>More <i>text", f"{TEXT}\n\nMore text"),
    "attributes": (f"<article data-x='a>b' class=post><p title=\"<p>\">{TEXT}</p></article>", TEXT),
    "entities": (f"<article><p>{TEXT} &lt;b&gt; &#233; &#x1F600; &copy &unknown; a &amp;lt; b</p></article>", f"{TEXT} <b> é \U0001f600 © &unknown; a &lt; b"),
}


@pytest.mark.parametrize("name", CASES)
def test_layouts(name):
    page, want = CASES[name]
    assert extract(page, Weights()) == want


def test_deep_and_unmatched_tags_cost_no_more_than_flat_ones():
    page = "<div>" * 20_000 + "</x>" * 20_000 + "<article>" * 5_000 + "<header>" * 5_000 + TEXT
    assert extract(page, Weights()) == TEXT and sum(_labelled(parse(page))) == 4_999 + 5_000 + 1


def test_nulls_and_columns(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", f"<p>{TEXT}", "x"), (3, "u", "<article>" * 3000 + "deep words here", "y")], "page_id long, url string, html string, text string")
    weights = learn(df)
    got = {r.id: (r.url, r.text, r.n_chars) for r in main_text(df, weights).collect()}
    assert got == {1: (None, "", 0), None: ("u", TEXT, len(TEXT)), 3: ("u", "deep words here", 15)}
    assert main_text(df.limit(0), Weights()).collect() == [] and learn(df.limit(0)) == Weights()


LINKS = "<ul><li><a href=x>First work cited</a><li><a href=y>Second work cited</a></ul>"
CITED = "First work cited\n\nSecond work cited"
MANY = "<p>" + "buy this now " * 60 + "</p>"
PARTED = {
    "long ad between sections": (f"<article><section><p>{TEXT}</p></section><div class=ad>{MANY}</div><section><p>Tail.</p></section></article>", f"{TEXT}\n\nTail."),
    "references": (f"<article><section><p>{TEXT}</p></section><section><h2>References</h2>{LINKS}</section></article>", f"{TEXT}\n\nReferences\n\n{CITED}"),
    "references in main": (f"<nav><a>Home</a></nav><main><div><p>{TEXT}</p></div><aside>{MANY}</aside><div>{LINKS}</div></main><footer>Foot</footer>", f"{TEXT}\n\n{CITED}"),
    "title before contents": (f"<article><header><h1>T</h1></header><nav>{LINKS * 9}</nav><div><p>{TEXT}</p></div></article>", f"T\n\n{TEXT}"),
    "sections alone": (f"<body><div><a>Home</a> <a>News</a></div><section><p>{TEXT}</p></section><form>{MANY}</form><section><div>{LINKS}</div></section><div><a>Imprint</a></div></body>", f"{TEXT}\n\n{CITED}"),
    "parts without article": (f"<body><div id=content><div><p>{TEXT}</p></div><div class=ad>{MANY}</div><div><p>{TEXT}</p></div></div></body>", f"{TEXT}\n\n{TEXT}"),
}


@pytest.mark.parametrize("name", PARTED)
@pytest.mark.parametrize("weights", [Weights(), Weights({"a": -4.0, ".ad": -4.0, "nav": -4.0, "aside": -4.0, "form": -4.0})])
def test_articles_in_parts(name, weights):
    page, want = PARTED[name]
    assert extract(page, weights) == want


KEPT = {
    "article names": (f"<article class='post no-sidebar'><p>{TEXT}</p></article>", TEXT),
    "article marked": (f"<article class='related' id=widget><p>{TEXT}</p></article>", TEXT),
    "content names": (f"<div id=content class='with-comments'><p>{TEXT}</p></div><div id=comments-area><p>A reader says this.</p></div>", TEXT),
    "heading": (f"<article><p>{TEXT}</p><h2 id='discussion'>Discussion</h2><p>Tail.</p></article>", f"{TEXT}\n\nDiscussion\n\nTail."),
    "anchor": (f"<article><h2><span id='Related_work'>Related work</span></h2><p>{TEXT} <span id=comments>Of comments.</span></p></article>", f"Related work\n\n{TEXT} Of comments."),
    "entry": (f"<article><div class='entry social-science'><p>{TEXT}</p></div><p>Tail.</p></article>", f"{TEXT}\n\nTail."),
    "whole page": (f"<body><div class=widget><div class=message><h1>T</h1><p>{TEXT}</p></div><div class=ads><p>Buy</p></div></div></body>", f"T\n\n{TEXT}"),
    "whole page hidden": (f"<body><div hidden><div class=widget><p>{TEXT}</p></div></div></body>", ""),
    "left out": (f"<article><p>{TEXT}</p><div class='main-sidebar'>a b</div><div class='siteFooter'>c d</div><div id=related_links>e f</div><p class='ad-box'>g h</p><section class=comments><article class=comment>i j</article></section><span class=ad>k</span></article>", TEXT),
}


@pytest.mark.parametrize("name", KEPT)
def test_names_of_elements(name):
    page, want = KEPT[name]
    assert extract(page, Weights()) == want


def plain(page):
    """The same page without tags and names that tell an article from what is around it."""
    page = re.sub(r"<(/?)(?:nav|footer|article)\b[^>]*>", r"<\1div>", page)
    return page.replace('<div class="ad">', "<div>")


def test_the_scan_and_what_was_learned_decide(spark):
    """On pages that say nothing about their parts: right with both, wrong without either."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = learn(pages)
    htmls = [r.html for r in pages.collect()]
    want = [article(x) for x in htmls]
    assert [extract(plain(x), weights) for x in htmls] == want
    whole = lambda parts, w: (0, len(parts) - 1)
    assert not any(extract(plain(x), weights, whole) == t for x, t in zip(htmls, want, strict=True))
    assert not any(extract(plain(x), Weights()) == t for x, t in zip(htmls, want, strict=True))
    few = learn(pages, HtmlText(contexts=1))
    assert len(few.words) + len(few.tags) <= 2


BARE = {
    "around": (f"<body><div><a>Home</a> <a>News</a> <a>All</a></div><h1>T</h1><p>{TEXT}</p><p>End.</p><div><a>Imprint</a> <a>Privacy</a></div></body>", f"T\n\n{TEXT}\n\nEnd."),
    "parts of blocks": (f"<body><ul><li><a>One</a></li><li><a>Two</a></li></ul><div>{TEXT} <a>link</a> more.</div><ul><li><a>Three</a></li><li><a>Four</a></li></ul></body>", f"{TEXT} link more."),
    "unlike the labelled": (f"<body><div><a>x</a></div><div><div>{TEXT}</div><div>{TEXT}</div></div></body>", f"{TEXT}\n\n{TEXT}"),
}


@pytest.mark.parametrize("name", BARE)
def test_pages_without_articles(name):
    page, want = BARE[name]
    assert extract(page, Weights()) == want
    assert extract(page, Weights({"article": 4.0, "<div>": -4.0, "a": -4.0}, {"div": -4.0, "/div": -4.0})) == want


def test_unclosed_tags_take_linear_time():
    n = 60_000
    for page in ("<a " * n, "<a '" + "<a " * n + "' x>", '<a "' * n, "<a <b " * n + ">", "</a " * n, "<!x" * n, "<script x" * n, "<p>" + "<a title='x" * n):
        start = time.perf_counter()
        extract(page, Weights())
        assert time.perf_counter() - start < 5
    assert extract(f"<article><p>{TEXT} <a href=x <b>bold</b> x < y <p>z</article>", Weights()) == f"{TEXT} bold x < y\n\nz"
