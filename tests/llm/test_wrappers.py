"""Wrappers and main texts of pages, and their edge cases."""

import functools
import html
import json
import re

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import wrappers
from ledgerlark.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def test_articles_of_all_pages(spark):
    found = {r.page_id: r for r in wrappers.main_texts(table(spark, SF_DIR, "pages")).collect()}
    for page in table(spark, SF_DIR, "pages").collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", page.html, re.DOTALL)[1]
        inside = re.sub(r"<[^>]*>", lambda tag: "" if tag[0] in ("<b>", "</b>") else " ", inside)
        wanted = " ".join(html.unescape(inside).split())
        assert (found[page.page_id].text, found[page.page_id].n_chars, found[page.page_id].url) == (wanted, len(wanted), page.url)


PAGE = """<!doctype html><HTML><head><title>T</title><style>p{}</style></head><body class="home">
<div id="cookie-notice">We use <b>cookies</b></div><header><h1>Site</h1><nav><ul><li><a>Home</a></ul></nav></header>
<div class=sidebar><p>Side</div><main><h1>Ti<em>t</em>le</h1><p>One &amp; two&nbsp;x<br>three<p>Unclosed <a href='a>b'>link</a>
<script>var a = "<p>no</p>";</script><div class="ad-box advert">Buy</div><form>Mail<input></form><table><tr><td>c1<td>c2</table>
<div class="comments"><p>Nice!</p></div></main><footer>&copy; 2020</footer></body></html>"""


def test_regions():
    assert wrappers.main_text(PAGE) == "Title One & two x three Unclosed link c1 c2"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain < text & more", "plain < text & more"),
        ("<p>a<p>b<ul><li>c<li>d</ul>e", "a b c d e"),
        ("<!-- <p>x</p> --><p>a<!-- open", "a"),
        ("<script>never closed <p>x", ""),
        ("</div></p>a</b>b</i>", "ab"),
        ("</div></p>a</div>b", "a b"),
        ("<div class='nav'>x</div><div>y</div>", "y"),
        ('<p title="a > b">q</p>', "q"),
        ('<p title="open>q</p><p>r</p>', "q r"),
        ("&#65;&lt;b&gt;", "A<b>"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<article>1</article><p>out</p><article>2</article>", "1 2"),
        ("<article><p>x</p><article class='comment'>no</article></article>", "x"),
    ],
)
def test_single_pages(page, text):
    assert wrappers.main_text(page) == text


def test_expressions_align():
    pages = ["<body><h1>A</h1><p>x<p>y</body>", "<body><h1>B</h1><p>z<ul><li>1<li>2</ul></body>", "<body><h1>C</h1><img><dl><dt>a<dd>b<dt>c<dd>d</dl></body>"]
    merged = wrappers.wrapper_of(wrappers.parse(pages[0]))
    for page in pages[1:]:
        merged = wrappers.merge(merged, wrappers.wrapper_of(wrappers.parse(page)))
    shown = wrappers.expression(merged)
    assert "<h1> #text </h1>" in shown and "(<p> #text </p>)*" in shown and "(<ul>" in shown and "</ul>)?" in shown
    assert "(<dt> #text </dt> <dd> #text </dd>)+" in shown


def test_long_irregular_lists_stay_bounded():
    import random

    choose = random.Random(3)
    pages = ["<body>" + "".join(f"<{t}>x</{t}>" for t in choose.choices(["p", "pre", "h2", "div", "hr", "section", "table"], k=3000)) + "</body>" for _ in range(3)]
    merged = wrappers.wrapper_of(wrappers.parse(pages[0]))
    for page in pages[1:]:
        merged = wrappers.merge(merged, wrappers.wrapper_of(wrappers.parse(page)))
    assert len(wrappers.expression(merged)) < 2000
    assert wrappers.main_text(pages[1], merged, 3).count("x") == pages[1].count(">x<")


def test_fixed_texts_of_a_host_go_where_there_is_no_article(spark):
    page = "<body><div>Welcome to the site</div><div><p>Story {0} is here</p></div><div>All rights kept</div></body>"
    rows = [(k, "http://a.example/x", page.format(k)) for k in range(6)] + [(10, "http://b.example/", page.format(1)), (11, None, None), (None, "", "<p>z")]
    pages = spark.createDataFrame([(*row, "x", "x") for row in rows], "page_id long, url string, html string, host string, text string")
    found = {r.page_id: r.text for r in wrappers.main_texts(pages).collect()}
    assert found[3] == "Story 3 is here"
    assert found[10] == "Welcome to the site Story 1 is here All rights kept"
    assert found[11] == "" and found[None] == "z"
    assert wrappers.main_texts(pages.limit(0)).collect() == []


def test_hosts(spark):
    urls = ["http://A.example:80/x", "https://u@b.example?q", "c.example", "", None]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(wrappers.host_of(F.col("url")).alias("h"))
    assert [r.h for r in rows.collect()] == ["a.example", "b.example", "", "", ""]


def host_wrapper(pages):
    return functools.reduce(wrappers.merge, [wrappers.wrapper_of(wrappers.parse(page)) for page in pages])


@pytest.mark.parametrize("block", ["<blockquote>Only here</blockquote>", "<table><tr><td>Only</table>", "<pre>Only here</pre>", "<div>Only here</div>"])
def test_what_one_page_has_is_not_fixed(block):
    long = "We use cookies. " * 30
    pages = [f"<body><div>{long}</div><div><p>Story {k} is here</p></div>{block if k == 6 else ''}<div>All rights kept</div></body>" for k in range(10)]
    for order in (pages, pages[::-1], pages[6:] + pages[:6]):
        merged = json.loads(json.dumps(host_wrapper(order)))
        wanted = " ".join(re.sub("<[^>]*>", " ", block).split())
        assert wrappers.main_text(pages[6], merged, 10) == f"Story 6 is here {wanted}"
        assert wrappers.main_text(pages[5], merged, 10) == "Story 5 is here"


def test_end_tags_pair_up_below_the_deepest_level():
    nest = "<div>" * 60 + "deep" + "</div>" * 60
    assert wrappers.main_text(f"<html><body><div><article><p>before</p>{nest}<p>after</p></article></div><p>out</p></body></html>") == "before deep after"
    assert wrappers.main_text("<p>out</p>" + "<div>" * 60 + "<article>in<nav>no</nav></article>" + "</div>" * 60 + "<p>out</p>") == "in"
    for name in ("form", "nav", "article class='reply'", "div class='comment'"):
        end = f"</{name.split()[0]}>"
        page = f"<article>a{f'<{name}>' * 3000}no{end * 3000}b</article>"
        assert wrappers.main_text(page, host_wrapper([page] * 3), 3) == "a b"


LONG = "<p>The story of the day is told here</p>"


@pytest.mark.parametrize(
    "page, text",
    [
        *((f"<div class='layout {word}'><article>{LONG}</article><div class='sidebar'>no</div></div>", LONG[3:-4]) for word in ("has-sidebar", "no-comments", "with-nav", "search-page", "sidebar", "nav-left")),
        (f"<form id='aspnetForm'><nav>no</nav><article>{LONG}</article></form>", LONG[3:-4]),
        (f"<form><div>{LONG}</div><div class='footer'>no</div></form><p>end", LONG[3:-4] + " end"),
        (f"<article><form>{LONG}</form><p>end</p></article>", LONG[3:-4] + " end"),
        (f"<article><p>end</p><div class='comment-list'>{LONG}</div></article>", "end"),
        (f"<div>{LONG}</div><aside class='related'><article>no</article></aside>", LONG[3:-4]),
        (f"<article>{LONG}</article><aside class='related'><article>{LONG}{LONG}</article></aside>", LONG[3:-4]),
        (f"<div>{LONG}</div><div class='site-footer'>no</div><form>Mail</form>", LONG[3:-4]),
    ],
)
def test_containers_of_the_main_text_stay(page, text):
    assert wrappers.main_text(f"<html><body>{page}</body></html>") == text


def test_the_wrapper_decides_on_hosts_with_articles():
    share = "<p>Share this story with your friends</p>"
    pages = [f"<body><article>{share}<h1>Title {k}</h1><p>{f'Words of story {k}. ' * 9}</p></article><div>Other {k}</div></body>" for k in range(6)]
    wanted = f"Title 3 {(f'Words of story {3}. ' * 9).strip()}"
    assert wrappers.main_text(pages[3], host_wrapper(pages), 6) == wanted
    assert wrappers.main_text(pages[3], host_wrapper(pages[3:4]), 1) == "Share this story with your friends " + wanted
    # copies of one article are no template
    copies = [pages[3]] * 5 + [pages[3].replace("Title 3", "Title 4")]
    assert wrappers.main_text(copies[0], host_wrapper(copies), 6) == "Share this story with your friends " + wanted
    # articles that are teasers only
    teasers = [f"<body><div class='text'><h1>T{k}</h1><p>{f'Words of story {k}. ' * 9}</p></div><article>Next: {k}</article></body>" for k in range(6)]
    assert wrappers.main_text(teasers[3], host_wrapper(teasers), 6) == f"T3 {(f'Words of story {3}. ' * 9).strip()} Next: 3"
    # a form with most of what varies stays on pages where it is short
    forms = [f"<body><form><p>{f'Words of story {k}. ' * (9 if k else 1)}</p></form><div>Place {k} and a date</div></body>" for k in range(6)]
    assert wrappers.main_text(forms[0], host_wrapper(forms), 6) == "Words of story 0. Place 0 and a date"


@pytest.mark.parametrize(
    "block",
    [
        "<h2 id='navigation'>{}</h2>",
        "<h3 class='footer' id='related-work'>{}</h3>",
        "<section id='reply-to-critics'><p>{}</p></section>",
        "<div id='search-methods'>{}</div>",
        "<p class='login'>{}</p>",
        "<table><tr><td class='ad' id='menu'>{}</td></tr></table>",
    ],
)
@pytest.mark.parametrize("same", [True, False])
def test_words_of_headings_are_no_regions(block, same):
    """Slugs of headings and classes of texts inside an article cost nothing, on one page and on a host's."""
    pages = [f"<body><nav>menu</nav><article><p>{k} opens {'plainly ' * 9}</p>{block.format(f'kept {k}')}<p>{k} ends</p></article></body>" for k in range(6)]
    if not same:
        pages[1:] = [page.replace(block.format(f"kept {k}"), "") for k, page in enumerate(pages[1:], 1)]
    wrapper = functools.reduce(wrappers.merge, [wrappers.wrapper_of(wrappers.parse(page)) for page in pages])
    wanted = f"0 opens {'plainly ' * 9}kept 0 0 ends"
    assert wrappers.main_text(pages[0]) == wanted
    assert wrappers.main_text(pages[0], wrapper, len(pages)) == wanted


@pytest.mark.parametrize(
    "block",
    ["<div id='disqus_thread'>x</div>", "<section id='comments'><p>x</p></section>", "<ol id='comment-list'><li>x</ol>", "<div class='reader-comments'>x</div>", "<p class='ad'>x</p>", "<div class='ad' id='a1'>x</div>"],
)
def test_comments_and_adverts_inside_articles_go(block):
    assert wrappers.main_text(f"<body><article><p>A text</p>{block}<p>goes on</p></article></body>") == "A text goes on"
