from __future__ import annotations

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from hearthtab.llm import extract
from hearthtab.llm.queries import op1_html
from tests.llm import odd

MEDIUM = "/root/testdata/sf0.01"


def plain_article(page):
    """The text of an article of h1, p and b elements."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [
        re.sub(r"\s+", " ", html.unescape(re.sub("<br>", " ", x))).strip()
        for x in re.split(r"(?:</?(?:h1|p|b)>)+", inner)
    ]
    return "\n\n".join(b for b in blocks if b)


def test_query_equals_the_articles(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()}
    rows = op1_html(spark, MEDIUM).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r["page_id"]]
        assert (r["url"], r["text"]) == (page["url"], plain_article(page["html"]))
        assert r["n_chars"] == len(r["text"])


PAGE = """<!doctype html><html><head><title>No</title><style>p{{}}</style></head><body>
<header><a href="/">Site</a> motto</header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div id="cookie-notice">We use cookies</div>
<div class="{kind}"><h2>Title &amp; more {n}</h2><p>First   text {n}<br>on
two lines<p>Second <b>bold</b>, &lt;tag&gt; &#228;&eacute; &nbsp; end {n}
<script>var x = "<p>no</p>";</script><!-- <p>no</p> -->
<ul><li>Item {n}<li>Item two</ul>
<form><input value=x> Name <button>Send</button></form>
<section class="comments"><p>Reader says hi {n}</p></section>
<aside>Related {n}</aside></div>
<footer>&copy; all</footer></body></html>"""
EXPECTED = (
    "Title & more {n}\n\nFirst text {n} on two lines\n\nSecond bold, <tag> äé end {n}\n\n"
    "Item {n}\n\nItem two"
)


def made(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def test_template_without_article_tags(spark):
    rows = [(k, f"https://a.example/{k}", PAGE.format(kind="story", n=k)) for k in range(6)]
    got = {r["page_id"]: r["text"] for r in extract.extract_text(made(spark, rows)).collect()}
    assert got == {k: EXPECTED.format(n=k) for k in range(6)}
    slots = extract.templates(made(spark, rows)).collect()
    assert [(r["host"], r["slot"]) for r in slots] == [("a.example", "html/body/div.story")]


def test_main_slot_is_the_fullest(spark):
    page = (
        "<html><body><table><tr><td>menu {k}</td></tr></table><main><div><p>{words}</p></div></main>"
        "<p>short {k}</p></body></html>"
    )
    rows = [(k, "http://u:p@B.example:80/x", page.format(k=k, words=f"text {k} " * 50)) for k in range(5)]
    (slot,) = extract.templates(made(spark, rows)).collect()
    assert slot["host"] == "b.example:80" and slot["slot"].startswith("html/body/main")
    got = {r["page_id"]: r["text"] for r in extract.extract_text(made(spark, rows)).collect()}
    assert got == {k: (f"text {k} " * 50).strip() for k in range(5)}


def test_repeated_article_text_is_kept(spark):
    rows = [(k, "http://c.example/", "<article><p>Same on all pages</p></article>") for k in range(9)]
    got = {r["text"] for r in extract.extract_text(made(spark, rows)).collect()}
    assert got == {"Same on all pages"}


def test_broken_markup():
    cases = {
        "<p>a<p>b": "a\n\nb",
        "<article><header><h1>T</h1></header><p>x</p></article><footer>f</footer>": "T\n\nx",
        "text only": "text only",
        "a < b and <b>c": "a < b and c",
        "<article><p><b>x<br><p>y</article>z": "x\n\ny",
        "<div class='ad banner'>no</div>yes": "yes",
        "<p>unclosed <!-- comment": "unclosed",
        "<p title='a>b'>x</p>": "x",
        "<div>&am &amp &#x41; &bogus;</div>": "&am & A &bogus;",
        "": "",
    }
    assert {k: extract.main_text(k, None) for k in cases} == cases


def test_odd_rows(spark):
    pages = odd.table(spark)
    rows = extract.extract_text(pages, "doc_id", "url", "text").collect()
    assert len(rows) == len(odd.TEXTS)
    by_id = {r["doc_id"]: r["text"] for r in rows if r["doc_id"]}
    assert by_id[1] == by_id[2] == by_id[3] == ""
    assert by_id[10] == "a" * 50_000
    assert extract.extract_text(odd.empty(spark), "doc_id", "url", "text").count() == 0
    rows = [(1, None, "<p>x</p>"), (2, "no url", None), (None, "", "<p>y</p>")]
    got = {r["page_id"]: r["text"] for r in extract.extract_text(made(spark, rows)).collect()}
    assert got == {1: "x", 2: "", None: "y"}


def test_title_and_lead_beside_the_fullest_slot_are_kept(spark):
    inner = (
        "<h1>Title {k}</h1><p class=lead>Lead {k}</p><div class=entry-content><p>{words}</p><p>more</p></div>"
        "<section><p>Last {k}</p></section>"
    )
    hosts = {
        "article": f"<html><body><div class=top>Site</div><article>{inner}</article></body></html>",
        "div": f"<html><body><div class=top>Site</div><div class=all><div class=entry>{inner}</div>"
        "<div class=rail>Rail</div></div></body></html>",
        "one": "<html><body><div class=top>Site</div><article><h1>Title {k}</h1><p>{words}</p></article></body></html>",
    }
    words = lambda k: f"text {k} " * 200
    rows = [
        (k, f"http://{host}.example/{k}", page.format(k=k, words=words(k)))
        for host, page in hosts.items()
        for k in range(5)
    ]
    for r in extract.extract_text(made(spark, rows)).collect():
        k = r["page_id"]
        parts = [f"Title {k}", f"Lead {k}", words(k).strip(), "more", f"Last {k}"]
        assert r["text"].split("\n\n") == (parts[::2][:2] if "one" in r["url"] else parts)


def test_unknown_hosts_and_hosts_of_several_layouts(spark):
    rail = "<div class=rail>Rail {k}</div>"
    article = "<html><body>" + rail + "<article><h1>T {k}</h1><p>{words}</p></article></body></html>"
    story = "<html><body><div class=top-{n}>" + rail + "</div><div class=story-{n}><p>{words}</p><p>end</p></div></body></html>"
    words = lambda k: f"text {k} " * 50
    unknown = [(k, u, article.format(k=k, words=words(k))) for k, u in enumerate([None, "/a", None, "", "b"])]
    for r in extract.extract_text(made(spark, unknown)).collect():
        assert r["text"] == f"T {r['page_id']}\n\n{words(r['page_id']).strip()}"
    assert extract.templates(made(spark, unknown)).count() == 0
    several = [
        (k, "http://m.example/", story.format(k=k, n="abc"[k % 3], words=words(k))) for k in range(12)
    ]
    for r in extract.extract_text(made(spark, several)).collect():
        assert r["text"] == f"{words(r['page_id']).strip()}\n\nend"


def test_words_in_names_do_not_lose_articles():
    """Listed words on wrappers, in longer names and on elements of the article itself."""
    body = "<article><p>Body of the page.</p></article>"
    for page in (
        f'<div class="content has-sidebar">{body}</div>',
        f'<div id="page" class="site no-comments">{body}</div>',
        f'<div class="modal-closed wrapper">{body}</div>',
        f"<form><div>{body}</div></form>",
        f'<div class="widget">{body}</div>',
        f'<form><div class="nav-open sidebar">{body}</div></form><footer>Foot</footer>',
    ):
        assert extract.main_text(f"<html><body>{page}</body></html>") == "Body of the page."
    inside = (
        '<article><p class="share-price">Prices rose.</p><p class="related-work">Work.</p>'
        '<section id="comments-on-method"><p>Method.</p></section><p>a <math><mi>x</mi></math> b</p></article>'
    )
    assert extract.main_text(inside) == "Prices rose.\n\nWork.\n\nMethod.\n\na x b"
    title = '<div class="post-header"><h1>Title</h1></div><div class="entry"><p>Text.</p></div>'
    assert extract.main_text(title) == "Title\n\nText."
    alone = "<form><p>All of a page's text, in a form without any article.</p></form><nav>Home</nav>"
    assert extract.main_text(alone) == "All of a page's text, in a form without any article."


def test_what_is_left_out_by_name():
    """Comments, also those marked up as articles, and layout names made of listed words."""
    rest = (
        '<div class="comments-area"><article class="comment"><p>I say.</p></article></div>'
        '<div class="related-posts"><p>More.</p></div><div id="site-footer"><p>Foot.</p></div>'
        '<div class="cookie-consent-banner"><p>Cookies.</p></div><div class="ad-slot"><p>Buy.</p></div>'
        '<div class="site-header"><p>Site.</p></div><form><p>Your name</p></form><div hidden><p>Never.</p></div>'
    )
    assert extract.main_text(f"<body><article><p>Text.</p></article>{rest}</body>") == "Text."
    assert extract.main_text(f"<body><article><p>Text.</p>{rest}</article></body>").startswith("Text.")
    assert extract.main_text(f"<body><div><p>{'Text. ' * 30}</p></div>{rest}</body>") == ("Text. " * 30).strip()


def test_articles_in_wrappers_through_templates(spark):
    words = "one two three four five six seven eight nine ten".split()
    pages = [
        (k, f"https://wrapped.example/{k}", '<html><body><div class="content has-sidebar"><div class="sidebar"><p>Menu</p></div>'
         f"<article><h1>{words[k]}</h1><p>{' '.join(words[k:])} and so on.</p></article></div></body></html>")
        for k in range(5)
    ]
    got = {r.page_id: r.text for r in extract.extract_text(made(spark, pages)).collect()}
    assert got == {k: f"{words[k]}\n\n{' '.join(words[k:])} and so on." for k in range(5)}


@pytest.mark.parametrize("tag", ["div", "b", "p", "ul><li", "article", 'div class="widget"', "table><tr><td"])
def test_deep_nesting_takes_time_in_proportion(tag):
    began = time.perf_counter()
    assert extract.main_text(f"<{tag}>" * 100_000 + "deep").endswith("deep")
    assert time.perf_counter() - began < 20


def test_hosts_are_found_alike_in_templates_and_pages(spark):
    rows = [(k, f"\t\n https://User@Host.Example/{k}\n", f"<body><article><p>Text {k} of it.</p></article></body>") for k in range(4)]
    rows += [(9, "ftp:/nothing", "<p>x</p>"), (10, None, None)]
    found = spark.createDataFrame(rows, "page_id long, url string, html string").select(extract.host_of(F.col("url")).alias("h"))
    assert [r.h for r in found.collect()] == ["host.example"] * 4 + ["", ""]
    assert {r.host for r in extract.templates(made(spark, rows)).collect()} <= {"host.example"}
