from __future__ import annotations

import html
import re

import pytest

from ledgerlens.llm import html_text
from ledgerlens.llm.html_text import main_text
from tests.llm.conftest import rows_of

LONG = "Plain sentences of the story go on for a while, with commas, and they end here. "


def test_query_on_the_pages(spark, sf):
    p = rows_of("pages")
    got = {r.page_id: r for r in html_text.op7_html_text(spark, sf).collect()}
    assert len(got) == len(p["page_id"])
    for i, u, h in zip(p["page_id"], p["url"], p["html"]):
        body = re.sub(r"<br>|</?(?:p|h1)>", " ", re.search(r"<article>(.*?)</article>", h, re.DOTALL)[1])
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", "", body)).split())
        assert (got[i].url, got[i].text, got[i].n_chars) == (u, text, len(text))


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("just text", "just text"), ("<p>a&nbsp;&amp; b&lt;c", "a & b<c"), ("<html><body></body></html>", ""),
        ("<p>one<b>two</b>three<br>four", "onetwothree four"), ("<p>a<script>if (x < 1) '</p>'</script>b</p><style>p{}</style>", "ab"),
        ("<p>a<!-- <p>no --> b</p><!-- open", "a b"), ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"), ("x <3 y", "x <3 y"),
        ("<a href=\"q>r\">s</a", "s"), ("<article>é 😀</article>", "é 😀"), ("</p></div>stray", "stray"),
    ],
)
def test_small_markup(source, text):
    assert main_text(source) == text


@pytest.mark.parametrize(
    "other",
    [
        "<nav><a href='/x'>Menu one</a> <a href='/y'>Menu two</a></nav>", "<header>Site name and slogan of it</header>", "<footer>Some rights reserved</footer>",
        "<aside>Side notes that are long enough to look like text</aside>", "<form>Name <input name=n> <button>Send</button></form>",
        "<div class='cookie-notice'>We use cookies for everything that we do here</div>", "<div class=\"ad\">Buy this now, it is cheap and good</div>",
        "<section id=comments><p>Great post, I read it twice and told all friends</p></section>", "<div role='navigation'>Go on</div>",
        "<ul class='menu main'><li>Home<li>News</ul>", "<noscript>Please switch it on</noscript>", "<div class=sidebar><p>Popular posts of this week</p></div>",
    ],
)
@pytest.mark.parametrize("wrap", ["article", "main", "div"])
def test_what_is_not_the_article_goes(other, wrap):
    story = f"<{wrap}><h1>Title</h1><p>{LONG}</p><p>{LONG * 3}</p><p>{LONG * 2}</p></{wrap}>"
    expected = " ".join(f"Title {LONG} {LONG * 3} {LONG * 2}".split())
    for page in (f"{other}{story}", f"{story}{other}", f"{other}{story}{other}"):
        assert main_text(f"<!DOCTYPE html><html><head><title>t</title></head><body>{page}</body></html>") == expected
    inside = story.replace(f"</{wrap}>", f"{other}</{wrap}>")
    assert main_text(f"<body>{inside}</body>") == expected


STORY = f"<h1>Title</h1><p>{LONG * 2}</p><p>{LONG * 3}</p>"


@pytest.mark.parametrize(
    "wrap",
    [
        "<div class='layout no-sidebar'><article>{}</article></div>", "<div class='site has-sidebar'><article>{}</article></div>", "<div class='page with-header'>{}</div>",
        "<div class='elementor-widget'><main>{}</main></div>", "<div class=widget>{}</div>", "<div class=banner><p>x</p><article>{}</article></div>", "<form id=aspnet>{}</form>",
        "<main><h1>Top</h1><div class=widget><article>{}</article></div></main>", "<div data-id=menu data-class='search' title='not hidden here'>{}</div>",
    ],
)
def test_wrappers_with_marks_keep_their_text(wrap):
    text = main_text(f"<body><nav><a href=x>Home</a></nav>{wrap.format(STORY)}<footer>Rights</footer></body>")
    assert " ".join(f"Title {LONG * 2} {LONG * 3}".split()) in text and "Home" not in text and "Rights" not in text


@pytest.mark.parametrize(
    "part",
    [
        "<section id='related-work'><p>Other people did this</p></section>", "<h2 id='search'>Search</h2>", "<p class='notice'>Mind the step</p>",
        "<pre><code>x = 1 <span class='comment'># one</span></code></pre>", "<p data-class='ad' title=\"a hidden gem\">Found it</p>",
    ],
)
def test_marked_parts_of_an_article_stay(part):
    inside = " ".join(re.sub(r"<[^>]*>", "", part).split())
    assert main_text(f"<body><article>{STORY}{part}<p>{LONG}</p></article></body>") == " ".join(f"Title {LONG * 2} {LONG * 3} {inside} {LONG}".split())


def test_comments_longer_than_the_article_go_and_a_page_of_marks_has_text():
    replies = f"<section id=comments><article class=comment><p>{LONG * 20}</p></article></section>"
    assert main_text(f"<body><article>{STORY}{replies}</article></body>") == " ".join(f"Title {LONG * 2} {LONG * 3}".split())
    assert "one two" in main_text("<body><div class=widget>one two</div><div class=widget>three four</div><div class=widget>five six</div></body>")


def test_long_pages_and_deep_nesting():
    deep = "<div>" * 3000 + "core text" + "</div>" * 3000
    assert main_text(deep) == "core text"
    many = "<article>" + "<p>" + "word " * 50_000 + "</p></article>"
    assert len(main_text(many)) == 249_999


def test_odd_rows(spark):
    frame = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>k", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract(frame).collect()) == [(0, "k"), (1, ""), (1, "")]
    assert html_text.extract(frame.limit(0)).count() == 0
