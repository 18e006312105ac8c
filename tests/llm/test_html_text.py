import html
import re
import time

import pytest

from tradeframe.llm import html_text
from tradeframe.llm.html_text import main_text, stretches

LONG = "words of a paragraph that goes on and on, " * 6


def clean(text):
    return " ".join(text.split())


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain text", "plain text"),
    ("<p>a &lt;b&gt; &amp; c&#233;</p><p> d\n  e </p>", "a <b> & cé\n\nd e"),
    ("<nav><a href=x>Home</a></nav><article><header><h1>T</h1></header><p>x<br>y</p><aside>no</aside><p>z</p></article><footer>f</footer>", "T\n\nx y\n\nz"),
    ("<article><p><b>open<br><p>next</article><footer>&copy; x</footer>", "open\n\nnext"),
    ("<article><p>a<script>var t='</p>';</script>b<!-- c --></p><form>f</form></article>", "ab"),
    ("<main><p>q</p><section id='comments'><article class='comment'><p>no</p></article></section></main>", "q"),
    ("<article><p>cut off &am", "cut off &am"), ("<p>cut <a href='x", "cut"),
    ("<div class=ad>x<div>y</div></div><p>Hello <b>wor</b>ld</p><ul><li><a href=x>one</a></li></ul>", "Hello world"),
    ("<div class='cookie-notice'>We use cookies</div><h1>T</h1><p>body</p><div hidden>h</div><p style='display: none'>n</p>", "T\n\nbody"),
    ("<article><p>" + "word " * 50000 + "</p></article>", ("word " * 50000).strip()),
    # a short opening stays, whatever stands between it and the long text
    (f"<p>Short opening.</p><aside>ad</aside><p>{LONG}</p>", f"Short opening.\n\n{clean(LONG)}"),
    (f"<p>{LONG}</p><nav>n</nav><p>tiny</p>", f"{clean(LONG)}\n\ntiny"),
    # names that only seem to say something
    (f"<div class='layout has-sidebar'><p>{LONG}</p><div class=sidebar>s</div></div>", clean(LONG)),
    (f"<article class='post has-comments'><p>{LONG}</p><div class='post-comments'><p>{LONG}</p></div></article>", clean(LONG)),
    (f"<div id='notice-2021'><p>{LONG}</p></div><div id=notice><p>closed on Monday</p></div>", clean(LONG)),
    (f"<div class='social-history'><p>{LONG}</p></div>", clean(LONG)),
    (f"<div class=widget><p>{LONG}</p></div><p>by the way</p>", f"{clean(LONG)}\n\nby the way"),
    (f"<aside><article><p>{LONG}</p></article></aside><p>x</p>", clean(LONG)),
    # a list of links is no text, a single link in it is
    (f"<article><p>{LONG}</p><p><a href=x>see here</a></p><p>end.</p><div><div><a href=1>one</a></div><div><a href=2>two</a></div>"
     f"<div><a href=3>three</a></div><div><a href=4>four</a></div></div></article>", f"{clean(LONG)}\n\nsee here\n\nend."),
    (f"<main><h1>T</h1><div>Related reading in short</div><article><p>{LONG}</p></article></main>", clean(LONG)),
    ("<article><p>teaser</p></article>" + f"<div><p>{LONG}</p></div>" * 3, "teaser\n\n" + "\n\n".join([clean(LONG)] * 3)),
    (f"<body><nav><p>{LONG}</p></body>", clean(LONG)), (f"<p title='a > b'>{LONG}</p>", clean(LONG)),
])
def test_main_text(page, text):
    assert main_text(page) == text


def test_stretches_surge_and_dive():
    assert stretches([0, 0, 50, 0, 5, 0, 0, 0, 70]) == [(2, 5), (8, 9)]
    assert stretches([60, 0, 0, 0, 9, 0, 0, 0, 80]) == [(0, 1), (8, 9)]  # 9 alone is too light
    assert stretches([3, 0, 0, 0, 5]) == [(4, 5)]
    assert stretches([]) == [] and stretches([0, 0]) == []


def plain(page):
    """The marked article by regular expressions: good for pages that are written well."""
    page = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", "", page)
    inside = re.search(r"(?s)<article[^>]*>(.*?)(?:</article>|\Z)", page)[1]
    blocks = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div)\b[^>]*>", inside)
    found = [clean(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", "\n", b)))) for b in blocks]
    return "\n\n".join(b for b in found if b)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_whole_table(spark, folder):
    pages = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extracted(pages).collect()}
    assert found == {r["page_id"]: (plain(r["html"]), len(plain(r["html"]))) for r in pages.collect()}


@pytest.mark.parametrize("unit", ['<p "x', "<p 'x>", "<b></i>", "<script ", "<!-- ", "<div class='", "<a href=x>", "&amp;<", "</p", '<p a="b" c'])
def test_broken_pages_take_time_in_proportion(unit):
    started = time.process_time()
    main_text(unit * (1_000_000 // len(unit)))
    assert time.process_time() - started < 6


def test_operator(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (None, None, None), (1, "http://a/", "<p>x</p>"), (2, None, "")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = sorted(map(tuple, html_text.extracted(pages).collect()), key=str)
    assert found == sorted([(1, "http://a/", "x", 1), (None, None, "", 0), (1, "http://a/", "x", 1), (2, None, "", 0)], key=str)
    assert html_text.extracted(pages.limit(0)).count() == 0
