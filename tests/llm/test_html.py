import time

import pytest

pytest.importorskip("public_tokenizers")
from structjson.llm import html  # noqa: E402

PROSE = "It was the best of times and it was the worst of times for all of them, as he had said to the others. "


def text(page):
    return html.main_text(page).split("\n\n")


def test_names_do_not_hide_the_article():
    for wrap in ('<div class="post-with-sidebar">', '<div id="page" class="has-sidebar ad-free">', '<form action="/">', '<div class="content-sidebar-wrap"><section>'):
        assert text(f"<body>{wrap}<article><p>{PROSE}</p><p>Short.</p></article>") == [PROSE.strip(), "Short."]
        assert text(f"<body>{wrap}<p>{PROSE * 2}</p><p>Yes.</p><p>{PROSE * 2}</p>") == [(PROSE * 2).strip(), "Yes.", (PROSE * 2).strip()]
    for own in ("has-sidebar", "post comments-open", "sharing-enabled", "ad"):
        assert text(f'<article class="{own}"><p>One two three.</p></article>') == ["One two three."]
    assert text(f'<article><p>Head.</p><div class="related-work"><p>{PROSE}</p></div></article>') == ["Head.", PROSE.strip()]


def test_what_is_no_article_goes():
    page = (
        f'<body><div class="sidebar"><p>{PROSE}</p></div><article><h1>Title</h1><p>{PROSE * 2}</p><div class="ad">Buy it now</div>'
        f'<div class="social-share">Share it</div><section class="comments-area"><p>{PROSE}</p></section><nav>Next</nav><p>End.</p></article>'
        f'<div id="comments"><p>{PROSE * 9}</p></div><footer>{PROSE}</footer>'
    )
    assert text(page) == ["Title", (PROSE * 2).strip(), "End."]
    assert text(f'<article><p>{PROSE}</p><ul><li><a href="a">{PROSE}</a></li></ul></article>')[0] == PROSE.strip()


def test_without_an_article_the_rules_decide():
    page = (
        f'<body><div>Home | <a href="a">News</a></div><p>{PROSE * 3}</p><p>Yes.</p><p>{PROSE * 3}</p><p>Listen.</p><div><a href="b">{PROSE}</a></div>'
        '<div>Lorem42 zzz qqq xxx kkk vvv www jjj ppp ttt nnn mmm bbb ccc ddd fff ggg hhh lll rrr sss</div><div><a href="c">Next</a></div>'
    )
    assert text(page) == [(PROSE * 3).strip(), "Yes.", (PROSE * 3).strip()]
    blocks = html.classify(*html.blocks_of(page))
    assert {b.label for b in blocks} == {"good", "bad"} and not any(b.bad or b.main or b.mark >= 0 for b in blocks)


def test_stray_quotes_and_unclosed_tags():
    assert text('<p class=foo"bar>one</p><p class="x">two</p>') == ["one", "two"]
    assert text('<p title="a>b">x</p> <p title="a>y</p>') == ["x", "y"]
    assert text("<p data-x='>'>a<p>b<div>c</p></b></i>d<a") == ["a", "b", "c", "d"]
    assert text("a &lt;b&gt; &amp;amp; &#233;\u00a0x &unknown; 1 < 2") == ["a <b> &amp; \u00e9 x &unknown; 1 < 2"]


@pytest.mark.parametrize("piece", ['<a href="', '<p class="x>', "<a ", "<div>", "</p>", "<!--", "<div class=ad>", '<p a="x>"', "<script>", "<p>x</div>", "&", "<![CDATA[", "<p a=' \""])
def test_large_hostile_pages_take_seconds(piece):
    began = time.process_time()
    html.main_text("<div>" * 1000 + piece * (600_000 // len(piece)))
    assert time.process_time() - began < 20


def test_odd_rows(spark):
    rows = [(1, "u", "<p>x</p>", "t", 5), (1, "u", "<p>x</p>", "t", 5), (None, None, None, None, None), (3, "v", "", "t", 1), (4, "w", " \n ", "t", 1), (5, "l", "<article><p>" + "word " * 300_000, "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id or 0, r.url, r.text[:9], r.n_chars) for r in html.extract_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (0, None, "", 0), (3, "v", "", 0), (4, "w", "", 0), (5, "l", "word word", 1_499_999)], key=str)
    assert html.extract_text(pages.limit(0)).count() == 0
