"""Which lines of ordinary pages the markup settles, and which differencing decides."""

import re

from hourloom.llm import extraction


def _text(spark, *pages):
    rows = [(k, f"http://h.org/a/{k}", h) for k, h in enumerate(pages)]
    return [r.text for r in sorted(extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.page_id)]


def test_names_that_only_hint_at_a_frame(spark):
    page = lambda k: f'<main><div class="article-header"><h1>Headline {k}</h1></div><div class="share-price">Price {k}</div><div class="search-results"><p>Found {k}</p></div><div class="promo-text">Same hint</div><p>Same body</p></main>'
    assert _text(spark, page("one"), page("two")) == [f"Headline {k} Price {k} Found {k} Same body" for k in ("one", "two")]


def test_named_frames_go_though_unshared(spark):
    names = ["ad", "site-header", "cookie-notice", "main-nav", "comments", "comment-12", "sidebar", "related-posts", "ad_slot", "newsletter-form", "x ads y"]
    page = lambda k: "<article><p>Body</p>" + "".join(f'<div class="{n}">{n} {k}</div>' for n in names) + "<p>End</p></article>"
    assert _text(spark, page(1), page(2)) == ["Body End"] * 2


def test_quotes_in_tags_adverts_in_lines_and_hidden_text(spark):
    page = """<article><p title="a > b">One <span class="ad">buy <span>now</span> this</span>two</p><p title=it's>three</p>
    <div hidden>no</div><p style="display: none">no</p><p aria-hidden="true">no</p><p title="hidden gem">four</p><p class="ad">no<p>five</p><p data-id="menu">six</p><p a="x>y</p><p>seven</p></article>"""
    got = _text(spark, page)[0]
    assert re.sub(r"y |y$", "", got).startswith("One two three four five six") and "no" not in got.split() and 'b">' not in got and "seven" in got


def test_outside_the_article_and_titles(spark):
    page = lambda k, site: f"<header><h1>{site}</h1></header><div>outside {k}</div><article><p>Body {k}</p></article><div>more {k}</div>"
    assert _text(spark, page(1, "Site"), page(2, "Site")) == ["Body 1", "Body 2"]
    assert _text(spark, page(1, "First"), page(2, "Second")) == ["First Body 1", "Second Body 2"]
    assert _text(spark, page(1, "Alone")) == ["Body 1"]
    own = "<header><h1>Site {0}</h1></header><article><h1>Own {0}</h1><p>Body</p></article>"
    assert _text(spark, own.format(1), own.format(2)) == ["Own 1 Body", "Own 2 Body"]


def test_long_and_broken_markup_ends(spark):
    pages = ['<p a="' * 20000, "<div " * 50000, "<" * 100000, "<!--" * 30000, "<p>" * 50000 + "end", "&amp;" * 200000]
    got = _text(spark, *pages)
    assert len(got) == len(pages) and got[4] == "end" and got[5] == "&" * 200000
