"""Text under elements with names of junk, linked headings, small articles."""

import time

import pytest

from helixlake.llm.html_text import extract_text, main_text


def test_names_do_not_take_the_text():
    long = "A paragraph with a good deal of text in it. " * 3
    line = long.strip()
    assert main_text(f'<div class="page has-sidebar"><article><p>{long}</p></article><div class="sidebar"><p>x y</p></div></div>') == line
    assert main_text(f'<section class="share-enabled"><p>{long}</p></section><div class="share"><p>Share</p></div>') == line
    assert main_text(f'<div class="banner"><div class="search-page"><p>{long}</p><p class="ad">Buy</p></div></div><p>end</p>') == f"{line}\nend"
    assert main_text(f'<div id="comments"><p>nice one</p></div><p>{long}</p>') == line
    assert main_text(f'<div hidden><p>{long}</p></div><p>shown</p>') == "shown"
    assert main_text(f'<p>{long}<span class="share">Share</span> on</p>') == f"{line} on"


def test_linked_headings_stay():
    assert main_text("<article><h1><a href=x>Title</a></h1><p>text</p></article>") == "Title\ntext"
    assert main_text("<h1><a href=x>Title</a></h1><p>text</p><p><a href=y>linked line</a></p><p>more</p>") == "Title\ntext\nlinked line\nmore"
    assert main_text("<ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul><p>text</p>") == "text"


def test_small_articles_do_not_hide_the_page():
    long = "A paragraph with a good deal of text in it. " * 30
    got = main_text(f"<div><p>{long}</p><p>{long}</p></div><article><p>Card</p></article>")
    assert got.startswith(f"{long.strip()}\n{long.strip()}")


def test_quotes_in_attributes():
    assert main_text("<article><p title=it's>Hello</p><p>don't go</p></article>") == "Hello\ndon't go"
    assert main_text("""<article><p title='a > b' data-x="c > d">Hello</p><p id=x">on</p></article>""") == "Hello\non"
    assert main_text("<article><p>2 < 3 and a=\"b</p></article>") == '2 < 3 and a="b'


@pytest.mark.parametrize("name", ["notice-period", "search-results", "related-work", "social-history", "comment-on-policy", "banner-years", "form-factor"])
def test_names_within_an_article(name):
    long = "A paragraph with a good deal of text in it. " * 4
    assert main_text(f'<article><p>{long}</p><div class="{name}"><p>short one</p></div></article>') == long.strip() + "\nshort one"


@pytest.mark.parametrize("name", ["ad", "comment-list", "related-posts", "shareButtons", "cookie-notice", "newsletter-signup big"])
def test_junk_within_an_article(name):
    long = "A paragraph with a good deal of text in it. " * 4
    assert main_text(f'<article><p>{long}</p><div class="{name}"><p>short one</p></div></article>') == long.strip()


def test_links_and_header_of_an_article():
    got = main_text("<article><header><h1>The title</h1><p>Share this</p></header><p><a href=x>first link</a></p><p>text</p><p><a href=y>last link</a></p></article>")
    assert got == "The title\nfirst link\ntext\nlast link"


def test_deep_and_unclosed_markup():
    """Nested far beyond Python's stack, and tags that close nothing."""
    text = "x" * 50
    assert main_text("<div class=ad>" * 5000 + "a" + "</div>" * 5000 + f"<p>{text}</p>") == text
    began = time.process_time()
    assert main_text("<b>" * 20_000 + f"<p>{text}</p>" + "</i>" * 20_000) == text
    assert main_text("<i><div>" + "<b>" * 20_000 + text + "</i>" * 20_000) == text
    assert main_text("<a href=x>" * 20_000 + f"<p>{text}</p>" * 2000).count("x") in (0, 2000 * 50)
    whole = "".join(f"<p>line {k} <b>of</b> text</p>" for k in range(35_000))
    assert main_text(f"<article>{whole}</article>").count("\n") == 34_999  # 1 MB
    assert time.process_time() - began < 20


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", "<p>a</p>", "t", "n"), (1, "u", "<p>a</p>", "t", "n"), (None, None, "<p>b</p>", "t", "n"), (2, "v", "", "t", "n"), (3, "w", None, "t", "n")]
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in extract_text(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", "a", 1), ("1", "a", 1), ("2", "", 0), ("3", "", 0), ("None", "b", 1)]
    assert extract_text(spark.createDataFrame([], schema)).count() == 0
