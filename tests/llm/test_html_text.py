"""Main text against the text between the article's tags, and pages of other make."""

import html
import re
import time

import pytest

from passagekit.llm import html_text

MODEL = html_text.train()


def main(page):
    return html_text.main_text(page, MODEL)


def test_the_model_knows_its_table():
    pages = html_text.labelled_pages()
    hits = [
        bool(mark) == example.main
        for page in pages
        for example, mark in zip(page, MODEL.marks([MODEL.block_of(e) for e in page]), strict=True)
    ]
    assert sum(hits) / len(hits) > 0.95


def test_the_tree_reads_neighbours():
    assert {"links", "words", "low", "links_after"} <= MODEL.tree.used()


def test_query_equals_brute_force(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = html_text.query(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for row in rows:
        assert row.text == article_of(pages[row.page_id].html)
        assert (row.n_chars, row.url) == (len(row.text), pages[row.page_id].url)


def article_of(page):
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    plain = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", article))
    return " ".join(html.unescape(plain).split())


@pytest.mark.parametrize(
    "names",
    [
        {"article": "div"},
        {"article": "section"},
        {"article": "div", "nav": "div", "footer": "div id=footer"},
        {"article": "div", "nav": "ul", "footer": "div class=site-footer"},
    ],
)
def test_pages_without_an_article_element(spark, names):
    """The article of each page is found by its blocks, not by the name of the element that holds it."""
    right = pages = 0
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        page = row.html
        for old, new in names.items():
            page = page.replace(f"<{old}>", f"<{new}>").replace(f"</{old}>", f"</{new.split()[0]}>")
        pages += 1
        right += main(page) == article_of(row.html)
    assert right >= 0.97 * pages


def test_names_that_the_table_lacks_decide_nothing():
    for name in ("social-science", "zebra", "science-of-menus-and-ads-in-print"):
        assert main(f"<div class={name}><article>{BODY}</article></div>") in (TEXT, "")
    assert main(f"<div class='social-science'><article>{BODY}</article></div>") == TEXT
    assert main(f"<nav><a href=/>Home</a></nav><h1>Short one</h1>{BODY}") == f"Short one {TEXT}"


def test_a_header_is_the_article_s_or_the_page_s():
    assert main(f"<header><p>All the news of this site</p></header>{BODY}") == TEXT
    assert main(f"<article><header><h1>Of the article</h1></header>{BODY}</article>") == f"Of the article {TEXT}"


def test_links_among_text_are_text_and_lists_of_links_are_not():
    links = "".join(f"<li><a href=/{i}>Read number {i} of these</a></li>" for i in range(5))
    among = "<p><a href=/x>A sentence that is a link from its first to its last word</a></p>"
    assert main(f"<article>{BODY}<ul>{links}</ul></article>") == TEXT
    assert main(f"<article>{BODY}{among}{BODY}</article>") == f"{TEXT} A sentence that is a link from its first to its last word {TEXT}"


@pytest.mark.parametrize(
    "unit", ['<a "', "<a ", '<a ="', "<a ='\"", "<!", "<!--", "<button>", "<svg ", "</p>", "<div>", "<div a=", "&#1", "&", "= <", "<div class=b{}>x"]
)
def test_time_is_linear_in_hostile_markup(unit):
    def seconds(n):
        page = "".join(unit.format("abcdefghij"[i % 10] * (i // 10 % 50)) for i in range(n)) if "{" in unit else unit * n
        started = time.process_time()
        main(page)
        return time.process_time() - started

    # Eight times the page in less than 24 times the time; a quadratic reader takes 64 times.
    assert seconds(80_000) < 24 * max(seconds(10_000), 0.05)


def test_numbers_beyond_characters_are_read():
    assert html_text.plain("&#" + "1" * 9000 + "; &#" + "0" * 5000 + "65; &#65;&eacute;") == "\ufffd A A\xe9"


BODY = "<p>This is a first paragraph with quite a number of words in it, as articles have.</p><p>And <b>a</b> second&nbsp;one &lt;here&gt;,\n with an &eacute; and more than ten words.</p>"
TEXT = "This is a first paragraph with quite a number of words in it, as articles have. And a second one <here>, with an é and more than ten words."


@pytest.mark.parametrize(
    "around",
    [
        "{}",
        "<nav><ul><li><a href='/a>b'>Home</a><li><a href=x>News</a></ul></nav><main>{}</main><footer>&copy; all rights are reserved by us and others, see the terms</footer>",
        "<header><h1>The site</h1></header><div id=content>{}</div><aside><h3>More</h3><p>Related stories that you may like to read on this site today</p></aside>",
        "<div class='cookie-notice'><p>We use cookies to make this site better for you, click to accept them all.</p></div><article>{}</article>",
        "<article>{}<section class=comments><p>Great story, I liked to read it and to tell you so, thank you very much!</p></section></article>",
        "<style>p {{ color: red }}</style><script>var x = '</p><p>many words in a script that are no text at all'</script>{}<!-- <p>hidden words in a comment of the source, many of them</p> -->",
        "<form><p>Please give us your name and your address and your e-mail, then press</p><button>Send</button></form><div class=post>{}</div>",
        "<div class=ad>Buy this very good thing now, it is cheap and good and new!</div><div>{}</div><div style='display: none'>Words that nobody sees on the page, however many there are of them</div>",
    ],
)
def test_other_pages(around):
    assert main(f"<!DOCTYPE html><html><head><title>A title of the page</title></head><body>{around.format(BODY)}</body></html>") == TEXT


@pytest.mark.parametrize("page", ["", "   ", "<", "<!--", "<script>x", "<p", "</div></p>", "&", "<a href='" + "x" * 50_000])
def test_broken_pages_end(page):
    assert isinstance(main(page), str)


def test_odd_rows(spark):
    long = f"<article>{'<p>one two three</p>' * 20_000}</article>"
    pages = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (2, long, None), (2, long, None)], "page_id long, html string, text string")
    rows = html_text.with_main_text(pages).collect()
    assert sorted(len(r.text) for r in rows) == [0, 0, 279_999, 279_999]
    assert html_text.with_main_text(pages.limit(0)).collect() == []
