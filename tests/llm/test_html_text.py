import html
import re

import pytest

from murmuration.llm.html_text import extract_text, main_text
from murmuration.llm.queries import table

SCHEMA = "page_id long, url string, html string, text string, n_chars int"
LINE = "Enough words in one paragraph that it looks like text, is it not?"


def plain_article(page):
    """The blocks of the only article of a well-known page layout, by plain patterns."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = [html.unescape(re.sub(r"<[^>]*>", "", b)) for b in re.split(r"</?(?:h1|p)>", inside)]
    return "\n\n".join(" ".join(b.split()) for b in blocks if b.split())


def test_whole_table_against_plain_patterns(spark, sf_dir):
    for r in extract_text(table(spark, sf_dir, "pages")).collect():
        assert r.text == plain_article(r.html) and r.n_chars == len(r.text)


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<script>if (a<b) '<p>no</p>'</script>", ""), ("words only", "words only"),
    (f"<p>a &amp; &#8364;&nbsp;b\n c<p>{LINE}", f"a & € b c\n\n{LINE}"),
    ("<p>a</b></div></p><p>b<table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"),
    (f"<main><h1>T</h1><p>{LINE}</p><aside>no</aside><form><p>no</p></form><section class='comments'><p>{LINE}</p></section></main>",
     f"T\n\n{LINE}"),
    (f"<div id=header><a>Home</a></div><div class=content><h2>T</h2><p>{LINE}</p><p>Short.</p></div>"
     f"<div class=sidebar><p>{LINE}</p></div><div class='cookie-notice'>{LINE}</div><div id=comments><p>{LINE}</p></div>",
     f"T\n\n{LINE}\n\nShort."),
    (f"<article><header><h1>T</h1></header><p>{LINE}</p></article><div style='display:none'>{LINE}</div>", f"T\n\n{LINE}"),
])
def test_small_pages(page, text):
    assert main_text(page) == text


def test_long_page_and_clashing_columns(spark):
    page = "<article>" + f"<p>{LINE}</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, None, page, "old", 3), (1, None, page, "old", 3), (None, "u", None, None, None)], SCHEMA)
    got = extract_text(df).select("page_id", "text", "n_chars").collect()
    assert sorted(r.n_chars for r in got) == [0, *[20_000 * (len(LINE) + 2) - 2] * 2]
    assert extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("page, text", [
    (f"<html><head><title>no</title><meta charset=x><body><p>{LINE}</p></body></html>", LINE),
    (f"<head><title>no</title><script>no</script><p>{LINE}</p>", LINE),
    (f"<head><title>no</title>\n{LINE}", LINE),
    (f"<head><style>no</style></head><body><p>{LINE}</p>", LINE),
    *[(f"<body><div class='{name}'><h1>T</h1><p>{LINE}</p><p>{LINE}</p></div><div class=footer>no words here</div>",
       f"T\n\n{LINE}\n\n{LINE}") for name in ("content has-sidebar", "no-sidebar", "comments-enabled", "layout-sidebar")],
    (f"<div class=page-sidebar-2><div class=sidebar><h1>T</h1><p>{LINE}</p><p>{LINE}</p></div></div>", f"T\n\n{LINE}\n\n{LINE}"),
    (f"<div class=has-sidebar><p>{LINE}</p><p>{LINE}</p></div><div class=related><article>Teaser.</article></div>", f"{LINE}\n\n{LINE}"),
    (f"<article><p>Short one.</p></article><div class=sidebar><p>{LINE}</p></div>", "Short one."),
    (f"<div class=no-sidebar><div class=content><p>{LINE}</p><p>{LINE}</p></div><div class=sidebar><p>{LINE}</p></div></div>",
     f"{LINE}\n\n{LINE}"),
    ("<body>" + "".join(f"<article><h2>{k}</h2><p>{LINE}</p></article>" for k in range(7)) + "<p>no</p>",
     "\n\n".join(f"{k}\n\n{LINE}" for k in range(7))),
    (f"<article><p>{LINE * 20}</p></article><article><p>Tiny teaser.</p></article>", LINE * 20),
])
def test_pages_that_lose_nothing(page, text):
    assert main_text(page) == text
