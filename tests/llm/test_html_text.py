import html
import re

import pytest

from formline.llm.html_text import extract, main_text, second_pass

LONG = "The cat sat on the mat and it was the best of the days that we had in all of the year. " * 4


def page(inner, head=""):
    return f"<!DOCTYPE html><html><head><title>No title</title>{head}</head><body>{inner}</body></html>"


@pytest.mark.parametrize("inner, want", [
    ("<article><h1>T</h1><p>One.<p>Two <b>b</b>old</article>", "T One. Two bold"),
    ("<nav><a href=x>Home</a></nav><article><p>Kept</p></article><footer>&copy; x</footer>", "Kept"),
    ("<header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>x</p></main>", "Title x"),
    ("<article><p>a</p><aside>side</aside><p>b</p><div class='ad'>buy</div><form>name <input></form><p>c</p></article>", "a b c"),
    ("<article><p>a</p></article><section id=comments><article><p>I think so</p></article></section>", "a"),
    ("<article>a<div class=comment-list><p>nice</p></div></article><div class='cookie-notice'>We use</div>", "a"),
    ("<article><ul class=menu><li>m<ul><li>n</ul><li>o</ul><ul><li>keep<li>two</ul></article>", "keep two"),
    ("<article>x < y &amp;&lt;b&gt; &eacute;&#65;&#x42;&nbsp;&am z</article>", "x < y &<b> éAB &am z"),
    ("<article>a<!-- no <p>x -->b<script>var t='</p><p>no';</script>c<style>p{}</style></article>", "abc"),
    ("<article><p>a \n\t b&nbsp; c</p>\n<p> </p><p>d</p></article>", "a b c d"),
    ("<article>a<p hidden>no</p><span class='ad'>no</span>b</article>", "a b"),
    ("<article>a<script>never closed", "a"),
    ("<article>a<p>b <a href='", "a b"),
    ("<article><p><a href=x>all of it is a link</a></p><p>text</p></article>", "all of it is a link text"),
    ("<div class='content has-sidebar'><article>a</article></div>", "a"),
    (f"<div><a href=x>Home</a> <a href=y>More</a></div><div><p>{LONG}</p><p>Short.</p></div><div>tail x</div>",
     LONG.strip() + " Short. tail x"),
    ("<div>only short</div>", ""),
    ("", ""),
])
def test_pages(inner, want):
    assert main_text(page(inner)) == want


@pytest.mark.parametrize("labels, boxes, want", [
    ([0, 1, 0, 0, -1, 0], [0] * 6, [1, 1, 1, -1, -1, -1]),
    ([1, 0, -1], [0] * 3, [1, 1, -1]),
    ([-1, 0, 0], [0, 1, 1], [-1, 1, 1]),
    ([0, 0], [0, 0], [0, 0]),
])
def test_neighbours(labels, boxes, want):
    assert second_pass(labels, boxes) == want


def test_given_pages_against_their_template(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    for row in pages.collect():
        inner = re.search("<article>(.*)</article>", row.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", inner)]
        want = " ".join(x for x in parts if x)
        assert got[row.page_id].text == want and got[row.page_id].n_chars == len(want)
    assert len(got) == pages.count()


def test_nulls_repeats_long_and_clashing_columns(spark):
    rows = [(1, None, None, 5), (None, "u", "", 6), (2, "u", page("<article>🙂é</article>"), 7),
            (2, "u", page("<article>🙂é</article>"), 7), (3, "u", page("<article>" + "word " * 400_000 + "</article>"), 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, len(r.text), r.n_chars, r.carried.text) for r in extract(pages, carry=["text"]).collect()), key=str)
    assert got == sorted([(1, 0, 0, 5), (None, 0, 0, 6), (2, 2, 2, 7), (2, 2, 2, 7), (3, 1_999_999, 1_999_999, 8)], key=str)
    assert extract(pages.limit(0)).count() == 0
