"""Main text of pages against hand-made pages and the article element of the given ones."""

import html
import re
import time

import numpy as np
import pytest

from cubeloom.llm import html_text
from cubeloom.llm.queries import QUERIES

PAGES = "page_id bigint, url string, html string, text string, block string, label string"
PROSE = "The storm came in from the sea and it took the roof of the old mill with it before the people of the town were awake that day."
MORE = "In the morning they found that the road to the coast was under water and that the bridge had gone with all of its lamps and rails."


def extracted(spark, pages):
    rows = spark.createDataFrame([(i, f"http://x.org/{i}", p, "t", "b", "l") for i, p in enumerate(pages)], PAGES)
    got = {r["page_id"]: r for r in html_text.extract(rows.repartition(3)).collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    return [got[i]["text"] for i in range(len(pages))]


def test_given_pages(spark):
    wanted = {}
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect():
        article = re.search("(?s)<article>(.*)</article>", r["html"])[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:h1|p)>", article))
        wanted[r["page_id"]] = "\n\n".join(b for b in blocks if b)
    got = {r["page_id"]: r["text"] for r in QUERIES["op11_block_rules"](spark, "/root/testdata/sf0.1").collect()}
    assert got == wanted


AROUND = [
    "<nav><a href=/>Home of the old mill and the sea</a></nav>", "<header><p>{p}</p></header>", "<footer><p>{p}</p></footer>", "<aside>{p}</aside>",
    '<div class="cookie-notice"><p>{p}</p></div>', '<div id="sidebar">{p}</div>', '<section class="comments"><p>{p}</p></section>',
    "<form><p>{p}</p><input value='x > y'><button>Send</button></form>", "<script>var a = '<p>{p}</p>';</script>", "<style>p:after {{ content: '</p>' }}</style>",
    '<div class="ad">{p}</div>', "<!-- <p>{p}</p> -->", '<ul role="navigation"><li>{p}</li></ul>', '<div hidden><p>{p}</p></div>',
    '<div style="display: none">{p}</div>', '<div aria-hidden="true">{p}</div>', "<noscript>{p}</noscript>", '<div class="newsletterBox signup">{p}</div>',
    "<ul><li><a href=a>One thing to read</a></li><li><a href=b>And another of those</a></li></ul>", "<textarea>{p}</textarea>", "<dialog>{p}</dialog>",
]
FRAMES = ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', '<div itemprop="articleBody">{}</div>', "<div>{}</div>"]


@pytest.mark.parametrize("frame", FRAMES)
def test_what_stands_around_goes(spark, frame):
    body = f"<h1>Storm at the mill</h1><p>{PROSE} {MORE}</p><p>Short one.</p><p>{MORE} {PROSE}</p>"
    want = f"Storm at the mill\n\n{PROSE} {MORE}\n\nShort one.\n\n{MORE} {PROSE}"
    other = "Adverts of the day are for the people of the town and they are in all of the papers that you can get at the shop of the mill."
    pages = []
    for part in AROUND:
        part = part.format(p=other)
        pages += [f"<html><body>{part}{frame.format(body)}</body>", f"<html><body>{frame.format(body)}{part}</body>"]
    for part in AROUND[3:]:
        part = part.format(p=other)
        pages.append(f"<body>{frame.format(body.replace('<p>Short', part + '<p>Short'))}")
    got = extracted(spark, pages)
    assert [(p, g) for p, g in zip(pages, got, strict=True) if g != want] == []


def test_short_blocks_follow_their_neighbours(spark):
    near = f"<div><p>{PROSE} {MORE}</p><p>So it was.</p><p>{MORE} {PROSE}</p></div>"
    far = f"<div><p>{PROSE} {MORE}</p></div><p><a href=x>More of this and that here</a></p><p>All rights.</p><p><a href=y>And yet more of that</a></p>"
    assert extracted(spark, [near, far, "<p>Only this.</p>", "<article><p>Only this.</p></article>"]) == [
        f"{PROSE} {MORE}\n\nSo it was.\n\n{MORE} {PROSE}", f"{PROSE} {MORE}", "", "Only this."
    ]


def test_passes_by_hand():
    page = np.zeros(6, int)
    region = np.array([0, 0, 0, 0, 0, 0])
    label = np.array([html_text.OPEN, html_text.GOOD, html_text.OPEN, html_text.OPEN, html_text.BAD, html_text.OPEN])
    assert html_text.second_pass(page, region, label).tolist() == [1, 1, 1, 0, 0, 0]
    assert html_text.second_pass(np.array([0, 1]), np.array([0, 1]), np.array([-1, -1])).tolist() == [0, 1]
    assert html_text.second_pass(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_references_white_space_and_loose_markup(spark):
    got = extracted(
        spark,
        [
            "<article><p>a&nbsp;&amp; b\n\t c &lt;p&gt; &#233;&#x1F600; &copy &amp &am &#0;</p></article>",
            "<article><p>one<br>two <b>bo</b>ld<p>three <a title='x > y'>li</a>nk<div>four</article>",
            "<ARTICLE CLASS=post><P>a < b and c<d e</P></ARTICLE >", "<article><p>open <!-- never closed <p>x</p>", "<article>a<!>b<!-->c<?x?>d</article>",
            "<article><nav>n<p>x</nav>y</article>z", "<article><p>tail <b", '<article class="comment-closed no-comments">kept</article>',
        ],
    )
    assert got == [
        "a & b c <p> é😀 © & &am �", "one two bold\n\nthree link\n\nfour", "a < b and c", "open", "abcd", "y", "tail <b", "kept"
    ]


def test_odd_pages(spark):
    odd = [None, "", " \n ", "plain words only", "<", "<<<>>>", "</p></div>", "<script>", "<article></article>", "x" * 300_000, "\x00<p>\x00"]
    got = extracted(spark, odd + [None])
    assert got[:3] == ["", "", ""] and got[8] == ""
    empty = spark.createDataFrame([], PAGES)
    assert html_text.extract(empty).collect() == [] and html_text.blocks(empty).collect() == []
    rows = spark.createDataFrame([(7, None, "<article>a</article>", "", "", "")] * 3 + [(None, "u", "<article>b</article>", "", "", "")], PAGES)
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_text.extract(rows).collect()) == [(0, "b"), (7, "a"), (7, "a"), (7, "a")]
    assert {(r["page_id"], r["block"], r["first"], r["label"]) for r in html_text.blocks(rows).collect()} == {(7, 0, "open", "good"), (None, 0, "open", "good")}


@pytest.mark.parametrize("part", ["<", "<a ", '<a href="', "<div>", "</div>", "<!--", "<p>x", "<script>", "&amp", "<a b='>", "<nav>", "<article>", "a<br>"])
def test_time_grows_with_the_page_only(part):
    def took(n):
        begin = time.process_time()
        list(html_text.split(part * n))
        return time.process_time() - begin

    took(1000)
    assert took(200_000) < 20 * max(took(20_000), 0.02)
