"""Main text of web pages by two passes of rules over the blocks of a page.

A page is cut into blocks at block-level tags. What menus, page headers and
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
hold is told by its element, role or class name and is cut out at once.

First pass, by length, link density and share of stop words: a block is good,
bad or undecided. A block of links is bad. A long block with many stop words is
good. Short blocks, and blocks with too few stop words to tell, are undecided
where the page marks a main region (``article``, ``main`` or a name for it);
elsewhere a longer block without stop words is bad. If a page marks a main
region with any text, blocks outside it are bad.

Second pass: an undecided block takes the label of its nearest decided
neighbours in the same region. If the two sides differ, the nearer one counts,
and the good one when both are as near. In a main region without any decided
block the blocks are good, elsewhere they are bad.

A page is one row and is judged where it is read: nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import by_step

# Names of HTML elements.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre section select "
    "summary table tbody td template textarea tfoot th thead title tr ul".split()
)
CUT_TAGS = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea iframe object svg canvas audio video "
    "dialog menu".split()
)
RAW_TAGS = frozenset("script style textarea title iframe xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN_TAGS = frozenset(["article", "main"])
# Words in class names, ids and roles.
CUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment commentlist comments complementary "
    "consent contentinfo cookie cookies copyright dialog discussion disqus footer form gdpr header login masthead menu menubar modal nav "
    "navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promoted promotion related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar "
    "widget".split()
)
MAIN_NAMES = frozenset("article articlebody content entry main post story".split())
NOT_A_NAME = frozenset("has no with without is open closed off on hide hidden not".split())
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he his in is it not of on or she that the their they this to was were which with "
    "you aber als auch auf aus bei das dass dem den der des die ein eine einen einer er es für hat ich im ist mit nach nicht oder sich sie "
    "sind um und von war wie wir zu zum zur au aux avec ce cette dans de du elle en est et il la le les leur mais ne nous ou par pas plus "
    "pour que qui sa se ses son sont sur un une vous al como con del el era esta este ha las lo los más no nos o para pero por se sin su "
    "sus una y".split()
)
#: Shortest block that can be judged by its stop words, and the length from which they decide alone.
SHORT, LONG = 70, 200
#: Share of stop words that makes a block near-good, and good.
FEW_STOPS, MANY_STOPS = 0.2, 0.25
#: Share of a block's characters inside links above which it is bad: outside a main region, and inside one.
LINKS_OUTSIDE, LINKS_INSIDE = 0.2, 0.5

GOOD, BAD, OPEN = 1, 0, -1

_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: The rest of a tag; a ``>`` inside a quoted value does not end it.
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_ATTR = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT_NAME = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")

Block = tuple[str, int, int, int, int]


def _named(attrs: str, of: frozenset[str]) -> bool:
    """Whether a class, id, role or itemprop in a tag's attributes has a word of ``of`` at its head or end."""
    for name, *values in _ATTR.findall(attrs):
        if name.lower() in ("class", "id", "role", "itemprop"):
            for one in "".join(values).split():
                parts = [p.lower() for p in _SPLIT_NAME.split(one) if p]
                if parts and not NOT_A_NAME.intersection(parts) and ({one.lower(), parts[0], parts[-1]} & of):
                    return True
    return False


def _hidden(attrs: str) -> bool:
    given = {n.lower(): "".join(v).lower() for n, *v in _ATTR.findall(attrs)}
    return given.get("aria-hidden") == "true" or bool(_HIDDEN.search(given.get("style", ""))) or bool(re.search(r"\shidden(\s|$)", attrs))


def split(page: str) -> Iterator[Block]:
    """``text, region, n_words, n_stops, n_link_chars`` of each block that is not cut out, in page order.

    ``region`` is 0 outside main regions and numbers them from 1. One scan from
    left to right; every character is looked at a bounded number of times.
    """
    pos, size, last_end, last_link = 0, len(page), page.rfind(">"), page.lower().rfind("</a")
    opened: list[tuple[str, int, int]] = []  # element, whether it is cut, main region
    depth: Counter[str] = Counter()
    pieces: list[tuple[str, bool]] = []
    cut = region = regions = 0
    linked = False
    raw_end: dict[str, int] = {}

    def flush() -> Iterator[Block]:
        if pieces:
            text = " ".join(entities.unescape("".join(p for p, _ in pieces)).split())
            if text:
                inside = " ".join(entities.unescape("".join(p for p, a in pieces if a)).split())
                found = _WORD.findall(text.lower())
                yield text, region, len(found), sum(map(STOP_WORDS.__contains__, found)), len(inside)
            pieces.clear()

    while pos < size:
        at = page.find("<", pos)
        if at < 0 or at > last_end:
            at = size
        if at > pos and not cut:
            pieces.append((page[pos:at], linked))
        if at == size:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            if page.startswith((">", "->"), at + 4):
                end, step = page.index(">", at), 1
            else:
                step = 3
            pos = size if end < 0 else end + step
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            pos = page.index(">", at) + 1
            continue
        named = _NAME.match(page, at)
        rest = named and _REST.match(page, named.end())
        if not rest:
            if not cut:
                pieces.append(("<", linked))
            pos = at + 1
            continue
        tag, closing, attrs, pos = named[1].lower(), page[at + 1] == "/", rest[0][:-1], rest.end()
        if tag in BLOCK_TAGS:
            yield from flush()
        elif tag == "br":
            pieces.append((" ", linked))
        if tag == "a":
            linked = not closing and pos <= last_link
        elif closing:
            if depth[tag]:
                while True:
                    gone, was_cut, was_region = opened.pop()
                    depth[gone] -= 1
                    cut -= was_cut
                    region = was_region
                    if gone == tag:
                        break
        elif tag in RAW_TAGS:
            if raw_end.get(tag, 0) >= 0:
                found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, pos)
                raw_end[tag] = found.start() if found else -1
            end = raw_end[tag]
            after = page.find(">", end) + 1 if end >= 0 else size
            pos = after if after else size
        elif tag not in VOID_TAGS and (tag in BLOCK_TAGS or tag in CUT_TAGS) and tag != "p":
            begins = tag in MAIN_TAGS or tag not in ("html", "body") and _named(attrs, MAIN_NAMES)
            drop = tag in CUT_TAGS or tag == "header" and not region or _hidden(f" {attrs}")
            if tag not in ("html", "body", "main") and not drop:
                drop = _named(attrs, CUT_NAMES)
            opened.append((tag, int(drop), region))
            depth[tag] += 1
            cut += drop
            if begins and not region and not cut:
                regions += 1
                region = regions
    yield from flush()


def first_pass(page: np.ndarray, region: np.ndarray, length: np.ndarray, words: np.ndarray, stops: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Label of each block by its own numbers. ``page`` is the page's place in the batch, ascending."""
    share, density = stops / np.maximum(words, 1), links / np.maximum(length, 1)
    inside, short = region > 0, length < SHORT
    good = (length >= LONG) & (share >= MANY_STOPS) | inside & ~short & (share >= FEW_STOPS)
    bad = ~inside & ((density > LINKS_OUTSIDE) | short & (links > 0) | ~short & (share < FEW_STOPS)) | (density > LINKS_INSIDE)
    marked = np.zeros(int(page[-1]) + 1 if len(page) else 0, bool)
    marked[page[inside & ~bad]] = True
    bad |= ~inside & marked[page]
    return np.where(bad, BAD, np.where(good, GOOD, OPEN))


def second_pass(page: np.ndarray, region: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Undecided blocks take the label of the nearest decided ones of their page and region."""
    n = len(label)
    if not n:
        return label
    order = np.lexsort((np.arange(n), region, page))
    one, place = label[order], np.arange(n)
    starts = np.concatenate(([True], (np.diff(page[order]) != 0) | (np.diff(region[order]) != 0)))
    run = np.cumsum(starts)
    before = np.maximum.accumulate(np.where(one != OPEN, place, -1))
    after = np.minimum.accumulate(np.where(one != OPEN, place, n)[::-1])[::-1]
    has_before = (before >= 0) & (run[np.maximum(before, 0)] == run)
    has_after = (after < n) & (run[np.minimum(after, n - 1)] == run)
    left, right = one[np.maximum(before, 0)], one[np.minimum(after, n - 1)]
    near_left, near_right = place - before, after - place
    told = np.where(
        has_before & has_after,
        np.where(near_left == near_right, np.maximum(left, right), np.where(near_left < near_right, left, right)),
        np.where(has_before, left, np.where(has_after, right, np.where(region[order] > 0, GOOD, BAD))),
    )
    out = np.empty(n, label.dtype)
    out[order] = np.where(one == OPEN, told, one)
    return out


def _judged(texts: list[bytes | None]) -> tuple[list[Block], np.ndarray, np.ndarray, np.ndarray]:
    """All blocks of some pages, each one's page, and the labels after either pass."""
    per_page = [list(split((t or b"").decode("utf-8", "replace"))) for t in texts]
    every = [b for blocks in per_page for b in blocks]
    page = np.repeat(np.arange(len(texts)), [len(b) for b in per_page])
    numbers = np.array([(len(b[0]), *b[1:]) for b in every], np.int64).reshape(-1, 5)
    length, region, words, stops, links = numbers.T
    first = first_pass(page, region, length, words, stops, links)
    return every, page, first, second_pass(page, region, first)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``).

    ``text`` holds the good blocks in page order, joined by two line feeds;
    character references are decoded and white space inside a block is one
    space. Null, empty and all-boilerplate pages have an empty text. Repeated rows
    give repeated results; other columns are left out; an empty table gives no
    rows. Memory in a task is a small multiple of a few MB or of the longest page.
    """

    def make(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        every, page, _, label = _judged(texts)
        kept: list[list[str]] = [[] for _ in texts]
        for k in np.flatnonzero(label == GOOD):
            kept[page[k]].append(every[k][0])
        whole = ["\n\n".join(k) for k in kept]
        chars = pa.array([len(t) for t in whole], pa.int64())
        return pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(whole, pa.string()), chars], ["page_id", "url", "text", "n_chars"])

    schema = "page_id bigint, url string, text string, n_chars bigint"
    return _plain(pages).mapInArrow(by_step(make, "html"), schema)


def blocks(pages: DataFrame) -> DataFrame:
    """``page_id, block, text, first, label``: every block that is not cut out, counted from 0 in page order.

    ``first`` and ``label`` are ``good``, ``bad`` or (``first`` only) ``open``. For
    looking into a decision.
    """

    def make(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        every, page, first, label = _judged(texts)
        names = {GOOD: "good", BAD: "bad", OPEN: "open"}
        nth = np.arange(len(page)) - np.searchsorted(page, page)
        return pa.record_batch(
            [
                batch.column("page_id").take(pa.array(page)), pa.array(nth, pa.int64()), pa.array([b[0] for b in every], pa.string()),
                pa.array([names[x] for x in first.tolist()], pa.string()), pa.array([names[x] for x in label.tolist()], pa.string()),
            ],
            ["page_id", "block", "text", "first", "label"],
        )

    schema = "page_id bigint, block bigint, text string, first string, label string"
    return _plain(pages).mapInArrow(by_step(make, "html"), schema)


def _plain(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
