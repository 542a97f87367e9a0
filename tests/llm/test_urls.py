"""Url rules against a plain version; aliases over links; components against a plain search."""

import random
import re
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cubeloom.llm import url_rules
from cubeloom.llm.graph import components
from cubeloom.llm.queries import QUERIES, RULES

PAGES = "page_id bigint, url string, html string, host string, path string, rule string, key string"


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(url):
    host, path = plain_split(url)
    fits = [
        (len(h + p), a == "allow", h + p, a) for h, p, a in RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[2:] if fits else (None, None)


def judged(spark, rows):
    pages = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES)
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return {r["page_id"]: r for r in url_rules.judge(pages, rules).collect()}


def test_given_pages(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()}
    rows = QUERIES["op4_redirect_rules"](spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == len(pages)
    for r in rows:
        rule, action = plain_rule(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (*plain_split(pages[r["page_id"]]), rule, action or "allow")


ODD_URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.COM/en/x", "http://www.Example.com/en/?a#b", "x://net/es/", "x://a.net/es",
    "http://com", "http://com/", "http://a\nb.com/\n/c", "https://u.com?x://y/z", "http://É.NET/fr/", "http://" + "a." * 9000 + "com/x",
    "http://xcom/", "http://net/fr/a://b", "http://example.com/en/",
]


def test_odd_urls(spark):
    got = judged(spark, [(i, u, None) for i, u in enumerate(ODD_URLS)] + [(3, "http://", None)])
    for i, u in enumerate(ODD_URLS):
        rule, action = plain_rule(u)
        assert tuple(got[i])[1:] == (*plain_split(u), rule, action or "allow"), u


def test_no_pages(spark):
    assert judged(spark, []) == {}


def test_aliases(spark):
    canonical = '<html><LINK REL="canonical" HREF="{}"></html>'
    refresh = "<meta http-equiv=refresh content='0; url={}'>"
    rows = [
        (1, "http://a.org/1", canonical.format("https://shop.net/es/9")),  # blocked through its target
        (2, "http://b.org/2", refresh.format("http://a.org/1#part")),  # two steps away, fragment aside
        (3, "http://c.com/3", refresh.format("http://b.org/2")),  # its own allow rule wins
        (4, "http://d.org/x/4", canonical.format("5") + canonical.format("//e.org/6")),  # a relative link, not blocked
        (5, "https://d.org/x/5", None),
        (6, "http://f.org/", '<link rel="stylesheet" href="http://shop.net/es/9"><a href="http://shop.net/es/9">'),
        (7, "http://g.org/?q=1", canonical.format("http://c.com/3")),  # blocked through an allowed page
        (8, "http://g.org/?q=2", ""),
        (9, "http://h.org/a/b", canonical.format("/root")),
        (10, "http://h.org/root", refresh.format("http://net/fr/")),
        (10, "http://h.org/root", refresh.format("http://net/fr/")),
    ]
    got = judged(spark, rows)
    assert {i for i, r in got.items() if r["verdict"] == "block"} == {1, 2, 7, 9, 10}
    assert got[3]["rule"] == "com/" and got[1]["rule"] is None


def test_references_are_resolved_by_the_usual_rules(spark):
    """Each page has one canonical link; its target by hand, null where it names no other page."""
    page = "https://U.org/a/b/c?x={}#f"
    cases = {
        "https://shop.net/es/9": "http://shop.net/es/9", "HTTP://Shop.NET/es/9?a#b": "http://shop.net/es/9?a", "/go?u=https://shop.net/es/9": "http://u.org/go?u=https://shop.net/es/9",
        "../z": "http://u.org/a/z", "./z/./y/../w": "http://u.org/a/b/z/w", "../../../z": "http://u.org/z", "..": "http://u.org/a/", "?p=2": "http://u.org/a/b/c?p=2",
        "#top": None, "": None, "mailto:a@b.net": None, "javascript:void(0)": None, "//e.org/6": "http://e.org/6", "//": None, "z?q=../r": "http://u.org/a/b/z?q=../r",
        "/a&amp;b?c=1&amp;d=2": "http://u.org/a&b?c=1&d=2", "/&#x61;&#98;": "http://u.org/ab", "  z  ": "http://u.org/a/b/z", "http:": None, "x:y": None,
    }
    rows = [(i, page.format(i), f'<link rel="canonical" href="{ref}">') for i, ref in enumerate(cases)]
    found = url_rules.links(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    got = {r["url"]: r["target"] for r in found}
    assert [got.get(page.format(i)) for i in range(len(cases))] == list(cases.values()) and len(found) == len(got)


def test_links_by_hand(spark):
    bad = "http://shop.net/es/9"
    blocked = [
        f'<link rel="alternate canonical" href="{bad}">', f"<LINK title='a > b' href={bad} rel=CANONICAL>", f'<base href="http://shop.net/es/x"><link rel=canonical href="9">',
        f'<link rel="canonical" href="http://shop.net/es/&#57;">', f'<meta content="3; URL=\'{bad}\'" http-equiv="Refresh">', '<link rel="canonical" href="http://shop.net/fr/../es/./9">',
        f'<!-- x --><link rel="canonical" href="{bad}"><!-- y -->',
    ]
    free = [
        f'<!-- <link rel="canonical" href="{bad}"> -->', f'<script>var a = \'<link rel="canonical" href="{bad}">\';</script>', f'<link rel="canonical" href="/go?u={bad}">',
        f'<link data-rel="canonical" href="{bad}">', f'<link rel="canonicals" href="{bad}">', f'<meta http-equiv="refresh" content="5">', f'<meta name="refresh" content="0; url={bad}">',
        f'<!-- open <link rel="canonical" href="{bad}">', f'<link rel="canonical" data-href="{bad}">',
    ]
    rows = [(i, f"http://p{i}.org/a", h) for i, h in enumerate(blocked + free)]
    got = judged(spark, rows)
    assert {i for i, r in got.items() if r["verdict"] == "block"} == set(range(len(blocked)))


def test_aliases_through_pages_named_in_several_ways(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.org", link.format("http://b.org/x/../y?p=1&amp;q=2")), (2, "https://B.org/y?p=1&q=2#z", link.format("http://net/fr/1")),
        (3, "http://c.org/d/", link.format("http://a.org/")), (4, "http://c.org/d/e", link.format(".")), (5, "http://c.org/d", link.format("?")),
    ]
    assert {i for i, r in judged(spark, rows).items() if r["verdict"] == "block"} == {1, 2, 3, 4}


def test_long_html_is_read(spark):
    deep = "<link rel='x' " + "a='b' " * 20_000 + ">" + "<!--" + "y" * 300_000 + "-->" + "<script>" + "<" * 200_000
    rows = [(1, "http://a.org/1", '<link rel="canonical" href="http://net/fr/1">' + deep)]
    assert judged(spark, rows)[1]["verdict"] == "block"


def plain_components(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near[a].add(b), near[b].add(a)
    roots = {}
    for node in sorted(near):
        todo = [node] if node not in roots else []
        while todo:
            x = todo.pop()
            if x not in roots:
                roots[x] = node
                todo += near[x]
    return roots


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 30)), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == plain_components(edges) and len(got) == len({r["node"] for r in got})


def test_long_chain_and_hub(spark):
    chain = list(zip(range(300), range(1, 301)))
    hub = [(1000, k) for k in range(2000, 3000)]
    edges = chain + hub
    random.Random(1).shuffle(edges)
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == plain_components(edges)
