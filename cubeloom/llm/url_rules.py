"""Allow and block rules for urls, carried over redirects and canonical links.

A rule names a host and the start of a path and fits that host, its subdomains
and every longer path; the longest fitting rule decides. A url without a rule
is blocked if a blocked url is among its aliases: urls joined with it by
redirects (``meta`` refresh) and canonical links, over any number of steps. A
url's own allow rule wins over its aliases. The rest is allowed.

DataFrame operations only. Rules are matched once for each different host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .graph import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything up to the first ``://``, the host, the path, the query.
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def query_part(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; it begins with a slash."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    last = F.element_at(segments, -1)
    start = F.array().cast("array<string>")
    kept = F.aggregate(
        segments, start,
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def alias_key(url: Column) -> Column:
    """What makes two urls one: host, path without dot segments, and query. Null without ``://``."""
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), without_dots(path(url)), query_part(url)))


#: What no tag counts in: comments and elements whose content is text.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title|noscript)\b.*?(?:</\1\s*>|\z)"
_TAG = r"""(?is)<(?:link|meta|base)(?=[\s/])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
# Named references that a url may hold.
_NAMED = {"&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&sol;": "/", "&colon;": ":", "&quest;": "?", "&num;": "#", "&amp;": "&"}


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute with its character references decoded, empty where there is none."""
    found = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    bare = F.trim(F.regexp_replace(found, r"""^["']|["']$""", ""), F.lit(" \t\n\f\r"))
    numbers = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});"), F.lit(0)))
    digits = lambda r: F.regexp_extract(r, r"([0-9a-fA-F]+);", 1)
    code = lambda r: F.when(F.lower(r).startswith("&#x"), F.conv(digits(r), 16, 10)).otherwise(digits(r)).cast("bigint")
    decoded = F.aggregate(numbers, bare, lambda acc, r: F.when(code(r).between(1, 127), F.replace(acc, r, F.char(code(r)))).otherwise(acc))
    for name, letter in _NAMED.items():
        decoded = F.replace(decoded, F.lit(name), F.lit(letter))
    return decoded


def resolve(base: Column, reference: Column) -> Column:
    """The absolute url that a reference on a page with url ``base`` names; null if it names no page of a host.

    A reference is absolute only if it begins with a scheme. One to a part of the
    page itself, or to something without a host (``mailto:``), names no other page.
    """
    ref = F.regexp_replace(reference, r"(?s)#.*", "")
    here = F.concat(F.lit("http://"), host(base))
    ref_path, ref_query = F.regexp_extract(ref, r"(?s)^[^?]*", 0), F.regexp_extract(ref, r"(?s)\?.*", 0)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    tidy = lambda url: F.concat(F.lit("http://"), host(url), without_dots(path(url)), query_part(url))
    return (
        F.when(ref == "", None)
        .when(ref.rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]"), tidy(ref))
        .when(ref.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(ref.rlike(r"^//[^/?#]"), tidy(F.concat(F.lit("http:"), ref)))
        .when(ref.startswith("//"), None)
        .when(ref.startswith("/"), F.concat(here, without_dots(ref_path), ref_query))
        .when(ref.startswith("?"), F.concat(here, without_dots(path(base)), ref_query))
        .otherwise(F.concat(here, without_dots(F.concat(folder, F.when(folder == "", "/").otherwise(""), ref_path)), ref_query))
    )


def links(pages: DataFrame) -> DataFrame:
    """``url, target`` for each canonical link and each redirect in ``html``.

    Tags in comments, scripts and the like don't count. References are decoded and
    resolved against the first ``base`` or else the page's own url.
    """
    tags = F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, " "), F.lit(_TAG), F.lit(0))
    told = pages.where((F.instr("url", "://") > 0) & F.col("html").rlike(r"(?i)canonical|refresh")).select("url", tags.alias("tags"))
    bases = F.filter("tags", lambda t: t.rlike(r"(?is)^<base(?=[\s/]).*[\s\"'/]href\s*="))
    base_href = F.when(F.size(bases) > 0, _attribute(F.get(bases, F.lit(0)), "href"))
    told = told.select("url", F.coalesce(resolve(F.col("url"), base_href), F.col("url")).alias("base"), F.explode("tags").alias("tag"))
    tag = F.col("tag")
    relations = F.split(F.lower(_attribute(tag, "rel")), r"\s+")
    refresh = F.regexp_extract(_attribute(tag, "content"), r"""(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["']?\s*([^"']*)""", 1)
    href = F.when(tag.rlike("(?i)^<link") & F.array_contains(relations, "canonical"), _attribute(tag, "href")).when(
        tag.rlike("(?i)^<meta") & (F.lower(_attribute(tag, "http-equiv")) == "refresh"), F.trim(refresh, F.lit(" \t\n\f\r"))
    )
    found = told.select("url", resolve(F.col("base"), href).alias("target"))
    return found.where(F.col("target").isNotNull())


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with ``host`` and ``path``) plus ``rule`` and ``action`` of the longest fitting rule, or nulls.

    ``rules`` has ``host, path, action``. Rules of one length: an allow rule wins,
    then the last in text order.
    """
    labels = F.split("host", r"\.")
    most = rules.agg(F.max(F.size(labels))).first()[0] or 0
    end = F.size("labels")
    ends = F.transform(
        F.sequence(F.lit(1), F.least(end, F.lit(max(most, 1)))), lambda k: F.array_join(F.slice("labels", end - k + 1, k), ".")
    )
    each = urls.select("host").distinct().select("host", labels.alias("labels")).select("host", F.explode(ends).alias("end"))
    given = rules.select(
        F.col("host").alias("end"),
        F.struct("path", F.concat("host", "path").alias("rule"), "action").alias("one"),
    )
    by_host = each.join(given, "end").groupBy("host").agg(F.collect_set("one").alias("fitting"))
    found = urls.join(by_host, "host", "left")
    fits = F.filter("fitting", lambda r: F.col("path").startswith(r["path"]))
    ranked = F.transform(
        fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), (r["action"] == "allow").alias("allow"), r["rule"].alias("rule"), r["action"].alias("action"))
    )
    best = F.array_max(ranked)
    return found.select(*urls.columns, best["rule"].alias("rule"), best["action"].alias("action"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    A url that is null or has no ``://`` has an empty host and path, no rule and
    no aliases, and is allowed. Null ``html`` has no links. Repeated rows are
    judged alike; an empty table gives no rows.
    """
    linked = stored(links(pages).distinct(), "links")
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), alias_key(F.col("url")).alias("key"))
    urls = matched(urls, rules)
    edges = linked.select(alias_key(F.col("url")).alias("a"), alias_key(F.col("target")).alias("b"))
    rooted = stored(components(edges), "aliases")
    ends = linked.select("url").union(linked.select("target")).distinct()
    place = without_dots(path(F.col("url")))
    ends = ends.select(alias_key(F.col("url")).alias("node"), host(F.col("url")).alias("host"), place.alias("path"))
    bad = matched(ends, rules).where("action = 'block'").select("node").distinct()
    bad_roots = rooted.join(bad, "node", "left_semi").select("root").distinct()
    tainted = rooted.join(bad_roots, "root", "left_semi").select(F.col("node").alias("key"), F.lit("block").alias("by_alias"))
    told = urls.join(tainted, "key", "left")
    return told.select("page_id", "host", "path", "rule", F.coalesce("action", "by_alias", F.lit("allow")).alias("verdict"))
