"""Links of pages: discovery order, scoring, counts.  All projections of ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.html import attr, markup, start_tags
from ..functions.text import contains_any, each, extract, extract_all, let, trim_ws
from ..functions.urls import (
    is_same_site, is_valid_url, normalize_url, resolve_links, site_key, strip_query_fragment, url_struct,
)
from .page_facts import with_domain

__all__ = ["normalize_urls", "valid_urls", "page_links", "rank_links", "score_links", "link_counts", "site_links_array", "closed_anchors", "scored_links"]


def normalize_urls(df: DataFrame, column: str = "url") -> DataFrame:
    """Adds ``normalized`` and ``domain`` for a column of URLs typed by hand."""
    return df.withColumn("normalized", normalize_url(F.col(column))).withColumn("domain", site_key(F.col(column)))


def valid_urls(df: DataFrame, column: str = "url") -> DataFrame:
    return df.filter(is_valid_url(F.col(column)))


def _hrefs(html: Column, skip: str = fv.SKIP_HREF) -> Column:
    hrefs = F.transform(start_tags(markup(html), "a"), lambda t: trim_ws(attr(t, "href")))
    return F.filter(hrefs, lambda h: (h != "") & ~h.rlike(skip))


def page_links(pages: DataFrame) -> DataFrame:
    """One row per anchor: ``ord, href, url, host, kind`` (kind is internal, external or other)."""
    p = with_domain(pages).select("domain", "page_id", "url", _hrefs(F.col("html")).alias("hrefs"))
    p = p.withColumn("base", url_struct(F.col("url")))
    p = p.select("domain", "page_id", F.posexplode(F.arrays_zip("hrefs", resolve_links(F.col("base"), F.col("hrefs")).alias("s"))).alias("ord", "l"))
    p = p.select("domain", "page_id", "ord", F.col("l.hrefs").alias("href"), F.col("l.s").alias("s")).filter(F.col("s").isNotNull())
    web = F.col("s.scheme").isin("http", "https")
    kind = F.when(web & is_same_site(F.col("s.host"), F.col("domain")), "internal").when(web, "external").otherwise("other")
    return p.select(
        "domain", "page_id", "ord", "href",
        F.when(web, strip_query_fragment(F.col("s"))).alias("url"), kind.alias("kind"),
    )


def site_links_array(html: Column, base: Column) -> Column:
    """Every distinct http(s) link of a page as struct(url, host, priority), in first-seen order.

    ``base`` is the struct of the page's URL.  Independent of any site, so one column serves
    walks that start from different hosts.
    """

    def target(s: Column) -> Column:
        return F.struct(
            strip_query_fragment(s).alias("url"), s["host"].alias("host"),
            contains_any(F.lower(F.rtrim(s["path"], F.lit("/"))), fv.PRIORITY_PATHS).alias("priority"),
        )

    web = F.filter(resolve_links(base, _hrefs(html)), lambda s: s["scheme"].isin("http", "https"))
    return F.array_distinct(F.transform(web, target))


def priority_first(links: Column, base: Column) -> Column:
    """Urls of ``site_links_array`` on the site ``base``, priority paths first."""

    def order(own: Column) -> Column:
        return F.concat(F.filter(own, lambda s: s["priority"]), F.filter(own, lambda s: ~s["priority"]))

    ordered = let(F.filter(links, lambda s: is_same_site(s["host"], base)), order)
    return F.transform(ordered, lambda s: s["url"])


def rank_links(pages: DataFrame) -> DataFrame:
    """Distinct same-site links of each page with their rank: priority paths first."""
    p = with_domain(pages)
    p = p.select("domain", "page_id", "html", url_struct(F.col("url")).alias("base"))
    p = p.select("domain", "page_id", site_links_array(F.col("html"), F.col("base")).alias("links"))
    return p.select("domain", "page_id", F.posexplode(priority_first(F.col("links"), F.col("domain"))).alias("rank", "url"))


def _without_tags(text: Column) -> Column:
    """A blank for each tag.  Behind the last ``>`` there is none, so that part is not searched, however often it has ``<``."""
    tail = F.substring_index(text, ">", -1)
    return F.concat(F.regexp_replace(F.left(text, F.length(text) - F.length(tail)), r"<[^>]*>", " "), tail)


def closed_anchors(html: Column, max_text: int | None = None) -> Column:
    """Anchors with an ``href`` in page order, as array of struct(href, text); time is linear in the page.

    A page is cut at ``</a>``; each part holds at most one anchor, which begins at its first start tag with a quoted ``href``
    and takes the rest of the part as its text (markup included).  A tag ends at its first ``>`` and before any ``</a>``, so an
    address that contains one of them, and a tag that does not end before ``</a>``, count as none.  With ``max_text`` only tags followed by at most so many characters begin an anchor.  Null
    gives null, and a page without anchors an empty array.
    """

    def tags(pieces: Column) -> Column:
        ended = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        return F.struct(pieces.alias("pieces"), F.transform(ended, lambda t: extract(t, fv.FINDER_ANCHOR_TAG, 1)).alias("hrefs"))

    def first(x: Column) -> Column:
        hrefs, pieces = x["hrefs"], x["pieces"]
        if max_text is None:
            begins = F.transform(hrefs, lambda h: h != "")
        else:
            near = F.size(F.split(F.right(F.array_join(pieces, ">"), F.lit(max_text + 1)), ">")) - 1
            begins = F.transform(F.arrays_zip(hrefs.alias("h")), lambda h, i: (h["h"] != "") & (i >= F.size(hrefs) - near))
        return F.struct(x.alias("x"), F.array_position(begins, True).cast("int").alias("at"))

    def anchor(y: Column) -> Column:
        pieces = y["x"]["pieces"]
        rest = F.slice(pieces, y["at"] + 1, F.size(pieces))
        return F.struct(F.get(y["x"]["hrefs"], y["at"] - 1).alias("href"), F.array_join(rest, ">").alias("text"))

    parts = F.split(html, "(?i)</a>")
    closed = F.slice(parts, F.lit(1), F.size(parts) - 1)
    found = each(closed, lambda part: F.split(part, ">"), tags, first)
    return F.transform(F.filter(found, lambda y: y["at"] > 0), anchor)


def first_of_each(found: Column, key: str) -> Column:
    """Of an array of structs the first one of each value of the field ``key``, as struct(key, ord, x), in order of the key.

    Sorted once and compared with the neighbour: n log n, where a search per value takes the square.
    """
    keyed = F.transform(found, lambda x, i: F.struct(x[key].alias("key"), i.alias("ord"), x.alias("x")))
    return let(F.array_sort(keyed), lambda xs: F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1)["key"] != x["key"])))


def scored_links(pages: DataFrame, keywords: list[str], max_anchor: int | None = None) -> DataFrame:
    """Adds ``scored``: same-site links, best contact candidates first, as array of struct(neg_score, ord, url).

    Anchors may be of any length unless ``max_anchor`` limits them.
    """
    keep = [c for c in pages.columns if c != "html"]
    words = [k for k in keywords if k]
    p = pages.select(
        *keep, url_struct(F.col("url")).alias("base"),
        F.transform(
            closed_anchors(F.col("html"), max_anchor),
            lambda t: F.struct(trim_ws(t["href"]).alias("href"), F.lower(_without_tags(t["text"])).alias("anchor")),
        ).alias("tags"),
    )
    p = p.withColumn("targets", resolve_links(F.col("base"), F.transform("tags", lambda t: t["href"])))

    def link(t: Column, s: Column) -> Column:
        good = (t["href"] != "") & ~t["href"].rlike(fv.SKIP_HREF_FINDER) & is_same_site(s["host"], F.col("domain"))
        return F.when(good, F.struct(strip_query_fragment(s).alias("url"), t["anchor"].alias("anchor"), F.lower(s["path"]).alias("path")))

    p = p.withColumn("found", F.zip_with("tags", "targets", link))
    p = p.withColumn("found", F.filter("found", lambda x: x.isNotNull() & ~x["url"].rlike(fv.FILE_LINK)))

    def scored(e: Column) -> Column:
        x = e["x"]
        score = (
            F.when(contains_any(x["path"], fv.CONTACT_HINTS + words), 10.0).otherwise(0.0)
            + F.when(contains_any(x["anchor"], fv.CONTACT_HINTS), 6.0).otherwise(0.0)
            + F.when(contains_any(x["anchor"], words), 4.0).otherwise(0.0)
            - (F.size(F.split(x["url"], "/")) - 3) * 0.5
        )
        return F.struct((-score).alias("neg_score"), e["ord"].alias("ord"), x["url"].alias("url"))

    return p.select(*keep, F.array_sort(F.transform(first_of_each(F.col("found"), "url"), scored)).alias("scored"))


def score_links(pages: DataFrame, keywords: list[str] | None = None, max_anchor: int | None = None) -> DataFrame:
    """Same-site links of each page with the contact score and rank."""
    words = [k.strip().lower() for k in (keywords or []) if k.strip()]
    p = scored_links(with_domain(pages).select("domain", "page_id", "url", "html"), words, max_anchor)
    p = p.select("domain", "page_id", F.posexplode("scored").alias("rank", "l"))
    return p.select("domain", "page_id", "rank", "l.url", (-F.col("l.neg_score")).alias("score"))


def link_counts(pages: DataFrame) -> DataFrame:
    """Same-site and other links per page; schemes without a host count as external."""
    p = with_domain(pages).select("domain", "page_id", "url", _hrefs(F.col("html")).alias("hrefs"))
    p = p.withColumn("base", url_struct(F.col("url")))
    hosts = F.transform(resolve_links(F.col("base"), F.col("hrefs")), lambda s: s["host"])
    p = p.select("domain", "page_id", F.filter(hosts, lambda h: h.isNotNull()).alias("hosts"))
    internal = F.size(F.filter("hosts", lambda h: is_same_site(h, F.col("domain"))))
    return p.select(
        "domain", "page_id", internal.alias("internal_links"), (F.size("hosts") - internal).alias("external_links")
    )
