"""Bounded link walks over a table of stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.urls import normalize_url, page_key, site_key, url_struct
from ..operators.links import priority_first, scored_links, site_links_array
from ..session import materialize

__all__ = ["page_keys", "walk_sites", "finder_pages", "seed_sites"]


def _is_html(pages: DataFrame) -> Column:
    if "content_type" in pages.columns:
        return F.coalesce(F.contains("content_type", F.lit("text/html")), F.lit(False))
    return F.lit(True)


def page_keys(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """``key, page_id, is_html``: what a fetch of ``key`` finds, for pages on the host of a site or a sub-domain of it.

    No markup is read.  A page's host and its parent domains are joined with the sites by equality, so Spark broadcasts few
    sites and filters by a run-time Bloom filter where they are many; what is left is grouped on plain numbers.
    """
    host = url_struct(normalize_url(F.col("url")))["host"]
    p = pages.select("page_id", page_key(F.col("url")).alias("key"), _is_html(pages).alias("is_html"), F.split(host, r"\.").alias("labels"))
    parents = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    p = p.filter(F.size("labels") > 0).select("page_id", "key", "is_html", F.explode(parents).alias("domain"))
    kept = p.join(sites.select("domain"), "domain", "left_semi")
    return kept.groupBy("key").agg(F.min_by("is_html", "page_id").alias("is_html"), F.min("page_id").alias("page_id"))


def seed_sites(seeds: DataFrame) -> DataFrame:
    """One row per site from a column of entry URLs (the smallest URL of a host is its entry)."""
    s = seeds.select(normalize_url(F.col("url")).alias("url"), site_key(F.col("url")).alias("domain"))
    return s.filter(F.col("domain") != "").groupBy("domain").agg(F.min("url").alias("url"))


def _site_root(url: Column) -> Column:
    s = url_struct(url)
    return F.concat(s["scheme"], F.lit("://"), s["host"])


def _looked_up(frontier: DataFrame, keys: DataFrame) -> DataFrame:
    """Frontier rows with what is stored under their url."""
    found = frontier.withColumn("key", F.regexp_replace("url", r"(?s)#.*\z", "")).join(keys, "key", "left").drop("key")
    outcome = F.when(F.col("page_id").isNull(), "missing").when(F.col("is_html"), "page").otherwise("not_html")
    return found.withColumn("outcome", outcome).drop("is_html")


def _children(visits: DataFrame, pages: DataFrame, max_children: int) -> DataFrame:
    """``domain, url, at``: same-site links of the visited pages, ordered by page and place; markup is read for these pages only.

    Links leave the row of their page one by one, as short strings with a number.
    """
    read = visits.filter(F.col("outcome") == "page").select("domain", "ord", "page_id")
    p = pages.select("page_id", "html", F.col("url").alias("base")).join(read, "page_id")
    p = p.select("domain", "ord", "html", url_struct(F.col("base")).alias("base"))
    links = F.slice(priority_first(site_links_array(F.col("html"), F.col("base")), F.col("domain")), 1, max_children)
    p = p.select("domain", "ord", links.alias("links")).select("domain", "ord", F.posexplode("links").alias("i", "url"))
    return p.select("domain", "url", (F.col("ord") * F.lit(max_children) + F.col("i")).cast("long").alias("at"))


def walk_sites(
    pages: DataFrame,
    seeds: DataFrame,
    max_depth: int = fv.WALK_MAX_DEPTH,
    max_pages: int = fv.WALK_MAX_PAGES,
    max_children: int = fv.WALK_MAX_CHILDREN,
) -> DataFrame:
    """Breadth-first visits per site: ``domain, url, depth, ord, page_id, outcome``.

    The entry comes first, then the well-known paths and the entry's links, then links of links.
    Every attempted url uses budget, found or not.

    Visits are rows.  A level finds the distinct candidate urls with their smallest place (a partial aggregate of numbers),
    leaves out those visited before, and gives the first ones up to the site's budget their numbers: at most
    ``max_pages * max_children`` short rows of a site meet in a task, however large the site.  Page keys and levels are
    written once, so every plan stays as short as one level.
    """
    sites = materialize(seed_sites(seeds), "sites")
    keys = materialize(page_keys(pages, sites), "page-keys")
    frontier = sites.select("domain", "url", F.lit(0).alias("ord"))
    visits = None
    for depth in range(max_depth + 1):
        level = _looked_up(frontier.select("domain", "url", "ord"), keys).select("domain", "url", F.lit(depth).alias("depth"), "ord", "page_id", "outcome")
        level = materialize(level, "walk-level")
        visits = level if visits is None else visits.unionByName(level)
        if depth == max_depth:
            break
        found = _children(level, pages, max_children)
        if depth == 0:
            paths = F.array(*[F.lit(p) for p in fv.PRIORITY_PATHS])
            known = sites.select("domain", _site_root(F.col("url")).alias("root")).select("domain", "root", F.posexplode(paths).alias("i", "path"))
            # well-known paths come before all links
            found = found.unionByName(known.select("domain", F.concat("root", "path").alias("url"), (F.col("i") - len(fv.PRIORITY_PATHS)).cast("long").alias("at")))
        fresh = found.groupBy("domain", "url").agg(F.min("at").alias("at")).join(visits.select("domain", "url"), ["domain", "url"], "left_anti")
        used = visits.groupBy("domain").agg(F.count(F.lit(1)).cast("int").alias("used"))
        numbered = fresh.withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy("at")))
        frontier = numbered.join(used, "domain").withColumn("ord", F.col("used") + F.col("rank") - 1).filter(F.col("ord") < max_pages)
    return visits


def finder_pages(
    pages: DataFrame, seeds: DataFrame, keywords: list[str] | None = None, max_pages: int = fv.FINDER_DEFAULT_PAGES
) -> DataFrame:
    """Pages a contact search reads per site: ``domain, url, ord, page_id, error``.

    The entry, then the first ``max_pages - 1`` stored HTML pages of one queue: scored links,
    then well-known paths.  A site whose entry is missing gets one row with ``error``.
    """
    max_pages = max(1, max_pages)
    words = [k.strip().lower() for k in (keywords or []) if k.strip()]
    sites = materialize(seed_sites(seeds), "sites")
    keys = materialize(page_keys(pages, sites), "page-keys")
    entries = sites.withColumn("key", F.regexp_replace("url", r"(?s)#.*\z", "")).join(keys, "key", "left").drop("key")
    error = (
        F.when(F.col("page_id").isNull(), F.concat(
            F.lit("Could not reach "), F.col("domain"),
            F.lit(". The site may be down, blocking automated requests, or the URL may be wrong.")))
        .when(~F.col("is_html"), F.concat(F.col("domain"), F.lit(" did not return an HTML page.")))
    )
    first = entries.select("domain", "url", F.lit(0).alias("ord"), "page_id", error.alias("error"))

    # only entry pages bring their markup; one row per site
    good = first.filter(F.col("error").isNull()).select("domain", F.col("url").alias("entry"), "page_id")
    entry_html = good.join(pages.select("page_id", "html"), "page_id").select("domain", "html", F.col("entry").alias("url"))
    queue = scored_links(entry_html, words)
    paths = F.transform(F.array(*[F.lit(p) for p in fv.FINDER_SEED_PATHS]), lambda p: F.concat(_site_root(F.col("url")), p))
    queue = queue.select(
        "domain", "url",
        F.array_distinct(F.concat(F.transform("scored", lambda s: s["url"]), paths)).alias("queue"),
    )
    queue = queue.select("domain", F.posexplode(F.array_remove("queue", F.col("url"))).alias("pos", "key"))
    stored = queue.join(keys.filter("is_html"), "key").select("domain", F.col("key").alias("url"), "pos", "page_id")
    # the queue of a site is the link list of one page; its first stored pages are read
    place = F.row_number().over(Window.partitionBy("domain").orderBy("pos"))
    rest = stored.select("domain", "url", place.alias("ord"), "page_id", F.lit(None).cast("string").alias("error")).filter(F.col("ord") < max_pages)
    return first.unionByName(rest)
