"""Site records: walk the stored pages of each site, extract every fact, merge per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.addresses import distinct_addresses, extract_addresses
from ..operators.emails import extract_emails
from ..operators.page_facts import (
    clean_keywords, detect_tech, extract_metadata, extract_seo, extract_social, match_keywords,
)
from ..operators.phones import dedupe_phones, extract_phones
from ..operators.structured import structured_data
from ..session import materialize
from .walk import seed_sites, walk_sites

__all__ = [
    "visited_pages", "site_records", "keyword_rollup", "site_summary", "bulk_kpis", "overview_with_totals",
    "tech_by_category", "breakdown", "run_errors", "run_logs",
]


def visited_pages(pages: DataFrame, visits: DataFrame) -> DataFrame:
    """The stored HTML pages of a walk, with the walk's site as ``domain``.

    ``visits`` should be a written table: its size is then known, so Spark broadcasts it while it
    is small and otherwise joins with a run-time filter, before any markup is moved.
    """
    v = visits.filter(F.col("outcome") == "page").select("domain", "page_id", F.col("ord").alias("page_ord"), "depth")
    p = pages.drop("domain")
    return p.join(v, "page_id")


def _per_site(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Values in page order; at most the pages of one bounded walk."""
    return df.groupBy("domain").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("page_ord", value.alias("v")))), lambda x: x["v"]).alias(name)
    )


def keyword_rollup(hits: DataFrame, sites: DataFrame, keywords: list[str], order: str = "page_id") -> DataFrame:
    """Totals per (domain, keyword), with zero rows for keywords a site never uses."""
    total = hits.groupBy("domain", "keyword").agg(
        F.sum("count").alias("count"), F.count("*").alias("pages"), F.min_by("sample", order).alias("sample")
    )
    words = F.array(*[F.lit(k) for k in clean_keywords(keywords)])
    grid = sites.select("domain").distinct().select("domain", F.posexplode(words).alias("keyword_no", "keyword"))
    return grid.join(total, ["domain", "keyword"], "left").select(
        "domain", "keyword_no", "keyword",
        F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("pages", F.lit(0)).alias("pages"),
        F.coalesce("sample", F.lit("")).alias("sample"),
    )


def run_errors(visits: DataFrame) -> DataFrame:
    return visits.filter(F.col("outcome") == "missing").select(
        "domain", "ord", F.concat(F.lit("Failed: "), F.col("url")).alias("error")
    )


def run_logs(visits: DataFrame) -> DataFrame:
    return visits.filter(F.col("outcome") == "page").select(
        "domain", "ord", F.concat(F.lit("✓ ["), F.col("depth"), F.lit("] "), F.col("url")).alias("log")
    )


def site_records(
    pages: DataFrame, seeds: DataFrame, keywords: list[str] | None = None, visits: DataFrame | None = None
) -> DataFrame:
    """One nested row per site.

    A walk reads at most twenty-five pages per site, so every list gathered per site is bounded.
    The visits and the visited markup are written once; the facts are then independent scans of
    that table, each reduced to one row per site and joined on the site.
    """
    visits = visits if visits is not None else materialize(walk_sites(pages, seeds), "visits")
    p = materialize(visited_pages(pages, visits), "visited-pages")
    sites = seed_sites(seeds)
    order = ["page_ord", "ord"]
    keyed = p.select("domain", "page_id", "page_ord")

    emails = extract_emails(p).groupBy("domain").agg(F.array_sort(F.collect_set("email")).alias("emails"))
    numbers = dedupe_phones(extract_phones(p), order=order)
    phones = numbers.groupBy("domain").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("digits", "display"))), lambda x: x["display"]).alias("phones")
    )
    social = extract_social(p).groupBy("domain", "platform").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    social = social.groupBy("domain").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "urls")))).alias("social_links"))
    tech = detect_tech(p).join(keyed, ["domain", "page_id"]).groupBy("domain", "name").agg(
        F.min_by("category", F.struct("page_ord", "ord")).alias("category")
    )
    tech = tech.groupBy("domain").agg(F.collect_list(F.struct("category", "name")).alias("tech"))
    by_locale = F.array_sort(F.transform(
        "tech", lambda t: F.struct(F.collate(t["category"], "UNICODE").alias("category"), F.collate(t["name"], "UNICODE").alias("name"))))
    tech = tech.select("domain", F.transform(by_locale, lambda t: F.struct(
        F.collate(t["name"], "UTF8_BINARY").alias("name"), F.collate(t["category"], "UTF8_BINARY").alias("category"))).alias("tech"))

    s = structured_data(p)
    structured = s.groupBy("domain").agg(
        F.min_by("company", F.when(F.col("company").isNotNull(), F.col("page_ord"))).alias("company"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_ord", "products"))), lambda x: x["products"])).alias("products"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_ord", "jobs"))), lambda x: x["jobs"])).alias("jobs"),
    )
    # of a page, the addresses in its text come before those in its structured data
    lines = extract_addresses(p).select("domain", "page_ord", F.lit(0).alias("source"), "ord", "address").unionByName(
        s.select("domain", "page_ord", F.lit(1).alias("source"), F.posexplode("addresses").alias("ord", "address"))
    )
    kept = distinct_addresses(lines, ["domain"], ["page_ord", "source", "ord"])
    addresses = kept.groupBy("domain").agg(F.array_sort(F.collect_list(F.collate("address", "UNICODE"))).alias("a"))
    addresses = addresses.select("domain", F.transform("a", lambda x: F.collate(x, "UTF8_BINARY")).alias("addresses"))

    meta = extract_metadata(p).join(keyed, ["domain", "page_id"]).groupBy("domain").agg(
        F.min_by(F.struct("title", "description"), "page_ord").alias("metadata")
    )
    seo = extract_seo(p.filter(F.col("page_ord") == 0))
    seo = seo.select("domain", F.struct(*[c for c in seo.columns if c not in ("domain", "page_id")]).alias("seo"))
    trail = visits.groupBy("domain").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("outcome") == "page", F.struct("ord", "url")))), lambda x: x["url"]).alias("pages_crawled"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("outcome") == "missing", F.struct("ord", "url")))),
                    lambda x: F.concat(F.lit("Failed: "), x["url"])).alias("errors"),
    )
    out = sites
    parts = [emails, phones, addresses, social, structured, tech, seo, meta, trail]
    words = clean_keywords(keywords or [])
    if words:
        hits = match_keywords(p, words).join(keyed, ["domain", "page_id"])
        rolled = keyword_rollup(hits, sites, words, order="page_ord")
        parts.append(rolled.groupBy("domain").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("keyword_no", "keyword", "count", "pages", "sample"))),
                        lambda k: F.struct(k["keyword"].alias("keyword"), k["count"].alias("count"), k["pages"].alias("pages"), k["sample"].alias("sample"))).alias("keyword_hits")))
    for part in parts:
        out = out.join(part, "domain", "left")
    empty = F.array().cast("array<string>")
    for c in ("emails", "phones", "addresses", "pages_crawled", "errors"):
        out = out.withColumn(c, F.coalesce(c, empty))
    for c in ("products", "jobs", "tech"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)))
    out = out.withColumn("social_links", F.coalesce("social_links", F.create_map().cast("map<string,array<string>>")))
    return out.withColumn("status", F.when(F.size("pages_crawled") > 0, "success").otherwise("fail")).withColumn(
        "elapsed", F.lit(0.0)
    )


# ------------------------------------------------------------------------------ reports on site records
def _social_count() -> Column:
    return F.aggregate(F.map_values("social_links"), F.lit(0), lambda n, urls: n + F.size(urls))


def _dash(x: Column) -> Column:
    return F.coalesce(F.when(x != "", x), F.lit("—"))


def site_summary(sites: DataFrame) -> DataFrame:
    """Ten summary fields per site and the remaining headline counts."""
    return sites.select(
        _dash(F.col("domain")).alias("domain"), _dash(F.col("metadata.title")).alias("title"),
        _dash(F.col("metadata.description")).alias("description"),
        F.size("emails").alias("emails_found"), F.size("phones").alias("phones_found"), _social_count().alias("social_links"),
        F.size("pages_crawled").alias("pages_crawled"), F.size("errors").alias("errors"), F.col("elapsed").alias("seconds"),
        _dash(F.col("status")).alias("status"), F.size("addresses").alias("addresses"), F.size("tech").alias("technologies"),
    )


def bulk_kpis(sites: DataFrame) -> DataFrame:
    """Totals over all sites."""
    return sites.agg(
        F.coalesce(F.sum(F.size("emails")), F.lit(0)).alias("total_emails"),
        F.coalesce(F.sum(F.size("phones")), F.lit(0)).alias("total_phones"),
        F.coalesce(F.sum(_social_count()), F.lit(0)).alias("total_social"),
        F.coalesce(F.sum(F.size("pages_crawled")), F.lit(0)).alias("total_pages"),
        F.count_if(F.col("status") == "success").alias("succeeded"), F.count("*").alias("sites"),
        F.round(F.coalesce(F.sum("elapsed"), F.lit(0.0)), 1).alias("total_seconds"),
    )


def overview_with_totals(sites: DataFrame) -> DataFrame:
    """One row per site with counts, and a TOTAL row that sums them."""
    def n(platform: str) -> Column:
        return F.coalesce(F.size(F.try_element_at("social_links", F.lit(platform))), F.lit(0))

    counts = ["emails", "phones", "linkedin", "facebook", "instagram", "twitter", "tiktok", "pages", "seconds"]
    flat = sites.select(
        "domain", F.coalesce("metadata.title", F.lit("")).alias("title"), F.upper("status").alias("status"),
        F.size("emails").alias("emails"), F.size("phones").alias("phones"),
        *[F.when(F.size("social_links") > 0, n(p)).otherwise(0).alias(p) for p in counts[2:7]],
        F.size("pages_crawled").alias("pages"), F.col("elapsed").alias("seconds"),
    )
    rolled = flat.rollup("domain").agg(
        *[F.sum(x).alias(x) for x in counts], F.first("title").alias("title"), F.first("status").alias("status"),
        F.grouping("domain").alias("is_total"),
    )
    total = F.col("is_total") == 1
    return rolled.select(
        F.when(total, "TOTAL").otherwise(F.col("domain")).alias("domain"),
        F.when(total, "").otherwise(F.col("title")).alias("title"),
        F.when(total, "").otherwise(F.col("status")).alias("status"), *counts,
    )


def tech_by_category(tech: DataFrame) -> DataFrame:
    """Distinct technology names per site and category."""
    return tech.groupBy("domain", "category").agg(F.array_sort(F.collect_set("name")).alias("names"))


def breakdown(counts: DataFrame, max_slices: int = fv.MAX_SLICES) -> DataFrame:
    """Labels with a positive value, ranked; the tail folded into one slice; whole percents that
    add up to 100 (largest remainder).

    Only the top ``max_slices`` rows and one row of totals are brought together, however many
    labels there are: the folded slice is the total minus the slices shown.
    """
    shown = counts.filter(F.col("value") > 0).select("label", F.col("value").cast("bigint").alias("value"))
    head = shown.orderBy(F.col("value").desc(), "label").limit(max_slices)
    head = head.select((-F.col("value")).alias("neg"), "label", "value", F.lit(None).cast("bigint").alias("n"))
    totals = shown.agg(F.sum("value").alias("value"), F.count("*").alias("n")).select(
        F.lit(None).cast("bigint").alias("neg"), F.lit(None).cast("string").alias("label"), "value", "n"
    )
    row = head.unionByName(totals).agg(
        F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.struct("neg", "label", "value")))).alias("top"),
        F.max("n").alias("n"), F.max(F.when(F.col("n").isNotNull(), F.col("value"))).alias("sum"),
    ).filter(F.col("n") > 0)
    fold = F.col("n") > max_slices
    kept = F.when(fold, F.slice("top", 1, max_slices - 1)).otherwise(F.col("top"))
    row = row.withColumn("kept", F.transform(kept, lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"))))
    rest = F.col("sum") - F.aggregate("kept", F.lit(0).cast("bigint"), lambda n, x: n + x["value"])
    other = F.struct(
        F.concat(F.lit("Other ("), F.col("n") - (max_slices - 1), F.lit(")")).alias("label"), rest.alias("value")
    )
    rows = row.select(F.when(fold, F.array_append("kept", other)).otherwise(F.col("kept")).alias("rows"))
    total = F.aggregate("rows", F.lit(0).cast("bigint"), lambda n, x: n + x["value"])
    rows = rows.withColumn("total", total)
    shares = F.transform("rows", lambda r, i: F.struct(
        i.alias("i"), r["label"].alias("label"), r["value"].alias("value"),
        F.floor(r["value"] * 100 / F.col("total")).alias("whole"),
        (-((r["value"] * 100) % F.col("total"))).alias("neg_rest"),
    ))
    rows = rows.withColumn("shares", shares)
    left = 100 - F.aggregate("shares", F.lit(0).cast("bigint"), lambda n, s: n + s["whole"])
    rows = rows.withColumn("left", left).withColumn("by_rest", F.array_sort(F.transform(
        "shares", lambda s: F.struct(s["neg_rest"].alias("r"), s["i"].alias("i")))))
    lucky = F.transform(F.slice("by_rest", F.lit(1), F.greatest(F.col("left").cast("int"), F.lit(0))), lambda x: x["i"])
    rows = rows.withColumn("lucky", lucky)
    out = F.transform("shares", lambda s: F.struct(
        s["i"].alias("rank"), s["label"].alias("label"), s["value"].alias("value"),
        (s["whole"] + F.when(F.array_contains(F.col("lucky"), s["i"]), 1).otherwise(0)).alias("percent")))
    return rows.select(F.explode(out).alias("o")).select("o.*")
