"""Contact search: found addresses and a business profile per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.addresses import extract_addresses
from ..operators.emails import find_page_emails, score_emails
from ..operators.page_facts import (
    classify_category, detect_business_name, detect_tech, extract_social, has_contact_form, is_contact_page,
    is_profile_page, looks_like_business_address,
)
from ..operators.phones import dedupe_phones, extract_phones
from ..operators.ranks import rows_in_order
from ..session import materialize
from .walk import finder_pages

__all__ = ["read_pages_of", "found_emails", "business_profile", "finder_records", "filter_profiles", "category_values", "paginate"]


def read_pages_of(pages: DataFrame, visits: DataFrame) -> DataFrame:
    """Markup of the pages a contact search reads; ``url`` is the url they were reached by."""
    v = visits.filter(F.col("error").isNull()).select(
        "domain", "page_id", F.col("ord").alias("page_ord"), F.col("url").alias("reached")
    )
    p = pages.drop("domain").join(v, "page_id")
    return p.drop("url").withColumnRenamed("reached", "url")


def found_emails(read: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Scored addresses per site from the pages read."""
    words = [k.strip().lower() for k in (keywords or []) if k.strip()]
    hits = find_page_emails(read)
    hits = hits.withColumn("on_contact_page", is_contact_page(F.col("url"), words) | (F.col("page_ord") == 0))
    return score_emails(hits.withColumnRenamed("page_ord", "ord"))


def _preferred(url: Column) -> Column:
    return (F.col("page_ord") == 0) | is_profile_page(url)


def business_profile(read: DataFrame) -> DataFrame:
    """Name, phone, contact form, address, social links, category and technologies per site.

    Every pick is one aggregate with an ordering struct; nothing is sorted per site.
    """
    entry = read.filter(F.col("page_ord") == 0)
    name = detect_business_name(entry).drop("page_id")
    category = classify_category(entry).drop("page_id")
    tech = detect_tech(entry).groupBy("domain").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda t: t["name"]).alias("technologies")
    )
    phones = dedupe_phones(
        extract_phones(read), by=["domain", "page_id", "page_ord", "url"], order=["ord"]
    ).withColumn("preferred", _preferred(F.col("url")))
    plus = F.startswith("display", F.lit("+"))
    phone = phones.groupBy("domain").agg(
        F.min_by("display", F.struct(~F.col("preferred"), ~plus, F.length("display"), "page_ord", "digits")).alias("phone")
    )
    lines = extract_addresses(read).withColumn("preferred", _preferred(F.col("url")))
    fits = looks_like_business_address(F.col("address"))
    rank = F.struct(-F.length("address"), F.col("page_ord"), F.col("ord"))
    address = lines.withColumn("fits", fits).groupBy("domain").agg(
        F.bool_or("preferred").alias("any_preferred"),
        F.min_by("address", F.when(F.col("preferred") & F.col("fits"), rank)).alias("own"),
        F.min_by("address", F.when(F.col("fits"), rank)).alias("any"),
    ).select("domain", F.when(F.col("any_preferred"), F.col("own")).otherwise(F.col("any")).alias("address"))
    pages = read.select("domain", "page_id", "page_ord", "url")
    forms = has_contact_form(read).filter("has_form").join(pages, ["domain", "page_id"])
    profile_form = (F.col("page_ord") > 0) & is_profile_page(F.col("url"))
    form = forms.groupBy("domain").agg(
        F.coalesce(
            F.max_by("url", F.when(profile_form, F.col("page_ord"))), F.min_by("url", "page_ord")
        ).alias("contact_form_url")
    )
    social = extract_social(read).join(pages.select("domain", "page_id", "page_ord"), ["domain", "page_id"])
    social = social.groupBy("domain", "platform").agg(F.min_by("url", F.struct("page_ord", "url")).alias("url"))
    order = F.array_position(F.array(*[F.lit(p) for p in fv.SOCIAL_PLATFORMS]), F.col("platform"))
    social = social.groupBy("domain").agg(F.transform(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), "platform", "url"))),
        lambda s: F.struct(s["platform"].alias("platform"), s["url"].alias("url"))).alias("social"))
    out = name
    for part in (phone, form, address, social, category, tech):
        out = out.join(part, "domain", "left")
    return out


def finder_records(
    pages: DataFrame, seeds: DataFrame, keywords: list[str] | None = None, max_pages: int = fv.FINDER_DEFAULT_PAGES
) -> DataFrame:
    """One nested row per site; a site whose entry page is missing becomes a fail row."""
    visits = materialize(finder_pages(pages, seeds, keywords, max_pages), "finder-visits")
    read = materialize(read_pages_of(pages, visits), "finder-pages")
    emails = found_emails(read, keywords)
    rank = F.when(F.col("kind") == "personal", 0).when(F.col("kind") == "role", 1).otherwise(2)
    emails = emails.groupBy("domain").agg(F.transform(
        F.array_sort(F.collect_list(F.struct(
            (-F.col("score")).alias("neg"), rank.alias("rank"), "email",
            F.struct("email", "kind", "confidence", "score", "via_mailto", "on_site_domain", "sources").alias("e")))),
        lambda x: x["e"]).alias("emails"))
    trail = visits.groupBy("domain").agg(
        F.min_by("url", "ord").alias("url"), F.max("error").alias("error"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("ord", "url")))), lambda v: v["url"]).alias("pages_scanned"),
    )
    out = trail.join(emails, "domain", "left").join(business_profile(read), "domain", "left")
    for c in ("business_name", "phone", "contact_form_url", "address"):
        out = out.withColumn(c, F.coalesce(c, F.lit("")))
    for c in ("emails", "social", "technologies"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)))
    return out.withColumn("category", F.coalesce("category", F.lit(fv.NO_CATEGORY))).withColumn(
        "status", F.when(F.col("error").isNull(), "success").otherwise("fail")
    ).withColumn("elapsed", F.lit(0.0))


# ------------------------------------------------------------------------------ the results grid
def profile_grid(finder: DataFrame) -> DataFrame:
    """Flat text columns of finder records, as the grid shows and filters them."""
    return finder.select(
        "domain", "business_name", F.coalesce(F.get("emails.email", F.lit(0)), F.lit("")).alias("email"),
        F.greatest(F.size("emails") - 1, F.lit(0)).alias("extra_emails"),
        F.array_join("emails.email", " ").alias("all_emails"), "phone", F.col("contact_form_url").alias("contact_form"),
        "address", F.array_join(F.transform("social.platform", lambda p: F.initcap(p)), " ").alias("social_text"),
        "category", F.array_join("technologies", ", ").alias("technology"),
        F.when(F.col("status") == "success", "SUCCESS").otherwise("FAILED").alias("status"),
    )


def filter_profiles(grid: DataFrame, filters: dict[str, str] | None = None, category: str = "all", status: str = "all") -> DataFrame:
    """Case-insensitive substring filters on text columns, exact ones on category and status."""
    for column, term in (filters or {}).items():
        if term.strip():
            grid = grid.filter(F.contains(F.lower(column), F.lit(term.strip().lower())))
    if category != "all":
        grid = grid.filter(F.col("category") == category)
    if status != "all":
        grid = grid.filter(F.col("status") == status)
    return grid


def category_values(finder: DataFrame) -> DataFrame:
    return finder.select("category").filter((F.col("category") != "") & (F.col("category") != fv.NO_CATEGORY)).distinct()


def paginate(df: DataFrame, key: str, page: int, size: int, **ranges: int) -> DataFrame:
    """Page ``page`` (from 0) of a table in key order; past the end it is the last page.  ``ranges``: see ``rows_in_order``."""
    last = max(0, -(-df.count() // size) - 1)
    return rows_in_order(df, [key], min(page, last) * size, size, **ranges)
