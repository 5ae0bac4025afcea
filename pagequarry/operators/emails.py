"""Addresses found on pages: extraction, provenance, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.emails import (
    classify_email, domain_part, emails_in, is_on_site, normalize_usable_email, page_email_hits,
)
from ..functions.html import attr, markup, start_tags, visible_text
from ..functions.text import trim_ws
from .page_facts import with_domain

__all__ = ["extract_emails", "text_emails", "find_page_emails", "text_email_hits", "normalize_emails", "score_emails"]


def extract_emails(pages: DataFrame) -> DataFrame:
    """Distinct (domain, page_id, email): plain, spelled-out and mailto forms of the raw markup."""
    p = with_domain(pages).select("domain", "page_id", "html")
    hrefs = F.transform(start_tags(markup(F.col("html")), "a"), lambda t: attr(t, "href"))
    p = p.withColumn("mailtos", F.filter(hrefs, lambda h: F.lower(h).startswith("mailto:")))
    return p.select("domain", "page_id", F.explode(emails_in(F.col("html"), F.col("mailtos"))).alias("email"))


def text_emails(df: DataFrame, column: str = "text") -> DataFrame:
    """The same scan over a plain text column; the other columns are kept."""
    keys = [c for c in df.columns if c != column]
    return df.select(*keys, F.explode(emails_in(F.col(column), F.array().cast("array<string>"))).alias("email"))


def find_page_emails(pages: DataFrame) -> DataFrame:
    """Usable addresses per page with ``via_mailto``; ``pages`` columns other than the text are kept."""
    p = with_domain(pages)
    keep = [c for c in p.columns if c not in ("html", "content_type", "headers")]
    hrefs = F.transform(start_tags(markup(F.col("html")), "a"), lambda t: trim_ws(attr(t, "href")))
    p = p.select(*keep, "html", hrefs.alias("hrefs"), visible_text(F.col("html")).alias("visible"))
    hits = page_email_hits(F.col("html"), F.col("visible"), F.col("hrefs"))
    return p.select(*keep, F.explode(hits).alias("h")).select(*keep, "h.email", "h.via_mailto")


def text_email_hits(df: DataFrame, column: str = "text") -> DataFrame:
    """Usable addresses of a plain text column."""
    keys = [c for c in df.columns if c != column]
    hits = page_email_hits(F.col(column), F.col(column), F.array().cast("array<string>"))
    return df.select(*keys, F.explode(hits).alias("h")).select(*keys, "h.email")


def normalize_emails(df: DataFrame, column: str = "email") -> DataFrame:
    """Adds ``normalized`` (NULL when unusable) and ``kind`` for a column of raw addresses."""
    df = df.withColumn("normalized", normalize_usable_email(F.col(column)))
    return df.withColumn("kind", F.when(F.col("normalized").isNotNull(), classify_email(F.col("normalized"))))


def _email_score(email: Column, domain: Column, kind: Column, on_site: Column) -> Column:
    score = (
        F.lit(45)
        + F.when(F.col("via_mailto"), 25).otherwise(0)
        + F.when(F.col("on_contact_page"), 12).otherwise(0)
        + F.when(on_site, 15).otherwise(0)
        + F.when(F.col("page_count") > 1, 8).otherwise(0)
        + F.when((kind == "role") & on_site, 6).otherwise(0)
        - F.when(domain.isin(fv.FREE_PROVIDERS), 18).otherwise(0)
        - F.when(F.length(F.regexp_replace(email, "[^0-9]", "")) >= 4, 10).otherwise(0)
    )
    return F.greatest(F.lit(5), F.least(F.lit(99), score))


def score_emails(hits: DataFrame) -> DataFrame:
    """One row per (domain, email) from hits ``(domain, page_id, url, ord, email, via_mailto, on_contact_page)``.

    A finder run reads at most fifteen pages per site, so ``sources`` is short; the counts come
    from a partial aggregate keyed by site *and* address, which a large site does not skew.
    """
    per_page = hits.groupBy("domain", "email", "url").agg(
        F.min("ord").alias("ord"), F.bool_or("via_mailto").alias("via_mailto"),
        F.bool_or("on_contact_page").alias("on_contact_page"),
    )
    g = per_page.groupBy("domain", "email").agg(
        F.count("*").alias("page_count"), F.bool_or("via_mailto").alias("via_mailto"),
        F.bool_or("on_contact_page").alias("on_contact_page"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "url"))), lambda s: s["url"]).alias("sources"),
    )
    g = g.withColumn("kind", classify_email(F.col("email"))).withColumn("mail_domain", domain_part(F.col("email")))
    g = g.withColumn("on_site_domain", is_on_site(F.col("mail_domain"), F.col("domain")))
    g = g.withColumn("score", _email_score(F.col("email"), F.col("mail_domain"), F.col("kind"), F.col("on_site_domain")))
    return g.select(
        "domain", "email", "sources", "page_count", "kind",
        F.when(F.col("score") >= 75, "high").when(F.col("score") >= 50, "medium").otherwise("low").alias("confidence"),
        "score", "via_mailto", "on_site_domain",
    )


def email_order() -> list[Column]:
    """Sort keys of found addresses: score, then personal < role < generic, then the address."""
    rank = F.when(F.col("kind") == "personal", 0).when(F.col("kind") == "role", 1).otherwise(2)
    return [F.col("score").desc(), rank, F.col("email")]
