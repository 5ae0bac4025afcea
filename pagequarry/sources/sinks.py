"""Sinks and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "contact_rows", "contact_rows_bulk", "write_contacts_csv", "profile_rows", "write_profile_csv", "site_json_rows",
    "profile_json_rows", "write_json", "report_tables", "bulk_report_tables",
]


def _rows(sites: DataFrame, kind: str, values: Column) -> DataFrame:
    return sites.select("domain", F.explode(values).alias("v")).select(
        F.lit(kind).alias("type"), F.col("v").alias("value"), F.lit("").alias("platform"), "domain"
    )


def _social_rows(sites: DataFrame) -> DataFrame:
    return sites.select("domain", F.explode("social_links").alias("platform", "urls")).select(
        F.lit("social").alias("type"), F.explode("urls").alias("value"), "platform", "domain"
    )


def contact_rows(sites: DataFrame) -> DataFrame:
    """Long form of site records: e-mail, phone, address, social and technology rows."""
    tech = sites.select("domain", F.explode("tech").alias("t")).select(
        F.lit("technology").alias("type"), F.col("t.name").alias("value"), F.col("t.category").alias("platform"), "domain"
    )
    out = _rows(sites, "email", F.col("emails"))
    for part in (_rows(sites, "phone", F.col("phones")), _rows(sites, "address", F.col("addresses")), _social_rows(sites), tech):
        out = out.unionByName(part)
    return out


def contact_rows_bulk(sites: DataFrame) -> DataFrame:
    """The same for many sites: e-mails, phones and social links only."""
    out = _rows(sites, "email", F.col("emails")).unionByName(_rows(sites, "phone", F.col("phones"))).unionByName(_social_rows(sites))
    return out.withColumnRenamed("domain", "source_domain")


def write_contacts_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


PROFILE_COLUMNS = [
    "domain", "business_name", "email_address", "all_emails", "phone_no", "contact_form", "address", "social_profiles",
    "web_category", "web_technology", "emails_found", "pages_scanned", "exec_seconds", "status",
]


def profile_rows(finder: DataFrame) -> DataFrame:
    """Fourteen text columns per site; cells that a spreadsheet would run as a formula get a quote."""
    d = finder.select(
        "domain", "business_name", F.coalesce(F.get("emails.email", F.lit(0)), F.lit("")).alias("email_address"),
        F.array_join("emails.email", " | ").alias("all_emails"), F.col("phone").alias("phone_no"),
        F.col("contact_form_url").alias("contact_form"), "address", F.array_join("social.url", " | ").alias("social_profiles"),
        F.col("category").alias("web_category"), F.array_join("technologies", ", ").alias("web_technology"),
        F.size("emails").cast("string").alias("emails_found"), F.size("pages_scanned").cast("string").alias("pages_scanned"),
        F.col("elapsed").cast("string").alias("exec_seconds"),
        F.when(F.col("status") == "success", "SUCCESS").otherwise("FAILED").alias("status"),
    )
    guard = lambda c: F.when(F.col(c).rlike(r"\A[=+\-@]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c)
    return d.select(*[guard(c) for c in PROFILE_COLUMNS])


def write_profile_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def site_json_rows(sites: DataFrame, bulk: bool = False) -> DataFrame:
    """Fields of the JSON export: five per site in bulk, fifteen and a time stamp otherwise."""
    if bulk:
        return sites.select("domain", "emails", "phones", "social_links", "status")
    hits = "keyword_hits" if "keyword_hits" in sites.columns else F.array().alias("keyword_hits")
    return sites.select(
        "domain", "emails", "phones", "addresses", "social_links", "company", "seo", "tech", "products", "jobs", hits,
        "pages_crawled", "status", F.col("elapsed").alias("elapsed_sec"), F.current_timestamp().alias("exported_at"),
    )


def profile_json_rows(finder: DataFrame) -> DataFrame:
    """Nested rows of the contact-search export, with its key names."""
    renamed = F.transform("emails", lambda e: F.struct(
        e["email"].alias("email"), e["kind"].alias("type"), e["confidence"].alias("confidence"), e["score"].alias("score"),
        e["on_site_domain"].alias("same_domain"), e["via_mailto"].alias("from_mailto"), e["sources"].alias("found_on")))
    return finder.select(
        "url", "domain", "status", "error", "business_name", "phone", F.col("contact_form_url").alias("contact_form"), "address",
        F.col("social").alias("social_profiles"), F.col("category").alias("web_category"), F.col("technologies").alias("web_technology"),
        "pages_scanned", F.col("elapsed").alias("elapsed_seconds"), F.size("emails").alias("email_count"), renamed.alias("emails"),
    )


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def _sheet(sites: DataFrame, values: Column, *columns: Column) -> DataFrame:
    rows = sites.select("domain", F.posexplode(values).alias("pos", "x"))
    return rows.select("domain", (F.col("pos") + 1).alias("no"), *columns)


def _key_values(df: DataFrame, pairs: list[tuple[str, Column]]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(k).alias("field"), v.cast("string").alias("value")) for i, (k, v) in enumerate(pairs, 1)])
    return df.select("domain", F.explode(entries).alias("e")).select("domain", "e.*")


def _mail_domain(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("@")), F.substring_index(x, "@", -1)).otherwise("")


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), x.substr(2, 100))


def _dash(x: Column) -> Column:
    return F.coalesce(F.when(x.cast("string") != "", x.cast("string")), F.lit("—"))


def report_tables(sites: DataFrame) -> dict[str, DataFrame]:
    """The tables of a site's report workbook, keyed by sheet name."""
    x, blank = F.col("x"), lambda c: F.coalesce(c, F.lit(""))
    social_count = F.aggregate(F.map_values("social_links"), F.lit(0), lambda n, u: n + F.size(u))
    seo = sites.filter(F.col("seo").isNotNull())
    s = lambda name: F.col(f"seo.{name}")
    social = sites.select("domain", F.explode("social_links").alias("platform", "urls")).select(
        "domain", _capital(F.col("platform")).alias("platform"), F.explode("urls").alias("url"))
    return {
        "Summary": _key_values(sites, [
            ("Domain", _dash(F.col("domain"))), ("URL", _dash(F.col("url"))), ("Title", _dash(F.col("metadata.title"))),
            ("Description", _dash(F.col("metadata.description"))), ("Status", F.upper("status")), ("Emails Found", F.size("emails")),
            ("Phones Found", F.size("phones")), ("Social Links", social_count), ("Pages Crawled", F.size("pages_crawled")),
            ("Errors", F.size("errors")), ("Time (sec)", F.col("elapsed")),
            ("Exported At", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm 'UTC'")),
        ]),
        "Emails": _sheet(sites, F.col("emails"), x.alias("email"), _mail_domain(x).alias("email_domain")),
        "Phones": _sheet(sites, F.col("phones"), x.alias("phone")),
        "Social Links": social,
        "Pages Crawled": _sheet(sites, F.col("pages_crawled"), x.alias("url")),
        "Addresses": _sheet(sites, F.col("addresses"), x.alias("address")),
        "Technologies": _sheet(sites, F.col("tech"), F.col("x.category").alias("category"), F.col("x.name").alias("technology")),
        "SEO": _key_values(seo, [
            ("Title", s("title")), ("Title length", s("title_length")), ("Meta description", s("meta_description")),
            ("Meta desc length", s("meta_description_length")), ("Meta keywords", s("meta_keywords")), ("Canonical", s("canonical")),
            ("Robots", s("robots")), ("Lang", s("lang")), ("Viewport tag", F.when(s("viewport"), "yes").otherwise("no")),
            ("H1 count", F.size(s("h1"))), ("H1 (first)", blank(F.get(s("h1"), F.lit(0)))), ("H2 count", F.size(s("h2"))),
            ("Images", s("image_count")), ("Images missing alt", s("images_missing_alt")), ("Word count", s("word_count")),
            ("Internal links", s("internal_links")), ("External links", s("external_links")),
        ]),
        "Products": _sheet(sites, F.col("products"), F.col("x.name").alias("name"), *[
            blank(F.col(f"x.{c}")).alias(c) for c in ("price", "currency", "sku", "brand", "availability")]),
        "Jobs": _sheet(sites, F.col("jobs"), F.col("x.title").alias("title"), *[
            blank(F.col(f"x.{c}")).alias(c) for c in ("company", "location", "employment_type", "date_posted")]),
    }


def bulk_report_tables(sites: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report over many sites."""
    from ..plans.extractor import overview_with_totals

    x = F.col("x")
    per_site = report_tables(sites)
    return {
        "Overview": overview_with_totals(sites),
        "All Emails": per_site["Emails"],
        "All Phones": per_site["Phones"],
        "Social Links": per_site["Social Links"],
        "Errors": _sheet(sites, F.col("errors"), x.alias("error")),
    }
