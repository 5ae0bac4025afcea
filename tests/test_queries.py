"""A cross-section of the registered queries against their SQL (the checker runs all of them)."""

import pytest

import __spark_entry__ as entry
from workload import check

NAMES = [
    "normalized_urls", "page_links", "page_visible_lines", "page_emails", "page_seo", "technologies", "keyword_totals", "page_email_hits",
    "jsonld_nodes", "phone_validation", "email_syntax", "parsed_recipients", "send_plan", "campaign_summary", "brand_breakdown", "fetch_outcomes",
    "page_phones", "site_phones", "document_phones", "customer_phones", "list_file_layouts", "site_visits", "finder_outcomes",
]


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    assert check.spark_rows(entry.queries()[name](spark, sf)) == check.duck_rows(con, entry.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
