"""Registered queries over whole site records, contact searches, exports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.functions import fixed_values as fv
from pagequarry.operators import emails as em
from pagequarry.operators.ranks import rows_in_order
from pagequarry.plans import extractor, finder, walk
from pagequarry.session import materialize, shared_folder
from pagequarry.sources import sinks
from pagequarry.streaming import streams

from . import sqltext as st
from .derived import pages_site, sites, table
from .queries_lists import SUMMARY_SQL, deliveries
from .queries_pages import _PAGE_SOURCES, PAGE_EMAILS_CTE, _clean, finder_email_ctes, kind_sql
from .registry import query

_CACHE: dict = {}


def _once(spark, sf, name, build):
    """A written table shared by the reports that read it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _CACHE:
        _CACHE[key] = materialize(build(), name)
    return _CACHE[key]


def stored_pages(spark, sf):
    """The pages of the sites, written once: each level of a walk reads some columns of it instead of building all pages again."""
    return _once(spark, sf, "site-pages", lambda: pages_site(spark, sf))


def site_table(spark, sf):
    return _once(spark, sf, "sites", lambda: extractor.site_records(stored_pages(spark, sf), sites(spark, sf), ["the", "und"]))


def finder_table(spark, sf):
    return _once(spark, sf, "finder", lambda: finder.finder_records(stored_pages(spark, sf), sites(spark, sf)))


# ------------------------------------------------------------------------------ site records
_N7 = "page_id >= 0 AND page_id % 7"
SITE_CTES = (
    st.MARKUP_CTE, st.TEXT_CTE, st.LINKS_CTE, st.WALK_CTE, PAGE_EMAILS_CTE, st.PHONE_CTE,
    f"""seen_pages AS (SELECT v.domain, v.page_id, v.ord FROM visits v WHERE outcome = 'page'),
site_mentions AS (SELECT s.domain, s.ord AS page_ord, p.ord, display, digits, trusted FROM seen_pages s JOIN phone_rows p USING (page_id)),
{st.deduped_phones('site_phones', 'site_mentions', 'domain', 'page_ord, ord')},
site_emails AS (SELECT DISTINCT s.domain, email FROM seen_pages s JOIN page_emails USING (page_id)),
site_social AS (SELECT DISTINCT domain, 'linkedin' AS platform, concat('https://www.linkedin.com/company/c', CAST(page_id % 7 AS VARCHAR)) AS url FROM seen_pages WHERE page_id >= 0 AND page_id % 6 = 0
  UNION SELECT domain, 'facebook', concat('https://facebook.com/firm', CAST(page_id AS VARCHAR)) FROM seen_pages WHERE {_N7} = 0),
site_tech AS (SELECT DISTINCT domain, unnest(['WordPress', 'jQuery', 'Nginx']) AS name, unnest(['CMS', 'Library', 'Web Server']) AS category FROM seen_pages WHERE page_id >= 0 AND page_id % 8 = 0),
site_addresses AS (SELECT domain, concat(CAST(page_id + 1 AS VARCHAR), ' Main Street, Suite 5, Springfield, IL 62704, Partner') AS address FROM seen_pages WHERE page_id >= 0 AND page_id % 11 = 0
  UNION ALL SELECT domain, concat(CAST(page_id + 1 AS VARCHAR), CASE WHEN page_id % 7 = 0 THEN ' Mall Road, Lahore, Punjab, 54000 Pakistan' ELSE ' Canal Road, Lahore, Pakistan' END) FROM seen_pages WHERE {_N7} IN (0, 1)),
facts AS (SELECT domain, (SELECT count(*) FROM site_emails x WHERE x.domain = s.domain) AS emails, (SELECT count(*) FROM site_social x WHERE x.domain = s.domain) AS social,
  (SELECT count(*) FROM site_social x WHERE x.domain = s.domain AND platform = 'linkedin') AS linkedin, (SELECT count(*) FROM site_social x WHERE x.domain = s.domain AND platform = 'facebook') AS facebook,
  (SELECT count(*) FROM site_phones x WHERE x.domain = s.domain) AS phones, (SELECT count(*) FROM site_tech x WHERE x.domain = s.domain) AS tech, (SELECT count(*) FROM site_addresses x WHERE x.domain = s.domain) AS addresses,
  (SELECT count(*) FROM visits x WHERE x.domain = s.domain AND outcome = 'page') AS pages, (SELECT count(*) FROM visits x WHERE x.domain = s.domain AND outcome = 'missing') AS errors FROM site s)""",
)
_big = lambda *cs: [F.col(c).cast("bigint").alias(c) for c in cs]


@query(st.with_(*SITE_CTES) + "SELECT domain, concat('Home | ', domain) AS title, '—' AS description, emails AS emails_found, phones AS phones_found, social AS social_links, pages AS pages_crawled, errors, 'success' AS status, addresses, tech AS technologies FROM facts")
def site_summary(spark, sf):
    s = extractor.site_summary(site_table(spark, sf))
    return s.select("domain", "title", "description", "status", *_big("emails_found", "phones_found", "social_links", "pages_crawled", "errors", "addresses", "technologies"))


@query(st.with_(*SITE_CTES) + "SELECT CAST(sum(emails) AS BIGINT) AS total_emails, CAST(sum(phones) AS BIGINT) AS total_phones, CAST(sum(social) AS BIGINT) AS total_social, CAST(sum(pages) AS BIGINT) AS total_pages, count(*) AS succeeded, count(*) AS sites FROM facts")
def bulk_kpis(spark, sf):
    return extractor.bulk_kpis(site_table(spark, sf)).select(*_big("total_emails", "total_phones", "total_social", "total_pages", "succeeded", "sites"))


@query(st.with_(*SITE_CTES) + """SELECT coalesce(domain, 'TOTAL') AS domain, CASE WHEN domain IS NULL THEN '' ELSE concat('Home | ', domain) END AS title, CAST(sum(emails) AS BIGINT) AS emails, CAST(sum(phones) AS BIGINT) AS phones,
   CAST(sum(linkedin) AS BIGINT) AS linkedin, CAST(sum(facebook) AS BIGINT) AS facebook, CAST(sum(pages) AS BIGINT) AS pages FROM facts GROUP BY ROLLUP (domain)""")
def overview_with_totals(spark, sf):
    return extractor.overview_with_totals(site_table(spark, sf)).select("domain", "title", *_big("emails", "phones", "linkedin", "facebook", "pages"))


@query(st.with_(*SITE_CTES) + """SELECT domain, concat('Firm ', CAST(arg_min(page_id, ord) AS VARCHAR)) AS company FROM seen_pages WHERE """ + _N7 + """ = 0 GROUP BY domain""")
def site_companies(spark, sf):
    return site_table(spark, sf).filter(F.col("company").isNotNull()).select("domain", F.col("company.name").alias("company"))


@query(st.with_(*SITE_CTES) + """SELECT domain, concat('Part ', CAST(page_id AS VARCHAR)) AS product, row_number() OVER (PARTITION BY domain ORDER BY ord) - 1 AS pos FROM seen_pages WHERE """ + _N7 + """ = 1""")
def site_products(spark, sf):
    p = site_table(spark, sf).select("domain", F.posexplode("products").alias("pos", "p"))
    return p.select("domain", F.col("p.name").alias("product"), F.col("pos").cast("bigint").alias("pos"))


_CONTACTS = """SELECT 'email' AS type, email AS "value", '' AS platform, domain FROM site_emails UNION ALL SELECT 'phone', display, '', domain FROM site_phones UNION ALL SELECT 'social', url, platform, domain FROM site_social"""


@query(st.with_(*SITE_CTES) + _CONTACTS + " UNION ALL SELECT 'address', address, '', domain FROM site_addresses UNION ALL SELECT 'technology', name, category, domain FROM site_tech")
def contact_rows(spark, sf):
    """Long contact rows."""
    return sinks.contact_rows(site_table(spark, sf))


@query(st.with_(*SITE_CTES) + "SELECT type, \"value\", platform, domain AS source_domain FROM (" + _CONTACTS + ")")
def contact_csv_round_trip(spark, sf):
    """The bulk CSV export, written and read back."""
    path = shared_folder(spark, "contacts")
    sinks.write_contacts_csv(sinks.contact_rows_bulk(site_table(spark, sf)), path)
    back = spark.read.option("header", True).option("escape", '"').schema("type string, value string, platform string, source_domain string").csv(path)
    return back.na.fill("", ["platform"])


@query(st.with_(*SITE_CTES) + "SELECT domain, array_to_string(list_sort(list(email)), '|') AS emails, 'success' AS status FROM site_emails GROUP BY domain")
def site_json_round_trip(spark, sf):
    path = shared_folder(spark, "site-json")
    sinks.write_json(sinks.site_json_rows(site_table(spark, sf), bulk=True), path)
    back = spark.read.schema("domain string, emails array<string>, status string").json(path)
    return back.filter(F.size("emails") > 0).select("domain", F.array_join("emails", "|").alias("emails"), "status")


_SHEETS = {
    "Emails": "SELECT domain, concat(email, '|', regexp_extract(email, '@(.*)$', 1)) AS entry FROM site_emails",
    "Phones": "SELECT domain, display AS entry FROM site_phones",
    "Social Links": "SELECT domain, concat(upper(left(platform, 1)), substr(platform, 2), '|', url) AS entry FROM site_social",
    "Technologies": "SELECT domain, concat(category, '|', name) AS entry FROM site_tech",
    "Addresses": "SELECT domain, address AS entry FROM site_addresses",
    "Pages Crawled": "SELECT domain, url AS entry FROM visits WHERE outcome = 'page'",
    "Products": f"SELECT domain, concat('Part ', CAST(page_id AS VARCHAR), '|', CAST(page_id AS VARCHAR), '.5|USD|S', CAST(page_id AS VARCHAR), '|Brand ', CAST(page_id % 5 AS VARCHAR), '|InStock') AS entry FROM seen_pages WHERE {_N7} = 1",
    "Jobs": f"SELECT domain, concat('Job ', CAST(page_id AS VARCHAR), '|Firm ', CAST(page_id AS VARCHAR), '|', CAST(page_id + 1 AS VARCHAR), ' Canal Road, Lahore, Pakistan|FULL_TIME|2024-01-15') AS entry FROM seen_pages WHERE {_N7} = 1",
    "Errors": "SELECT domain, concat('Failed: ', url) AS entry FROM visits WHERE outcome = 'missing'",
}


@query(st.with_(*SITE_CTES) + " UNION ALL ".join(f"SELECT '{k}' AS sheet, domain, entry FROM ({v})" for k, v in _SHEETS.items()))
def report_sheets(spark, sf):
    s = site_table(spark, sf)
    tables = {**sinks.report_tables(s), **{k: v for k, v in sinks.bulk_report_tables(s).items() if k == "Errors"}}
    out = None
    for name in _SHEETS:
        df = tables[name]
        cells = [c for c in df.columns if c not in ("domain", "no")]
        part = df.select(F.lit(name).alias("sheet"), "domain", F.concat_ws("|", *cells).alias("entry"))
        out = part if out is None else out.unionByName(part)
    return out


@query(st.with_(*SITE_CTES) + """SELECT domain, unnest(['Title', 'Title length', 'Viewport tag', 'H1 count', 'H1 (first)', 'Images']) AS field,
   unnest([concat('Home | ', domain), CAST(length(domain) + 7 AS VARCHAR), 'no', '1', domain, '0']) AS "value" FROM site""")
def report_seo_sheet(spark, sf):
    t = sinks.report_tables(site_table(spark, sf))["SEO"]
    return t.filter(F.col("field").isin("Title", "Title length", "Viewport tag", "H1 count", "H1 (first)", "Images")).select("domain", "field", "value")


@query(st.with_(*SITE_CTES) + """SELECT domain, unnest(['Domain', 'URL', 'Status', 'Emails Found', 'Pages Crawled', 'Errors']) AS field,
   unnest([domain, concat('https://', domain), 'SUCCESS', CAST(emails AS VARCHAR), CAST(pages AS VARCHAR), CAST(errors AS VARCHAR)]) AS "value" FROM facts""")
def report_summary_sheet(spark, sf):
    t = sinks.report_tables(site_table(spark, sf))["Summary"]
    return t.filter(F.col("field").isin("Domain", "URL", "Status", "Emails Found", "Pages Crawled", "Errors")).select("domain", "field", "value")


# ------------------------------------------------------------------------------ contact search
_ONSITE = "regexp_extract(email, '@(.*)$', 1)"
FINDER_CTES = (
    st.MARKUP_CTE, st.TEXT_CTE, st.SCORED_CTE, st.FINDER_CTE, finder_email_ctes(_PAGE_SOURCES),
    rf"""hits AS (SELECT f.domain, f.url, f.ord, email, bool_or(via) AS via, f.ord = 0 OR regexp_matches(lower(regexp_replace(f.url, '^https?://[^/]+', '')), '{"|".join(fv.CONTACT_HINTS)}') AS contact
  FROM finder f JOIN usable USING (page_id) GROUP BY ALL),
per_email AS (SELECT domain, email, bool_or(via) AS via_mailto, bool_or(contact) AS on_contact, count(*) AS page_count, string_agg(url, '|' ORDER BY ord) AS sources FROM hits GROUP BY 1, 2),
found AS (SELECT *, {kind_sql('email')} AS kind, {_ONSITE} = site_host OR {_ONSITE} LIKE concat('%.', site_host) OR regexp_extract({_ONSITE}, '([^.]+\.[^.]+)$', 1) = regexp_extract(site_host, '([^.]+\.[^.]+)$', 1) AS on_site_domain
  FROM (SELECT *, regexp_replace(domain, '^www\.', '') AS site_host FROM per_email)),
found_emails AS (SELECT *, CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, greatest(5, least(99, 45 + CASE WHEN via_mailto THEN 25 ELSE 0 END + CASE WHEN on_contact THEN 12 ELSE 0 END
   + CASE WHEN on_site_domain THEN 15 ELSE 0 END + CASE WHEN page_count > 1 THEN 8 ELSE 0 END + CASE WHEN kind = 'role' AND on_site_domain THEN 6 ELSE 0 END
   - CASE WHEN {_ONSITE} IN ({", ".join(st.q(p) for p in fv.FREE_PROVIDERS)}) THEN 18 ELSE 0 END - CASE WHEN length(regexp_replace(email, '[^0-9]', '', 'g')) >= 4 THEN 10 ELSE 0 END)) AS score FROM found))""",
)


@query(st.with_(*FINDER_CTES) + "SELECT domain, email, sources, page_count, kind, confidence, score, via_mailto, on_site_domain FROM found_emails")
def found_emails(spark, sf):
    p = stored_pages(spark, sf)
    visits = walk.finder_pages(p, sites(spark, sf))
    e = finder.found_emails(finder.read_pages_of(p, visits))
    return e.withColumn("sources", F.array_join("sources", "|"))


@query(st.with_(*FINDER_CTES) + """SELECT domain, email, row_number() OVER (PARTITION BY domain ORDER BY score DESC, CASE kind WHEN 'personal' THEN 0 WHEN 'role' THEN 1 ELSE 2 END, email) - 1 AS pos FROM found_emails""")
def found_email_order(spark, sf):
    e = finder_table(spark, sf).select("domain", F.posexplode("emails").alias("pos", "e"))
    return e.select("domain", F.col("e.email").alias("email"), F.col("pos").cast("bigint").alias("pos"))


PROFILE_CTE = st.PHONE_CTE.strip() + ",\n" + st.deduped_phones("page_numbers", "phone_rows", "page_id", "ord") + rf""",
profile AS (SELECT domain, coalesce((SELECT arg_min(display, ROW(NOT (f.ord = 0 OR regexp_matches(lower(regexp_replace(f.url, '^https?://[^/]+|[?#].*$', '', 'g')), '{"|".join(fv.PROFILE_HINTS)}')), display NOT LIKE '+%', length(display), f.ord, digits))
     FROM finder f JOIN page_numbers n USING (page_id) WHERE f.domain = s.domain), '') AS phone, {_clean("'Home'")} AS business_name,
  coalesce((SELECT min(arg) FROM (SELECT arg_min(f.url, f.ord) AS arg FROM finder f WHERE f.domain = s.domain AND f.page_id >= 0 AND f.page_id % 9 = 0) x), '') AS contact_form_url,
  coalesce((SELECT string_agg(url, '|' ORDER BY platform DESC) FROM (SELECT platform, arg_min(url, lpad(CAST(ord AS VARCHAR), 5, '0') || url) AS url FROM (
     SELECT ord, 'linkedin' AS platform, concat('https://www.linkedin.com/company/c', CAST(page_id % 7 AS VARCHAR)) AS url FROM finder f WHERE f.domain = s.domain AND page_id >= 0 AND page_id % 6 = 0
     UNION ALL SELECT ord, 'facebook', concat('https://facebook.com/firm', CAST(page_id AS VARCHAR)) FROM finder f WHERE f.domain = s.domain AND page_id >= 0 AND page_id % 7 = 0) GROUP BY platform)), '') AS social,
  coalesce((SELECT arg_min(a, lpad(CAST(999 - length(a) AS VARCHAR), 4, '0') || lpad(CAST(ord AS VARCHAR), 5, '0')) FROM (SELECT ord, concat(CAST(page_id + 1 AS VARCHAR), ' Main Street, Suite 5, Springfield, IL 62704, Partner') AS a FROM finder f
     WHERE f.domain = s.domain AND page_id >= 0 AND page_id % 11 = 0)), '') AS address, '—' AS category, '' AS technologies, 'success' AS status FROM site s)"""


@query(st.with_(*FINDER_CTES, PROFILE_CTE) + "SELECT * FROM profile")
def business_profiles(spark, sf):
    f = finder_table(spark, sf)
    return f.select("domain", "business_name", "phone", "contact_form_url", F.array_join("social.url", "|").alias("social"), "address", "category", F.array_join("technologies", "|").alias("technologies"), "status")


@query(st.with_(*FINDER_CTES, PROFILE_CTE) + "SELECT domain, address FROM profile WHERE contains(lower(address), 'main street') AND contains(domain, 'example')")
def filtered_profiles(spark, sf):
    grid = finder.profile_grid(finder_table(spark, sf))
    return finder.filter_profiles(grid, {"address": " MAIN street ", "domain": "example"}, status="SUCCESS").select("domain", "address")


@query(st.with_() + "SELECT domain FROM (SELECT DISTINCT host AS domain FROM pages_rich) ORDER BY domain LIMIT 10 OFFSET 10")
def profile_page(spark, sf):
    """Second page of ten of the results grid."""
    return finder.paginate(finder_table(spark, sf).select("domain"), "domain", 1, 10)


@query("""SELECT l_extendedprice, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS place, count(*) OVER () AS n FROM lineitem)
  WHERE place >= n // 3 AND place < n // 3 + 250""")
def lineitem_page(spark, sf):
    """250 order lines a third of the way down the order of their prices."""
    lines = table(spark, sf, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber")
    return rows_in_order(lines, lines.columns, lines.count() // 3, 250)


@query("SELECT DISTINCT p_type AS category FROM part WHERE p_type NOT IN ('', '—')")
def category_values(spark, sf):
    """Distinct categories of a results table (here the part types stand in for sectors)."""
    return finder.category_values(table(spark, sf, "part").select(F.col("p_type").alias("category")))


@query(st.with_(*FINDER_CTES, PROFILE_CTE) + """SELECT p.domain, p.business_name, coalesce(string_agg(email, ' | ' ORDER BY score DESC, CASE kind WHEN 'personal' THEN 0 WHEN 'role' THEN 1 ELSE 2 END, email), '') AS all_emails,
   CAST(count(email) AS VARCHAR) AS emails_found, replace(p.social, '|', ' | ') AS social_profiles, 'SUCCESS' AS status FROM profile p LEFT JOIN found_emails f ON p.domain = f.domain GROUP BY p.domain, p.business_name, p.social""")
def profile_csv_round_trip(spark, sf):
    path = shared_folder(spark, "profiles")
    sinks.write_profile_csv(sinks.profile_rows(finder_table(spark, sf)), path)
    back = spark.read.option("header", True).option("escape", '"').schema(", ".join(f"{c} string" for c in sinks.PROFILE_COLUMNS)).csv(path)
    return back.na.fill("").select("domain", "business_name", "all_emails", "emails_found", "social_profiles", "status")


@query(st.with_(*FINDER_CTES) + "SELECT domain, email, kind AS type, score, on_site_domain AS same_domain, via_mailto AS from_mailto FROM found_emails")
def profile_json_round_trip(spark, sf):
    path = shared_folder(spark, "profile-json")
    sinks.write_json(sinks.profile_json_rows(finder_table(spark, sf)), path)
    back = spark.read.schema("domain string, emails array<struct<email:string,type:string,score:int,same_domain:boolean,from_mailto:boolean>>").json(path)
    return back.select("domain", F.explode("emails").alias("e")).select("domain", "e.*")


def _entries_that_fail(spark, sf):
    """Stored pages whose entry is no HTML for a third of the hosts, and seeds with a host that is not stored for every host."""
    pdf = (F.col("page_id") < 0) & (F.col("page_id") % 3 == 0)
    pages = pages_site(spark, sf).withColumn("content_type", F.when(pdf, "application/pdf").otherwise(F.col("content_type")))
    urls = sites(spark, sf)
    return materialize(pages, "pages"), urls.unionByName(urls.select(F.replace("url", F.lit("https://"), F.lit("https://gone.")).alias("url")))


_ENTRY = "(SELECT host AS domain, -1 - min(page_id) AS entry FROM pages_rich GROUP BY host)"


@query(st.with_(*FINDER_CTES) + f"""SELECT domain, CASE WHEN entry % 3 = 0 THEN 'fail' ELSE 'success' END AS status, CASE WHEN entry % 3 = 0 THEN concat(domain, ' did not return an HTML page.') END AS error,
   CASE WHEN entry % 3 = 0 THEN 0 ELSE (SELECT count(*) FROM finder f WHERE f.domain = e.domain) END AS pages_scanned, CASE WHEN entry % 3 = 0 THEN 0 ELSE (SELECT count(*) FROM found_emails f WHERE f.domain = e.domain) END AS emails FROM {_ENTRY} e
   UNION ALL SELECT concat('gone.', domain), 'fail', concat('Could not reach gone.', domain, '. The site may be down, blocking automated requests, or the URL may be wrong.'), 0, 0 FROM {_ENTRY}""")
def finder_outcomes(spark, sf):
    """Success and fail rows of a contact search: entries that are missing or no HTML stay in the results, with the reason."""
    f = finder.finder_records(*_entries_that_fail(spark, sf))
    return f.select("domain", "status", "error", F.size("pages_scanned").cast("bigint").alias("pages_scanned"), F.size("emails").cast("bigint").alias("emails"))


@query(st.with_(*SITE_CTES) + f"""SELECT domain, CASE WHEN entry % 3 = 0 THEN 'fail' ELSE 'success' END AS status, CASE WHEN entry % 3 = 0 THEN {len(fv.PRIORITY_PATHS)} ELSE errors END AS errors,
   CASE WHEN entry % 3 = 0 THEN 0 ELSE pages END AS pages, CASE WHEN entry % 3 = 0 THEN 0 ELSE phones END AS phones FROM facts JOIN {_ENTRY} USING (domain)
   UNION ALL SELECT concat('gone.', domain), 'fail', {len(fv.PRIORITY_PATHS) + 1}, 0, 0 FROM {_ENTRY}""")
def site_outcomes(spark, sf):
    """Success and fail rows of site records."""
    s = extractor.site_records(*_entries_that_fail(spark, sf))
    return s.select("domain", "status", *[F.size(c).cast("bigint").alias(n) for c, n in (("errors", "errors"), ("pages_crawled", "pages"), ("phones", "phones"))])


# ------------------------------------------------------------------------------ streams
@query(SUMMARY_SQL.replace("count(*) + 5 AS total, ", "").replace("campaign_id, total, sent, failed, skipped, total - sent - failed - skipped AS pending,", "campaign_id, sent, failed, skipped,"))
def campaign_status_stream(spark, sf):
    """Final state of the delivery stream."""
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out, ckpt = shared_folder(spark, "stream-status"), shared_folder(spark, "stream-checkpoint")
    streams.run_available(streams.stream_campaign_status(deliveries(spark, sf, events)), out, ckpt, mode="complete")
    return spark.read.parquet(out)


def _page_stream(spark, sf):
    folder = _once(spark, sf, "page-stream", lambda: pages_site(spark, sf).drop("headers"))
    path = folder.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(folder.schema).option("maxFilesPerTrigger", 4).parquet(path)


@query(st.with_(st.TEXT_CTE, PAGE_EMAILS_CTE, st.PHONE_CTE) + """SELECT domain, page_id, 'phone' AS type, display AS "value", '' AS platform FROM phone_rows
  UNION ALL SELECT domain, page_id, 'email' AS type, email AS "value", '' AS platform FROM page_emails
  UNION SELECT host, page_id, 'social', concat('https://www.linkedin.com/company/c', CAST(page_id % 7 AS VARCHAR)), 'linkedin' FROM pages_rich WHERE page_id % 6 = 0
  UNION SELECT host, page_id, 'social', concat('https://facebook.com/firm', CAST(page_id AS VARCHAR)), 'facebook' FROM pages_rich WHERE page_id % 7 = 0""")
def contact_stream(spark, sf):
    """Contact facts appended by a stream of pages."""
    out, ckpt = shared_folder(spark, "stream-contacts"), shared_folder(spark, "stream-checkpoint")
    facts = streams.stream_extract(_page_stream(spark, sf))
    streams.run_available(facts, out, ckpt)
    return spark.read.parquet(out)


@query(st.with_(PAGE_EMAILS_CTE) + "SELECT DISTINCT domain, 'email' AS type, email AS \"value\" FROM page_emails")
def distinct_contact_stream(spark, sf):
    """Each address of a site once, although pages of the site arrive in several batches."""
    out, ckpt = shared_folder(spark, "stream-distinct"), shared_folder(spark, "stream-checkpoint")
    pages = _page_stream(spark, sf)
    facts = em.extract_emails(pages).select("domain", F.lit("email").alias("type"), F.col("email").alias("value"))
    facts = facts.withColumn("at", F.current_timestamp())
    streams.run_available(streams.stream_contacts_distinct(facts).drop("at"), out, ckpt)
    return spark.read.parquet(out)


@query(st.with_(st.TEXT_CTE, PAGE_EMAILS_CTE, st.PHONE_CTE) + """SELECT domain, 'email' AS type, email AS "value" FROM page_emails UNION SELECT domain, 'phone', display FROM phone_rows
  UNION SELECT host, 'social', concat('https://www.linkedin.com/company/c', CAST(page_id % 7 AS VARCHAR)) FROM pages_rich WHERE page_id % 6 = 0
  UNION SELECT host, 'social', concat('https://facebook.com/firm', CAST(page_id AS VARCHAR)) FROM pages_rich WHERE page_id % 7 = 0""")
def contact_register(spark, sf):
    """Every contact of a site once for ever: the stream of pages is read twice, by two queries that share one register."""
    folder = shared_folder(spark, "contact-register")
    for _ in range(2):
        streams.register_contacts(streams.stream_extract(_page_stream(spark, sf)), folder, shared_folder(spark, "stream-checkpoint"))
    return streams.read_contacts(spark, folder).drop("batch")
