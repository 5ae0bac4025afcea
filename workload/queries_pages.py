"""Registered queries over pages: links, text, facts, walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.functions import fixed_values as fv
from pagequarry.functions.html import html_to_text
from pagequarry.operators import addresses, emails, links, page_facts, phones, structured
from pagequarry.plans import walk
from pagequarry.session import materialize
from pagequarry.sources.readers import html_pages

from . import sqltext as st
from .derived import pages_site, sites, table
from .registry import query

J = lambda c: F.array_join(c, "|")
big = lambda c: F.col(c).cast("bigint").alias(c)


# ------------------------------------------------------------------------------ urls and links
@query(rf"""SELECT page_id, concat(regexp_extract(url, '^(https?://)', 1), lower(regexp_extract(url, '^https?://([^/?#]+)', 1)),
  regexp_replace({st.encoded(r"regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)")}, '/+$', ''), regexp_extract(url, '^https?://[^?#]*([?#].*)$', 1)) AS normalized,
  lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS domain FROM pages""")
def normalized_urls(spark, sf):
    return links.normalize_urls(table(spark, sf, "pages").select("page_id", "url")).select("page_id", "normalized", "domain")


_TYPED = "CASE page_id % 5 WHEN 0 THEN concat(' ', url, ' ') WHEN 1 THEN replace(url, 'example', 'ex ample') WHEN 2 THEN regexp_replace(url, '^https?://', '') WHEN 3 THEN concat('ftp://', url) ELSE replace(replace(url, 'http:', 'HTTP:'), '.example.', '-.example.') END"


@query(rf"""SELECT page_id, trim(typed) AS url FROM (SELECT page_id, {_TYPED} AS typed FROM pages)
  WHERE regexp_matches(trim(typed), '(?i)^(?:https?://)?(?:(?:[A-Z0-9](?:[A-Z0-9-]{{0,61}}[A-Z0-9])?\.)+[A-Z]{{2,6}}\.?|localhost|\d{{1,3}}(?:\.\d{{1,3}}){{3}})(?::\d+)?(?:/?|[/?]\S+)$')""")
def valid_page_urls(spark, sf):
    typed = table(spark, sf, "pages").select("page_id", F.expr(_TYPED).alias("url"))
    return links.valid_urls(typed).select("page_id", F.trim("url").alias("url"))


@query(st.with_(st.MARKUP_CTE, st.LINKS_CTE) + """SELECT host AS domain, page_id, ord, href, link AS url,
  CASE WHEN thost = host OR thost LIKE concat('%.', host) THEN 'internal' ELSE 'external' END AS kind FROM links""")
def page_links(spark, sf):
    return links.page_links(pages_site(spark, sf)).withColumn("ord", F.col("ord").cast("bigint"))


@query(st.with_(st.MARKUP_CTE, st.LINKS_CTE) + "SELECT host AS domain, page_id, rank, link AS url FROM ranked")
def ranked_links(spark, sf):
    return links.rank_links(pages_site(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query(st.with_(st.SCORED_CTE) + "SELECT host AS domain, page_id, rank, link AS url, CAST(score AS DOUBLE) AS score FROM scored")
def scored_links(spark, sf):
    return links.score_links(pages_site(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


#: Anchors of several hundred characters, repeated targets, an anchor that is not closed, names without address.
_LONG_ANCHORS = """concat(html, '<a name="n">plan</a><a class="w" href="/offer/', CAST(page_id % 5 AS STRING), '?x=1"><b>', repeat('Widget prices <i>and more</i> ', 10 + CAST(abs(page_id) % 40 AS INT)),
  CASE WHEN page_id % 2 = 0 THEN 'Tariffs' ELSE '' END, '</b></a><a href="/offer/', CAST(page_id % 5 AS STRING), '">Contact</a>',
  CASE WHEN page_id % 3 = 0 THEN '<a href="/open/1"><A HREF="/tariffs/2">Shut</A><a href=''/z/y/x''>Tariffs 1 > 0</a>' ELSE '' END, '<a href="/never-closed">Tariffs')"""


@query(st.with_(f"pages_long AS (SELECT page_id, url, host, {_LONG_ANCHORS} AS html FROM pages_site)",
                st.scored_cte("pages_long", r"[\s\S]*?", ("tariffs", "report"))) + "SELECT host AS domain, page_id, rank, link AS url, CAST(score AS DOUBLE) AS score FROM scored")
def keyword_scored_links(spark, sf):
    """Links scored with keywords, anchors of any length."""
    pages = pages_site(spark, sf).withColumn("html", F.expr(_LONG_ANCHORS.replace("''/z/y/x''", "\\'/z/y/x\\'")))
    return links.score_links(pages, [" Tariffs ", "report", ""]).withColumn("rank", F.col("rank").cast("bigint"))


@query(st.with_(st.MARKUP_CTE, st.LINKS_CTE) + """SELECT p.host AS domain, p.page_id, count(link) FILTER (thost = p.host OR thost LIKE concat('%.', p.host)) AS internal_links,
  count(link) FILTER (NOT (thost = p.host OR thost LIKE concat('%.', p.host))) AS external_links
  FROM pages_site p LEFT JOIN links l ON p.page_id = l.page_id GROUP BY p.host, p.page_id""")
def link_counts(spark, sf):
    return links.link_counts(pages_site(spark, sf)).select("domain", "page_id", big("internal_links"), big("external_links"))


# ------------------------------------------------------------------------------ text
_TOK = (
    r"(?s)<!--.*?(?:-->|\z)|<script(?:[\s/][^>]*)?>.*?(?:</script\s*>|\z)|<style(?:[\s/][^>]*)?>.*?(?:</style\s*>|\z)|"
    + st.TAG.replace("(?s)", "") + r"|[^<]+|<"
)


@query(st.with_() + rf"""SELECT page_id, kind, count(*) AS tokens, CAST(sum(length(tok)) AS BIGINT) AS chars FROM (
  SELECT page_id, tok, CASE WHEN tok LIKE '<!--%' THEN 'comment' WHEN regexp_matches(tok, '^</[a-zA-Z]') THEN 'end'
    WHEN regexp_matches(tok, '(?i)^<(?:script|style)[\s/>]') THEN 'raw' WHEN regexp_matches(tok, '^<[a-zA-Z]') THEN 'start'
    WHEN regexp_matches(tok, '^<[!?]') THEN 'declaration' ELSE 'text' END AS kind
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_TOK}')) AS tok FROM pages_site)) GROUP BY 1, 2""")
def page_token_counts(spark, sf):
    from pagequarry.functions.html import TOKEN

    p = pages_site(spark, sf)
    kinds = page_facts.page_tokens(p).groupBy("page_id", "kind").agg(F.count("*").alias("tokens"))
    raw = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("t"))
    kind = (
        F.when(F.col("t").startswith("<!--"), "comment").when(F.col("t").rlike("^</[a-zA-Z]"), "end")
        .when(F.col("t").rlike("(?i)^<(?:script|style)[\\s/>]"), "raw").when(F.col("t").rlike("^<[a-zA-Z]"), "start")
        .when(F.col("t").rlike("^<[!?]"), "declaration").otherwise("text")
    )
    chars = raw.groupBy("page_id", kind.alias("kind")).agg(F.sum(F.length("t")).alias("chars"))
    return kinds.join(chars, ["page_id", "kind"])


@query(st.with_(st.TEXT_CTE) + "SELECT host AS domain, page_id, text FROM vis")
def page_visible_text(spark, sf):
    return page_facts.visible_text(pages_site(spark, sf))


@query(st.with_(st.TEXT_CTE) + """SELECT host AS domain, page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS line_no, line FROM (
  SELECT host, page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT host, page_id, string_split(text, chr(10)) AS ls FROM vis)) WHERE line <> ''""")
def page_visible_lines(spark, sf):
    return page_facts.visible_lines(pages_site(spark, sf)).withColumn("line_no", F.col("line_no").cast("bigint"))


def _mail_text(x: str) -> str:
    for pattern, value in [
        (r"(?is)<style.*?</style>", "' '"), (r"(?is)<script.*?</script>", "' '"), (r"(?i)<br\s*/?>", "chr(10)"),
        (r"(?i)</(?:p|div|li|h[1-6]|tr)>", "chr(10)"), (r"(?i)<li[^>]*>", "'• '"), (r"<[^>]+>", "''"), ("(?i)&nbsp;", "' '"),
        ("(?i)&amp;", "'&'"), ("(?i)&lt;", "'<'"), ("(?i)&gt;", "'>'"), ("(?i)&quot;", "'\"'"), ("&#39;", "chr(39)"),
        (r"[\t\v\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+", "' '"), (r"\n{3,}", "concat(chr(10), chr(10))"),
    ]:
        x = f"regexp_replace({x}, '{pattern}', {value}, 'g')"
    return st.trim(x)


@query(f"SELECT page_id, {_mail_text('html')} AS text FROM pages")
def mail_plain_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


# ------------------------------------------------------------------------------ facts
_TITLE = st.trim(st.plain(r"regexp_extract(m, '(?is)<title(?:[\s/][^>]*)?>(.*?)(?:</title\s*>|\z)', 1)"))
_OG = "trim(" + st.entities("regexp_extract(m, '<meta property=\"og:title\" content=\"([^\"]*)\">', 1)") + ")"
_DESCRIPTION = "trim(" + st.entities("regexp_extract(m, '<meta name=\"description\" content=\"([^\"]*)\">', 1)") + ")"


@query(st.with_(st.MARKUP_CTE) + f"""SELECT host AS domain, page_id, CASE WHEN {_TITLE} <> '' THEN {_TITLE} ELSE {_OG} END AS title, {_DESCRIPTION} AS description FROM mk""")
def page_metadata(spark, sf):
    return page_facts.extract_metadata(pages_site(spark, sf))


_H1 = st.trim(st.squeeze(st.plain(r"regexp_extract(m, '(?is)<h1(?:[\s/][^>]*)?>(.*?)(?:</h1\s*>|\z)', 1)")))
_N = "CASE WHEN page_id >= 0 AND page_id % 10 = 0 THEN {} ELSE {} END"


@query(st.with_(st.MARKUP_CTE, st.LINKS_CTE) + rf""", words AS (SELECT page_id, {st.trim(st.squeeze(st.BODY_TEXT))} AS b FROM pages_site),
 n AS (SELECT page_id, count(*) FILTER (thost = host OR thost LIKE concat('%.', host)) AS i, count(*) AS a FROM links GROUP BY page_id)
 SELECT mk.host AS domain, mk.page_id, {_TITLE} AS title, length({_TITLE}) AS title_length, {_DESCRIPTION} AS meta_description,
  length({_DESCRIPTION}) AS meta_description_length, '' AS meta_keywords, '' AS robots, false AS viewport,
  {_N.format("concat('https://', host, '/c/', CAST(page_id AS VARCHAR))", "''").replace("page_id", "mk.page_id")} AS canonical,
  regexp_extract(m, '<html lang="([^"]*)"', 1) AS lang, {_H1} AS h1, '' AS h2, '' AS h3,
  {_N.format("concat('og:title=OG ', CAST(page_id AS VARCHAR))", "''").replace("page_id", "mk.page_id")} AS og_tags,
  {_N.format("'twitter:card=summary'", "''").replace("page_id", "mk.page_id")} AS twitter_tags,
  {_N.format("2", "0").replace("page_id", "mk.page_id")} AS image_count, {_N.format("1", "0").replace("page_id", "mk.page_id")} AS images_missing_alt,
  CASE WHEN b = '' THEN 0 ELSE length(b) - length(replace(b, ' ', '')) + 1 END AS word_count,
  coalesce(i, 0) AS internal_links, coalesce(a - i, 0) AS external_links
 FROM mk JOIN words USING (page_id) LEFT JOIN n USING (page_id)""")
def page_seo(spark, sf):
    s = page_facts.extract_seo(pages_site(spark, sf))
    pairs = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|")
    s = s.withColumn("og_tags", pairs("og_tags")).withColumn("twitter_tags", pairs("twitter_tags"))
    for h in ("h1", "h2", "h3"):
        s = s.withColumn(h, J(h))
    for n in ("title_length", "meta_description_length", "image_count", "images_missing_alt", "word_count", "internal_links", "external_links"):
        s = s.withColumn(n, F.col(n).cast("bigint"))
    return s


@query(st.with_() + r"""SELECT DISTINCT host AS domain, page_id, platform, regexp_replace(regexp_extract(raw, '^([^?#]*)', 1), '/+$', '') AS url FROM (
  SELECT host, page_id, 'linkedin' AS platform, unnest(regexp_extract_all(html, '(?:https?://)(?:www\.)?linkedin\.com/(?:in|company|school|pub)/[^"''\s<>?#&]+')) AS raw FROM pages_site
  UNION ALL SELECT host, page_id, 'facebook', unnest(regexp_extract_all(html, '(?:https?://)(?:www\.)?facebook\.com/[^"''\s<>?#&]+')) FROM pages_site)""")
def social_profiles(spark, sf):
    return page_facts.extract_social(pages_site(spark, sf))


def _tech_sql() -> str:
    rows = []
    for name, category, patterns, rules in fv.TECH_SIGNATURES:
        tests = [f"regexp_matches(html, {st.q(p.replace(fv.W0, chr(92) + 'b').replace(fv.W1, chr(92) + 'b'))})" for p in patterns]
        tests += [f"regexp_matches(server, {st.q(v)})" for k, v in rules if k == "server" and v]
        if tests:
            rows.append(f"SELECT host AS domain, page_id, {st.q(name)} AS name, {st.q(category)} AS category FROM pages_site WHERE {' OR '.join(tests)}")
    return st.with_() + " UNION ALL ".join(rows)


@query(_tech_sql())
def technologies(spark, sf):
    return page_facts.detect_tech(pages_site(spark, sf)).drop("ord")


@query(_tech_sql().replace(" FROM pages_site", " FROM pages_site", 1).replace("SELECT host AS domain", "SELECT host AS domain", 1)
       .replace(st.with_(), st.with_() + "SELECT domain, category, string_agg(name, '|' ORDER BY name) AS names FROM (SELECT DISTINCT domain, category, name FROM (", 1)
       + ")) GROUP BY domain, category")
def technologies_by_category(spark, sf):
    from pagequarry.plans.extractor import tech_by_category

    return tech_by_category(page_facts.detect_tech(pages_site(spark, sf))).withColumn("names", J("names"))


KEYWORDS = ["the", "und", "Released under", "MIT License", "zzz"]


def _keyword_sql(source: str) -> str:
    words = ", ".join(f"({i}, {st.q(k)}, {st.q(k.lower())})" for i, k in enumerate(KEYWORDS))
    return f"""hits AS (SELECT b.*, keyword, n AS keyword_no,
   CAST((length(lo) - length(replace(lo, low, ''))) / length(low) AS BIGINT) AS "count",
   concat(CASE WHEN hit > 41 THEN '…' ELSE '' END, trim(substr(t, greatest(hit - 40, 1), least(length(t), hit + length(low) + 39) - greatest(hit - 41, 0))),
          CASE WHEN hit + length(low) + 39 < length(t) THEN '…' ELSE '' END) AS sample
   FROM (SELECT b.*, n, keyword, low, strpos(lo, low) AS hit FROM ({source}) b, (VALUES {words}) w(n, keyword, low)) b WHERE hit > 0)"""


_BODIES = f"SELECT host AS domain, page_id, t, lower(t) AS lo FROM (SELECT host, page_id, {st.squeeze(st.BODY_TEXT)} AS t FROM pages_site)"


@query(st.with_(_keyword_sql(_BODIES)) + 'SELECT domain, page_id, keyword, "count", sample FROM hits')
def page_keyword_hits(spark, sf):
    return page_facts.match_keywords(pages_site(spark, sf), KEYWORDS)


@query("WITH " + _keyword_sql(f"SELECT conv_id, turn, t, lower(t) AS lo FROM (SELECT conv_id, turn, {st.squeeze('text')} AS t FROM conversations)")
       + ' SELECT conv_id, turn, keyword, "count", sample FROM hits')
def conversation_keyword_hits(spark, sf):
    return page_facts.match_keywords(table(spark, sf, "conversations").select("conv_id", "turn", "text"), KEYWORDS, "text")


_WORD_TABLE = r"""words AS (SELECT DISTINCT keyword, lower(keyword) AS low FROM (
   SELECT unnest(string_split_regex(text, '[^A-Za-zÀ-ÿ]+')) AS keyword FROM benchmark UNION ALL SELECT p_name FROM part UNION ALL SELECT text FROM benchmark) WHERE length(keyword) > 1)"""


@query(f"""WITH {_WORD_TABLE}, texts AS (SELECT conv_id, turn, {st.squeeze('text')} AS t FROM conversations),
 found AS (SELECT conv_id, turn, t, lower(t) AS lo, keyword, low, strpos(lower(t), low) AS hit FROM texts, words WHERE contains(lower(t), low))
 SELECT conv_id, turn, keyword, CAST((length(lo) - length(replace(lo, low, ''))) / length(low) AS BIGINT) AS "count",
   concat(CASE WHEN hit > 41 THEN '…' ELSE '' END, trim(substr(t, greatest(hit - 40, 1), least(length(t), hit + length(low) + 39) - greatest(hit - 41, 0))),
          CASE WHEN hit + length(low) + 39 < length(t) THEN '…' ELSE '' END) AS sample FROM found""")
def dictionary_keyword_hits(spark, sf):
    """Keywords by the table: every word and passage of the benchmark, every name of a part."""
    passages = table(spark, sf, "benchmark").select(F.col("text").alias("keyword"))
    words = passages.select(F.explode(F.split("keyword", "[^A-Za-zÀ-ÿ]+")).alias("keyword"))
    names = table(spark, sf, "part").select(F.col("p_name").alias("keyword"))
    keywords = words.union(names).union(passages).where(F.length("keyword") > 1)
    return page_facts.match_keyword_table(table(spark, sf, "conversations").select("conv_id", "turn", "text"), keywords, "text")


@query(st.with_(_keyword_sql(_BODIES), f"words(keyword_no, keyword) AS (VALUES {', '.join(f'({i}, {st.q(k)})' for i, k in enumerate(KEYWORDS))})",
                "tot AS (SELECT domain, keyword, CAST(sum(\"count\") AS BIGINT) AS c, count(*) AS p, arg_min(sample, page_id) AS s FROM hits GROUP BY 1, 2)")
       + 'SELECT h.domain, keyword, coalesce(c, 0) AS "count", coalesce(p, 0) AS pages, coalesce(s, \'\') AS sample FROM (SELECT DISTINCT host AS domain FROM pages_rich) h CROSS JOIN words LEFT JOIN tot USING (domain, keyword)')
def keyword_totals(spark, sf):
    from pagequarry.plans.extractor import keyword_rollup

    hits = page_facts.match_keywords(pages_site(spark, sf), KEYWORDS)
    all_sites = links.normalize_urls(sites(spark, sf)).select("domain")
    return keyword_rollup(hits, all_sites, KEYWORDS).drop("keyword_no")


_ORG = r"regexp_extract(html, '\"@type\":\"Organization\",\"name\":\"([^\"]{2,80})\"', 1)"
_STEM = rf"trim(string_split_regex({_TITLE}, '{st.SPW}+[|\-–—·•:]{st.SPW}+')[1])"


def _clean(x: str) -> str:
    return rf"substr(trim(regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '(?i)^(?:welcome\s+to|home)\s*[-|:–—]?\s*', '')), 1, 80)"


@query(st.with_(st.MARKUP_CTE) + rf"""SELECT domain, page_id, CASE WHEN org <> '' THEN {_clean('org')} WHEN title <> '' THEN
   CASE WHEN length(stem) BETWEEN 2 AND 60 THEN {_clean('stem')} ELSE {_clean('substr(title, 1, 60)')} END
   ELSE replace(replace(string_split(regexp_replace(domain, '^www\.', ''), '.')[1], '-', ' '), '_', ' ') END AS business_name
  FROM (SELECT host AS domain, page_id, {_ORG} AS org, {_TITLE} AS title, {_STEM} AS stem FROM mk)""")
def business_names(spark, sf):
    return page_facts.detect_business_name(pages_site(spark, sf))


@query(st.with_() + "SELECT host AS domain, page_id, page_id >= 0 AND page_id % 9 = 0 AS has_form FROM pages_site")
def contact_forms(spark, sf):
    return page_facts.has_contact_form(pages_site(spark, sf))


def _category_sql() -> str:
    score = lambda terms: " + ".join(f"CASE WHEN contains(strong, {st.q(t)}) THEN 3 WHEN contains(body, {st.q(t)}) THEN 1 ELSE 0 END" for t in terms)
    scores = ", ".join(f"{{'s': {score(terms)}, 'r': {-i}, 'l': {st.q(label)}}}" for i, (label, terms) in enumerate(fv.CATEGORY_RULES))
    return st.with_(st.MARKUP_CTE, st.TEXT_CTE) + f"""SELECT domain, page_id, CASE WHEN best.s >= 3 THEN best.l ELSE '—' END AS category FROM (
      SELECT domain, page_id, list_max([{scores}]) AS best FROM (
        SELECT mk.host AS domain, mk.page_id, lower(concat({_TITLE}, ' ', {_DESCRIPTION.replace('trim(', '(', 1)}, '  ', {st.plain("regexp_extract(m, '(?is)<h1(?:[ /][^>]*)?>(.*?)(?:</h1>|$)', 1)")})) AS strong,
               lower(text) AS body FROM mk JOIN vis ON mk.page_id = vis.page_id))"""


@query(_category_sql())
def page_categories(spark, sf):
    return page_facts.classify_category(pages_site(spark, sf))


# ------------------------------------------------------------------------------ e-mail
_EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
_SPELLED = rf"(?i)[a-zA-Z0-9._%+\-]+{st.SPW}*[\[\(]?{st.SPW}*(?:at|@){st.SPW}*[\]\)]?{st.SPW}*[a-zA-Z0-9.\-]+{st.SPW}*[\[\(]?{st.SPW}*(?:dot|\.){st.SPW}*[\]\)]?{st.SPW}*[a-zA-Z]{{2,}}"


def _despell(x: str) -> str:
    x = f"lower({x})"
    for w, s in (("at", "@"), ("dot", ".")):
        for form in (f"[{w}]", f"({w})", f" {w} ", f"{{{w}}}"):
            x = f"replace({x}, '{form}', '{s}')"
    return f"regexp_replace({x}, '{st.SPW}+', '', 'g')"


def _kept(e: str) -> str:
    quote = lambda ws: ", ".join(st.q(w) for w in ws)
    return (
        rf"regexp_full_match({e}, '{_EMAIL}') AND NOT regexp_matches({e}, '\.(?:png|jpg|gif|svg|webp|css|js)$')"
        f" AND string_split({e}, '@')[2] NOT IN ({quote(fv.JUNK_EMAIL_DOMAINS)}) AND string_split({e}, '@')[1] NOT IN ({quote(fv.JUNK_EMAIL_USERS)})"
    )


PAGE_EMAILS_CTE = rf"""found AS (
   SELECT host, page_id, regexp_replace(lower(unnest(regexp_extract_all(html, '{_EMAIL}'))), '^[.,;:]+|[.,;:]+$', '', 'g') AS email FROM pages_site
   UNION ALL SELECT host, page_id, {_despell('s')} FROM (SELECT host, page_id, unnest(regexp_extract_all(html, '{_SPELLED}')) AS s FROM pages_site)
   UNION ALL SELECT host, page_id, concat('sales@', host) FROM pages_site WHERE page_id >= 0 AND page_id % 3 = 0),
 page_emails AS (SELECT DISTINCT host AS domain, page_id, email FROM found WHERE {_kept('email')})"""


@query(st.with_(PAGE_EMAILS_CTE) + "SELECT * FROM page_emails")
def page_emails(spark, sf):
    return emails.extract_emails(pages_site(spark, sf))


@query(rf"""SELECT DISTINCT doc_id, email FROM (
   SELECT doc_id, regexp_replace(lower(unnest(regexp_extract_all(text, '{_EMAIL}'))), '^[.,;:]+|[.,;:]+$', '', 'g') AS email FROM documents
   UNION ALL SELECT doc_id, {_despell('s')} FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_SPELLED}')) AS s FROM documents))
  WHERE {_kept('email')}""")
def document_emails(spark, sf):
    return emails.text_emails(table(spark, sf, "documents").select("doc_id", "text"))


def _finder_despell(x: str) -> str:
    x, sp = f"lower({x})", st.SPW
    for pattern, sign in (
        (rf"{sp}*[\[({{<]{sp}*(?:at|@){sp}*[\])}}>]{sp}*", "@"), (f"{sp}+at{sp}+", "@"),
        (rf"{sp}*[\[({{<]{sp}*(?:dot|punkt|punto){sp}*[\])}}>]{sp}*", "."), (f"{sp}+(?:dot|punkt|punto){sp}+", "."), (f"{sp}+", ""),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{sign}', 'g')"
    return x


_TLDS = ", ".join(st.q(t) for t in fv.GENERIC_TLDS + fv.COUNTRY_TLDS)


def finder_email_ctes(sources: str) -> str:
    """Usable addresses from ``sources`` (key columns, raw, via), as the finder's rules define them."""
    quote = lambda ws: ", ".join(st.q(w) for w in ws)
    edge = r"^[.,;:<>(\"''\s]+|[.,;:<>)\"''\s]+$"
    return rf"""tidy AS (SELECT * EXCLUDE (raw), lower(regexp_replace(raw, '{edge}', '', 'g')) AS t FROM ({sources})),
 parts AS (SELECT * EXCLUDE (t), regexp_extract(t, '^(.*)@', 1) AS local, string_split(regexp_extract(t, '@([^@]*)$', 1), '.') AS ls FROM tidy WHERE strpos(t, '@') > 1),
 fixed AS (SELECT * EXCLUDE (ls), array_to_string(CASE WHEN len(ls) < 3 OR ls[-1] IN ({_TLDS}) THEN ls WHEN ls[-2] IN ({_TLDS}) THEN ls[:-2]
    WHEN len(ls) >= 4 AND ls[-3] IN ({_TLDS}) THEN ls[:-3] ELSE ls END, '.') AS domain_part FROM parts),
 usable AS (SELECT * FROM (SELECT *, concat(local, '@', domain_part) AS email FROM fixed)
   WHERE regexp_matches(email, '^[a-z0-9](?:[a-z0-9._%+-]{{0,62}}[a-z0-9])?@(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z]{{2,24}}$')
   AND NOT regexp_matches(email, '(?:{"|".join(x.replace(".", chr(92) + ".") for x in fv.FINDER_ASSET_SUFFIXES)})$') AND length(email) <= 254
   AND domain_part NOT IN ({quote(fv.PLACEHOLDER_DOMAINS)}) AND local NOT IN ({quote(fv.PLACEHOLDER_LOCALS + fv.UNREACHABLE_LOCALS)})
   AND NOT regexp_matches(local, '^[0-9a-f]{{16,}}$') AND NOT (length(local) >= 20 AND NOT regexp_matches(local, '[._+-]') AND regexp_matches(local, '[a-z]') AND regexp_matches(local, '[0-9]'))
   AND NOT regexp_matches(local, '^u[0-9a-f]{{4}}') AND NOT regexp_matches(local, '^[0-9]+$') AND NOT regexp_matches(domain_part, '(?:^|\.)[0-9]+(?:\.|$)'))"""


def kind_sql(email: str) -> str:
    base = rf"regexp_replace(regexp_extract({email}, '^(.*)@', 1), '\+.*$', '')"
    roles = ", ".join(st.q(r) for r in fv.FINDER_ROLES)
    return (
        f"CASE WHEN {base} IN ({roles}) OR list_has_any(string_split_regex({base}, '[._-]'), [{roles}]) THEN 'role'"
        rf" WHEN regexp_matches({base}, '^[a-z]{{2,}}(?:[._-][a-z]{{2,}}){{1,2}}$') OR regexp_matches({base}, '^[a-z][._-][a-z]{{3,}}$') THEN 'personal' ELSE 'generic' END"
    )


_PAGE_SOURCES = rf"""SELECT host, page_id, unnest(regexp_extract_all(html, '{_EMAIL}')) AS raw, false AS via FROM pages_site
  UNION ALL SELECT host, page_id, {_finder_despell('s')}, false FROM (SELECT host, page_id, unnest(regexp_extract_all(text, '{_SPELLED}')) AS s FROM vis)
  UNION ALL SELECT host, page_id, concat('sales@', host), true FROM pages_site WHERE page_id >= 0 AND page_id % 3 = 0"""


@query(st.with_(st.TEXT_CTE, finder_email_ctes(_PAGE_SOURCES)) + "SELECT host AS domain, page_id, email, bool_or(via) AS via_mailto FROM usable GROUP BY 1, 2, 3")
def page_email_hits(spark, sf):
    return emails.find_page_emails(pages_site(spark, sf)).select("domain", "page_id", "email", "via_mailto")


_DOC_SOURCES = rf"""SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS raw FROM documents
  UNION ALL SELECT doc_id, {_finder_despell('s')} FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_SPELLED}')) AS s FROM documents)"""


@query("WITH " + finder_email_ctes(_DOC_SOURCES) + "SELECT DISTINCT doc_id, email FROM usable")
def document_email_hits(spark, sf):
    return emails.text_email_hits(table(spark, sf, "documents").select("doc_id", "text"))


# ------------------------------------------------------------------------------ phones and addresses
@query(st.with_() + """SELECT host AS domain, page_id, concat('+15552', lpad(CAST(page_id AS VARCHAR), 5, '0'), '7') AS display FROM pages_rich WHERE page_id % 5 = 0
  UNION ALL SELECT host, page_id, concat('+92 21 3', lpad(CAST(page_id AS VARCHAR), 5, '0'), '79') FROM pages_rich WHERE page_id % 7 = 0""")
def declared_phones(spark, sf):
    return phones.extract_phones(pages_site(spark, sf)).filter("trusted").select("domain", "page_id", "display")


@query(st.with_() + """SELECT DISTINCT host AS domain, concat('15552', lpad(CAST(page_id AS VARCHAR), 5, '0'), '7') AS digits, concat('+15552', lpad(CAST(page_id AS VARCHAR), 5, '0'), '7') AS display FROM pages_rich WHERE page_id % 5 = 0
  UNION SELECT host, concat('92213', lpad(CAST(page_id AS VARCHAR), 5, '0'), '79'), concat('+92 21 3', lpad(CAST(page_id AS VARCHAR), 5, '0'), '79') FROM pages_rich WHERE page_id % 7 = 0""")
def declared_phones_per_site(spark, sf):
    return phones.dedupe_phones(phones.extract_phones(pages_site(spark, sf)).filter("trusted"))


@query(st.with_(st.TEXT_CTE, st.PHONE_CTE) + "SELECT domain, page_id, ord, display, digits, trusted FROM phone_rows")
def page_phones(spark, sf):
    return phones.extract_phones(pages_site(spark, sf)).select("domain", "page_id", big("ord"), "display", "digits", "trusted")


@query(st.with_(st.TEXT_CTE, st.PHONE_CTE, st.deduped_phones("kept", "phone_rows", "domain", "page_id, ord")) + "SELECT * FROM kept")
def site_phones(spark, sf):
    return phones.dedupe_phones(phones.extract_phones(pages_site(spark, sf)))


@query(f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS ord, display, regexp_replace(display, '[^0-9]', '', 'g') AS digits, false AS trusted FROM (
   SELECT doc_id, unnest(xs) AS display, generate_subscripts(xs, 1) AS n FROM (SELECT doc_id, {st.scanned_phones('text')} AS xs FROM documents)) WHERE regexp_full_match(display, '{st.NUMBER}')""")
def document_phones(spark, sf):
    return phones.text_phones(table(spark, sf, "documents").select("doc_id", "text")).withColumn("ord", F.col("ord").cast("bigint"))


_TAIL = "concat(CAST(200 + c_custkey % 700 AS STRING), '-', CAST(100 + c_custkey * 37 % 800 AS STRING), '-', CAST(1000 + c_custkey * 7 % 9000 AS STRING))"
_FULL = f"concat('+', CAST(10 + c_nationkey AS STRING), ' ', replace({_TAIL}, '-', ' '))"
#: A customer's number in full, without its country, with a trunk zero, twice, or only as its tail: (form, declared, which customers).
_FORMS = [
    (_FULL, "false", "c_custkey % 4 <> 0"), (_TAIL, "true", "c_custkey % 4 IN (0, 1)"), (f"concat('0', {_TAIL})", "false", "c_custkey % 4 = 2"),
    (f"replace({_FULL}, ' ', '.')", "true", "c_custkey % 4 = 3"),
]
_MENTIONS = " UNION ALL ".join(
    f"SELECT CAST(c_nationkey % 5 AS STRING) AS domain, c_custkey AS page_id, {i} AS ord, {form} AS display, {declared} AS trusted FROM customer WHERE {which}"
    for i, (form, declared, which) in enumerate(_FORMS)
)


@query(f"WITH mentions AS (SELECT *, regexp_replace(display, '[^0-9]', '', 'g') AS digits FROM ({_MENTIONS})), "
       + st.deduped_phones("kept", "mentions", "domain", "page_id, ord") + " SELECT * FROM kept")
def customer_phones(spark, sf):
    """De-duplication of many numbers with tails and ties: customers' numbers in several forms, five scopes."""
    customers, mentions = table(spark, sf, "customer"), None
    for i, (form, declared, which) in enumerate(_FORMS):
        part = customers.where(which).select(
            (F.col("c_nationkey") % 5).cast("string").alias("domain"), F.col("c_custkey").alias("page_id"), F.lit(i).alias("ord"),
            F.expr(form).alias("display"), F.expr(declared).alias("trusted"),
        )
        mentions = part if mentions is None else mentions.unionByName(part)
    return phones.dedupe_phones(mentions.withColumn("digits", F.regexp_replace("display", "[^0-9]", "")))


@query(st.with_() + rf"""SELECT host AS domain, page_id, {st.normalized(st.plain(r"regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)"))} AS lines FROM pages_rich WHERE html LIKE '%<footer>%'
  UNION ALL SELECT host, page_id, concat(CAST(page_id + 1 AS VARCHAR), ' Main Street, Suite 5', chr(10), 'Springfield, IL 62704') FROM pages_rich WHERE page_id % 11 = 0""")
def address_containers(spark, sf):
    c = addresses.page_containers(pages_site(spark, sf))
    return c.select("domain", "page_id", F.array_join("lines", "\n").alias("lines"))


@query(st.with_() + """SELECT host AS domain, page_id, concat(CAST(page_id + 1 AS VARCHAR), ' Main Street, Suite 5, Springfield, IL 62704, Partner') AS address FROM pages_rich WHERE page_id % 11 = 0""")
def page_addresses(spark, sf):
    return addresses.extract_addresses(pages_site(spark, sf)).select("domain", "page_id", "address")


# ------------------------------------------------------------------------------ structured data
@query(st.with_() + """SELECT host AS domain, page_id, unnest(CASE WHEN page_id % 7 = 0 THEN ['organization', 'website'] ELSE ['product', 'product', 'jobposting,thing'] END) AS types,
   unnest(CASE WHEN page_id % 7 = 0 THEN [0, 1] ELSE [0, 1, 2] END) AS ord FROM pages_rich WHERE page_id % 7 IN (0, 1)""")
def jsonld_nodes(spark, sf):
    n = structured.jsonld_nodes(pages_site(spark, sf))
    return n.select("domain", "page_id", F.array_join("types", ",").alias("types"), "ord")


@query(st.with_() + """SELECT host AS domain, page_id, concat('Firm ', CAST(page_id AS VARCHAR)) AS name, CAST(NULL AS VARCHAR) AS legal_name, concat('https://', host, '/logo.png') AS logo,
   concat('+92 21 3', lpad(CAST(page_id AS VARCHAR), 5, '0'), '79') AS telephone, concat(CAST(page_id + 1 AS VARCHAR), ' Mall Road, Lahore, Punjab, 54000 Pakistan') AS address,
   concat('https://facebook.com/firm', CAST(page_id AS VARCHAR)) AS same_as FROM pages_rich WHERE page_id % 7 = 0""")
def companies(spark, sf):
    c = structured.extract_company(pages_site(spark, sf))
    return c.select("domain", "page_id", "name", "legal_name", "logo", "telephone", "address", J("same_as").alias("same_as"))


@query(st.with_() + """SELECT host AS domain, page_id, concat('Part ', CAST(page_id AS VARCHAR)) AS name, concat(CAST(page_id AS VARCHAR), '.5') AS price, 'USD' AS currency,
   concat('S', CAST(page_id AS VARCHAR)) AS sku, concat('Brand ', CAST(page_id % 5 AS VARCHAR)) AS brand, 'InStock' AS availability, url FROM pages_rich WHERE page_id % 7 = 1""")
def products(spark, sf):
    return structured.extract_products(pages_site(spark, sf)).drop("ord", "category")


@query("""SELECT p_partkey AS page_id, p_name AS name, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END AS price,
   p_brand AS brand, p_type AS category, concat('part-', CAST(p_partkey AS VARCHAR)) AS sku FROM part""")
def catalogue_products(spark, sf):
    p = table(spark, sf, "part")
    node = F.to_json(F.struct(
        F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        F.concat(F.lit("part-"), F.col("p_partkey")).alias("mpn"), F.struct(F.col("p_retailprice").alias("lowPrice")).alias("offers")))
    pages = p.select(
        F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.example.net/p/"), F.col("p_partkey")).alias("url"),
        F.concat(F.lit('<html><body><script type="application/ld+json">'), node, F.lit("</script></body></html>")).alias("html"))
    return structured.extract_products(pages).select("page_id", "name", "price", "brand", "category", "sku")


@query(st.with_() + """SELECT host AS domain, page_id, concat('Job ', CAST(page_id AS VARCHAR)) AS title, concat('Firm ', CAST(page_id AS VARCHAR)) AS company,
   concat(CAST(page_id + 1 AS VARCHAR), ' Canal Road, Lahore, Pakistan') AS location, 'FULL_TIME' AS employment_type, '2024-01-15' AS date_posted, url FROM pages_rich WHERE page_id % 7 = 1""")
def jobs(spark, sf):
    return structured.extract_jobs(pages_site(spark, sf)).drop("ord")


@query(st.with_() + """SELECT host AS domain, page_id, concat(CAST(page_id + 1 AS VARCHAR), CASE WHEN page_id % 7 = 0 THEN ' Mall Road, Lahore, Punjab, 54000 Pakistan' ELSE ' Canal Road, Lahore, Pakistan' END) AS address FROM pages_rich WHERE page_id % 7 IN (0, 1)""")
def structured_addresses(spark, sf):
    return structured.structured_addresses(pages_site(spark, sf)).drop("ord")


# ------------------------------------------------------------------------------ walks
def _stored(spark, sf):
    """The site pages as a stored table, which walks read column by column."""
    return materialize(pages_site(spark, sf), "pages")


@query(st.with_(st.MARKUP_CTE, st.LINKS_CTE, st.WALK_CTE) + "SELECT domain, url, depth, ord, page_id, outcome FROM visits")
def site_visits(spark, sf):
    v = walk.walk_sites(_stored(spark, sf), sites(spark, sf))
    return v.select("domain", "url", "depth", F.col("ord").cast("bigint").alias("ord"), "page_id", "outcome")


@query(st.with_(st.MARKUP_CTE, st.LINKS_CTE, st.WALK_CTE) + "SELECT domain, ord, concat('Failed: ', url) AS error FROM visits WHERE outcome = 'missing'")
def walk_errors(spark, sf):
    from pagequarry.plans.extractor import run_errors

    return run_errors(walk.walk_sites(_stored(spark, sf), sites(spark, sf))).withColumn("ord", F.col("ord").cast("bigint"))


@query(st.with_(st.MARKUP_CTE, st.LINKS_CTE, st.WALK_CTE) + "SELECT domain, ord, concat('✓ [', CAST(depth AS VARCHAR), '] ', url) AS log FROM visits WHERE outcome = 'page'")
def walk_logs(spark, sf):
    from pagequarry.plans.extractor import run_logs

    return run_logs(walk.walk_sites(_stored(spark, sf), sites(spark, sf))).withColumn("ord", F.col("ord").cast("bigint"))


@query(st.with_(st.SCORED_CTE, st.FINDER_CTE) + "SELECT domain, url, ord, page_id FROM finder")
def finder_visits(spark, sf):
    v = walk.finder_pages(_stored(spark, sf), sites(spark, sf))
    return v.select("domain", "url", F.col("ord").cast("bigint").alias("ord"), "page_id")


@query("SELECT page_id, url FROM pages WHERE page_id % 4 <> 3")
def stored_html_pages(spark, sf):
    kind = F.when(F.col("page_id") % 4 == 3, "application/pdf").otherwise("text/html; charset=utf-8")
    return html_pages(table(spark, sf, "pages").withColumn("content_type", kind)).select("page_id", "url")
