"""SQL fragments for the checking engine: the derived pages, their text and their links."""

from __future__ import annotations

from pagequarry.functions import fixed_values as fv

from .derived import RICH_CTE

SPW = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TAG = r"(?s)</?[a-zA-Z](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>|</?[a-zA-Z][^>]*>|<[!?][^>]*>"


def q(text: str) -> str:
    """A Python text as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def entities(x: str) -> str:
    for ref, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, {q(ref)}, {q(ch)})"
    return x


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPW}+|{SPW}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '{SPW}+', ' ', 'g')"


def plain(x: str) -> str:
    return entities(f"regexp_replace({x}, '{TAG}', '', 'g')")


_BLOCKS = "|".join(fv.BLOCK_TAGS)
_NOISE = "|".join(rf"<{t}[\s/>].*?(?:</{t}\s*>|\z)|<{t}>.*?(?:</{t}\s*>|\z)" for t in fv.NOISE_TAGS if t != "option")

MARKUP = (
    r"regexp_replace(html, '(?is)(<script(?:[\s/][^>]*)?>).*?(?:</script\s*>|\z)|(<style(?:[\s/][^>]*)?>).*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)', '\1\2', 'g')"
)


def body(x: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({x}, '(?i)<body[\s/>]') THEN regexp_replace({x}, '(?is)\A.*?<body(?:[\s/][^>]*)?>', '')"
        rf" WHEN regexp_matches({x}, '(?i)</head\s*>') THEN regexp_replace({x}, '(?is)\A.*?</head\s*>', '') ELSE {x} END"
    )


BODY_TEXT = entities(
    r"regexp_replace(" + body("html")
    + r", '(?is)<script(?:[\s/][^>]*)?>(.*?)(?:</script\s*>|\z)|<style(?:[\s/][^>]*)?>(.*?)(?:</style\s*>|\z)|<!--.*?(?:-->|\z)|"
    + TAG.replace("(?s)", "") + r"', '\1\2', 'g')"
)


def visible(html: str = "html") -> str:
    x = f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?i)<(?:br|hr)\s*/?>', chr(10), 'g')"
    x = rf"regexp_replace({x}, '(?i)(</(?:{_BLOCKS})\s*>)', concat('\1', chr(10)), 'g')"
    x = f"regexp_replace({x}, '(?is){_NOISE}', '', 'g')"
    return x


def normalized(x: str) -> str:
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = r"regexp_replace(" + x + r", '[\t\v\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')"
    x = rf"regexp_replace({x}, ' *\n[ \n]*', chr(10), 'g')"
    return trim(x)


TEXT_CTE = f"""
marked AS (SELECT page_id, url, host, {visible()} AS mk FROM pages_site),
vis AS (SELECT page_id, url, host, {normalized(plain(body('mk')))} AS text FROM marked)
"""
MARKUP_CTE = f"mk AS (SELECT page_id, url, host, html, server, {MARKUP} AS m FROM pages_site)"


def attribute(tag: str, name: str) -> str:
    return entities(rf"regexp_extract({tag}, '(?is)[\s/]{name}\s*=\s*\"([^\"]*)\"', 1)")


def encoded(path: str) -> str:
    return (
        rf"array_to_string(list_transform(regexp_extract_all({path}, '(?s).'), lambda c: CASE WHEN regexp_matches(c, '[^\x21-\x7e]|[\"<>`{{}}]')"
        " THEN url_encode(c) ELSE c END), '')"
    )


LINKS_CTE = rf"""
anchors AS (
  SELECT page_id, host, url, unnest(tags) AS tag, generate_subscripts(tags, 1) AS n
  FROM (SELECT page_id, host, url, regexp_extract_all(m, '(?i)<a\s[^>]*>') AS tags FROM mk)),
hrefs AS (
  SELECT page_id, host, url, href, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS ord
  FROM (SELECT *, {trim(attribute('tag', 'href'))} AS href FROM anchors)
  WHERE href <> '' AND NOT regexp_matches(href, '(?i)^(?:#|mailto:|tel:|javascript:)')),
links AS (
  SELECT *, concat(regexp_extract(target, '^(https?)://', 1), '://', thost, regexp_replace({encoded('raw_path')}, '/+$', '')) AS link
  FROM (SELECT *, lower(regexp_extract(target, '^https?://([^/?#]+)', 1)) AS thost,
               regexp_extract(target, '^https?://[^/?#]+([^?#]*)', 1) AS raw_path
        FROM (SELECT *, CASE WHEN href LIKE 'http%' THEN href ELSE concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), href) END AS target FROM hrefs))),
ranked AS (
  SELECT page_id, host, link, row_number() OVER (PARTITION BY page_id ORDER BY first_ord + CASE WHEN priority THEN 0 ELSE 1000000 END) - 1 AS rank
  FROM (SELECT page_id, host, link, min(ord) AS first_ord,
               regexp_matches(lower(regexp_replace(link, '^https?://[^/]+', '')), '{"|".join(fv.PRIORITY_PATHS)}') AS priority
        FROM links WHERE thost = host OR thost LIKE concat('%.', host) GROUP BY page_id, host, link))
"""

PAGE_KEY = (
    r"concat(regexp_extract(url, '^(https?://)', 1), lower(regexp_extract(url, '^https?://([^/?#]+)', 1)),"
    + r" regexp_replace(" + encoded(r"regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)") + r", '/+$', ''), regexp_extract(url, '^[^?#]*(\?[^#]*)', 1))"
)
_SEEDS = ", ".join(f"({i}, {q(p)})" for i, p in enumerate(fv.PRIORITY_PATHS))

WALK_CTE = f"""
keys AS (SELECT {PAGE_KEY} AS key, min(page_id) AS page_id FROM pages_site GROUP BY 1),
site AS (SELECT DISTINCT host AS domain FROM pages_rich),
v0 AS (SELECT domain, concat('https://', domain) AS url, 0 AS depth, 0 AS ord, page_id
       FROM site LEFT JOIN keys ON key = concat('https://', domain)),
c1 AS (
  SELECT domain, url, min(pos) AS pos FROM (
    SELECT domain, concat('https://', domain, path) AS url, i AS pos FROM site, (VALUES {_SEEDS}) s(i, path)
    UNION ALL
    SELECT domain, link, 100 + rank FROM v0 JOIN ranked USING (page_id) WHERE rank < {fv.WALK_MAX_CHILDREN})
  GROUP BY domain, url),
v1 AS (
  SELECT domain, url, 1 AS depth, rn AS ord, page_id FROM (
    SELECT *, row_number() OVER (PARTITION BY domain ORDER BY pos) AS rn
    FROM c1 WHERE NOT EXISTS (SELECT 1 FROM v0 WHERE v0.domain = c1.domain AND v0.url = c1.url))
  LEFT JOIN keys ON key = url WHERE rn <= {fv.WALK_MAX_PAGES} - 1),
seen AS (SELECT * FROM v0 UNION ALL SELECT * FROM v1),
used AS (SELECT domain, count(*) AS n FROM seen GROUP BY domain),
c2 AS (
  SELECT domain, link AS url, min(ord * 100 + rank) AS pos FROM v1 JOIN ranked USING (page_id)
  WHERE rank < {fv.WALK_MAX_CHILDREN} GROUP BY domain, link),
v2 AS (
  SELECT c.domain, c.url, 2 AS depth, n + rn - 1 AS ord, page_id FROM (
    SELECT *, row_number() OVER (PARTITION BY domain ORDER BY pos) AS rn
    FROM c2 WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.domain = c2.domain AND seen.url = c2.url)) c
  JOIN used USING (domain) LEFT JOIN keys ON key = c.url WHERE n + rn <= {fv.WALK_MAX_PAGES}),
visits AS (
  SELECT domain, url, depth, ord, page_id, CASE WHEN page_id IS NULL THEN 'missing' ELSE 'page' END AS outcome
  FROM (SELECT * FROM seen UNION ALL SELECT * FROM v2))
"""

_HINTS = "|".join(fv.CONTACT_HINTS)


def scored_cte(pages: str = "pages_site", text: str = r"[\s\S]{0,120}?", words: tuple[str, ...] = ()) -> str:
    """Same-site links with the score of a contact search; ``text`` is the pattern of an anchor's text."""
    paths = "|".join((_HINTS, *words))
    extra = f" + CASE WHEN regexp_matches(anchor, '{'|'.join(words)}') THEN 4.0 ELSE 0.0 END" if words else ""
    return rf"""
tags AS (
  SELECT page_id, host, url, unnest(hs) AS raw, unnest(ts) AS anchor, generate_subscripts(hs, 1) AS n FROM (
    SELECT page_id, host, url,
      regexp_extract_all(html, '(?i)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>({text})</a>', 1) AS hs,
      regexp_extract_all(html, '(?i)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>({text})</a>', 2) AS ts
    FROM {pages})),
absolute AS (
  SELECT *, CASE WHEN href LIKE 'http%' THEN href ELSE concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), href) END AS target
  FROM (SELECT *, {trim('raw')} AS href FROM tags)
  WHERE href <> '' AND NOT regexp_matches(href, '(?i)^(?:#|mailto:|tel:|javascript:|data:)')),
own AS (
  SELECT page_id, host, n, lower(regexp_replace(anchor, '<[^>]*>', ' ', 'g')) AS anchor, {encoded("regexp_extract(target, '^https?://[^/?#]+([^?#]*)', 1)")} AS path,
         concat(regexp_extract(target, '^(https?)://', 1), '://', lower(regexp_extract(target, '^https?://([^/?#]+)', 1))) AS root
  FROM absolute WHERE lower(regexp_extract(target, '^https?://([^/?#]+)', 1)) = host OR lower(regexp_extract(target, '^https?://([^/?#]+)', 1)) LIKE concat('%.', host)),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY n) AS k FROM (
    SELECT *, concat(root, regexp_replace(path, '/+$', '')) AS link FROM own)
  WHERE NOT regexp_matches(link, '(?i)\.(?:pdf|zip|jpe?g|png|gif|svg|webp|mp4|mp3|docx?|xlsx?)$')),
scored AS (
  SELECT page_id, host, link, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, n) - 1 AS rank FROM (
    SELECT *, CASE WHEN regexp_matches(lower(path), '{paths}') THEN 10.0 ELSE 0.0 END + CASE WHEN regexp_matches(anchor, '{_HINTS}') THEN 6.0 ELSE 0.0 END{extra}
              - (length(link) - length(replace(link, '/', '')) - 2) * 0.5 AS score
    FROM firsts WHERE k = 1))
"""


SCORED_CTE = scored_cte()
_FSEEDS = ", ".join(f"({i}, {q(p)})" for i, p in enumerate(fv.FINDER_SEED_PATHS))
FINDER_CTE = f"""
keys AS (SELECT {PAGE_KEY} AS key, min(page_id) AS page_id FROM pages_site GROUP BY 1),
site AS (SELECT DISTINCT host AS domain FROM pages_rich),
entry AS (SELECT domain, concat('https://', domain) AS url, page_id FROM site LEFT JOIN keys ON key = concat('https://', domain)),
queue AS (
  SELECT domain, link, min(pos) AS pos FROM (
    SELECT domain, link, rank AS pos FROM entry JOIN scored USING (page_id)
    UNION ALL SELECT domain, concat(url, path), 1000 + i FROM entry, (VALUES {_FSEEDS}) s(i, path))
  WHERE link <> concat('https://', domain) GROUP BY domain, link),
finder AS (
  SELECT domain, url, 0 AS ord, page_id FROM entry
  UNION ALL
  SELECT domain, link, rn, page_id FROM (
    SELECT q.domain, link, page_id, row_number() OVER (PARTITION BY q.domain ORDER BY pos) AS rn FROM queue q JOIN keys ON key = link)
  WHERE rn < {fv.FINDER_DEFAULT_PAGES})
"""


_LABELS = "version|ver|build|rev|revision|sku|isbn|issn|id|ref|order|invoice|item|qty|quantity|width|height|size|account|routing|tax|vat"
_UNITS = "px|pt|em|rem|vh|vw|ms|kg|lbs?|oz|km|cm|mm|mi|ft|in|mb|gb|tb|kb|hz|usd|eur|gbp|pkr|inr|aed|st|nd|rd|th|am|pm"
NUMBER = r"\+\d \(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4}|[2-9]\d{9}"


def scanned_phones(text: str) -> str:
    """Numbers of a text in the shapes that the given tables have.  A label or currency before one and a unit after it speak
    against it; they stay part of the match, so that only bare numbers match ``NUMBER`` in full."""
    before = rf"(?:(?:(?i){_LABELS})[:#.() ]*|[$€£¥₹₨฿₦₽] ?)?"
    return rf"regexp_extract_all({text}, '(?:^|[^A-Za-z0-9_.+,/-])({before}(?:{NUMBER})(?: *(?i:{_UNITS})\b)?)(?:$|[^A-Za-z0-9_-])', 1)"


PHONE_CTE = rf"""
phone_rows AS (
  SELECT host AS domain, page_id, row_number() OVER (PARTITION BY page_id ORDER BY src, n) - 1 AS ord, display, regexp_replace(display, '[^0-9]', '', 'g') AS digits, src < 2 AS trusted FROM (
    SELECT host, page_id, 0 AS src, 1 AS n, concat('+15552', lpad(CAST(page_id AS VARCHAR), 5, '0'), '7') AS display FROM pages_rich WHERE page_id % 5 = 0
    UNION ALL SELECT host, page_id, 1, 1, concat('+92 21 3', lpad(CAST(page_id AS VARCHAR), 5, '0'), '79') FROM pages_rich WHERE page_id % 7 = 0
    UNION ALL SELECT host, page_id, 2, n, display FROM (
      SELECT host, page_id, unnest(xs) AS display, generate_subscripts(xs, 1) AS n FROM (SELECT host, page_id, {scanned_phones('text')} AS xs FROM vis))
    WHERE regexp_full_match(display, '{NUMBER}')))
"""


def deduped_phones(name: str, source: str, by: str, order: str) -> str:
    """CTE ``name`` with the best form per number of ``by``; numbers that are the tail of a longer one are compared pair by pair."""
    same = " AND ".join(f"m.{c.strip()} = b.{c.strip()}" for c in by.split(","))
    return f"""{name}_best AS (SELECT {by}, digits, ltrim(digits, '0') AS core, arg_min(display, ROW(-(CASE WHEN trusted THEN 100 ELSE 0 END + length(digits) + CASE WHEN display LIKE '+%' THEN 5 ELSE 0 END), {order})) AS display
   FROM {source} GROUP BY {by}, digits),
{name} AS (SELECT {by}, digits, display FROM {name}_best b WHERE NOT EXISTS (SELECT 1 FROM {name}_best m WHERE {same} AND length(m.digits) > length(b.digits) AND length(b.core) >= 8
   AND b.core IN (m.core, substr(m.core, 2), substr(m.core, 3), substr(m.core, 4), substr(m.core, 5))))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in (RICH_CTE, *ctes)) + "\n"
