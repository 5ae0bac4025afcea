"""Per-page facts: tokens, text, metadata, SEO, social profiles, technologies, keywords, category.

Every operator here is a projection of ``pages`` (no shuffle); results are either one row per
page or the page's array exploded.  ``pages`` needs ``page_id, url, html``; ``domain`` is taken
from the table when present (a site walk sets it) and from the URL otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.html import (
    attr, raw_attr, body_text, element_texts, markup, script_bodies, start_tags, visible_text as visible_text_of, lines_of, TOKEN,
)
from ..functions.text import (
    array_of, blank_to_null, contains_any, decode_entities, each, extract, extract_all, let, literal_map, squeeze, trim_ws,
)
from ..functions.urls import URL_STEPS, is_same_site, path_of, resolve_links, site_key, url_struct

__all__ = [
    "with_domain", "page_tokens", "visible_text", "visible_lines", "extract_metadata", "extract_seo",
    "extract_social", "detect_tech", "match_keywords", "match_keyword_table", "detect_business_name", "has_contact_form",
    "classify_category", "robots_warnings", "resolve_fetch_log",
]


def with_domain(pages: DataFrame) -> DataFrame:
    return pages if "domain" in pages.columns else pages.withColumn("domain", site_key(F.col("url")))


# ------------------------------------------------------------------------------ tokens and text
def page_tokens(pages: DataFrame) -> DataFrame:
    """One row per token: start and end tags, text, raw script / style elements, comments."""
    raw = with_domain(pages).select("domain", "page_id", F.posexplode(extract_all(F.col("html"), TOKEN)).alias("pos", "raw"))
    t = F.col("raw")
    name = F.lower(extract(t, r"\A</?([a-zA-Z][^\s/>]*)", 1))
    kind = (
        F.when(t.startswith("<!--"), "comment")
        .when(t.rlike(r"\A</[a-zA-Z]"), "end")
        .when(t.rlike(r"(?i)\A<(?:script|style)[\s/>]"), "raw")
        .when(t.rlike(r"\A<[a-zA-Z]"), "start")
        .when(t.rlike(r"\A<[!?]"), "declaration")
        .otherwise("text")
    )
    pair = r"(?s)([^\s/>=\"']++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>\"']++))?"
    inside = F.regexp_replace(extract(t, r"(?s)\A<[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", 0), r"\A<[^\s/>]+|/?>\z", "")
    attrs = F.transform(
        extract_all(inside, pair),
        lambda a: F.struct(
            F.lower(extract(a, pair, 1)).alias("k"),
            decode_entities(F.regexp_replace(extract(a, pair, 2), r"(?s)\A([\"'])(.*)\1\z", "$2")).alias("v"),
        ),
    )
    return raw.withColumn("kind", kind).select(
        "domain", "page_id", "pos", "kind",
        F.when(F.col("kind").isin("start", "end", "raw"), name).alias("tag"),
        F.when(F.col("kind").isin("start", "raw"), attrs).alias("attrs"),
        F.when(F.col("kind") == "text", decode_entities(t))
        .when(F.col("kind") == "raw", F.regexp_replace(t, r"(?is)\A<[^>]*>|</(?:script|style)\s*>\z", "")).alias("text"),
    )


def visible_text(pages: DataFrame) -> DataFrame:
    """Rendered text of each page, block boundaries as new lines."""
    return with_domain(pages).select("domain", "page_id", visible_text_of(F.col("html")).alias("text"))


def visible_lines(pages: DataFrame) -> DataFrame:
    """One row per non-empty line of the rendered text."""
    return (
        visible_text(pages)
        .select("domain", "page_id", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
    )


# ------------------------------------------------------------------------------ metadata and SEO
def _first(values: Column) -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def _meta(metas: Column, key: str, value: str) -> Column:
    """Content of the meta tags whose attribute ``key`` equals ``value``, in page order."""
    return F.transform(F.filter(metas, lambda t: raw_attr(t, key) == value), lambda t: attr(t, "content"))


def _titles(m: Column) -> Column:
    return F.transform(element_texts(m, "title"), trim_ws)


def extract_metadata(pages: DataFrame) -> DataFrame:
    """Title (else the last og:title) and first non-empty description."""
    p = with_domain(pages).select("domain", "page_id", markup(F.col("html")).alias("m"))
    p = p.select("domain", "page_id", _first(_titles(F.col("m"))).alias("title"), start_tags(F.col("m"), "meta").alias("metas"))
    described = F.filter(
        "metas",
        lambda t: (F.lower(raw_attr(t, "name")) == "description") | (F.lower(raw_attr(t, "property")) == "og:description"),
    )
    description = F.get(F.filter(F.transform(described, lambda t: trim_ws(attr(t, "content"))), lambda v: v != ""), F.lit(0))
    og = F.try_element_at(_meta(F.col("metas"), "property", "og:title"), F.lit(-1))
    return p.select(
        "domain", "page_id",
        F.coalesce(blank_to_null(F.col("title")), trim_ws(og), F.lit("")).alias("title"),
        F.coalesce(description, F.lit("")).alias("description"),
    )


def _tag_map(metas: Column, key: str, prefix: str) -> Column:
    """Map of meta tags whose ``key`` starts with ``prefix``; the last of a name wins."""
    pairs = F.filter(
        F.transform(metas, lambda t: F.struct(raw_attr(t, key).alias("k"), attr(t, "content").alias("v"))),
        lambda e: F.startswith(e["k"], F.lit(prefix)) & (e["v"] != ""),
    )

    def last_wins(es: Column) -> Column:
        kept = F.filter(
            es, lambda e, i: ~F.exists(F.slice(es, i + F.lit(2), F.size(es)), lambda later: later["k"] == e["k"])
        )
        return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"].alias("k"), trim_ws(e["v"]).alias("v"))))

    return let(pairs, last_wins)


def link_targets(pages_m: DataFrame) -> DataFrame:
    """Adds ``hrefs``: trimmed href of every anchor that is not a fragment, mail, phone or script link."""
    hrefs = F.transform(start_tags(F.col("m"), "a"), lambda t: trim_ws(attr(t, "href")))
    return pages_m.withColumn("hrefs", F.filter(hrefs, lambda h: (h != "") & ~h.rlike(fv.SKIP_HREF)))


def extract_seo(pages: DataFrame, max_headings: int | None = None) -> DataFrame:
    """Nineteen on-page facts per page; links are judged against the page's ``domain``.

    ``max_headings`` keeps the first so many headings of each level.
    """
    p = with_domain(pages).select("domain", "page_id", "url", "html", markup(F.col("html")).alias("m"))
    p = link_targets(p).select(
        "domain", "page_id", "url", "m", "hrefs",
        start_tags(F.col("m"), "meta").alias("metas"),
        start_tags(F.col("m"), "link").alias("link_tags"),
        start_tags(F.col("m"), "img").alias("imgs"),
        trim_ws(squeeze(body_text(F.col("html")))).alias("body"),
    )
    p = p.withColumn("base", url_struct(F.col("url")))
    hosts = F.transform(resolve_links(F.col("base"), F.col("hrefs")), lambda s: s["host"])
    p = p.withColumn("hosts", F.filter(hosts, lambda h: h.isNotNull()))

    def headings(name: str) -> Column:
        texts = F.transform(element_texts(F.col("m"), name), lambda x: squeeze(trim_ws(x)))
        texts = F.filter(texts, lambda x: x != "")
        return texts if max_headings is None else F.slice(texts, 1, max_headings)

    metas = F.col("metas")
    canonical = F.transform(F.filter("link_tags", lambda t: raw_attr(t, "rel") == "canonical"), lambda t: attr(t, "href"))
    internal = F.size(F.filter("hosts", lambda h: is_same_site(h, F.col("domain"))))
    p = p.select(
        "domain", "page_id",
        _first(_titles(F.col("m"))).alias("title"),
        trim_ws(_first(_meta(metas, "name", "description"))).alias("meta_description"),
        trim_ws(_first(_meta(metas, "name", "keywords"))).alias("meta_keywords"),
        trim_ws(_first(canonical)).alias("canonical"),
        trim_ws(_first(_meta(metas, "name", "robots"))).alias("robots"),
        F.exists("metas", lambda t: raw_attr(t, "name") == "viewport").alias("viewport"),
        trim_ws(_first(F.transform(start_tags(F.col("m"), "html"), lambda t: raw_attr(t, "lang")))).alias("lang"),
        headings("h1").alias("h1"), headings("h2").alias("h2"), headings("h3").alias("h3"),
        _tag_map(metas, "property", "og:").alias("og_tags"),
        _tag_map(metas, "name", "twitter:").alias("twitter_tags"),
        F.size("imgs").alias("image_count"),
        F.size(F.filter("imgs", lambda t: trim_ws(raw_attr(t, "alt")) == "")).alias("images_missing_alt"),
        F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", " "))).alias("word_count"),
        internal.alias("internal_links"),
        (F.size("hosts") - internal).alias("external_links"),
    )
    return p.withColumn("title_length", F.length("title")).withColumn("meta_description_length", F.length("meta_description"))


# ------------------------------------------------------------------------------ social profiles
def _absolute_profile(raw: Column) -> Column:
    return F.when(raw.startswith("http"), raw).otherwise(F.concat(F.lit("https://"), F.ltrim(raw, F.lit("/"))))


def _profile(s: Column) -> Column:
    """``scheme://host/path`` of a profile link; NULL when the path or the link is too short."""
    path = F.rtrim(s["path"], F.lit("/"))
    clean = F.concat(s["scheme"], F.lit("://"), s["host"], path)
    return F.when((F.length(path) >= 2) & (F.length(clean) > 15), clean)


def extract_social(pages: DataFrame) -> DataFrame:
    """Distinct (platform, url) per page: matching hrefs as a whole, and matches in the markup."""
    p = with_domain(pages).select("domain", "page_id", "html", F.lower("html").alias("lo"), markup(F.col("html")).alias("m"))
    hrefs = F.transform(start_tags(F.col("m"), "a"), lambda t: trim_ws(attr(t, "href")))
    p = p.withColumn("hrefs", F.filter(hrefs, lambda h: F.contains(F.lower(h), F.lit(".com/"))))

    def found(platform: str, pattern: str) -> Column:
        rx = "(?i)" + pattern
        raw = F.concat(F.filter("hrefs", lambda h: h.rlike(rx)), extract_all(F.col("html"), rx))
        mark = F.lit(fv.SOCIAL_GATES[platform])
        # a link may be written with character references, which only its decoded form shows
        gate = F.contains(F.col("lo"), mark) | F.exists("hrefs", lambda h: F.contains(F.lower(h), mark))
        return F.transform(F.when(gate, raw), lambda u: F.struct(F.lit(platform).alias("platform"), u.alias("url")))

    none = F.array().cast("array<struct<platform:string,url:string>>")
    p = p.select("domain", "page_id", F.concat(*[F.coalesce(found(k, v), none) for k, v in fv.SOCIAL_PATTERNS.items()]).alias("raw"))
    cleaned = each(F.transform("raw", lambda r: r["url"]), _absolute_profile, *URL_STEPS, _profile)
    pairs = F.zip_with("raw", cleaned, lambda r, u: F.struct(r["platform"].alias("platform"), u.alias("url")))
    kept = F.array_distinct(F.filter(pairs, lambda s: s["url"].isNotNull()))
    return p.select("domain", "page_id", F.explode(kept).alias("s")).select("domain", "page_id", "s.platform", "s.url")


# ------------------------------------------------------------------------------ technologies
def _literal_choices(pattern: str) -> list[str] | None:
    """The literals of a plain case-insensitive alternation, or None when it needs a regex."""
    if not pattern.startswith("(?i)"):
        return None
    body = re.sub(r"\\([./(])", lambda m: {".": "\x00", "/": "/", "(": "\x01"}[m.group(1)], pattern[4:])
    if re.search(r"[\\\[\](){}*+?^$.]", body):
        return None
    return [w.replace("\x00", ".").replace("\x01", "(").lower() for w in body.split("|")]


def _tech_array(html: Column, lowered: Column, headers: Column | None) -> Column:
    found = []
    for name, category, patterns, rules in fv.TECH_SIGNATURES:
        test = F.lit(False)
        for pattern in patterns:
            words = _literal_choices(pattern)
            test = test | (contains_any(lowered, words) if words else html.rlike(pattern))
        if headers is not None:
            for key, value in rules:
                seen = F.try_element_at(headers, F.lit(key))
                test = test | F.coalesce(seen.rlike(value) if value else seen.isNotNull(), F.lit(False))
        found.append(F.when(test, F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"))))
    return F.filter(F.array(*found), lambda t: t.isNotNull())


def detect_tech(pages: DataFrame) -> DataFrame:
    """(name, category, ord) of every signature found in a page's markup or response headers."""
    p = with_domain(pages)
    headers = F.col("headers") if "headers" in p.columns else None
    p = p.withColumn("lo", F.lower("html"))
    return p.select("domain", "page_id", F.posexplode(_tech_array(F.col("html"), F.col("lo"), headers)).alias("ord", "t")).select(
        "domain", "page_id", "ord", "t.name", "t.category"
    )


# ------------------------------------------------------------------------------ keywords
def clean_keywords(keywords: list[str], cap: int | None = None) -> list[str]:
    """Trimmed, non-empty, distinct; the first ``cap`` where that is given."""
    return list(dict.fromkeys(k.strip() for k in keywords if k.strip()))[:cap]


def match_keywords(pages: DataFrame, keywords: list[str], text_column: str | None = None) -> DataFrame:
    """Count and first sample of each keyword in the body text (or in ``text_column`` as given)."""
    words = clean_keywords(keywords)
    p = pages if text_column else with_domain(pages)
    keys = [k for k in ("domain", "page_id") if k in p.columns] if not text_column else [c for c in p.columns if c != text_column]
    text = F.col(text_column) if text_column else body_text(F.col("html"))
    p = p.select(*keys, squeeze(text).alias("t")).withColumn("lo", F.lower("t"))

    def hit(word: str) -> Column:
        low = word.lower()
        n = ((F.length("lo") - F.length(F.replace(F.col("lo"), F.lit(low), F.lit("")))) / F.lit(len(low))).cast("bigint")
        at = F.instr(F.col("lo"), F.lit(low))
        start = F.greatest(at - 41, F.lit(0))
        stop = F.least(F.length("t"), at + F.lit(len(low) + 39))
        sample = F.concat(
            F.when(start > 0, "…").otherwise(""),
            trim_ws(F.col("t").substr(start + 1, stop - start)),
            F.when(stop < F.length("t"), "…").otherwise(""),
        )
        return F.when(F.contains(F.col("lo"), F.lit(low)), F.struct(F.lit(word).alias("keyword"), n.alias("count"), sample.alias("sample")))

    hits = F.filter(F.array(*[hit(w) for w in words]), lambda h: h.isNotNull())
    return p.select(*keys, F.explode(hits).alias("h")).select(*keys, "h.keyword", "h.count", "h.sample")


#: Characters of keywords in one automaton; more keywords take more than one pass.
KEYWORD_BLOCK = 4_000_000
#: Hits that a task holds at once (a text with more is a part of its own).
KEYWORD_HITS = 20_000


def _scanner(words: dict[str, list[str]]):
    """Rows of texts ``t`` with their lower case ``lo`` as rows of keyword hits, by one automaton of all words."""

    def as_rows(others: pd.DataFrame, row: list[int], found: list[tuple]) -> pd.DataFrame:
        hits = pd.DataFrame(found, columns=["keyword", "count", "cut", "before", "after"])
        return pd.concat([others.iloc[row].reset_index(drop=True), hits], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for low in words:
            automaton.add_word(low, low)
        automaton.make_automaton()
        for rows in batches:
            row, found, others = [], [], rows.drop(columns=["t", "lo"])
            for n, (t, lo) in enumerate(zip(rows["t"], rows["lo"])):
                if len(found) >= KEYWORD_HITS:
                    yield as_rows(others, row, found)
                    row, found = [], []
                seen: dict[str, list[int]] = {}  # first place, end of the last occurrence counted, count
                for last, low in automaton.iter(lo or ""):
                    begin = last + 1 - len(low)
                    hit = seen.setdefault(low, [begin, begin, 0])
                    if begin >= hit[1]:  # occurrences of a word do not overlap
                        hit[1], hit[2] = last + 1, hit[2] + 1
                for low, (at, _, count) in seen.items():
                    start, stop = max(at - 40, 0), min(len(t), at + len(low) + 40)
                    for word in words[low]:
                        row.append(n)
                        found.append((word, count, t[start:stop], start > 0, stop < len(t)))
            yield as_rows(others, row, found)

    return run


def match_keyword_table(pages: DataFrame, keywords: DataFrame, text_column: str | None = None, block: int = KEYWORD_BLOCK) -> DataFrame:
    """``match_keywords`` for a table of keywords (column ``keyword``) of any size: the same rows.

    Keywords are dealt into blocks of about ``block`` characters by a hash; a block is one automaton, and the texts are read once
    for each block, however many words it has.  Nulls and blanks are no keywords; null texts have no hits.
    """
    words = keywords.select(trim_ws(F.col("keyword")).alias("keyword")).where("keyword <> ''").distinct().withColumn("low", F.lower("keyword"))
    size = words.agg(F.sum(F.length("low"))).first()[0] or 0
    p = pages if text_column else with_domain(pages)
    keys = [k for k in ("domain", "page_id") if k in p.columns] if not text_column else [c for c in p.columns if c != text_column]
    text = F.col(text_column) if text_column else body_text(F.col("html"))
    p = p.select(*keys, squeeze(text).alias("t")).where("t is not null").withColumn("lo", F.lower("t"))
    fields = T.StructType([p.schema[k] for k in keys])
    for name, kind in (("keyword", "string"), ("count", "long"), ("cut", "string"), ("before", "boolean"), ("after", "boolean")):
        fields = fields.add(name, kind)
    blocks = max(1, -(-size // block))
    passes = []
    for number in range(blocks):  # of bounded size each
        held: dict[str, list[str]] = {}
        for r in words.where(F.pmod(F.xxhash64("low"), F.lit(blocks)) == number).collect():
            held.setdefault(r["low"], []).append(r["keyword"])
        passes.append(p.mapInPandas(_scanner(held), fields) if held else p.sparkSession.createDataFrame([], fields))
    hits = reduce(DataFrame.unionByName, passes)
    ellipsis = lambda flag: F.when(flag, "…").otherwise("")
    return hits.select(*keys, "keyword", "count", F.concat(ellipsis(F.col("before")), trim_ws(F.col("cut")), ellipsis(F.col("after"))).alias("sample"))


# ------------------------------------------------------------------------------ business profile
def _clean_name(x: Column) -> Column:
    x = F.regexp_replace(squeeze(x), r"(?i)\A(?:welcome\s+to|home)\s*[-|:–—]?\s*", "")
    return trim_ws(x).substr(1, 80)


def detect_business_name(pages: DataFrame) -> DataFrame:
    """Structured data, then site-name tags, then the title's stem, then the host's stem."""
    p = with_domain(pages).select("domain", "page_id", "html", markup(F.col("html")).alias("m"))
    p = p.select(
        "domain", "page_id", start_tags(F.col("m"), "meta").alias("metas"),
        _first(_titles(F.col("m"))).alias("title"), script_bodies(F.col("html")).alias("ld"),
    )
    named = F.filter(F.transform("ld", lambda s: extract(s, fv.BUSINESS_TYPE_NAME, 1)), lambda n: n != "")
    site_name = F.coalesce(
        blank_to_null(_first(_meta(F.col("metas"), "property", "og:site_name"))),
        blank_to_null(_first(_meta(F.col("metas"), "name", "application-name"))),
        F.lit(""),
    )
    separator = fv.SP + r"+[|\-–—·•:]" + fv.SP + "+"
    p = p.select(
        "domain", "page_id", "title", F.get(named, F.lit(0)).alias("ld_name"), site_name.alias("site_name"),
        trim_ws(F.get(F.split("title", separator), F.lit(0))).alias("stem"),
    )
    name = (
        F.when(F.col("ld_name").isNotNull(), _clean_name(F.col("ld_name")))
        .when(trim_ws(F.col("site_name")) != "", _clean_name(F.col("site_name")))
        .when(
            F.col("title") != "",
            F.when(F.length("stem").between(2, 60), _clean_name(F.col("stem"))).otherwise(_clean_name(F.col("title").substr(1, 60))),
        )
        .otherwise(F.translate(F.substring_index(F.regexp_replace("domain", r"\Awww\.", ""), ".", 1), "-_", "  "))
    )
    return p.select("domain", "page_id", name.alias("business_name"))


def _names_email(tags: Column) -> Column:
    def signature(t: Column) -> Column:
        return F.lower(F.concat_ws(" ", raw_attr(t, "type"), raw_attr(t, "name"), raw_attr(t, "id"), raw_attr(t, "placeholder")))

    return F.exists(tags, lambda t: contains_any(signature(t), ["email", "e-mail"]))


def has_contact_form(pages: DataFrame) -> DataFrame:
    """Whether the page has a form that can carry a message."""
    p = with_domain(pages).select("domain", "page_id", markup(F.col("html")).alias("m"))
    m = F.col("m")
    form = r"(?is)<form(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</form\s*>|\z)"

    def carries_message(f: Column) -> Column:
        tag = extract(f, r"(?is)\A<form(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", 0)
        named = F.lower(F.concat_ws(" ", raw_attr(tag, "id"), raw_attr(tag, "class"), raw_attr(tag, "action"), raw_attr(tag, "name")))
        inputs = start_tags(f, "input")
        return ~named.rlike(fv.NOT_A_CONTACT_FORM) & (
            f.rlike(r"(?i)<textarea[\s/>]") | ((F.size(inputs) >= 2) & _names_email(inputs))
        )

    in_form = F.exists(extract_all(m, form), carries_message)
    loose = m.rlike(r"(?i)<textarea[\s/>]") & _names_email(start_tags(m, "input"))
    gate = m.rlike(r"(?i)<(?:textarea|input)[\s/>]")
    return p.select("domain", "page_id", F.when(gate, in_form | loose).otherwise(False).alias("has_form"))


def classify_category(pages: DataFrame) -> DataFrame:
    """Sector label of a page: a declared schema type, else term scores; '—' when nothing scores."""
    p = with_domain(pages).select("domain", "page_id", "html", markup(F.col("html")).alias("m"))
    m = F.col("m")
    p = p.select(
        "domain", "page_id", start_tags(m, "meta").alias("metas"), _first(_titles(m)).alias("title"),
        element_texts(m, "h1|h2").alias("heads"), script_bodies(F.col("html")).alias("ld"),
        F.lower(visible_text_of(F.col("html"))).alias("body"),
    )
    table = literal_map(fv.SCHEMA_CATEGORY)
    typed = F.flatten(F.transform("ld", lambda s: extract_all(s, r'"@type"\s*:\s*"([A-Za-z]+)"', 1)))
    declared = F.get(F.filter(F.transform(typed, lambda t: F.try_element_at(table, F.lower(t))), lambda x: x.isNotNull()), F.lit(0))
    strong = F.lower(F.concat_ws(
        " ", "title", _first(_meta(F.col("metas"), "name", "description")), _first(_meta(F.col("metas"), "name", "keywords")),
        F.array_join("heads", " "),
    ))
    p = p.select("domain", "page_id", "body", declared.alias("declared"), strong.alias("strong"))

    scores = F.array(*[
        F.struct(
            F.aggregate(
                array_of(terms), F.lit(0),
                lambda acc, t: acc + F.when(F.contains(F.col("strong"), t), 3).when(F.contains(F.col("body"), t), 1).otherwise(0),
            ).alias("score"),
            F.lit(-i).alias("rank"), F.lit(label).alias("label"),
        )
        for i, (label, terms) in enumerate(fv.CATEGORY_RULES)
    ])
    best = F.array_max(scores)
    p = p.withColumn("best", best)
    return p.select(
        "domain", "page_id",
        F.coalesce("declared", F.when(F.col("best.score") >= 3, F.col("best.label")), F.lit(fv.NO_CATEGORY)).alias("category"),
    )


def looks_like_business_address(x: Column) -> Column:
    t = trim_ws(x)
    return (
        (F.length(t) >= 12) & ~t.rlike(r"\A(?:19|20)\d{2}(?![A-Za-z0-9_])")
        & (t.rlike(fv.BUSINESS_STREET) | t.rlike(fv.BUSINESS_POSTAL))
    )


def is_profile_page(url: Column) -> Column:
    return let(path_of(url), lambda p: contains_any(p, fv.PROFILE_HINTS))


def is_contact_page(url: Column, keywords: list[str]) -> Column:
    return let(path_of(url), lambda p: contains_any(p, fv.CONTACT_HINTS + [k for k in keywords if k]))


# ------------------------------------------------------------------------------ recorded fetches
def robots_warnings(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """A warning per site whose robots text disallows a rooted path."""
    warned = robots.groupBy("domain").agg(F.bool_or(F.contains("text", F.lit("Disallow: /"))).alias("restricted"))
    return sites.join(warned, "domain", "left").select(
        *[sites[c] for c in sites.columns],
        F.when(F.col("restricted"), F.concat(F.lit("robots.txt may restrict crawl on "), F.col("url"))).alias("warning"),
    )


def resolve_fetch_log(fetch_log: DataFrame, tries: int = fv.FETCH_TRIES) -> DataFrame:
    """Outcome per url of recorded attempts: the first 2xx, or 403 / 404 / 410, decides."""
    ok = F.col("status").between(200, 299)
    final = ok | F.col("status").isin(403, 404, 410)
    a = fetch_log.filter(F.col("attempt") <= tries).groupBy("url").agg(
        F.min_by("status", F.when(final, F.col("attempt"))).alias("status"),
        F.min(F.when(final, F.col("attempt"))).alias("decided_at"),
        F.max("attempt").alias("last_attempt"),
    )
    decided = F.col("decided_at").isNotNull()
    return a.select(
        "url",
        F.when(decided & F.col("status").between(200, 299), "fetched").otherwise("failed").alias("outcome"),
        F.when(decided, F.col("status")).alias("status"),
        F.coalesce("decided_at", "last_attempt").alias("attempts"),
    )
