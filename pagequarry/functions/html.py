"""Column builders over raw HTML: elements, attributes, visible text, body text.

Pages are never turned into a tree.  Each extractor takes the slice of markup it needs with a
linear pattern (possessive loops, no nested back-tracking); only the innermost-container step
(``operators.addresses.page_containers``) needs a stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import decode_entities, extract, extract_all, trim_ws

# the inside of a start tag: quoted values may hold '>'
_IN_TAG = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
ANY_TAG = r"</?[a-zA-Z](?:" + _IN_TAG + r">|[^>]*>)|<[!?][^>]*>"
_COMMENT = r"<!--.*?(?:-->|\z)"

TOKEN = (
    r"(?s)<!--.*?(?:-->|\z)"
    r"|<(?i:script|style)(?=[\s/>])" + _IN_TAG + r">.*?(?:</(?i:script|style)\s*>|\z)"
    r"|" + ANY_TAG + r"|[^<]+|<"
)


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", " ")


def markup(html: Column) -> Column:
    """HTML without comments and without the bodies of script and style elements."""
    return F.regexp_replace(
        html, r"(?is)(<(script|style)(?=[\s/>])[^>]*>).*?(?:</\2\s*>|\z)|" + _COMMENT, "$1"
    )


def start_tags(m: Column, name: str) -> Column:
    """Array of the start tags ``<name …>`` of comment-free markup, in page order."""
    return extract_all(m, r"(?i)<(?:" + name + r")(?=[\s/>])" + _IN_TAG + ">")


def raw_attr(tag: Column, name: str) -> Column:
    """Value of the first attribute ``name`` of a start tag as written ('' if absent)."""
    pattern = (
        r"(?is)\A<[a-z][^\s/>]*+(?:[\s/]++(?!" + name + r"\s*+=)[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']++))?+)*+"
        r"[\s/]++" + name + r"\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>\"']++)"
    )
    return F.regexp_replace(extract(tag, pattern, 1), r"(?s)\A([\"'])(.*)\1\z", "$2")


def attr(tag: Column, name: str) -> Column:
    """``raw_attr`` with entities decoded."""
    return decode_entities(raw_attr(tag, name))


def has_attr(tag: Column, name: str) -> Column:
    return tag.rlike(r"(?i)[\s/]" + name + r"(?=[\s=/>])")


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)" + ANY_TAG, "")


def element_texts(m: Column, name: str) -> Column:
    """Array of the text of each ``<name>…</name>`` (up to the next closing tag of that name)."""
    inner = extract_all(m, r"(?is)<(?:" + name + r")(?=[\s/>])" + _IN_TAG + r">(.*?)(?:</(?:" + name + r")\s*>|\z)", 1)
    return F.transform(inner, lambda x: decode_entities(strip_tags(x)))


def body_of(html: Column) -> Column:
    """Everything after the body start tag; without one, after the head; else the page."""
    body = r"(?is)\A.*?<body(?=[\s/>])[^>]*>"
    head = r"(?is)\A.*?</head\s*>"
    return (
        F.when(html.rlike(r"(?i)<body[\s/>]"), F.regexp_replace(html, body, ""))
        .when(html.rlike(r"(?i)</head\s*>"), F.regexp_replace(html, head, ""))
        .otherwise(F.regexp_replace(html, r"(?is)<title[^>]*>.*?</title\s*>", ""))
    )


def body_text(html: Column) -> Column:
    """Text of the body and all its descendants; script and style bodies count as text."""
    plain = F.regexp_replace(
        body_of(html),
        r"(?is)<(script|style)(?=[\s/>])[^>]*>(.*?)(?:</\1\s*>|\z)|" + _COMMENT + "|" + ANY_TAG,
        "$2",
    )
    return decode_entities(plain)


def normalize_whitespace(x: Column) -> Column:
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[\t\x0B\f\r " + fv.SP_CHARS.replace(r"\s", "") + r"]+", " ")
    x = F.regexp_replace(x, r" *\n[ \n]*", "\n")
    return trim_ws(x)


def marked(html: Column) -> Column:
    """Comments and noise elements dropped; line breaks after <br>, <hr> and block ends."""
    x = strip_comments(html)
    x = F.regexp_replace(x, r"(?i)<(?:br|hr)" + fv.SP + r"*/?>", "\n")
    x = F.regexp_replace(x, r"(?i)</(?:" + "|".join(fv.BLOCK_TAGS) + ")" + fv.SP + "*>", "$0\n")
    noise = "|".join(t for t in fv.NOISE_TAGS if t != "option")
    x = F.regexp_replace(x, r"(?is)<(" + noise + r")(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\z)", "")
    return F.regexp_replace(x, r"(?i)<option(?=[\s/>])[^>]*>[^<]*(?:</option\s*>)?", "")


def text_of_marked(x: Column) -> Column:
    return normalize_whitespace(decode_entities(strip_tags(x)))


def visible_text(html: Column) -> Column:
    """Rendered text of the page: no code, comments or markup, one line per block."""
    return text_of_marked(body_of(marked(html)))


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), trim_ws), lambda x: x != "")


def html_to_text(html: Column) -> Column:
    """Plain-text part of a mail message."""
    sp = fv.SP
    for pattern, value in [
        (r"(?is)<style.*?</style>", " "),
        (r"(?is)<script.*?</script>", " "),
        (r"(?i)<br" + sp + "*/?>", "\n"),
        (r"(?i)</(?:p|div|li|h[1-6]|tr)>", "\n"),
        (r"(?i)<li[^>]*>", "• "),
        (r"<[^>]+>", ""),
        (r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&"), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"),
        (r"(?i)&quot;", '"'), (r"&#39;", "'"),
        (r"[\t\x0B\f\r " + fv.SP_CHARS.replace(r"\s", "") + "]+", " "),
        (r"\n{3,}", "\n\n"),
    ]:
        html = F.regexp_replace(html, pattern, value)
    return trim_ws(html)


def script_bodies(html: Column) -> Column:
    """Bodies of the JSON-LD script elements (empty array where the page has none)."""
    bodies = extract_all(
        html,
        r"(?is)<script(?=[\s/])(?=[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"'\s>/])[^>]*>(.*?)(?:</script\s*>|\z)", 1,
    )
    return F.when(F.contains(F.lower(html), F.lit("ld+json")), bodies).otherwise(F.array().cast("array<string>"))
