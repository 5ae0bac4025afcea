"""Main text of web pages: element structure for what lies in or out of an article, a host suffix array for the rest.

1. A page is cut into blocks of three kinds: *article* (inside ``article``, else ``main``), *chrome* (menus, headers,
   footers, sidebars, notices, adverts, forms, comments) and *loose* (outside both; all of the body on a page without
   ``article`` and ``main``; paragraphs and inline elements of an article that only a class name calls chrome).
2. The tokens of all blocks that are not article text form the page's stream.  The suffixes of all streams of a host are
   dealt by their first token, so that each shard holds a whole range of the host's suffix array; it sorts its suffixes to
   a depth of ``min_run`` tokens and compares neighbours: equal neighbours from distinct pages are a repeated substring.
3. Tokens of loose blocks that a repeated substring covers are boilerplate and go; the unique runs stay, with the article
   blocks, in page order.

Only suffixes travel, a few tokens each, never pages; a host with most of the pages is spread over its first tokens.

Edge cases: null and empty pages have an empty text; pages without a host share the empty host; a page that is stored
twice does not make its own text a repetition; unclosed elements end with their parent; a head ends at the first tag that
does not belong there; media without an end tag hide nothing; quotes count only where a value begins; the time is in proportion
to the page for any markup; other columns are kept (columns
called ``text`` and ``n_chars`` are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

ARTICLE, CHROME, LOOSE = 0, 1, 2

#: Comments, declarations and tags; what the page's end cuts off is one of them, too, so that a scan never goes back.
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S)
#: Elements that hold no markup up to their end tag; without one, the first two go to the page's end, the others hold nothing.
_RAW = frozenset("script style title textarea iframe noscript noembed noframes template".split())
_RAW_TO_END = frozenset(("script", "style"))
#: Elements whose content is no text of the page, if they are closed.
_HIDDEN = frozenset("svg math object canvas audio video".split())
_OF_HEAD = frozenset("title meta link base script style noscript template".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements of the text itself: a class name alone does not make them chrome.
_TEXTUAL = _INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption td th dd dt".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME_ELEMENTS = frozenset("nav footer aside form menu dialog button select option fieldset".split())
_CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|banner|promo\w*|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|comments?|disqus|replies|"
    r"sidebar|menu|navbar|navigation|nav|breadcrumbs?|footer|masthead|share|sharing|social|related|recommended|widget|pagination|pager|toolbar)(?:$|[\s_-])", re.I,
)
_COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|reply|replies)(?:$|[\s_-])", re.I)
_NAME_ATTRIBUTES = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_CHROME_ROLES = re.compile(r"""\brole\s*+=\s*+["']?(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert)\b""", re.I)


def _kind_of(name: str, attributes: str, inside: int, root: str | None) -> int:
    """The kind of what an element holds that begins inside of an element of kind ``inside``."""
    if inside == CHROME:
        return CHROME
    if name in _CHROME_ELEMENTS or name == "header" and inside != ARTICLE:
        return CHROME
    names = ["".join(m) for m in _NAME_ATTRIBUTES.findall(attributes)] if "=" in attributes else ()
    if name in ("article", "main"):  # readers' comments are often articles of their own
        if any(_COMMENT_NAMES.search(n) for n in names):
            return CHROME
        return ARTICLE if name == root else inside
    if not names or name in ("body", "html"):
        return inside
    if _CHROME_ROLES.search(attributes):
        return CHROME
    if any(_CHROME_NAMES.search(n) for n in names):
        return CHROME if name not in _TEXTUAL or inside != ARTICLE else LOOSE  # whether it is repeated decides
    return inside


def _tags(page: str) -> list[tuple[str, str, str, str]]:
    """``(slash, name, attributes, text after it)`` of all tags, the first without a name; raw elements are left out with what
    they hold, and start tags of hidden elements without an end are left out alone."""
    tags, texts, at, endless = [("", "", "")], [[]], 0, set()
    open_hidden: dict[str, list[int]] = {}
    while found := _MARKUP.search(page, at):
        texts[-1].append(page[at:found.start()])
        at = found.end()
        if not found[2]:
            texts[-1].append(" ")
            continue
        slash, name, attributes = found[1], found[2].lower(), found[3]
        if name in _RAW:
            texts[-1].append(" ")
            if not slash and name not in endless:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in _RAW_TO_END:
                    at = len(page)
                else:
                    endless.add(name)
            continue
        if name in _HIDDEN:
            if not slash:
                open_hidden.setdefault(name, []).append(len(tags))
            elif open_hidden.get(name):
                open_hidden[name].pop()
        tags.append((slash, name, attributes))
        texts.append([])
    texts[-1].append(page[at:])
    for unclosed in open_hidden.values():
        for i in unclosed:
            tags[i] = "", "wbr", ""
            texts[i].insert(0, " ")
    return [(*tag, "".join(text)) for tag, text in zip(tags, texts)]


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """``(kind, text)`` of every non-empty block in page order; white space is single and character references are decoded.

    The time is in proportion to the page, whatever its markup.
    """
    if not page:
        return []
    tags = _tags(page)
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements with the kind of what they hold
    opened: Counter[str] = Counter()
    starts = {name for slash, name, _, _ in tags if not slash}
    root = next((name for name in ("article", "main") if name in starts), None)
    kind, piece, in_head = LOOSE, [tags[0][3]], False

    def flush():
        text = " ".join(entities.unescape("".join(piece)).split())
        piece.clear()
        if text and not in_head:
            out.append((kind, text))

    def pop() -> int:
        name, held = stack.pop()
        opened[name] -= 1
        return held

    for slash, name, attributes, text in tags[1:]:
        inside = stack[-1][1] if stack else LOOSE
        if name == "head" or in_head and name not in _OF_HEAD:  # a head ends at the first tag that does not belong there
            flush()
            in_head = name == "head" and not slash
            piece.append(text)
            if name == "head":
                continue
            piece.clear()
        holds = inside if slash else CHROME if name in _HIDDEN else _kind_of(name, attributes, inside, root)
        if name not in _INLINE or holds != inside:
            flush()
        if slash:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                if pop() != (stack[-1][1] if stack else LOOSE):
                    flush()
        elif name not in _VOID and not attributes.endswith("/"):
            if name in ("p", "li") and stack and stack[-1][0] == name:
                pop()  # a paragraph or list item ends where the next begins
                inside = stack[-1][1] if stack else LOOSE
                holds = _kind_of(name, attributes, inside, root)
            stack.append((name, holds))
            opened[name] += 1
        kind = stack[-1][1] if stack else LOOSE
        piece.append(text)
    flush()
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        found = [blocks_of(page) for page in rows.pop("__html")]
        yield rows.assign(
            __kinds=[[k for k, _ in b] for b in found], __texts=[[t for _, t in b] for b in found], __loose=[any(k == LOOSE for k, _ in b) for b in found],
        )


def _suffixes(min_run: int, shards: int):
    """Every position of a page's stream from which ``min_run`` tokens follow, with their hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parts = []
            for key, host, kinds, texts in zip(rows["__key"], rows["host"], rows["__kinds"], rows["__texts"]):
                tokens = [w for k, t in zip(kinds, texts) if k != ARTICLE for w in t.split()]
                if len(tokens) < min_run:
                    continue
                hashes = np.array([xxhash.xxh32_intdigest(w) for w in tokens], np.uint32).view(np.int32)
                n = len(tokens) - min_run + 1
                parts.append(pd.DataFrame({"key": key, "host": host, "shard": hashes[:n] % shards, "position": np.arange(n, dtype=np.int32)} | {f"t{i}": hashes[i:i + n] for i in range(min_run)}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return run


def repeated(group: pd.DataFrame, min_run: int) -> np.ndarray:
    """Which suffixes have a neighbour, in suffix order, that is equal to depth ``min_run`` and of another page."""
    columns = [group[f"t{i}"].to_numpy() for i in range(min_run)]
    order = np.lexsort([group["key"].to_numpy(), *columns[::-1]])
    if not len(order):
        return np.zeros(0, bool)
    same = np.ones(len(order) - 1, bool)
    for c in columns:
        same &= c[order][1:] == c[order][:-1]
    run = np.concatenate([[0], np.cumsum(~same)])
    keys = group["key"].to_numpy()[order]
    # a run of equal suffixes is sorted by page: it has several pages if its first and last differ
    first, last = np.searchsorted(run, run, "left"), np.searchsorted(run, run, "right") - 1
    out = np.zeros(len(order), bool)
    out[order] = keys[first] != keys[last]
    return out


def extract_text(pages: DataFrame, html: str = "html", url: str = "url", min_run: int = 6, shards: int = 64) -> DataFrame:
    """``pages`` without ``html``, with ``text string`` (empty if none) and ``n_chars long`` (its code points)."""
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    fed = pages.select(
        *(F.col(f"`{c}`") for c in kept), F.xxhash64(F.col(f"`{url}`"), F.col(f"`{html}`")).alias("__key"),
        F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")).alias("__host"),
        F.col(f"`{html}`").alias("__html"),
    )
    schema = T.StructType([*(f for f in fed.schema if f.name != "__html")])
    schema.add("__kinds", T.ArrayType(T.IntegerType())).add("__texts", T.ArrayType(T.StringType())).add("__loose", T.BooleanType())
    parsed = materialize(fed.mapInPandas(_parse, schema), "page-blocks")
    joined = lambda blocks: F.array_join(blocks, " ")
    of_kind = lambda k: F.filter("__texts", lambda t, i: F.get(F.col("__kinds"), i) == k)
    plain = parsed.where(~F.col("__loose")).select(*(f"`{c}`" for c in kept), joined(of_kind(ARTICLE)).alias("text"))

    numbers = ", ".join(f"t{i} int" for i in range(min_run))
    suffixes = parsed.select("__key", F.col("__host").alias("host"), "__kinds", "__texts").mapInPandas(
        _suffixes(min_run, shards), f"key long, host string, shard int, position int, {numbers}",
    )
    covered = suffixes.groupBy("host", "shard").applyInPandas(lambda g: g.loc[repeated(g, min_run), ["key", "position"]], "key long, position int")
    loose = parsed.where("__loose")
    # only pages with loose blocks need their repetitions
    found = covered.join(loose.select(F.col("__key").alias("key")).distinct(), "key", "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("position")).alias("__starts"))
    rest = loose.join(found, F.col("__key") == F.col("key"), "left")

    def unique_runs(kinds, texts, starts) -> str:
        covered_tokens = {p + i for p in (starts if starts is not None else ()) for i in range(min_run)}
        at, out = 0, []
        for k, t in zip(kinds, texts):
            if k == ARTICLE:
                out.append(t)
                continue
            words = t.split()
            if k == LOOSE:
                out.append(" ".join(w for i, w in enumerate(words, at) if i not in covered_tokens))
            at += len(words)
        return " ".join(t for t in out if t)

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [unique_runs(*x) for x in zip(rows.pop("__kinds"), rows.pop("__texts"), rows.pop("__starts"))]
            yield rows.assign(text=texts)

    out = T.StructType([*(f for f in fed.schema if f.name in kept), T.StructField("text", T.StringType())])
    cleaned = rest.select(*(f"`{c}`" for c in kept), "__kinds", "__texts", "__starts").mapInPandas(clean, out)
    return plain.unionByName(cleaned).withColumn("n_chars", F.length("text").cast("long"))
