"""Tables derived from the given ones: pages with contact markup, entry pages, mail lists.

The given pages carry no contact markup, so blocks chosen by ``page_id`` are added before
``</body>``.  The SQL expressions below run unchanged in Spark and in the checking engine; only
list building differs between the two dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagequarry.sources.readers import spread

HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
PATHLESS = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
NEAR = 40  # a page links to the pages of its own site among the next NEAR page ids
ENTRY_LINKS = 20


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _when(cond: str, *parts: str) -> str:
    return f"CASE WHEN {cond} THEN concat({', '.join(parts)}) ELSE '' END"


N = _s("page_id")
N1 = _s("page_id + 1")
PAD5 = f"lpad({N}, 5, '0')"

BLOCKS = [
    _when("page_id % 3 = 0", "'<p><a href=\"mailto:sales@'", "host", "'?subject=x\">Mail us</a></p>'"),
    _when("page_id % 4 = 1", "'<p>Write to info [at] '", "substr(host, 1, length(host) - 4)", "' [dot] '", "right(host, 3)", "' for more</p>'"),
    _when("page_id % 5 = 0", "'<p><a href=\"tel:+15552'", PAD5, "'7\">Ring</a></p>'"),
    _when(
        "page_id % 5 = 2", "'<p>Call 555-'", _s("200 + page_id % 700"), "'-'", _s("1000 + page_id % 9000"),
        "'</p><p>Order id 8893214455</p><p>Weight 1200 kg</p>'",
    ),
    _when(
        "page_id % 6 = 0", "'<p><a href=\"https://www.linkedin.com/company/c'", _s("page_id % 7"),
        "'/?trk=1\">L</a> <a href=\"https://x.com/share\">S</a></p>'",
    ),
    _when(
        "page_id % 7 = 0",
        "'<script type=\"application/ld+json\">{\"@context\":\"https://schema.org\",\"@type\":\"Organization\",\"name\":\"Firm '", N,
        "'\",\"telephone\":\"+92 21 3'", PAD5, "'79\",\"logo\":{\"url\":\"https://'", "host",
        "'/logo.png\"},\"sameAs\":[\"https://facebook.com/firm'", N,
        "'\"],\"address\":{\"@type\":\"PostalAddress\",\"streetAddress\":\"'", N1,
        "' Mall Road\",\"addressLocality\":\"Lahore\",\"addressRegion\":\"Punjab\",\"postalCode\":\"54000\",\"addressCountry\":\"PK\"}}</script>'",
        "'<script type=\"application/ld+json\">{\"@type\":\"WebSite\",\"address\":{\"@type\":\"PostalAddress\",\"addressCountry\":\"PK\"}}</script>'",
        "'<script type=\"application/ld+json\">{broken</script>'",
    ),
    _when(
        "page_id % 7 = 1",
        "'<script type=\"application/ld+json\">{\"@graph\":[{\"@type\":\"Product\",\"name\":\"Part '", N, "'\",\"sku\":\"S'", N,
        "'\",\"brand\":{\"name\":\"Brand '", _s("page_id % 5"), "'\"},\"offers\":[{\"price\":'", N,
        "'.5,\"priceCurrency\":\"USD\",\"availability\":\"https://schema.org/InStock\"}]},{\"@type\":\"Product\",\"sku\":\"nameless\"},'",
        "'{\"@type\":[\"JobPosting\",\"Thing\"],\"title\":\"Job '", N, "'\",\"hiringOrganization\":{\"name\":\"Firm '", N,
        "'\"},\"jobLocation\":{\"address\":{\"@type\":\"PostalAddress\",\"streetAddress\":\"'", N1,
        "' Canal Road\",\"addressLocality\":\"Lahore\",\"addressCountry\":\"PK\"}},\"employmentType\":\"FULL_TIME\",\"datePosted\":\"2024-01-15\"}]}</script>'",
    ),
    _when("page_id % 8 = 0", "'<link rel=\"stylesheet\" href=\"/wp-content/themes/t.css\"><script src=\"/js/jquery-3.6.0.min.js\"></script>'"),
    _when(
        "page_id % 9 = 0",
        "'<form id=\"contact-form\" action=\"/send\"><input type=\"text\" name=\"name\"><input type=\"email\" name=\"mail\"><textarea name=\"message\"></textarea></form>'",
    ),
    _when("page_id % 9 = 4", "'<form class=\"newsletter\"><input type=\"email\" name=\"email\"><input type=\"submit\"></form>'"),
    _when(
        "page_id % 10 = 0", "'<meta property=\"og:title\" content=\"OG '", N, "'\"><meta name=\"twitter:card\" content=\"summary\"><link rel=\"canonical\" href=\"https://'",
        "host", "'/c/'", N, "'\"><meta name=\"description\" content=\" About page '", N, "' \"><img src=\"/a.png\" alt=\"A\"><img src=\"/b.png\">'",
    ),
    _when("page_id % 11 = 0", "'<div class=\"footer-address\">'", N1, "' Main Street, Suite 5<br>Springfield, IL 62704</div>'"),
    "'<p><a href=\"https://other.example.org/x?n=1\">Partner</a></p>'",
]

BLOCK = "concat(" + ",\n  ".join(BLOCKS) + ")"
RICH_HTML = (
    "CASE WHEN html LIKE '%</body>%' THEN replace(html, '</body>', concat(block, near_html, '</body>'))"
    " ELSE concat(html, block, near_html) END"
)
SERVER = "CASE WHEN page_id % 8 = 0 THEN 'nginx/1.2' ELSE 'none' END"
NEAR_LINK = "concat('<p><a href=\"', near_url, '\">Related ', CAST(near_id AS STRING), '</a></p>')"
ENTRY_HEAD = "concat('<html><head><title>Home | ', host, '</title></head><body><h1>', host, '</h1>')"
ENTRY_TAIL = "'</body></html>'"

# ------------------------------------------------------------------ the same in the checking engine
RICH_CTE = f"""
base AS (SELECT page_id, url, html, {HOST} AS host, {PATHLESS} AS root FROM pages),
near AS (
  SELECT a.page_id, string_agg({NEAR_LINK.replace('near_url', 'b.url').replace('near_id', 'b.page_id')}, '' ORDER BY b.page_id) AS near_html
  FROM base a JOIN base b ON a.host = b.host AND b.page_id > a.page_id AND b.page_id <= a.page_id + {NEAR}
  GROUP BY a.page_id),
pages_rich AS (
  SELECT page_id, url, host, {RICH_HTML} AS html, {SERVER} AS server
  FROM (SELECT b.*, {BLOCK.replace('page_id', 'b.page_id')} AS block, coalesce(near_html, '') AS near_html
        FROM base b LEFT JOIN near ON b.page_id = near.page_id)),
pages_site AS (
  SELECT page_id, url, host, html, server FROM pages_rich
  UNION ALL
  SELECT -1 - min(page_id), concat('https://', host, '/'), host,
         concat({ENTRY_HEAD}, string_agg({NEAR_LINK.replace('near_url', 'url').replace('near_id', 'page_id')}, '' ORDER BY page_id), {ENTRY_TAIL}), 'none'
  FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn FROM base)
  WHERE rn <= {ENTRY_LINKS} GROUP BY host)
"""


TEXT_KEYS = {"pages": "page_id", "documents": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", "html", F.expr(HOST).alias("host"), F.expr(PATHLESS).alias("root")
    )


def _with_headers(df: DataFrame) -> DataFrame:
    return df.select(
        "page_id", "url", "html", F.lit("text/html; charset=utf-8").alias("content_type"),
        F.create_map(F.lit("server"), F.col("server")).alias("headers"),
    )


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _base(spark, sf_dir)
    keys = base.select("host", F.col("page_id").alias("near_id"), F.col("url").alias("near_url"))
    slots = base.select(
        "page_id", "host", F.explode(F.sequence(F.col("page_id") + 1, F.col("page_id") + NEAR)).alias("near_id")
    )
    near = (
        slots.join(keys, ["host", "near_id"])
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("near_id", "near_url"))).alias("near"))
        .select("page_id", F.array_join(F.transform("near", lambda x: F.concat(
            F.lit('<p><a href="'), x["near_url"], F.lit('">Related '), x["near_id"].cast("string"), F.lit("</a></p>"))), "").alias("near_html"))
    )
    return (
        base.join(near, "page_id", "left")
        .withColumn("near_html", F.coalesce("near_html", F.lit("")))
        .withColumn("block", F.expr(BLOCK))
        .select("page_id", "url", "host", F.expr(RICH_HTML).alias("html"), F.expr(SERVER).alias("server"))
    )


def pages_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every given page with contact markup added: page_id, url, html, content_type, headers."""
    return _with_headers(_rich(spark, sf_dir))


def pages_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages_rich`` plus one entry page per host that links to pages of the host."""
    base = _base(spark, sf_dir).select("page_id", "url", "host")
    first = base.withColumn("rn", F.row_number().over(W.partitionBy("host").orderBy("page_id"))).filter(
        F.col("rn") <= ENTRY_LINKS
    )
    entry = (
        first.groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("links"), F.min("page_id").alias("lo"))
        .select(
            (F.lit(-1) - F.col("lo")).alias("page_id"),
            F.concat(F.lit("https://"), F.col("host"), F.lit("/")).alias("url"),
            "host",
            F.concat(
                F.expr(ENTRY_HEAD),
                F.array_join(F.transform("links", lambda x: F.concat(
                    F.lit('<p><a href="'), x["url"], F.lit('">Related '), x["page_id"].cast("string"), F.lit("</a></p>"))), ""),
                F.lit("</body></html>"),
            ).alias("html"),
            F.lit("none").alias("server"),
        )
    )
    return _with_headers(_rich(spark, sf_dir).unionByName(entry))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seed url per host of the given pages."""
    return _base(spark, sf_dir).select(F.concat(F.lit("https://"), F.col("host"), F.lit("/")).alias("url")).distinct()
