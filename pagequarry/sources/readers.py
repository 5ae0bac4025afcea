"""Sources: stored pages, url lists, recipient lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import extract_all, trim_ws
from ..functions.urls import is_valid_url
from ..session import materialize

__all__ = ["read_pages", "spread", "url_list", "read_list_files", "read_list_records", "split_lists", "read_lookup"]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages that are HTML; other content types are left out."""
    return html_pages(spark.read.parquet(path))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table of long texts over all cores when it has fewer files than cores.

    A small file is one row group and so one task, however heavy the text scan is.  A large
    table has far more files than cores and is left as it is: no shuffle of its texts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def html_pages(pages: DataFrame) -> DataFrame:
    if "content_type" not in pages.columns:
        return pages
    return pages.filter(F.contains("content_type", F.lit("text/html")))


def url_list(lists: DataFrame, finder: bool = False, limit: int | None = None) -> DataFrame:
    """Pasted URL lists ``(list_id, text)`` to ``(list_id, ord, url, valid, taken)``.

    One URL per line (the finder also splits at commas and drops repeats).  ``taken`` marks the valid ones, with ``limit``
    the first so many of each list.
    """
    parts = F.transform(F.split("text", r"[\n,]+" if finder else r"\n"), trim_ws)
    urls = F.filter(parts, lambda u: u != "")
    urls = F.array_distinct(urls) if finder else urls
    flagged = F.transform(urls, lambda u: F.struct(u.alias("url"), is_valid_url(u).alias("valid")))
    rows = lists.select("list_id", flagged.alias("f"))
    if limit is None:
        return rows.select("list_id", F.posexplode("f").alias("ord", "x")).select("list_id", "ord", "x.url", "x.valid", F.col("x.valid").alias("taken"))
    accepted = F.transform(F.filter(F.transform("f", lambda x, i: F.struct(i.alias("i"), x["valid"].alias("ok"))), lambda x: x["ok"]), lambda x: x["i"])
    rows = rows.withColumn("within", F.slice(accepted, 1, limit))
    rows = rows.select("list_id", "within", F.posexplode("f").alias("ord", "x"))
    return rows.select("list_id", "ord", "x.url", "x.valid", F.array_contains("within", F.col("ord")).alias("taken"))


def read_list_files(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Recipient list files, one row per file: ``(list_id, text, too_large)``.

    With ``limit``, files of more bytes come back with ``too_large`` and no text.
    """
    found = spark.read.format("text").option("wholetext", True).load(path)
    large = F.lit(False) if limit is None else F.col("_metadata.file_size") > limit
    return found.select(
        F.col("_metadata.file_name").alias("list_id"), F.when(~large, F.col("value")).alias("text"), large.alias("too_large")
    )


def _numbered(df: DataFrame, count: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``count`` over the rows of a list before each row.

    Sums within a block of a file, plus those of the blocks before it: only one number of each block meets in a task.
    """
    inside = Window.partitionBy("list_id", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy("list_id", "block").agg(F.sum(count).alias("__n"))
    earlier = Window.partitionBy("list_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("list_id", "block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    summed = df.withColumn("__inside", F.coalesce(F.sum(count).over(inside), F.lit(0))).join(blocks, ["list_id", "block"])
    return summed.withColumn(name, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def read_list_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of recipient list files, ``(list_id, pos, cells)``; one file is read by as many tasks as it has blocks.

    A line begins a record if an even number of quotes lies before it: a sum over the lines of its block and over the blocks
    before.  Lines of a record are brought together by its number.  The separator of a list is the most frequent of comma,
    tab and semicolon in its first line; a list without any second cell is a loose one, whose tokens are its rows.  Blank
    rows are left out.  ``list_id`` is the partition column of that name, or else the file's name.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    named = F.col("list_id").cast("string") if "list_id" in lines.columns else F.col("_metadata.file_name")
    lines = lines.select(
        named.alias("list_id"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block"),
        F.monotonically_increasing_id().alias("line"), F.col("value"),
    )
    lines = materialize(lines, "list-lines")  # the numbers of lines stay as they are
    quoted = _numbered(lines.withColumn("quotes", F.regexp_count("value", F.lit('"'))), F.col("quotes"), "quotes_before")
    begins = quoted.withColumn("begins", (F.col("quotes_before") % 2 == 0).cast("int"))
    counted = _numbered(begins, F.col("begins"), "started").withColumn("record", F.col("started") + F.col("begins"))
    records = counted.groupBy("list_id", "record").agg(
        F.min(F.struct("block", "line")).alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"]), "\n").alias("text"),
    ).select("list_id", "at.block", "at.line", "text")
    first = F.regexp_extract(F.min_by("value", F.struct("block", "line")), r"\A([^\n]*)", 1)
    heads = lines.filter(trim_ws(F.col("value")) != "").groupBy("list_id").agg(first.alias("first"))
    heads = heads.select("list_id", *[F.regexp_count("first", F.lit(ch)).alias(n) for n, ch in (("commas", ","), ("tabs", r"\t"), ("semis", ";"))])
    sep = (
        F.when((F.col("commas") >= F.col("tabs")) & (F.col("commas") >= F.col("semis")), ",")
        .when(F.col("tabs") >= F.col("semis"), "\t").otherwise(";")
    )
    text = F.col("text")
    cells = F.when(sep == ",", _cells(text, ",")).when(sep == "\t", _cells(text, "\t")).otherwise(_cells(text, ";"))
    rows = records.join(heads, "list_id").select("list_id", "block", "line", "text", cells.alias("cells"))
    rows = rows.filter(F.exists("cells", lambda c: trim_ws(c) != ""))
    wide = rows.groupBy("list_id").agg((F.max(F.size("cells")) > 1).alias("table"))
    tokens = F.transform(F.filter(F.split("text", "[,;" + fv.SP_CHARS + "]+"), lambda x: x != ""), lambda x: F.array(x))
    rows = rows.join(wide, "list_id").withColumn("rows", F.when(F.col("table"), F.array("cells")).otherwise(tokens))
    rows = _numbered(rows.select("list_id", "block", "line", "rows"), F.size("rows"), "first")
    rows = rows.select("list_id", "first", F.posexplode("rows").alias("i", "cells"))
    return rows.select("list_id", (F.col("first") + F.col("i")).cast("long").alias("pos"), "cells")


def _cells(record: Column, sep: str) -> Column:
    """Cells of one record: quoted cells may hold the separator, quotes are doubled inside."""
    ch = {"\t": r"\t"}.get(sep, sep)
    raw = extract_all(F.concat(F.lit(sep), record), ch + r"((?:[^\"" + ch + r"]++|\"[^\"]*+(?:\"|\z))*+)", 1)

    def plain(x: Column) -> Column:
        inner = F.regexp_replace(x, r"\"((?:[^\"]++|\"\")*+)(?:\"|\z)", "$1")
        return F.when(F.contains(x, F.lit('"')), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(F.replace(x, F.lit("\r"), F.lit("")))

    return F.transform(raw, plain)


def split_lists(lists: DataFrame) -> DataFrame:
    """List texts ``(list_id, text)`` to their cells: ``(list_id, rows ARRAY<ARRAY<STRING>>)``.

    The separator is the most frequent of comma, tab and semicolon in the first line.  A text
    without any second cell is a loose list: every token is an address.
    """
    t = lists.select("list_id", trim_ws(F.col("text")).alias("text")).filter(F.col("text") != "")
    first = F.regexp_extract("text", r"\A([^\n]*)", 1)
    count = lambda ch: F.regexp_count(first, F.lit(ch))
    t = t.withColumn("commas", count(",")).withColumn("tabs", count(r"\t")).withColumn("semis", count(";"))
    sep = (
        F.when((F.col("commas") >= F.col("tabs")) & (F.col("commas") >= F.col("semis")), ",")
        .when(F.col("tabs") >= F.col("semis"), "\t").otherwise(";")
    )
    records = extract_all(F.col("text"), r"(?:[^\"\n]++|\"[^\"]*+(?:\"|\z))++")
    t = t.select("list_id", "text", sep.alias("sep"), records.alias("records"))
    rows = F.when(F.col("sep") == ",", F.transform("records", lambda r: _cells(r, ",")))
    rows = rows.when(F.col("sep") == "\t", F.transform("records", lambda r: _cells(r, "\t"))).otherwise(
        F.transform("records", lambda r: _cells(r, ";")))
    t = t.withColumn("rows", F.filter(rows, lambda r: F.exists(r, lambda c: trim_ws(c) != "")))
    tokens = F.filter(F.split("text", "[,;" + fv.SP_CHARS + "]+"), lambda x: x != "")
    loose = F.transform(tokens, lambda x: F.array(x))
    return t.select("list_id", F.when(F.exists("rows", lambda r: F.size(r) > 1), F.col("rows")).otherwise(loose).alias("rows"))


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A recorded look-up table (mail exchangers, replies, robots texts, fetch logs) with a fixed schema."""
    return spark.read.schema(schema).parquet(path)
