"""Mail campaigns: recipient lists, rendering, planning, delivery summaries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.html import html_to_text
from ..functions.text import blank_to_null, round_half_up, trim_ws

__all__ = [
    "is_mailbox", "parse_recipients", "merge_recipients", "Template", "render_messages", "available_tags",
    "unresolved_tags", "plan_sends", "apply_cancel", "dry_run", "campaign_summary", "failure_breakdown",
    "activity_log", "campaign_readiness", "form_eta", "server_eta", "format_duration", "retained_campaigns",
    "clamp_throttle",
]


def is_mailbox(x: Column) -> Column:
    return F.coalesce(trim_ws(x).rlike(fv.MAILBOX), F.lit(False))


# ------------------------------------------------------------------------------ recipient lists
def _with_layout(lists: DataFrame) -> DataFrame:
    """Header, body, address column and column names of each list, inside its row."""
    any_mail = lambda r: F.exists(r, is_mailbox)
    first = F.coalesce(F.get("rows", F.lit(0)), F.array().cast("array<string>"))
    later = F.exists(F.slice("rows", F.lit(2), F.size("rows")), any_mail)
    has_header = F.when(F.size("rows") < 2, ~any_mail(first)).otherwise(~any_mail(first) & later)
    d = lists.withColumn("has_header", has_header)
    d = d.withColumn("header", F.when(F.col("has_header"), F.transform(first, trim_ws)).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("body", F.when(F.col("has_header"), F.slice("rows", F.lit(2), F.size("rows"))).otherwise(F.col("rows")))
    named = F.transform("header", lambda h, i: F.when(h.rlike(r"(?i)\Ae-?mail(?:\s*address)?\z"), i))
    like = F.transform("header", lambda h, i: F.when(h.rlike("(?i)mail"), i))
    first_of = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), F.lit(0))
    widest = F.coalesce(F.array_max(F.transform("body", lambda r: F.size(r))), F.lit(0))
    d = d.withColumn("by_name", F.coalesce(first_of(named), first_of(like))).withColumn("width", widest)
    columns = F.when(F.col("width") > 0, F.sequence(F.lit(0), F.col("width") - 1)).otherwise(F.array().cast("array<int>"))
    hits = F.transform(columns, lambda c: F.struct(
        F.size(F.filter("body", lambda r: is_mailbox(F.get(r, c)))).alias("hits"), (-c).alias("neg")))
    d = d.withColumn("best", F.array_max(hits))
    index = F.coalesce("by_name", F.when(F.col("best.hits") > 0, -F.col("best.neg")), F.lit(-1))
    d = d.withColumn("email_index", index)
    generated = F.transform(
        F.when(F.col("width") > 0, F.sequence(F.lit(1), F.col("width"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.when(i - 1 == F.col("email_index"), "email").otherwise(F.concat(F.lit("column_"), i)),
    )
    return d.select(
        "list_id", "body", "email_index", F.when(F.size("header") > 0, F.col("header")).otherwise(generated).alias("columns")
    )


def _fields() -> Column:
    """Non-empty cells next to the address as array of struct(k, v); the last of a name counts."""
    pairs = F.zip_with(F.col("columns"), F.slice("cells", F.lit(1), F.size("columns")), lambda k, v: F.struct(k.alias("k"), trim_ws(v).alias("v")))
    indexed = F.transform(pairs, lambda p, i: F.struct(i.alias("i"), p["k"].alias("k"), p["v"].alias("v")))
    kept = F.filter(indexed, lambda p: (p["i"] != F.col("email_index")) & (F.coalesce(p["k"], F.lit("")) != "") & (F.coalesce(p["v"], F.lit("")) != ""))
    return F.transform(kept, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))


def parse_recipients(lists: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(recipients, invalid, stats)`` of lists ``(list_id, rows)``.

    The first row of an address counts; de-duplication is a keyed aggregate, so one huge or very
    repetitive list does not gather on a task.
    """
    return _recipients(_with_layout(lists).select("list_id", "columns", "email_index", F.posexplode("body").alias("pos", "cells")))


def parse_records(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for lists as rows ``(list_id, pos, cells)``, of which one list may fill many tasks.

    Header, width and address column of a list are aggregates over its rows; only they are joined back.
    """
    mail = F.exists("cells", is_mailbox)
    top = F.col("pos") == 0
    seen = rows.groupBy("list_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(top & mail).alias("first_mail"), F.bool_or(~top & mail).alias("later_mail"),
        F.min_by("cells", F.when(top, F.col("pos"))).alias("first"), F.max(F.when(~top, F.size("cells"))).alias("later_width"),
    )
    none = F.array().cast("array<string>")
    has_header = ~F.col("first_mail") & ((F.col("n") < 2) | F.col("later_mail"))
    seen = seen.withColumn("skip", has_header.cast("int")).withColumn("header", F.when(has_header, F.transform("first", trim_ws)).otherwise(none))
    seen = seen.withColumn("width", F.greatest(F.coalesce("later_width", F.lit(0)), F.when(has_header, 0).otherwise(F.size("first"))))
    hits = rows.select("list_id", F.posexplode("cells").alias("c", "cell")).filter(is_mailbox(F.col("cell"))).groupBy("list_id", "c").count()
    hits = hits.groupBy("list_id").agg(F.max_by("c", F.struct("count", -F.col("c"))).alias("most"))
    named = F.transform("header", lambda h, i: F.when(h.rlike(r"(?i)\Ae-?mail(?:\s*address)?\z"), i))
    like = F.transform("header", lambda h, i: F.when(h.rlike("(?i)mail"), i))
    first_of = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), F.lit(0))
    layout = seen.join(hits, "list_id", "left").withColumn("email_index", F.coalesce(first_of(named), first_of(like), "most", F.lit(-1)))
    generated = F.transform(
        F.when(F.col("width") > 0, F.sequence(F.lit(1), F.col("width"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.when(i - 1 == F.col("email_index"), "email").otherwise(F.concat(F.lit("column_"), i)),
    )
    layout = layout.select("list_id", "skip", "email_index", F.when(F.size("header") > 0, F.col("header")).otherwise(generated).alias("columns"))
    body = rows.join(layout, "list_id").withColumn("pos", F.col("pos") - F.col("skip")).filter("pos >= 0")
    return _recipients(body.select("list_id", "columns", "email_index", "pos", "cells"))


def _recipients(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    email = F.when(F.col("email_index") >= 0, F.lower(trim_ws(F.get("cells", F.col("email_index")))))
    rows = rows.select(
        "list_id", (F.col("pos") + 1).alias("row"), F.coalesce(email, F.lit("")).alias("email"),
        F.array_join("cells", ", ").substr(1, 80).alias("value"), _fields().alias("fields"),
    )
    rows = rows.withColumn("ok", is_mailbox(F.col("email")))
    recipients = rows.filter("ok").groupBy("list_id", "email").agg(
        F.min("row").alias("row"), F.min_by("fields", "row").alias("fields"), F.count("*").alias("copies")
    )
    invalid = rows.filter(~F.col("ok")).select("list_id", "row", "value")
    stats = recipients.groupBy("list_id").agg(
        F.count("*").alias("recipients"), F.sum(F.col("copies") - 1).alias("duplicates")
    ).join(invalid.groupBy("list_id").agg(F.count("*").alias("invalid")), "list_id", "full")
    stats = stats.select("list_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("recipients", "duplicates", "invalid")])
    return recipients.select("list_id", "row", "email", "fields"), invalid, stats


def merge_recipients(recipients: DataFrame) -> DataFrame:
    """One row per address over all lists: the first list and row count."""
    return recipients.groupBy("email").agg(F.min_by(F.struct("list_id", "row", "fields"), F.struct("list_id", "row")).alias("r")).select(
        "email", "r.list_id", "r.row", "r.fields"
    )


# ------------------------------------------------------------------------------ templates
@dataclass(frozen=True)
class Template:
    subject: str
    html: str
    unsubscribe_url: str | None = None

    def tags(self) -> list[str]:
        """Distinct merge tags in first-seen order."""
        seen = [m.group(1).strip().lower() for t in (self.subject, self.html) for m in re.finditer(fv.MERGE_TAG, t or "")]
        return list(dict.fromkeys(seen))


def _normal(name: str) -> str:
    return re.sub(r"[\s-]+", "_", name.strip().lower())


def _escape_html(x: Column) -> Column:
    for ch, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(ch), F.lit(ref))
    return x


def _rendered(text: str, unsubscribe_url: str | None, escape: bool) -> Column:
    """The template as one concatenation of literals and field look-ups."""

    def value(tag: str, fallback: str | None) -> Column:
        key = tag.strip().lower()
        if key == "email":
            found = F.col("email")
        elif key in ("unsubscribe_url", "unsubscribe"):
            found = F.lit(unsubscribe_url).cast("string")
        else:
            found = F.get(F.filter("_lookup", lambda f: f["k"] == _normal(key)), F.lit(0))["v"]
        return F.coalesce(found, F.lit(fallback or ""))

    parts, at = [], 0
    for m in re.finditer(fv.MERGE_TAG, text):
        parts.append(F.lit(text[at:m.start()]))
        v = value(m.group(1), m.group(2))
        parts.append(_escape_html(v) if escape else v)
        at = m.end()
    parts.append(F.lit(text[at:]))
    return F.concat(*parts)


def render_messages(recipients: DataFrame, template: Template) -> DataFrame:
    """Subject, HTML body (values escaped) and plain-text part for every recipient."""
    lookup = F.transform("fields", lambda f: F.struct(F.regexp_replace(F.lower(trim_ws(f["k"])), r"[\s-]+", "_").alias("k"), f["v"].alias("v")))
    r = recipients.withColumn("_lookup", lookup)
    r = r.withColumn("subject", _rendered(template.subject, template.unsubscribe_url, False))
    r = r.withColumn("html", _rendered(template.html, template.unsubscribe_url, True))
    return r.withColumn("text", html_to_text(F.col("html"))).drop("_lookup")


def available_tags(recipients: DataFrame) -> DataFrame:
    """Column names that any recipient offers, and ``email``."""
    return recipients.select(F.explode("fields.k").alias("tag")).select(F.lower("tag").alias("tag")).union(
        recipients.sparkSession.range(1).select(F.lit("email").alias("tag"))
    ).distinct()


def unresolved_tags(template: Template, recipients: DataFrame) -> DataFrame:
    """Template tags that no column can fill (a fallback does not exempt a tag)."""
    known = available_tags(recipients).select(F.regexp_replace("tag", r"[\s-]+", "_").alias("name"))
    wanted = [(i, t, re.sub(r"[\s-]+", "_", t)) for i, t in enumerate(template.tags()) if t not in ("unsubscribe", "unsubscribe_url")]
    tags = recipients.sparkSession.createDataFrame(wanted, "ord int, tag string, name string")
    return tags.join(known, "name", "left_anti").select("ord", "tag")


# ------------------------------------------------------------------------------ planning
def clamp_throttle(delay: float = 2, batch: float = 50, pause: float = 60) -> tuple[float, int, float]:
    return min(max(delay, 0.5), 600), int(min(max(batch, 0), 1000)), min(max(pause, 0), 3600)


#: Recipients of a campaign that are ranked by one task.
_RANK_ROWS = 4096


def plan_sends(
    recipients: DataFrame, delay: float = 2, batch: int = 50, pause: float = 60, order: str = "row", max_recipients: int | None = None,
) -> DataFrame:
    """Start second of every message of ``(campaign_id, email, <order>)``; ``order`` is an integer column.

    Ranks are taken in two steps, so that a campaign of any size is spread over tasks: ranges of ``order`` are counted and
    their counts added up, then rows are numbered within their range.  With ``max_recipients`` larger campaigns are left out.
    """
    delay, batch, pause = clamp_throttle(delay, batch, pause)
    r = recipients
    if max_recipients is not None:
        size = r.groupBy("campaign_id").agg(F.count("*").alias("n"))
        r = r.join(size.filter(F.col("n") <= max_recipients).select("campaign_id"), "campaign_id", "left_semi")
    r = r.withColumn("__range", F.floor(F.col(order) / _RANK_ROWS))
    counts = r.groupBy("campaign_id", "__range").agg(F.count("*").alias("__n"))
    before = W.partitionBy("campaign_id").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("campaign_id", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    within = F.row_number().over(W.partitionBy("campaign_id", "__range").orderBy(order, "email")) - 1
    r = r.withColumn("__k", within).join(offsets, ["campaign_id", "__range"])
    r = r.withColumn("k", F.col("__k") + F.col("__offset")).drop("__k", "__offset", "__range")
    pauses = F.floor(F.col("k") / batch) if batch > 0 else F.lit(0)
    return r.withColumn("planned_offset_s", ((F.col("k") - pauses) * F.lit(float(delay)) + pauses * F.lit(float(pause))).cast("double"))


def apply_cancel(plan: DataFrame, cancel_at: float) -> DataFrame:
    late = F.col("planned_offset_s") >= cancel_at
    return plan.withColumn("state", F.when(late, "skipped").otherwise("sent")).withColumn(
        "message", F.when(late, fv.CANCELLED_NOTE)
    )


def dry_run(recipients: DataFrame, template: Template, delay: float = 2, batch: int = 50, pause: float = 60) -> DataFrame:
    """Every message rendered and logged as sent, nothing delivered."""
    plan = plan_sends(recipients, delay, batch, pause)
    return render_messages(plan, template).withColumn("state", F.lit("sent")).withColumn("message", F.lit(fv.DRY_RUN_NOTE))


def campaign_readiness(drafts: DataFrame) -> DataFrame:
    """Adds ``blockers`` (what keeps a draft from being sent) and ``route_errors``."""
    blank = lambda c: trim_ws(F.coalesce(c, F.lit(""))) == ""
    b, r = fv.BLOCKERS, fv.ROUTE_CHECKS
    live = ~F.coalesce("dry_run", F.lit(False))
    blockers = F.array(
        F.when(F.col("recipients") == 0, b["recipients"]), F.when(blank("subject"), b["subject"]), F.when(blank("html"), b["body"]),
        F.when(blank("from_email"), b["from"]), F.when(live & blank("host"), b["host"]),
    )
    limit = F.concat(
        F.lit(f"This tool sends up to {fv.MAX_RECIPIENTS} recipients per campaign (got "), F.col("recipients"), F.lit(").")
    )
    errors = F.array(
        F.when(F.col("recipients") > fv.MAX_RECIPIENTS, limit),
        F.when(~is_mailbox(F.col("from_email")), r["from"]),
        F.when(~blank("reply_to") & ~is_mailbox(F.col("reply_to")), r["reply_to"]),
        F.when(live & ~F.coalesce(F.col("port").between(1, 65535), F.lit(False)), r["port"]),
    )
    return drafts.withColumn("blockers", F.array_compact(blockers)).withColumn("route_errors", F.array_compact(errors))


# ------------------------------------------------------------------------------ deliveries
def summary_columns() -> list[Column]:
    is_ = lambda s: F.count_if(F.col("state") == s)
    return [is_("sent").alias("sent"), is_("failed").alias("failed"), is_("skipped").alias("skipped")]


def with_percentages(counts: DataFrame) -> DataFrame:
    attempted = F.col("sent") + F.col("failed")
    share = lambda c: F.when(attempted > 0, round_half_up(F.col(c) * 100 / attempted)).otherwise(0).cast("bigint")
    return counts.withColumn("delivered_pct", share("sent")).withColumn("failed_pct", share("failed"))


def campaign_summary(deliveries: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Counts and percentages per campaign; ``campaigns`` holds ``campaign_id, total``.

    States are counted map-side first: a campaign with a third of all deliveries sends one
    partial row per task.
    """
    c = deliveries.groupBy("campaign_id").agg(*summary_columns())
    j = campaigns.select("campaign_id", "total").join(c, "campaign_id", "left").na.fill(0, ["sent", "failed", "skipped"])
    j = j.withColumn("pending", F.greatest(F.lit(0), F.col("total") - F.col("sent") - F.col("failed") - F.col("skipped")).cast("bigint"))
    return with_percentages(j)


def _reason(code: Column, response: Column, message: Column) -> Column:
    line = F.coalesce(F.regexp_extract(response, r"\A([^\r\n]*)", 1), F.lit(""))
    out = None
    for name, text in fv.DELIVERY_REASONS.items():
        value = trim_ws(F.concat(F.lit(text), line)) if name in ("EAUTH", "EENVELOPE", "EMESSAGE") else F.lit(text)
        out = F.when(code == name, value) if out is None else out.when(code == name, value)
    smtp = code.rlike(r"\A\d{3}\z") & (line != "")
    return out.when(smtp, F.concat(F.lit("SMTP "), code, F.lit(": "), line)).otherwise(
        F.coalesce(blank_to_null(message), F.lit(fv.UNKNOWN_DELIVERY_ERROR))
    )


def failure_breakdown(deliveries: DataFrame) -> DataFrame:
    """Failed deliveries per campaign, code and readable reason."""
    f = deliveries.filter(F.col("state") == "failed")
    f = f.withColumn("reason", _reason(F.col("code"), F.col("response"), F.col("message")))
    return f.groupBy("campaign_id", "code", "reason").agg(F.count("*").alias("failures"))


def activity_log(deliveries: DataFrame, rows: int = fv.ACTIVITY_LOG_ROWS) -> DataFrame:
    """The newest deliveries per campaign; the rank limit is applied before the exchange too."""
    w = W.partitionBy("campaign_id").orderBy(F.col("at").desc(), F.col("delivery_id").desc())
    return deliveries.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= rows)


def server_eta(pending: Column, done: Column, delay: float, batch: int, pause: float) -> Column:
    pauses = F.floor(pending / batch) if batch > 0 else F.lit(0)
    seconds = pending * (max(delay, 0) + 1) + pauses * max(pause, 0)
    return F.when(done, 0).otherwise(round_half_up(seconds)).cast("bigint")


def form_eta(n: Column, delay: float, batch: int, pause: float) -> Column:
    pauses = F.greatest(F.lit(0), F.floor(n / batch) - F.when(n % batch == 0, 1).otherwise(0)) if batch > 0 else F.lit(0)
    return F.when(n > 0, (n - 1) * F.lit(float(delay)) + pauses * F.lit(float(pause)) + n).otherwise(0.0).cast("double")


def format_duration(seconds: Column) -> Column:
    minutes, rest = F.floor(seconds / 60), round_half_up(seconds % 60)
    return (
        F.when(seconds < 60, F.concat(round_half_up(seconds), F.lit("s")))
        .when((minutes < 60) & (rest > 0), F.concat(minutes, F.lit("m "), rest, F.lit("s")))
        .when(minutes < 60, F.concat(minutes, F.lit("m")))
        .otherwise(F.concat(F.floor(minutes / 60), F.lit("h "), minutes % 60, F.lit("m")))
    )


def retained_campaigns(status: DataFrame, now: Column, keep: int = fv.RETAINED_CAMPAIGNS) -> DataFrame:
    """Campaigns still listed: unfinished ones, and those finished within the hour, the newest
    ``keep`` in all.  Only finished campaigns are ever dropped."""
    oldest = now - F.make_dt_interval(secs=F.lit(fv.RETENTION_SECONDS))
    live = status.filter(F.col("finished_at").isNull() | (F.col("finished_at") >= oldest))
    running = live.filter(F.col("finished_at").isNull())
    room = max(0, keep - running.count())  # one number
    finished = live.filter(F.col("finished_at").isNotNull()).orderBy(F.col("finished_at").desc(), "campaign_id").limit(room)
    return running.unionByName(finished)
