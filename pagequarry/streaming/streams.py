"""Structured Streaming forms of the jobs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.campaigns import summary_columns, with_percentages
from ..operators.emails import extract_emails
from ..operators.page_facts import extract_social
from ..operators.phones import extract_phones

__all__ = ["stream_extract", "stream_contacts_distinct", "register_contacts", "read_contacts", "stream_campaign_status", "stream_retention", "run_available"]


def stream_extract(pages: DataFrame) -> DataFrame:
    """Contact facts of a stream of pages: ``domain, page_id, type, value, platform``.

    The batch operators are per-page projections, so they run unchanged and need no state.
    """
    fact = lambda df, kind, value, platform: df.select(
        "domain", "page_id", F.lit(kind).alias("type"), F.col(value).alias("value"), platform.alias("platform")
    )
    return (
        fact(extract_emails(pages), "email", "email", F.lit(""))
        .unionByName(fact(extract_phones(pages), "phone", "display", F.lit("")))
        .unionByName(fact(extract_social(pages), "social", "url", F.col("platform")))
    )


def stream_contacts_distinct(facts: DataFrame, at: str = "at", delay: str = "1 hour") -> DataFrame:
    """Each (domain, type, value) once; the watermark bounds the state."""
    return facts.withWatermark(at, delay).dropDuplicatesWithinWatermark(["domain", "type", "value"])


CONTACT_KEY = ["domain", "type", "value"]
_REGISTER = "domain string, type string, value string, source bigint, batch bigint, bucket int"


def register_contacts(facts: DataFrame, folder: str, checkpoint: str, buckets: int = 64) -> None:
    """Add the contacts of a stream of facts that ``folder`` does not have yet, each (domain, type, value) once for ever.

    Every micro-batch is one keyed merge: its distinct contacts, without those written before, become a folder of their own,
    dealt by a hash of the key.  The join also goes by that hash, so only files of hashes that the batch has are read.  A
    repeated batch overwrites its own folder and does not look at it, so it writes the same rows again.  Nothing is kept in
    memory between batches and no contact comes back after a delay.  Streams with checkpoints of their own may share a
    register, one after the other.  Contacts with null parts are compared like others.
    """
    spark = facts.sparkSession
    source = zlib.crc32(checkpoint.encode())
    bucket = F.pmod(F.xxhash64(*CONTACT_KEY), F.lit(buckets)).cast("int")
    spark.createDataFrame([], "domain string, type string, value string").write.mode("overwrite").parquet(f"{folder}/source=0/batch=-1/bucket=0")

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.select(*CONTACT_KEY).distinct().withColumn("bucket", bucket).alias("new")
        before = (F.col("source") != source) | (F.col("batch") < number)
        known = batch.sparkSession.read.schema(_REGISTER).option("basePath", folder).parquet(folder).where(before).alias("known")
        same = F.col("new.bucket") == F.col("known.bucket")
        for c in CONTACT_KEY:
            same &= F.col(f"new.{c}").eqNullSafe(F.col(f"known.{c}"))
        fresh = new.join(known, same, "left_anti").repartition("bucket")
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/source={source}/batch={number}")

    facts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()


def read_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """All registered contacts: ``domain, type, value, batch``."""
    return spark.read.schema(_REGISTER).option("basePath", folder).parquet(folder).drop("source", "bucket")


def stream_campaign_status(deliveries: DataFrame) -> DataFrame:
    """Running counts and percentages per campaign (update or complete mode; one row of state each)."""
    return with_percentages(deliveries.groupBy("campaign_id").agg(*summary_columns()))


def stream_retention(status: DataFrame) -> DataFrame:
    """Status stream ``(campaign_id, state, finished_at)`` to events ``listed`` and ``dropped``.

    A finished campaign is dropped one hour after it finished, by a processing-time timer; run it
    with a processing-time trigger (a run that stops when no data is left never sees the timer).
    """
    hour_ms = fv.RETENTION_SECONDS * 1000

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (campaign,) = key
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"campaign_id": [campaign], "event": ["dropped"]})
            return
        fresh = not state.exists
        done = any(b["finished_at"].notna().any() for b in batches)
        state.update((bool(done or (not fresh and state.get[0])),))
        if done:
            state.setTimeoutDuration(hour_ms)
        if fresh:
            yield pd.DataFrame({"campaign_id": [campaign], "event": ["listed"]})

    return status.groupBy("campaign_id").applyInPandasWithState(
        step, "campaign_id bigint, event string", "finished boolean", "append", "ProcessingTimeTimeout"
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is available and stop: append to files, or write the final state."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", path).outputMode("append").start().awaitTermination()
        return

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer.outputMode("complete").foreachBatch(replace).start().awaitTermination()
