from pyspark.sql import functions as F

from pagequarry.operators.campaigns import campaign_summary
from pagequarry.operators.emails import extract_emails
from pagequarry.session import shared_folder
from pagequarry.streaming import streams
from workload.derived import pages_site, table
from workload.queries_lists import deliveries


def test_campaign_status_equals_batch(spark, sf):
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = shared_folder(spark, "t")
    streams.run_available(streams.stream_campaign_status(deliveries(spark, sf, events)), out, shared_folder(spark, "c"), mode="complete")
    d = deliveries(spark, sf)
    want = campaign_summary(d, d.groupBy("campaign_id").agg(F.count("*").alias("total")))
    cols = ["campaign_id", "sent", "failed", "skipped", "delivered_pct", "failed_pct"]
    assert sorted(spark.read.parquet(out).select(cols).collect()) == sorted(want.select(cols).collect())


def test_contacts_once_across_batches(spark, sf):
    pages = shared_folder(spark, "p")
    pages_site(spark, sf).drop("headers").repartition(6).write.parquet(pages)
    schema = spark.read.parquet(pages).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(pages)
    facts = extract_emails(stream).select("domain", F.lit("email").alias("type"), F.col("email").alias("value"), F.current_timestamp().alias("at"))
    out = shared_folder(spark, "t")
    streams.run_available(streams.stream_contacts_distinct(facts).drop("at"), out, shared_folder(spark, "c"))
    got = [(r.domain, r.value) for r in spark.read.parquet(out).collect()]
    want = {(r.domain, r.email) for r in extract_emails(spark.read.parquet(pages)).collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_registered_contacts_never_come_again(spark, tmp_path):
    src, out, checkpoint = str(tmp_path / "facts"), str(tmp_path / "register"), str(tmp_path / "checkpoint")
    days = [
        [("a.org", "email", "x@a.org"), ("a.org", "email", "x@a.org"), ("b.org", "email", "x@a.org"), ("a.org", None, "y")],
        [("a.org", "email", "x@a.org"), ("a.org", None, "y"), ("a.org", "phone", "x@a.org")],
        [("b.org", "email", "x@a.org")],
    ]
    for day in days:  # one run a day, each with a micro-batch of its own
        spark.createDataFrame(day, "domain string, type string, value string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("domain string, type string, value string").parquet(src)
        streams.register_contacts(stream, out, checkpoint, buckets=4)
    got = sorted((r.domain, str(r.type), r.value, r.batch) for r in streams.read_contacts(spark, out).collect())
    assert got == [("a.org", "None", "y", 0), ("a.org", "email", "x@a.org", 0), ("a.org", "phone", "x@a.org", 1), ("b.org", "email", "x@a.org", 0)]


def test_streams_that_share_a_register(spark, tmp_path):
    """A second stream, with a checkpoint of its own, adds what the first did not have."""
    schema, out = "domain string, type string, value string", str(tmp_path / "register")
    for run, numbers in enumerate((range(50), range(30, 80))):
        src = str(tmp_path / f"facts-{run}")
        spark.createDataFrame([("a.org", "email", f"{i}@a.org") for i in numbers], schema).write.parquet(src)
        for _ in range(2):  # the repeated run finds nothing new
            streams.register_contacts(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / f"checkpoint-{run}"))
    got = [r.value for r in streams.read_contacts(spark, out).collect()]
    assert len(got) == 80 and len(set(got)) == 80


def test_retention_lists_each_campaign_once(spark, tmp_path):
    src = str(tmp_path / "status")
    df = spark.createDataFrame([(1, "running", None), (2, "completed", "2024-01-01 00:00:00"), (1, "completed", "2024-01-01 01:00:00")], "campaign_id long, state string, finished_at string")
    df.withColumn("finished_at", F.to_timestamp("finished_at")).write.parquet(src)
    stream = spark.readStream.schema("campaign_id long, state string, finished_at timestamp").parquet(src)
    out = shared_folder(spark, "t")
    # without new data a pending timer would keep asking for empty batches
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = None
    try:
        writer = streams.stream_retention(stream).writeStream.option("checkpointLocation", shared_folder(spark, "c"))
        q = writer.format("parquet").option("path", out).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    finally:
        if q is not None:
            q.stop()
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted((r.campaign_id, r.event) for r in spark.read.parquet(out).collect()) == [(1, "listed"), (2, "listed")]
