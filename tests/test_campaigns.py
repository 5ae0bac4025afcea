from pyspark.sql import functions as F

from pagequarry.operators import campaigns as ca
from pagequarry.plans.extractor import breakdown
from pagequarry.sources import readers

LISTS = [
    ("header", 'Firm;Mail;City\n"Hill; Sons";order@hillsons.test;York\nMoor Ltd;MOOR@moor.test;"Line one\nline two"\nHill again;order@hillsons.test;Leeds\nNo address;nowhere;Bath\n'),
    ("bare", "p1@one.test\np2@two.test p3@three.test"), ("unnamed", "Kim,kim@four.test\r\nLee,lee@four.test\r\n"), ("single", "q1@five.test, q2@five.test"),
    ("tabs", "who\temail\nMia\tmia@six.test\n\t\n"),
]


def test_lists(spark):
    rec, invalid, stats = ca.parse_recipients(readers.split_lists(spark.createDataFrame(LISTS, "list_id string, text string")))
    got = {}
    for r in rec.orderBy("list_id", "row").collect():
        got.setdefault(r.list_id, []).append((r.email, {f.k: f.v for f in r.fields}))
    assert got["header"] == [("order@hillsons.test", {"Firm": "Hill; Sons", "City": "York"}), ("moor@moor.test", {"Firm": "Moor Ltd", "City": "Line one\nline two"})]
    assert [e for e, _ in got["bare"]] == ["p1@one.test", "p2@two.test", "p3@three.test"]
    assert got["unnamed"] == [("kim@four.test", {"column_1": "Kim"}), ("lee@four.test", {"column_1": "Lee"})]
    # one pasted line with commas is a table row: only its first address column is read
    assert got["single"] == [("q1@five.test", {"column_2": "q2@five.test"})]
    assert got["tabs"] == [("mia@six.test", {"who": "Mia"})]
    assert [(r.list_id, r.value) for r in invalid.collect()] == [("header", "No address, nowhere, Bath")]
    s = {r.list_id: (r.recipients, r.duplicates, r.invalid) for r in stats.collect()}
    assert s["header"] == (2, 1, 1) and s["bare"] == (3, 0, 0)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(LISTS[0][1])
    (tmp_path / "big.csv").write_text("x@y.org\n" * 50)
    files = readers.read_list_files(spark, str(tmp_path), limit=300)
    got = {r.list_id: (r.text is not None, r.too_large) for r in files.collect()}
    assert got == {"a.csv": (True, False), "big.csv": (False, True)}


def test_render(spark):
    df = spark.createDataFrame([("x@y.z", [("Name", "<script>alert(1)</script>"), ("Company Name", "Smith & Sons"), ("company-name", "second")])], "email string, fields array<struct<k:string,v:string>>")
    t = ca.Template("Hi {{name}} at {{ company_name }}", "<p>{{name|there}} {{unsubscribe_url|-}} {{missing_tag}}</p>{{email}}")
    r = ca.render_messages(df, t).first()
    assert r.subject == "Hi <script>alert(1)</script> at Smith & Sons"
    assert r.html == "<p>&lt;script&gt;alert(1)&lt;/script&gt; - </p>x@y.z"
    assert t.tags() == ["name", "company_name", "unsubscribe_url", "missing_tag", "email"]
    assert [r.tag for r in ca.unresolved_tags(t, df).collect()] == ["missing_tag"]


def test_plan(spark):
    small = spark.range(7).select(F.lit(1).alias("campaign_id"), F.col("id").alias("row"), F.concat("id", F.lit("@seven.test")).alias("email"))
    large = spark.range(40_000).select(F.lit(2).alias("campaign_id"), (F.col("id") * 3).alias("row"), F.concat("id", F.lit("@large.test")).alias("email"))
    plan = ca.plan_sends(small.unionByName(large), 2, 3, 10)
    assert [r.planned_offset_s for r in plan.where("campaign_id = 1").orderBy("row").collect()] == [0, 2, 4, 14, 16, 18, 28]
    assert [r.k for r in plan.where("campaign_id = 2").orderBy("row").collect()] == [*range(40_000)]
    assert ca.plan_sends(small.unionByName(large), max_recipients=5000).select("campaign_id").distinct().count() == 1
    assert ca.clamp_throttle(0, 5000, -1) == (0.5, 1000, 0)


def test_eta_and_duration(spark):
    df = spark.createDataFrame([(50,), (51,), (0,)], "n long")
    assert [r[0] for r in df.select(ca.form_eta(F.col("n"), 2, 50, 60)).collect()] == [148.0, 211.0, 0.0]
    assert [r[0] for r in df.select(ca.server_eta(F.col("n"), F.col("n") == 51, 2, 50, 60)).collect()] == [210, 0, 0]
    d = spark.createDataFrame([(59,), (60,), (125,), (7260,)], "s long")
    assert [r[0] for r in d.select(ca.format_duration(F.col("s"))).collect()] == ["59s", "1m", "2m 5s", "2h 1m"]


def test_percentages(spark):
    df = spark.createDataFrame([(1, "sent")] * 1 + [(1, "failed")] * 1 + [(1, "skipped")] * 2, "campaign_id int, state string")
    totals = spark.createDataFrame([(1, 10), (2, 3)], "campaign_id int, total long")
    got = {r.campaign_id: (r.pending, r.delivered_pct, r.failed_pct) for r in ca.campaign_summary(df, totals).collect()}
    assert got == {1: (6, 50, 50), 2: (3, 0, 0)}


def test_breakdown_adds_up(spark):
    for values in ([1, 1, 1], [5, 3, 2, 2, 1, 1, 1, 1], [1], [7, 7, 7, 7, 7, 7]):
        df = spark.createDataFrame([(f"l{i}", v) for i, v in enumerate(values)] + [("zero", 0)], "label string, value long")
        rows = breakdown(df).orderBy("rank").collect()
        assert sum(r.percent for r in rows) == 100 and sum(r.value for r in rows) == sum(values)
        assert len(rows) == min(len(values), 6)
    rows = breakdown(spark.createDataFrame([(f"l{i}", 9 - i) for i in range(8)], "label string, value long")).orderBy("rank").collect()
    assert rows[-1].label == "Other (3)"
