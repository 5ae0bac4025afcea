from collections import Counter

from pagequarry.plans import extractor, finder, walk

PAGE = '<html><head><title>{t}</title></head><body>{b}</body></html>'


def site(spark, pages):
    rows = [(i, u, PAGE.format(t=u, b=b)) for i, (u, b) in enumerate(pages.items())]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def links(*paths):
    return "".join(f'<a href="{p}">{p.strip("/")}</a>' for p in paths)


def seeds(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def test_budget_counts_misses_and_depth(spark):
    pages = {"https://a.org/": links(*[f"/l{i}" for i in range(20)])}
    pages |= {f"https://a.org/l{i}": links(f"/deep{i}") for i in range(20)}
    pages |= {f"https://a.org/deep{i}": "" for i in range(20)}
    v = walk.walk_sites(site(spark, pages), seeds(spark, "a.org")).orderBy("ord").collect()
    # the entry, thirteen well-known paths, and eleven of the twelve children of the entry
    assert len(v) == 25 and [r.ord for r in v] == list(range(25))
    assert Counter(r.outcome for r in v) == {"page": 12, "missing": 13}
    v = walk.walk_sites(site(spark, pages), seeds(spark, "a.org"), max_pages=60).collect()
    assert Counter(r.depth for r in v) == {0: 1, 1: 25, 2: 12}
    v = walk.walk_sites(site(spark, pages), seeds(spark, "a.org"), max_depth=1, max_pages=60).collect()
    assert Counter(r.depth for r in v) == {0: 1, 1: 25}


def test_subdomains_and_failing_site(spark):
    pages = {"https://a.org/": links("https://blog.a.org/x", "https://b.org/y", "/contact"), "https://blog.a.org/x": "", "https://b.org/y": "", "https://a.org/contact": ""}
    v = walk.walk_sites(site(spark, pages), seeds(spark, "https://a.org", "nowhere.org"))
    got = {(r.domain, r.url) for r in v.filter("outcome = 'page'").collect()}
    assert got == {("a.org", "https://a.org"), ("a.org", "https://blog.a.org/x"), ("a.org", "https://a.org/contact")}
    rec = {r.domain: r for r in extractor.site_records(site(spark, pages), seeds(spark, "https://a.org", "nowhere.org")).collect()}
    assert rec["nowhere.org"].status == "fail" and rec["nowhere.org"].emails == [] and len(rec["nowhere.org"].errors) == 14
    assert rec["a.org"].status == "success" and len(rec["a.org"].pages_crawled) == 3


def test_finder_picks(spark):
    pages = {
        "https://a.org/": links("/contact-page", "/jobs") + "<p>Tel 555-223-1000</p><p>info [at] a [dot] org</p>",
        "https://a.org/jobs": "<p>Call +44 20 7123 4567</p><p>99 Vacancy Street, Berlin</p>",
        "https://a.org/contact-page": "<p>Ring (555) 223-2000</p><address>12 Main Street, Springfield, IL 62704</address>"
        "<form id=c><input type=email name=e><textarea name=t></textarea></form><a href='mailto:jane.roe@a.org'>mail</a>",
    }
    p = site(spark, pages)
    v = walk.finder_pages(p, seeds(spark, "a.org", "gone.org")).orderBy("domain", "ord").collect()
    assert [(r.domain, r.url, r.error is None) for r in v] == [
        ("a.org", "https://a.org", True), ("a.org", "https://a.org/contact-page", True), ("a.org", "https://a.org/jobs", True), ("gone.org", "https://gone.org", False)]
    rec = {r.domain: r for r in finder.finder_records(p, seeds(spark, "a.org", "gone.org")).collect()}
    a = rec["a.org"]
    assert [(e.email, e.kind, e.score) for e in a.emails] == [("jane.roe@a.org", "personal", 97), ("info@a.org", "role", 78)]
    # only the entry and profile pages describe the business; the jobs page does not
    assert (a.phone, a.contact_form_url) == ("555-223-1000", "https://a.org/contact-page")
    assert "12 Main Street, Springfield, IL 62704" in a.address and "Vacancy" not in a.address
    assert rec["gone.org"].status == "fail" and "Could not reach gone.org" in rec["gone.org"].error


def test_keys_hold_the_sites_only_and_read_no_markup(spark, tmp_path):
    pages = {"https://a.org/": "", "https://a.org/x?q=1#top": "", "https://blog.a.org/y": "", "https://aa.org/z": "", "https://b.org/": "", "not a url": ""}
    site(spark, pages).write.parquet(str(tmp_path / "pages"))
    stored = spark.read.parquet(str(tmp_path / "pages"))
    keys = walk.page_keys(stored, walk.seed_sites(seeds(spark, "a.org", "nowhere.org")))
    assert sorted(r.key for r in keys.collect()) == ["https://a.org", "https://a.org/x?q=1", "https://blog.a.org/y"]
    plan = keys._jdf.queryExecution().toString()
    assert "html:string" not in plan and "SortAggregate" not in plan


def test_smallest_page_id_decides_between_pages_of_one_key(spark):
    rows = [(9, "https://a.org/", "text/html"), (3, "https://A.org", "application/pdf"), (4, "https://a.org/#x", "text/html")]
    pages = spark.createDataFrame(rows, "page_id long, url string, content_type string")
    (key,) = walk.page_keys(pages, walk.seed_sites(seeds(spark, "a.org"))).collect()
    assert (key.key, key.page_id, key.is_html) == ("https://a.org", 3, False)


def test_one_page_under_two_sites(spark):
    """A page of a sub-domain belongs to the walk of its own site and to that of the parent's."""
    pages = {"https://a.org/": links("https://sub.a.org/p"), "https://sub.a.org/": links("/p"), "https://sub.a.org/p": ""}
    v = walk.walk_sites(site(spark, pages), seeds(spark, "a.org", "sub.a.org")).filter("outcome = 'page'").collect()
    assert {(r.domain, r.url) for r in v} == {
        ("a.org", "https://a.org"), ("a.org", "https://sub.a.org/p"), ("sub.a.org", "https://sub.a.org"), ("sub.a.org", "https://sub.a.org/p")}


def test_site_queries_walk_over_written_pages(spark, sf, monkeypatch):
    from workload import queries_sites

    walked = []
    monkeypatch.setattr(queries_sites, "_CACHE", {})
    monkeypatch.setattr(queries_sites.extractor, "site_records", lambda pages, seeds, words: walked.append(pages) or seeds)
    monkeypatch.setattr(queries_sites.finder, "finder_records", lambda pages, seeds: walked.append(pages) or seeds)
    queries_sites.site_table(spark, sf)
    queries_sites.finder_table(spark, sf)
    assert len(walked) == 2
    for pages in walked:
        assert "Join" not in pages._jdf.queryExecution().optimizedPlan().toString()
