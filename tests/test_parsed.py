"""Parsed pages kept by host bucket and updated snapshot by snapshot."""

import uuid

from contactloom.operators.pages import page_contents
from contactloom.operators.parsed import ParsedSites
from contactloom.plans import queries as Q
from contactloom.session import shared_dir
from contactloom.sources.pages import latest_pages

SCHEMA = "page_id long, url string, status int, html string"


def _page(i, url, body, status=200):
    return (i, url, status, f"<html><body>{body} <a href='/next'>n</a></body></html>")


def _rows(df):
    return sorted((r.url, tuple(r.hits), tuple(r.hrefs), r.target) for r in df.collect())


def test_updates_parse_only_newer_snapshots_and_match_a_full_parse(spark):
    parsed = ParsedSites(spark, f"{shared_dir(spark)}/test-parsed/{uuid.uuid4().hex}", buckets=8)
    first = [_page(1, "http://a.org/", "a@a.org"), _page(2, "http://b.org/x", "b@b.org"), _page(3, "http://c.org/", "c")]
    later = [_page(4, "http://a.org/", "new@a.org"), _page(0, "http://b.org/x", "old@b.org"),
             _page(5, "http://c.org/", "gone", status=404), _page(6, "http://d.org/", "d@d.org")]
    parsed.update(spark.createDataFrame(first, SCHEMA))
    parsed.update(spark.createDataFrame(later, SCHEMA))
    # The second commit holds a.org (newer), c.org (removed) and d.org; not the older b.org snapshot.
    segment = parsed.store.manifest()["segments"][-1]["id"]
    assert spark.read.parquet(f"{parsed.store.path}/segments/{segment}").count() == 3
    every = spark.createDataFrame(first + later, SCHEMA)
    hosts = spark.createDataFrame([(h,) for h in ["a.org", "b.org", "c.org", "d.org"]], "host string")
    whole = page_contents(latest_pages(every))
    assert _rows(parsed.contents(hosts)) == _rows(whole)
    some = parsed.contents(spark.createDataFrame([("a.org",)], "host string"))
    assert [r.url for r in some.collect()] == ["http://a.org/"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_scan_over_stored_pages_equals_scan_batch(spark):
    sf = "/root/testdata/sf0.001"
    assert sorted(map(tuple, Q.scan_stored(spark, sf).collect()), key=str) == sorted(
        map(tuple, Q.scan_batch(spark, sf).collect()), key=str
    )
