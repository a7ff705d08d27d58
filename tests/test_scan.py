"""Whole scans, in batch and as a stream, on small sites and on the derived ones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from contactloom.operators import results as R
from contactloom.operators.addresses import email_lists
from contactloom.options import ScanOptions
from contactloom.plans import derived as D
from contactloom.plans.scan import crawl_sites, scan
from contactloom.streaming.scan import stream_scan

T0 = dt.datetime(2024, 1, 1)

PAGES = [
    (1, "https://a.org/", 200, '<a href="/x">x</a> One@a.org'),
    (2, "https://a.org/", 200, '<a href="/x">x</a><a href="/contact">c</a> two@a.org'),
    (3, "https://a.org/x", 200, "three@a.org"),
    (4, "https://a.org/contact", 200, "four@a.org two@a.org"),
    (5, "http://b.org/x", 200, "five@b.org"),
    (6, "https://c.org", 500, "six@c.org"),
]
SEEDS = [
    (1, "a.org/"), (2, "http://A.org?x=1"), (3, "https://a.org/#top"), (4, ""),
    (5, "https://b b/"), (6, "http://b.org/x"), (7, "https://b.org/x/"), (8, "c.org"), (9, "a.org/x"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, status int, html string")


def seeds(spark, rows=SEEDS, day=0):
    at = T0 + dt.timedelta(days=day)
    data = [(i, u, at + dt.timedelta(seconds=i)) for i, u in rows]
    return spark.createDataFrame(data, "seed_id long, url string, requested_at timestamp")


def answers(done):
    lists = email_lists(done.answers.emails, ["key", "scan_id"])
    joined = done.responses.join(lists, ["key", "scan_id"], "left")
    return {
        r.seed_id: (r.from_cache, r.pages_visited, tuple(r.emails or ()), r.error)
        for r in joined.collect()
    }


A = ("four@a.org", "three@a.org", "two@a.org")
EXPECTED = {
    1: (False, 3, A, None),
    2: (True, 3, A, None),
    3: (True, 3, A, None),
    4: (False, None, (), "Missing 'url' parameter"),
    5: (False, None, (), "Invalid URL provided"),
    6: (False, 1, ("five@b.org",), None),
    7: (True, 1, ("five@b.org",), None),
    8: (False, 1, (), None),
    9: (False, 1, ("three@a.org",), None),
}


def moment(day):
    return F.lit(T0 + dt.timedelta(days=day)).cast("timestamp")


@pytest.mark.parametrize("rows", [1_000_000, 1])
def test_scan(spark, pages, rows):
    """The same with every key, start and page dealt over several tasks."""
    first = scan(seeds(spark), pages, R.empty_results(spark), moment(0), rows=rows)
    assert answers(first) == EXPECTED
    if rows == 1:
        return
    again = scan(seeds(spark), pages.limit(0), first.results, moment(359))
    got = answers(again)
    assert all(got[i] == (True, *EXPECTED[i][1:]) for i in (1, 2, 3, 6, 7, 8, 9))
    late = scan(seeds(spark, [(1, "a.org/")]), pages.limit(0), first.results, moment(360))
    assert answers(late) == {1: (False, 1, (), None)}
    assert late.results.records.count() == 4


def test_without_cache(spark, pages):
    done = scan(
        seeds(spark), pages, R.empty_results(spark), moment(0), ScanOptions(cache_enabled=False)
    )
    got = answers(done)
    assert not any(from_cache for from_cache, *_ in got.values())
    assert (got[1], got[2][1:3], got[7][1:3]) == ((False, 3, A, None), (1, ()), (1, ()))
    assert done.results.records.count() == 0


def test_counts_as_the_service_reports_them(spark, pages):
    done = scan(seeds(spark), pages, R.empty_results(spark), moment(0), compat=True)
    got = {i: pages_visited for i, (_, pages_visited, _, _) in answers(done).items()}
    assert (got[1], got[8], got[9]) == (3, 0, 1)
    exact = crawl_sites(
        spark.createDataFrame([("https://a.org/",)], "start string"), pages, ScanOptions(), exact=True
    )
    assert exact.figures.first().pages_visited == 3


def test_stream_equals_one_after_the_other(spark, pages, tmp_path):
    schema = "request_id long, body string, requested_at timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for day, part in enumerate((SEEDS[:2], SEEDS[2:])):
        rows = [
            (i, f'{{"url": "{u}", "webhook_url": "http://h/{i}"}}', T0 + dt.timedelta(days=day, seconds=i))
            for i, u in part
        ]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        stream_scan(stream, pages, out).trigger(availableNow=True).start().awaitTermination()
    jobs = {r.webhook_url[9:]: r for r in spark.read.parquet(f"{out}/jobs").collect()}
    for i, (from_cache, visited, mails, error) in EXPECTED.items():
        if error is None:
            job = jobs[str(i)]
            assert (job.from_cache, job.pages_visited, job.n_emails) == (from_cache, visited, len(mails))
    refused = {r.request_id: r.error for r in spark.read.parquet(f"{out}/refused").collect()}
    assert refused == {4: "Missing 'url' field", 5: "Invalid URL format"}
    bodies = [r.body for r in spark.read.parquet(f"{out}/payloads").collect()]
    assert len(bodies) == 7 and sum("four@a.org" in body for body in bodies) == 3
    kept = R.read_results(spark, f"{out}/results/1")
    assert kept.records.count() == 4


def test_derived_walks(spark, sf_dir):
    given = D.table(spark, sf_dir, "pages")
    starts = D.site(given).filter("k = 0").select(D.site_url(F.col("host"), F.col("k")).alias("start"))
    site = D.site_pages(given)
    least = crawl_sites(starts, site, ScanOptions())
    exact = crawl_sites(starts, site, ScanOptions(), exact=True)
    total = F.sum("pages_visited")
    assert least.figures.agg(total).first()[0] == 243
    assert exact.figures.agg(total).first()[0] == 223
    assert least.emails.count() == 209
