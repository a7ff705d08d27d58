"""Results, requests, jobs, delivery and the helpers against small cases and brute force."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from contactloom.functions.records import duration_text, elapsed_seconds
from contactloom.functions.urls import url_key
from contactloom.operators import addresses, delivery, jobs, results, skew
from contactloom.options import ScanOptions
from contactloom.plans.outcomes import job_outcomes
from contactloom.session import stored
from contactloom.sources import messages, requests
from contactloom.sources.pages import latest_pages

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def moment(hours):
    return F.lit(at(hours)).cast("timestamp")


def now():
    return moment(24 * 9)


def test_options():
    options = ScanOptions.from_mapping(
        {"max_depth": "5", "ttl_days": "x", "deduplicate": "F", "cache_enabled": "maybe"}
    )
    assert options == ScanOptions(max_depth=5, deduplicate=False)


def test_spread_join(spark):
    rng = random.Random(3)
    left = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}") for i in range(500)]
    right = [("hot", 1), ("hot", 2), ("k1", 3), ("k5", 4), ("zz", 5)]
    a = spark.createDataFrame(left, "id int, k string")
    b = spark.createDataFrame(right, "k string, v int")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, a.join(b, "k", how).collect()), key=str)
        spread = skew.spread_join(a, b, ["k"], how, rows=10)
        assert sorted(map(tuple, spread.select("k", "id", "v").collect()), key=str) == plain


def test_rows_without_a_key_are_dealt(spark):
    left = spark.range(2_000).select("id", F.when(F.col("id") % 20 == 0, "k").alias("k"))
    right = spark.createDataFrame([("k", 1), (None, 2)], "k string, v int")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.spread_join(left, right.hint("merge"), ["k"], "left", rows=10)
        tasks = joined.filter("k IS NULL").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(tasks) > 2 and sum(r["count"] for r in tasks) == 1_900
    assert joined.filter("k IS NULL AND v IS NOT NULL").isEmpty()


def test_latest_pages_with_repeated_versions(spark):
    rows = [
        (1, "https://h/a", "old"), (2, "https://h/a", "new"), (1, "https://h/b", "only"),
        (3, "https://h/c", "x"), (3, "https://h/c", "y"), (4, "https://h/d", "z"), (4, "https://h/d", "z"),
    ]
    table = spark.createDataFrame(rows, "v int, url string, html string")
    got = latest_pages(table, "v").collect()
    assert sorted(r.url[-1] for r in got) == ["a", "b", "c", "d"]
    assert {r.html for r in got if r.url.endswith(("a", "b"))} == {"new", "only"}


@pytest.mark.parametrize("value", ['{"emails": 5}', "[1]", '"x"', '{"emails": [1]}', '{"timestamp": "soon"}', '{"crawl_info": {"depth": "x"}}'])
def test_mistyped_records_are_misses(spark, value):
    kept = spark.createDataFrame([("k", value)], "key string, value string")
    assert results.results_from_json(kept).records.isEmpty()


def test_cancel_after_a_start_that_found_no_job(spark):
    actions = log(spark, (0, "enqueue"), (25, "start"), (26, "cancel"))
    assert [r.refused for r in jobs.cancel_guard(actions).collect()] == [False]
    assert {r.seq for r in jobs.job_expiry(actions).collect()} == {1, 2}
    assert {r.error for r in jobs.judged_actions(actions).collect()} == {None, "job not found"}


def test_late_actions_are_told(spark):
    first = log(spark, (0, "enqueue"), (5, "start"))
    late = log(spark, (4, "complete"), (6, "complete"))
    state = jobs.advance_jobs(spark.createDataFrame([], jobs.STATE_SCHEMA), first)
    assert [r.seq for r in jobs.late_actions(state, late).collect()] == [0]
    assert jobs.advance_jobs(state, late).first().status == "completed"


@pytest.mark.parametrize("rows", [1_000_000, 5])
def test_running_values(spark, rows):
    rng = random.Random(5)
    data = [
        ("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", i,
         rng.choice([None, "x", "y"]), rng.randrange(10))
        for i in range(300)
    ]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, i int, word string, n int")
    log = skew.Ordered(df, ["k"], ["i"], rows)
    assert log.split == (rows == 5)
    log = log.running({"n_sum": skew.Total(F.col("n")), "top": skew.Greatest(F.col("n"))})
    log = log.running({"seen": skew.Last(F.col("word"))}, before=True)
    got = {r.i: (r.n_sum, r.top, r.seen) for r in log.result().collect()}
    state, expected = {}, {}
    for k, i, word, n in sorted(data, key=lambda r: r[1]):
        total, top, seen = state.get(k, (0, -1, None))
        expected[i] = (total + n, max(top, n), seen)
        state[k] = (total + n, max(top, n), word or seen)
    assert got == expected


def test_email_lists_in_parts(spark):
    rows = [("a", f"m{i:02}@x.org") for i in range(25)] + [("b", "z@x.org")]
    found = spark.createDataFrame(rows, "k string, email string").repartition(4)
    for limit in (1_000_000, 3):
        lists = addresses.email_lists(found, ["k"], length=10, rows=limit).collect()
        parts = {(r.k, r.part): r.emails for r in lists}
        assert [len(parts["a", i]) for i in range(3)] == [10, 10, 5]
        assert parts["a", 0] + parts["a", 1] + parts["a", 2] == [m for k, m in rows if k == "a"]
        assert parts["b", 0] == ["z@x.org"]


def store(spark, rows):
    """Results from ``key, scan_id, hours, emails``."""
    records = [(k, s, at(h), 3, 1, len(m)) for k, s, h, m in rows]
    emails = [(k, s, mail) for k, s, _, m in rows for mail in m]
    return results.Results(
        spark.createDataFrame(records, results.RECORD_SCHEMA),
        spark.createDataFrame(emails, results.EMAIL_SCHEMA),
    )


def shown(found):
    mails = {}
    for r in found.emails.collect():
        mails.setdefault((r.key, r.scan_id), set()).add(r.email)
    return {(r.key, r.scan_id): mails.get((r.key, r.scan_id), set()) for r in found.records.collect()}


def test_upsert(spark):
    old = store(spark, [("a", "1", 0, ["o@a"]), ("b", "1", 5, ["o@b"]), ("c", "1", 0, [])])
    new = store(
        spark,
        [("a", "2", 1, ["n@a"]), ("a", "3", 2, ["m@a", "k@a"]), ("b", "2", 4, ["n@b"]), ("d", "2", 1, [])],
    )
    once = results.upsert_results(old, new)
    expected = {("a", "3"): {"m@a", "k@a"}, ("b", "1"): {"o@b"}, ("c", "1"): set(), ("d", "2"): set()}
    assert shown(once) == expected
    twice = results.upsert_results(once, new)
    assert shown(twice) == expected
    assert twice.emails.count() == 3
    gone = results.clear(once)
    assert gone.records.count() == gone.emails.count() == 0


def test_files(spark, tmp_path):
    found = store(spark, [("a", "1", 0, ["x@a", "y@a"]), ("b", "1", 0, [])])
    results.write_results(found, str(tmp_path / "v1"))
    assert shown(results.read_results(spark, str(tmp_path / "v1"))) == shown(found)


def test_expiry_of_results(spark):
    found = store(spark, [("a", "1", 0, []), ("b", "1", 1, [])])
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "b")], "id int, key string")
    end = moment(24 * 360)
    hits, misses = results.split_hits(asked, found.records, end, 360)
    assert sorted(r.id for r in hits.collect()) == [2, 4]
    assert sorted(r.id for r in misses.collect()) == [1, 3]
    assert results.cache_stats(found.records, end, 360).first().cached_urls == 1
    assert results.cache_stats(found.records, end, 360, enabled=False).first().cached_urls == 0


def test_results_from_json(spark):
    good = json.dumps(
        {"emails": ["B@x.org", "a@x.org", "b@x.org "], "timestamp": "2024-01-01T00:00:00Z",
         "crawl_info": {"depth": 3, "pages_visited": 2}}
    )
    kept = spark.createDataFrame([("k", good), ("bad", "{"), ("no", "")], "key string, value string")
    found = results.results_from_json(kept)
    assert shown(found) == {("k", "import"): {"a@x.org", "b@x.org"}}
    record = found.records.first()
    assert (record.cached_at, record.depth, record.pages_visited, record.n_emails) == (T0, 3, 2, 2)


REQUESTS = {
    '{"url":"a.b","webhook_url":"h"}': None,
    '{"url": ': "Invalid JSON format",
    "null": "Missing 'url' field",
    "[1]": "Invalid JSON format",
    '{"url":5}': "Invalid JSON format",
    '{"url":"a"} x': "Invalid JSON format",
    "": "Invalid JSON format",
    '{"url":null,"webhook_url":"h"}': "Missing 'url' field",
    '{"url":"a"}': "Missing 'webhook_url' field",
    '{"url":"a\\u0001","webhook_url":"h"}': "Invalid URL format",
    '{"url":"a","webhook_url":"http://h:x/"}': "Invalid webhook_url format",
    '{"url":"a","webhook_url":"any text"}': None,
}


def test_requests(spark):
    df = spark.createDataFrame([(b,) for b in REQUESTS], "body string")
    got = requests.validate_requests(requests.parse_requests(df)).collect()
    assert {r.body: r.error for r in got} == REQUESTS


SEEDS = {
    "": "Missing 'url' parameter", None: "Missing 'url' parameter", "ex.com": None,
    "https://": None, "https://a b/": "Invalid URL provided", "ftp://x/y": None,
    "http://x/%zz": "Invalid URL provided",
}


def test_seeds(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(SEEDS)], "seed_id int, url string")
    got = requests.validate_seeds(df).collect()
    assert {r.url: r.error for r in got} == SEEDS


def log(spark, *actions):
    rows = [("j", at(h), i, a) for i, (h, a) in enumerate(actions)]
    return spark.createDataFrame(rows, "job_id string, ts timestamp, seq long, action string")


LOGS = [
    # enqueue, then too late to start: stays active
    ([(0, "enqueue"), (25, "start")], "queued", True, ["job not found"]),
    # a finished scan brings the record back
    ([(0, "enqueue"), (1, "start"), (26, "complete")], "completed", False, []),
    # a refused cancel does not renew the record
    ([(0, "enqueue"), (1, "start"), (24, "cancel"), (26, "start")], "processing", True,
     ["cannot cancel job that is currently processing", "job not found"]),
    ([(0, "enqueue"), (1, "cancel")], "cancelled", False, []),
    ([(0, "enqueue"), (1, "start"), (2, "complete"), (3, "cancel")], "cancelled", False, []),
    ([(0, "enqueue"), (1, "start"), (2, "fail"), (26, "cancel")], "failed", False, ["job not found"]),
]


@pytest.mark.parametrize("rows", [1_000_000, 1])
def test_job_logs(spark, rows):
    table = None
    for i, (actions, *_) in enumerate(LOGS):
        part = log(spark, *actions).withColumn("job_id", F.lit(str(i)))
        table = part if table is None else table.unionByName(part)
    folded = {r.job_id: r for r in jobs.fold_jobs(table, now(), rows=rows).collect()}
    errors = jobs.judged_actions(table, rows=rows).filter("error is not null").orderBy("seq")
    refused = {}
    for r in errors.collect():
        refused.setdefault(r.job_id, []).append(r.error)
    for i, (_, status, active, expected) in enumerate(LOGS):
        assert (folded[str(i)].status, folded[str(i)].active) == (status, active), i
        assert refused.get(str(i), []) == expected, i


def test_job_actions(spark):
    asked = spark.createDataFrame(
        [(1, "https://x.org", "http://h", ""), (2, "https://y.org", "http://h", "cb")],
        "request_id long, target string, webhook_url string, callback_id string",
    )
    seq = F.lit(10)
    new = jobs.enqueue(asked, moment(0))
    ids = new.select("job_id")
    assert ids.distinct().count() == 2 and len(ids.first().job_id) == 36
    first = new.filter("url = 'https://x.org'").select("job_id")
    begun = jobs.start(first, moment(1), seq)
    then = moment(2)
    folded = jobs.fold_jobs(new.unionByName(begun, allowMissingColumns=True), then)
    rows, refused = jobs.cancel(folded, ids.unionByName(spark.createDataFrame([("no",)], "job_id string")), then, seq)
    assert {r.error for r in refused.collect()} == {
        "job not found", "cannot cancel job that is currently processing",
    }
    whole = new.unionByName(begun, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True)
    states = {r.url: (r.status, r.callback_id) for r in jobs.fold_jobs(whole, then).collect()}
    assert states == {"https://x.org": ("processing", None), "https://y.org": ("cancelled", "cb")}
    ended = jobs.fail(first.withColumn("error", F.lit("Job timed out")), then, F.lit(11))
    done = jobs.fold_jobs(whole.unionByName(ended, allowMissingColumns=True), then)
    assert done.filter("error = 'Job timed out' and status = 'failed'").count() == 1


def test_outcomes_and_payloads(spark):
    rows = [
        ("hit", "https://a.org", "http://h", 999.0), ("late", "https://b.org", "http://h", 300.0),
        ("bad", "https://a b/", "http://h", 1.0), ("fresh", "https://c.org", "", 2.3),
        ("fresh2", "https://d.org", "http://h", 2.3),
    ]
    asked = spark.createDataFrame(
        [(j, u, w, None, s) for j, u, w, s in rows],
        "job_id string, url string, webhook_url string, callback_id string, crawl_seconds double",
    )
    found = store(spark, [("a", "1", 0, ["x@a.org"])])
    records = found.records.withColumn("key", url_key(F.lit("https://a.org")))
    crawled = spark.createDataFrame(
        [("fresh", 4, 0), ("fresh2", 4, 1)], "job_id string, pages_visited int, n_emails int"
    )
    out = job_outcomes(asked, records, crawled, now()).cache()
    got = {r.job_id: (r.status, r.error, r.from_cache, r.kept) for r in out.collect()}
    assert got == {
        "hit": ("completed", None, True, False),
        "late": ("failed", "Job timed out", False, False),
        "bad": ("failed", "Invalid URL: https://a b/", False, False),
        "fresh": ("completed", None, False, True),
        "fresh2": ("completed", None, False, True),
    }
    lists = spark.createDataFrame([("fresh2", 0, ["x@d.org"])], "job_id string, part int, emails array<string>")
    sent = {r.job_id: json.loads(r.body) for r in delivery.webhook_payloads(out, lists, now()).collect()}
    assert set(sent) == {"hit", "late", "bad", "fresh2"}
    assert sent["fresh2"] == {
        "job_id": "fresh2", "status": "completed", "url": "https://d.org", "emails": ["x@d.org"],
        "crawl_time": "2.3s", "pages_visited": 4, "completed_at": "2024-01-10T00:00:00.000Z",
    }
    assert "emails" not in sent["late"] and sent["late"]["error"] == "Job timed out"


def test_scan_messages(spark):
    responses = spark.createDataFrame(
        [(1, "k", "s", True, None), (2, "k2", "s", False, None), (3, None, None, False, "Invalid URL provided")],
        "seed_id int, key string, scan_id string, from_cache boolean, error string",
    )
    lists = spark.createDataFrame(
        [("k", "s", 0, ["a@x.org"]), ("k", "s", 1, ["b@x.org"])],
        "key string, scan_id string, part int, emails array<string>",
    )
    rows = messages.scan_responses(responses, lists).collect()
    got = {(r.seed_id, r.part): json.loads(r.body) for r in rows}
    assert got == {
        (1, 0): {"emails": ["a@x.org"], "from_cache": True},
        (1, 1): {"emails": ["b@x.org"], "from_cache": True, "part": 1},
        (2, 0): {"from_cache": False},
        (3, 0): {"error": "Invalid URL provided", "from_cache": False},
    }
    full = messages.scan_responses(responses, lists, compat=False).collect()
    assert json.loads(next(r.body for r in full if r.seed_id == 2))["emails"] == []


DELIVERIES = {
    "a": ([500, 200], (True, 2, 2, 2)),
    "b": ([None, 302, 204], (True, 3, 3, 6)),
    "c": ([500, 500, 500, 200], (False, None, 3, 6)),
    "d": ([200, 500], (True, 1, 1, 0)),
}


def test_delivery(spark):
    rows = [(j, i + 1, s) for j, (log_, _) in DELIVERIES.items() for i, s in enumerate(log_)]
    attempts = spark.createDataFrame(rows, "job_id string, attempt int, http_status int")
    got = {r.job_id: tuple(r)[1:] for r in delivery.delivery_outcomes(attempts).collect()}
    assert got == {j: expected for j, (_, expected) in DELIVERIES.items()}
    none = delivery.delivery_outcomes(attempts, retries=0).collect()
    assert all(tuple(r)[1:] == (False, None, 0, 0) for r in none)
    waits = delivery.backoff_schedule(attempts.select("job_id").distinct(), 3)
    assert sorted(r.wait_s for r in waits.filter("job_id = 'a'").collect()) == [2, 4]
    assert delivery.backoff_schedule(attempts, 1).count() == 0


DURATIONS = {
    2.3: "2.3s", 0.000396: "396µs", 0.0021: "2.1ms", 90.5: "1m30.5s", 3600.0: "1h0m0s",
    300.0: "5m0s", 0.0: "0s", 1e-9: "1ns", 59.999: "59.999s",
}


def test_durations(spark):
    df = spark.createDataFrame([(s,) for s in DURATIONS], "s double")
    got = {r.s: r.t for r in df.select("s", duration_text(F.col("s")).alias("t")).collect()}
    assert got == DURATIONS
    span = spark.range(1).select(
        elapsed_seconds(moment(0), moment(1))
    )
    assert span.first()[0] == 3600.0


@pytest.mark.parametrize("rows", [1_000_000, 3])
def test_log_in_parts(spark, rows):
    """A log folded part by part comes to the same as in one go."""
    rng = random.Random(11)
    kinds = ("start", "complete", "fail", "cancel", "start", "cancel")
    data, hour = [], 0
    for i in range(240):
        hour += rng.choice((0, 1, 9, 30))
        data.append((f"j{rng.randrange(4)}", at(hour), i, "enqueue" if i < 8 else rng.choice(kinds)))
    schema = "job_id string, ts timestamp, seq long, action string"
    whole = spark.createDataFrame(data, schema)
    state = spark.createDataFrame([], jobs.STATE_SCHEMA)
    for low in range(0, 240, 80):
        part = whole.filter(f"seq >= {low} and seq < {low + 80}")
        changed = stored(jobs.advance_jobs(state, part, rows=rows))
        state = stored(state.join(changed, "job_id", "left_anti").unionByName(changed))
    names = ["job_id", "status", "created_at", "started_at", "completed_at", "updated_at", "active"]
    expected = jobs.fold_jobs(whole, now(), rows=rows).select(*names)
    assert sorted(state.select(*names).collect()) == sorted(expected.collect())
    late = whole.filter("seq < 40")
    assert jobs.advance_jobs(state, late).count() == 0
