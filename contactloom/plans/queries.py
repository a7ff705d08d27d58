"""The queries over the test tables, by name. Their SQL twins are in ``oracles``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from contactloom.functions import emails as E
from contactloom.functions import urls as U
from contactloom.functions.records import expires_at, to_record
from contactloom.operators import addresses, delivery, graph, jobs, pages, results
from contactloom.operators.skew import spread_join
from contactloom.operators.parsed import ParsedSites
from contactloom.operators.store import KeyedStore
from contactloom.options import ScanOptions
from contactloom.plans import derived as D
from contactloom.plans.outcomes import complete_from_results, job_outcomes
from contactloom.plans.scan import Scan, scan
from contactloom.session import shared_dir, stored
from contactloom.sources import messages, requests
from contactloom.sources.pages import latest_pages, with_status
from contactloom.streaming import contacts
from contactloom.streaming import jobs as live_jobs
from contactloom.streaming import keyed
from contactloom.streaming import scan as live_scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
OPTIONS = ScanOptions()


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "pages")


def _text(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = D.site(_pages(spark, sf_dir)).filter("k = 0")
    return first.select(D.site_url(F.col("host"), F.col("k")).alias("start"))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_contents(D.site_pages(_pages(spark, sf_dir)))


def _results(spark: SparkSession, sf_dir: str) -> results.Results:
    """The stored results, as tables like those a scan reads."""
    return results.Results(*map(stored, D.results(_pages(spark, sf_dir))))


def _keyed_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = requests.validate_seeds(D.scan_seeds(_pages(spark, sf_dir)))
    return seeds.select("seed_id", U.url_key(F.col("target")).alias("key"))


def _joined_lists(found: results.Results) -> DataFrame:
    lists = addresses.email_lists(found.emails, ["key", "scan_id"])
    return lists.select("key", "scan_id", "part", F.array_join("emails", ",").alias("emails"))


# URLs


@query
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", U.url_parts(F.col("url")).alias("u")).select(
        "page_id", "u.scheme", "u.host", "u.path", "u.query", "u.fragment"
    )


@query
def url_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the given URLs, of their spelling without scheme, and of broken text."""
    url = F.col("url")
    bare = F.regexp_replace(url, "^https?://", "")
    return _pages(spark, sf_dir).select(
        "page_id",
        U.url_key(url).alias("key"),
        U.url_key_raw(bare).alias("bare_key"),
        U.url_key_raw(bare, compat=True).alias("compat_key"),
        U.url_key(F.concat(url, F.lit("%"))).alias("broken_key"),
    )


@query
def canonical_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the given pages, resolved against their page."""
    links = pages.page_links(pages.page_contents(with_status(_pages(spark, sf_dir))))
    return links.select("src", F.col("pos").cast("long").alias("pos"), "href", "dst")


@query
def contact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of the site pages, off-host ones too, with their contact flag and cost."""
    links = pages.page_links(_contents(spark, sf_dir))
    return links.select(
        "src",
        F.col("pos").cast("long").alias("pos"),
        "dst",
        "kind",
        U.is_contact_path(U.url_path(F.col("dst"))).alias("contact"),
        U.link_cost(F.col("dst"), F.col("kind")).alias("cost"),
    )


@query
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = pages.site_edges(_contents(spark, sf_dir))
    return edges.select("src", F.col("pos").cast("long").alias("pos"), "dst", "cost")


@query
def meta_refresh_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.split_redirects(_contents(spark, sf_dir))


# Addresses


@query
def page_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses per host and the number of pages they are on."""
    found = pages.page_emails(pages.mail_pages(with_status(_pages(spark, sf_dir))))
    return found.groupBy(U.url_host(F.col("url")).alias("host"), "email").agg(
        F.count(F.lit(1)).alias("pages")
    )


@query
def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = E.lower_hits(E.extract_emails(F.col("text")))
    documents = D.table(spark, sf_dir, "documents").filter(F.col("text").contains("@"))
    return (
        documents.select("doc_id", hits.alias("hits"))
        .filter(F.size("hits") > 0)
        .select("doc_id", F.size("hits").alias("n_hits"), F.array_join("hits", ",").alias("emails"))
    )


@query
def dedup_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address lists made untidy and cleaned again."""
    hits = E.extract_emails(F.col("text"))
    untidy = F.concat(
        F.transform(hits, lambda m: F.concat(F.lit(" \t"), F.upper(m), F.lit("\n"))),
        F.array(F.lit(""), F.lit("  ")),
        hits,
    )
    return D.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.array_join(E.dedup_emails(untidy), ",").alias("emails"),
        F.size(E.dedup_emails(untidy, enabled=False)).alias("n_untidy"),
        F.array_join(E.omit_empty(E.dedup_emails(untidy)), ",").alias("shown"),
    )


@query
def host_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct addresses per host, over the site pages and the given pages."""
    contents = [_contents(spark, sf_dir), pages.mail_pages(with_status(_pages(spark, sf_dir)))]
    found = [
        pages.page_emails(c).select(U.url_host(F.col("url")).alias("host"), "email")
        for c in contents
    ]
    lists = addresses.email_lists(addresses.union_emails(*found), ["host"])
    return lists.select("host", "part", F.array_join("emails", ",").alias("emails"))


@query
def email_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.email_hits(_contents(spark, sf_dir))


@query
def page_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = pages.parse_pages(with_status(_pages(spark, sf_dir)), mail_only=False)
    return pages.page_preview(parsed)


# Sources and checks


@query
def latest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_pages(D.snapshots(_pages(spark, sf_dir))).select("page_id", "url")


@query
def validate_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = D.faulty_seeds(_pages(spark, sf_dir))
    return requests.validate_seeds(seeds).select("seed_id", "target", "error")


@query
def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = requests.parse_requests(D.requests(_pages(spark, sf_dir)))
    return requests.validate_requests(parsed).select(
        "request_id", "target", "webhook_url", "callback_id", "error"
    )


# Crawls


@query
def crawl_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = stored(_contents(spark, sf_dir))
    return graph.crawl(_starts(spark, sf_dir), pages.site_edges(contents), OPTIONS.max_depth)


@query
def crawl_exact_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = stored(_contents(spark, sf_dir))
    return graph.crawl_exact(_starts(spark, sf_dir), pages.site_edges(contents), OPTIONS.max_depth)


@query
def crawl_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = stored(_contents(spark, sf_dir))
    reach = graph.crawl(_starts(spark, sf_dir), pages.site_edges(contents), OPTIONS.max_depth)
    return addresses.reach_emails(reach, pages.page_emails(contents))


@query
def crawl_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and depth reached per start; beside it the number of addresses as page count."""
    contents = stored(_contents(spark, sf_dir))
    reach = graph.crawl(_starts(spark, sf_dir), pages.site_edges(contents), OPTIONS.max_depth)
    found = addresses.reach_emails(reach, pages.page_emails(contents))
    compat = addresses.pages_visited(reach, found).select(
        "start", F.col("pages_visited").alias("compat_pages_visited")
    )
    return (
        addresses.pages_visited(reach)
        .join(compat, "start")
        .withColumn("depth", F.lit(OPTIONS.max_depth))
    )


def _scan(
    spark: SparkSession, sf_dir: str, seeds: Callable[[DataFrame], DataFrame], options: ScanOptions
) -> Scan:
    """A scan of derived seeds over derived pages and results, all of them tables first."""
    given = _pages(spark, sf_dir)
    return scan(
        stored(seeds(given)),
        stored(D.site_pages(given).select("page_id", "url", "status", "html")),
        _results(spark, sf_dir),
        D.as_of(),
        options,
    )


@query
def scan_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seeds against the stored results and the site pages."""
    done = _scan(spark, sf_dir, D.scan_seeds, OPTIONS)
    answers = done.responses.join(_joined_lists(done.answers), ["key", "scan_id"], "left")
    return answers.select(
        "seed_id",
        "from_cache",
        "depth",
        "pages_visited",
        "n_emails",
        F.coalesce("emails", F.lit("")).alias("emails"),
        "error",
    )


@query
def scan_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan_batch`` over a store of parsed pages that was filled in two parts, the second
    parsing only the snapshots the first did not hold."""
    given = _pages(spark, sf_dir)
    site = stored(D.site_pages(given).select("page_id", "url", "status", "html"))
    parsed = ParsedSites(spark, _folder(spark))
    middle = site.agg(F.percentile_approx("page_id", 0.5)).first()[0]
    parsed.update(site.filter(F.col("page_id") <= middle))
    parsed.update(site)
    done = scan(stored(D.scan_seeds(given)), site, _results(spark, sf_dir), D.as_of(), OPTIONS, parsed=parsed)
    answers = done.responses.join(_joined_lists(done.answers), ["key", "scan_id"], "left")
    return answers.select(
        "seed_id",
        "from_cache",
        "depth",
        "pages_visited",
        "n_emails",
        F.coalesce("emails", F.lit("")).alias("emails"),
        "error",
    )


@query
def scan_uncached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same seeds with the cache switched off."""
    done = _scan(spark, sf_dir, D.seeds, ScanOptions(cache_enabled=False))
    return done.responses.select("seed_id", "from_cache", "pages_visited", "n_emails")


@query
def scan_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers of stored results, read back field by field."""
    found = _results(spark, sf_dir)
    hits, _ = results.split_hits(
        _keyed_seeds(spark, sf_dir), found.records, D.as_of(), OPTIONS.ttl_days
    )
    answers = hits.withColumns({"from_cache": F.lit(True), "error": F.lit(None).cast("string")})
    lists = addresses.email_lists(found.emails, ["key", "scan_id"])
    body = F.from_json("body", "emails array<string>, from_cache boolean, error string")
    return (
        messages.scan_responses(answers, lists)
        .select("seed_id", "part", body.alias("b"), F.col("body").contains('"emails"').alias("has"))
        .select(
            "seed_id",
            "part",
            F.array_join("b.emails", ",").alias("emails"),
            "b.from_cache",
            F.col("has").alias("has_emails"),
        )
    )


# Stored results


@query
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, _ = results.split_hits(
        _keyed_seeds(spark, sf_dir), _results(spark, sf_dir).records, D.as_of(), OPTIONS.ttl_days
    )
    return hits.select(
        "seed_id",
        "key",
        _text("cached_at").alias("cached_at"),
        _text(expires_at(F.col("cached_at"), OPTIONS.ttl_days)).alias("expires_at"),
        "depth",
        "pages_visited",
        "n_emails",
    )


@query
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, misses = results.split_hits(
        _keyed_seeds(spark, sf_dir), _results(spark, sf_dir).records, D.as_of(), OPTIONS.ttl_days
    )
    return misses.select("seed_id", "key")


def _result_rows(found: results.Results) -> DataFrame:
    """Records with their addresses in one text."""
    return (
        found.records.join(_joined_lists(found), ["key", "scan_id"], "left")
        .withColumn("cached_at", _text("cached_at"))
        .withColumn("emails", F.coalesce("emails", F.lit("")))
        .select("key", "scan_id", "cached_at", "depth", "pages_visited", "n_emails", "emails")
    )


@query
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = results.Results(*map(stored, D.rewritten(_pages(spark, sf_dir))))
    return _result_rows(results.upsert_results(_results(spark, sf_dir), new))


@query
def cache_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upserted results published as one version next to the given ones, read back."""
    folder = _folder(spark)
    results.publish_results(_results(spark, sf_dir), folder)
    new = results.Results(*map(stored, D.rewritten(_pages(spark, sf_dir))))
    results.publish_results(results.upsert_results(results.read_published(spark, folder), new), folder)
    return _result_rows(results.read_published(spark, folder))


@query
def cache_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results kept as JSON values, some of them unreadable."""
    found = _results(spark, sf_dir)
    lists = addresses.email_lists(found.emails, ["key", "scan_id"]).drop("part")
    number = F.substring("scan_id", 2, 20).cast("long")
    value = to_record(
        F.col("emails"),
        F.col("cached_at").alias("timestamp"),
        F.struct("depth", "pages_visited").alias("crawl_info"),
    )
    kept = found.records.join(lists, ["key", "scan_id"], "left").select(
        "key", F.when(number % 5 == 0, F.lit('{"emails": [')).otherwise(value).alias("value")
    )
    return _result_rows(results.results_from_json(kept))


@query
def cache_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without every other page, named without its scheme."""
    given = _pages(spark, sf_dir)
    urls = D.site(given).filter("k % 2 = 0").select(
        F.regexp_replace(D.site_url(F.col("host"), F.col("k")), "^https://", "").alias("url")
    )
    return _result_rows(results.invalidate(_results(spark, sf_dir), urls))


@query
def cache_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without what has expired."""
    kept = results.purge_expired(_results(spark, sf_dir), D.as_of(), OPTIONS.ttl_days)
    return _result_rows(kept)


@query
def cache_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleared = results.clear(_results(spark, sf_dir))
    return cleared.records.select("key", "scan_id")


@query
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.cache_stats(_results(spark, sf_dir).records, D.as_of(), OPTIONS.ttl_days)


# Jobs


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.job_events(D.table(spark, sf_dir, "events"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.fold_jobs(_events(spark, sf_dir), D.as_of(D.JOBS_AS_OF))


def _micros(ts: str) -> Column:
    return F.unix_micros(ts).alias(ts)


@query
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select(
        "job_id",
        "status",
        *[_micros(ts) for ts in ("created_at", "started_at", "completed_at", "updated_at")],
        "active",
        "visible",
    )


@query
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every job, and of as many that never were."""
    folded = _jobs(spark, sf_dir)
    known = folded.select("job_id")
    ids = known.unionByName(known.select(F.concat("job_id", F.lit("-x")).alias("job_id")))
    return jobs.job_status(folded, ids).select("job_id", "status", "error")


@query
def cancel_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.cancel_guard(_events(spark, sf_dir)).select("job_id", "seq", "refused")


@query
def job_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_expiry(_events(spark, sf_dir)).select("job_id", "seq", "action")


@query
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last log row per job, taken as its record."""
    updates = _events(spark, sf_dir).withColumn("updated_at", F.struct("ts", "seq"))
    return jobs.latest_jobs(updates).select("job_id", "seq", "action")


@query
def queue_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_next(_jobs(spark, sf_dir), 5).select("job_id", _micros("created_at"))


@query
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_stats(_jobs(spark, sf_dir))


@query
def jobs_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.jobs_overview(_jobs(spark, sf_dir), OPTIONS)


@query
def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.active_jobs(_jobs(spark, sf_dir))


@query
def remove_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active jobs that are not waiting any more."""
    folded = _jobs(spark, sf_dir)
    queued = folded.filter(F.col("status") == "queued")
    return jobs.remove_ids(jobs.active_jobs(folded), queued)


@query
def accept_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = requests.parse_requests(D.requests(_pages(spark, sf_dir)))
    good = requests.validate_requests(parsed).filter(F.col("error").isNull())
    queued = jobs.enqueue(good, D.as_of()).withColumn("job_id", F.col("seq").cast("string"))
    return messages.accept_responses(queued)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished = D.outcomes(D.table(spark, sf_dir, "events"), _pages(spark, sf_dir))
    crawled = finished.select(
        "job_id", F.lit(4).alias("pages_visited"), F.lit(2).alias("n_emails")
    )
    return job_outcomes(
        finished, _results(spark, sf_dir).records, crawled, D.as_of(), OPTIONS
    )


@query
def job_outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select(
        "job_id", "status", "error", "pages_visited", "n_emails", "from_cache", "kept"
    )


@query
def jobs_from_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs a stored result completes at once."""
    finished = D.outcomes(D.table(spark, sf_dir, "events"), _pages(spark, sf_dir))
    looked_up = complete_from_results(
        finished, _results(spark, sf_dir).records, D.as_of(), OPTIONS
    )
    return looked_up.filter("hit").select("job_id", "scan_id", "pages_visited", "n_emails")


# Delivery


@query
def webhook_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages read back field by field; stored results give the address lists."""
    done = stored(_outcomes(spark, sf_dir))
    found = _results(spark, sf_dir)
    answered = done.filter("from_cache").select("job_id", U.url_key(F.col("url")).alias("key"))
    lists = addresses.email_lists(found.emails, ["key"])
    answered = spread_join(answered, lists, ["key"])
    schema = (
        "job_id string, callback_id string, status string, url string, emails array<string>,"
        "crawl_time string, pages_visited int, completed_at string, error string"
    )
    sent = delivery.webhook_payloads(done, answered.drop("key"), D.as_of())
    return sent.select("webhook_url", "part", F.from_json("body", schema).alias("b")).select(
        "b.job_id",
        "webhook_url",
        "part",
        "b.callback_id",
        "b.status",
        "b.url",
        F.array_join("b.emails", ",").alias("emails"),
        "b.pages_visited",
        F.substring("b.completed_at", 1, 19).alias("completed_at"),
        "b.error",
    )


@query
def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = D.attempts(D.table(spark, sf_dir, "events"))
    return delivery.delivery_outcomes(log, OPTIONS.webhook_retries)


@query
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = D.attempts(D.table(spark, sf_dir, "events"))
    sent = log.select("job_id").distinct()
    return delivery.backoff_schedule(sent, OPTIONS.webhook_retries)


# Streams: the input arrives in three parts, each worked off before the next; the sink is
# read back.


def _in_parts(
    df: DataFrame, order: str, path: str, start: Callable[[DataFrame], DataStreamWriter]
) -> None:
    """Let ``df`` arrive at ``path`` in the order of ``order`` and run the stream each time."""
    spark = df.sparkSession
    place = F.col(order).cast("double")
    low, high = df.agg(F.percentile_approx(place, [0.34, 0.67])).first()[0]
    for part in (place <= low, (place > low) & (place <= high), place > high):
        df.filter(part).write.mode("append").parquet(path)
        source = spark.readStream.schema(df.schema).parquet(path)
        start(source).trigger(availableNow=True).start().awaitTermination()


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


@query
def stream_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses per host, from the site pages as they come in."""
    folder = _folder(spark)
    given = D.site_pages(_pages(spark, sf_dir)).select(
        "url",
        "status",
        "html",
        (D.as_of() + F.make_dt_interval(secs=F.col("page_id"))).alias("fetched_at"),
    )

    def start(source: DataFrame) -> DataStreamWriter:
        found = contacts.stream_contacts(source, "fetched_at", "3650 days")
        return found.writeStream.option("checkpointLocation", f"{folder}/progress").option(
            "path", f"{folder}/out"
        )

    _in_parts(given, "fetched_at", f"{folder}/in", start)
    schema = "fetched_at timestamp, host string, email string"
    return spark.read.schema(schema).parquet(f"{folder}/out").select("host", "email")


@query
def stream_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last state of every job, from its actions as they come in."""
    folder = _folder(spark)

    def start(source: DataFrame) -> DataStreamWriter:
        return live_jobs.stream_job_state(source, folder)

    _in_parts(stored(_events(spark, sf_dir)), "ts", f"{folder}/in", start)
    state = live_jobs.read_state(spark, folder, batch_id=2)
    times = ("created_at", "started_at", "completed_at", "updated_at")
    return state.select("job_id", "status", *[_micros(ts) for ts in times], "active")


@query
def stream_job_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last state of every job, kept in a keyed state store that each batch touches only
    where it has actions."""
    folder = _folder(spark)

    def start(source: DataFrame) -> DataStreamWriter:
        return keyed.stream_keyed_jobs(source, folder, expire=False)

    _in_parts(stored(_events(spark, sf_dir)), "ts", f"{folder}/in", start)
    changes = spark.read.schema(keyed.OUTPUT).parquet(f"{folder}/out")
    times = ("created_at", "started_at", "completed_at", "updated_at")
    return keyed.latest_states(changes).select("job_id", "status", *times, "active")


@query
def stream_job_refold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last state of every job when the log comes in three parts dealt by a hash of the
    action, not by time: late actions refold their job."""
    folder = _folder(spark)

    def start(source: DataFrame) -> DataStreamWriter:
        return keyed.stream_keyed_jobs(source, folder, expire=False, refold=True)

    shuffled = stored(_events(spark, sf_dir)).withColumn("_part", F.pmod(F.xxhash64("seq"), F.lit(1000)))
    _in_parts(shuffled, "_part", f"{folder}/in", start)
    changes = spark.read.schema(keyed.OUTPUT).parquet(f"{folder}/out")
    times = ("created_at", "started_at", "completed_at", "updated_at")
    return keyed.latest_states(changes).select("job_id", "status", *times, "active")


@query
def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that ended and were forgotten by their timer once the watermark passed the end
    of their record, with the state they had."""
    folder = _folder(spark)

    def start(source: DataFrame) -> DataStreamWriter:
        return keyed.stream_keyed_jobs(source, folder, expire=True)

    _in_parts(stored(_events(spark, sf_dir)), "ts", f"{folder}/in", start)
    changes = spark.read.schema(keyed.OUTPUT).parquet(f"{folder}/out")
    return changes.filter(F.col("kind") == "expired").select(
        "job_id", "status", "completed_at", "updated_at", "seen_at"
    )


@query
def jobs_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job records kept in a keyed store: the log is folded in three parts, and each part
    commits only the jobs it changed, upserted by ``job_id``."""
    events = _events(spark, sf_dir)
    store = KeyedStore(spark, _folder(spark), ["job_id"], ["seen_at"])
    place = F.col("ts").cast("double")
    low, high = events.agg(F.percentile_approx(place, [0.34, 0.67])).first()[0]
    state = spark.createDataFrame([], jobs.STATE_SCHEMA)
    for part in (place <= low, (place > low) & (place <= high), place > high):
        store.commit(jobs.advance_jobs(state, events.filter(part)))
        state = store.read()
    times = ("created_at", "started_at", "completed_at", "updated_at")
    return state.select("job_id", "status", *[_micros(ts) for ts in times], "active")


@query
def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of all requests, served batch by batch; later batches find earlier results."""
    folder = _folder(spark)
    given = _pages(spark, sf_dir)
    asked = D.requests(given).withColumn(
        "requested_at", D.as_of() + F.make_dt_interval(secs=F.col("request_id"))
    )
    site = stored(D.site_pages(given).select("page_id", "url", "status", "html"))

    def start(source: DataFrame) -> DataStreamWriter:
        return live_scan.stream_scan(source, site, f"{folder}/out")

    _in_parts(asked, "request_id", f"{folder}/in", start)
    done = spark.read.parquet(f"{folder}/out/jobs")
    return done.select(
        "url", "webhook_url", "callback_id", "status", "pages_visited", "n_emails"
    )
