"""The scan of many start URLs: check, look up, crawl what is missing, keep, answer."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions.urls import canonical_url, url_host, url_key
from contactloom.operators.addresses import pages_visited, reach_emails
from contactloom.operators.graph import crawl, crawl_exact
from contactloom.operators.pages import page_contents, page_emails, site_edges
from contactloom.operators.parsed import ParsedSites
from contactloom.operators.results import Results, lookup, upsert_results
from contactloom.operators.skew import ROWS_PER_TASK, spread_join
from contactloom.options import ScanOptions
from contactloom.session import stored
from contactloom.sources.pages import latest_pages, pages_of_hosts
from contactloom.sources.requests import validate_seeds


class Crawled(NamedTuple):
    """Per start: figures (``start, pages_visited, max_depth_reached``) and addresses."""

    figures: DataFrame
    emails: DataFrame


class Scan(NamedTuple):
    """Answers, one row per seed; the results they rest on; the results to keep."""

    responses: DataFrame
    answers: Results
    results: Results


def crawl_sites(
    starts: DataFrame,
    pages: DataFrame,
    options: ScanOptions,
    exact: bool = False,
    compat: bool = False,
    rows: int = ROWS_PER_TASK,
    parsed: ParsedSites | None = None,
) -> Crawled:
    """Walk the sites of ``starts`` (one column ``start``) and collect their addresses.

    Only pages on the hosts of the starts are read and parsed, once for all starts. With
    ``parsed`` (kept up to date with ``pages``) nothing is parsed: the pages of those hosts
    are read from their buckets of the store.
    """
    starts = starts.select("start").distinct()
    hosts = starts.select(url_host(F.col("start")).alias("host"))
    if parsed is not None:
        contents = stored(parsed.contents(hosts))
    else:
        contents = stored(page_contents(latest_pages(pages_of_hosts(pages, hosts), rows=rows)))
    walk = crawl_exact if exact else crawl
    reach = walk(starts, site_edges(contents), options.max_depth, rows=rows)
    emails = stored(reach_emails(reach, page_emails(contents), rows))
    return Crawled(pages_visited(reach, emails if compat else None), emails)


def scan(
    seeds: DataFrame,
    pages: DataFrame,
    results: Results,
    as_of: Column,
    options: ScanOptions | None = None,
    compat: bool = False,
    rows: int = ROWS_PER_TASK,
    parsed: ParsedSites | None = None,
) -> Scan:
    """Answer ``seeds`` (``seed_id, url, requested_at``) from ``results`` and ``pages``.

    Of several seeds with one key the first is crawled, from its full URL; the others are
    answered by its result, as they would be one after the other. Without a cache every
    seed counts as crawled, though equal starts share the work, and nothing is kept. A
    start without content gives an empty result, which is kept like any other.
    """
    options = options or ScanOptions()
    checked = validate_seeds(seeds)
    valid = checked.filter(F.col("error").isNull()).select(
        "seed_id",
        "requested_at",
        url_key(F.col("target")).alias("key"),
        canonical_url(F.col("target")).alias("start"),
    )
    if options.cache_enabled:
        looked_up = stored(lookup(valid, results.records, as_of, options.ttl_days, rows))
        misses = looked_up.filter("not hit").select(*valid.columns)
        group = ["key"]
    else:
        looked_up, misses, group = None, stored(valid), ["key", "start"]

    order = F.struct("requested_at", "seed_id")
    leaders = misses.groupBy(*group).agg(
        F.min_by(F.struct("seed_id", "start"), order).alias("first")
    )
    leaders = leaders.select(
        "key",
        F.col("first.start").alias("start"),
        F.col("first.seed_id").alias("leader"),
        F.col("first.seed_id").cast("string").alias("scan_id"),
    )
    crawled = crawl_sites(leaders, pages, options, compat=compat, rows=rows, parsed=parsed)

    counts = crawled.emails.groupBy("start").agg(F.count(F.lit(1)).cast("int").alias("n_emails"))
    records = stored(
        leaders.join(crawled.figures, "start", "left")
        .join(counts, "start", "left")
        .select(
            "key",
            "scan_id",
            as_of.alias("cached_at"),
            F.lit(options.max_depth).alias("depth"),
            F.coalesce("pages_visited", F.lit(0)).alias("pages_visited"),
            F.coalesce("n_emails", F.lit(0)).alias("n_emails"),
            "start",
            "leader",
        )
    )
    names = records.select("start", "key", "scan_id")
    emails = spread_join(crawled.emails, names, ["start"], rows=rows).select(
        "key", "scan_id", "email"
    )
    new = Results(records.drop("start", "leader"), emails)

    shown = ["seed_id", "key", "scan_id", "from_cache", "depth", "pages_visited", "n_emails"]
    by = records if group != ["key"] else records.drop("start")
    crawled_rows = (
        spread_join(misses, by, group, rows=rows)
        .withColumn(
            "from_cache", F.lit(options.cache_enabled) & (F.col("seed_id") != F.col("leader"))
        )
        .select(*shown)
    )
    rows_out = crawled_rows
    if looked_up is not None:
        hits = looked_up.filter("hit").withColumn("from_cache", F.lit(True)).select(*shown)
        rows_out = hits.unionByName(crawled_rows)
    refused = checked.filter(F.col("error").isNotNull()).select(
        "seed_id", F.lit(False).alias("from_cache"), "error"
    )
    responses = rows_out.withColumn("error", F.lit(None).cast("string")).unionByName(
        refused, allowMissingColumns=True
    )
    if not options.cache_enabled:
        return Scan(responses, new, results)
    kept = upsert_results(results, new)
    return Scan(responses, kept, kept)
