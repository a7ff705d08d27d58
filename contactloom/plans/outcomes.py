"""What becomes of queued scan jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions.urls import is_parseable, url_key
from contactloom.operators.results import lookup
from contactloom.operators.skew import ROWS_PER_TASK
from contactloom.options import ScanOptions


def apply_timeout(seconds: Column, options: ScanOptions) -> Column:
    """True for crawls that ran into the time limit; looked at only after the crawl."""
    return seconds >= options.job_timeout_s


def complete_from_results(
    jobs: DataFrame,
    records: DataFrame,
    as_of: Column,
    options: ScanOptions | None = None,
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Jobs with the stored result of their URL, and ``hit``."""
    options = options or ScanOptions()
    keyed = jobs.withColumn("key", url_key(F.col("url")))
    if not options.cache_enabled:
        records = records.limit(0)
    return lookup(keyed, records, as_of, options.ttl_days, rows)


def job_outcomes(
    jobs: DataFrame,
    records: DataFrame,
    crawled: DataFrame,
    as_of: Column,
    options: ScanOptions | None = None,
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Status, error and figures of every job, and whether its result is to be kept.

    ``jobs`` has ``job_id, url, webhook_url, callback_id, crawl_seconds``, ``crawled`` the
    crawl figures per job (``job_id, pages_visited, n_emails``). A stored result completes
    a job at once, whatever its URL or time; then come bad URLs, then crawls that took too
    long; the rest complete and are kept.
    """
    options = options or ScanOptions()
    looked_up = complete_from_results(jobs, records, as_of, options, rows)
    figures = crawled.select(
        "job_id",
        F.col("pages_visited").alias("_pages"),
        F.col("n_emails").alias("_emails"),
    )
    error = F.when(
        ~F.col("hit"),
        F.when(~is_parseable(F.col("url")), F.concat(F.lit("Invalid URL: "), "url")).when(
            apply_timeout(F.col("crawl_seconds"), options), F.lit("Job timed out")
        ),
    )
    done = F.col("error").isNull()
    fresh = done & ~F.col("hit")
    return (
        looked_up.join(figures, "job_id", "left")
        .withColumn("error", error)
        .select(
            "job_id",
            "url",
            "webhook_url",
            "callback_id",
            "crawl_seconds",
            F.when(done, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
            "error",
            F.when(F.col("hit"), F.col("pages_visited"))
            .when(done, F.coalesce("_pages", F.lit(0)))
            .otherwise(F.lit(0))
            .alias("pages_visited"),
            F.when(F.col("hit"), F.col("n_emails"))
            .when(done, F.coalesce("_emails", F.lit(0)))
            .otherwise(F.lit(0))
            .alias("n_emails"),
            F.col("hit").alias("from_cache"),
            (fresh & F.lit(options.cache_enabled)).alias("kept"),
        )
    )
