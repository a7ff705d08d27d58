"""Messages to webhooks, and what became of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions.emails import omit_empty
from contactloom.functions.records import duration_text, to_record


def deliverable(jobs: DataFrame) -> DataFrame:
    """Jobs that send a message: completed or failed, with a webhook URL."""
    return jobs.filter(
        F.col("status").isin("completed", "failed") & (F.coalesce("webhook_url", F.lit("")) != "")
    )


def webhook_payloads(jobs: DataFrame, lists: DataFrame, sent_at: Column) -> DataFrame:
    """Messages of finished jobs: ``job_id, webhook_url, part, body``.

    ``lists`` holds the addresses per job (``job_id, part, emails``). An address list in
    several parts makes several messages, each with its part number; a single one carries
    none. ``completed_at`` is the time of sending.
    """
    empty = F.col("pages_visited") == 0
    messages = deliverable(jobs).join(lists, "job_id", "left")
    parts = F.coalesce("part", F.lit(0))
    body = to_record(
        F.col("job_id"),
        F.when(F.col("callback_id") != "", F.col("callback_id")).alias("callback_id"),
        F.col("status"),
        F.col("url"),
        omit_empty(F.col("emails")).alias("emails"),
        duration_text(F.col("crawl_seconds")).alias("crawl_time"),
        F.when(~empty, F.col("pages_visited")).alias("pages_visited"),
        sent_at.alias("completed_at"),
        F.when(F.col("error") != "", F.col("error")).alias("error"),
        F.when(parts > 0, parts).alias("part"),
    )
    return messages.select("job_id", "webhook_url", parts.alias("part"), body.alias("body"))


def delivery_outcomes(attempts: DataFrame, retries: int = 3) -> DataFrame:
    """Per message: delivered at the first 2xx answer within ``retries`` attempts, or failed.

    A transport error has no status. Rows beyond the last allowed attempt do not count.
    """
    success = F.col("http_status").between(200, 299)
    allowed = F.col("attempt") <= retries
    summary = attempts.groupBy("job_id").agg(
        F.min(F.when(allowed & success, F.col("attempt"))).alias("delivered_at"),
        F.coalesce(F.max(F.when(allowed, F.col("attempt"))), F.lit(0)).alias("_tried"),
    )
    tries = F.coalesce("delivered_at", "_tried")
    return summary.select(
        "job_id",
        F.col("delivered_at").isNotNull().alias("delivered"),
        "delivered_at",
        tries.alias("attempts"),
        (tries * (tries - 1)).alias("waited_s"),
    )


def backoff_seconds(retries: Column) -> Column:
    """Waits after each failed attempt but the last: two seconds more every time."""
    return F.when(
        retries > 1, F.transform(F.sequence(F.lit(1), retries - 1), lambda k: 2 * k)
    ).otherwise(F.array().cast("array<int>"))


def backoff_schedule(messages: DataFrame, retries: int = 3) -> DataFrame:
    """Wait after every possible attempt of every message: ``job_id, attempt, wait_s``."""
    return messages.select("job_id", F.posexplode(backoff_seconds(F.lit(retries)))).select(
        "job_id", (F.col("pos") + 1).alias("attempt"), F.col("col").alias("wait_s")
    )
