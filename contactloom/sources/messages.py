"""Answers to requests, and the sink for messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.functions.emails import omit_empty
from contactloom.functions.records import duration_text, to_record
from contactloom.operators.skew import ROWS_PER_TASK, spread_join

# Fixed value: the time a new job is said to take.
ESTIMATE = "30-60s"


def scan_responses(
    responses: DataFrame, lists: DataFrame, compat: bool = True, rows: int = ROWS_PER_TASK
) -> DataFrame:
    """JSON answers of a scan: ``seed_id, part, body``.

    ``lists`` holds the addresses per stored result (``key, scan_id, part, emails``). With
    ``compat`` an empty list is left out of the JSON, otherwise it is written as ``[]``.
    """
    seconds = F.col("crawl_seconds") if "crawl_seconds" in responses.columns else F.lit(None)
    answered = spread_join(responses, lists, ["key", "scan_id"], "left", rows)
    part = F.coalesce("part", F.lit(0))
    emails = F.coalesce("emails", F.array().cast("array<string>"))
    shown = omit_empty(emails) if compat else F.when(F.col("error").isNull(), emails)
    body = to_record(
        shown.alias("emails"),
        F.col("error"),
        F.col("from_cache"),
        duration_text(seconds.cast("double")).alias("crawl_time"),
        F.when(part > 0, part).alias("part"),
    )
    return answered.select("seed_id", part.alias("part"), body.alias("body"))


def accept_responses(jobs: DataFrame) -> DataFrame:
    """Answers to accepted requests."""
    return jobs.select(
        "job_id",
        F.lit("queued").alias("status"),
        F.lit(ESTIMATE).alias("estimated_time"),
        "webhook_url",
        F.concat(F.lit("/scan/status/"), F.col("job_id")).alias("check_status_url"),
    )


def write_messages(messages: DataFrame, path: str) -> None:
    """One JSON object per line."""
    messages.write.json(path)
