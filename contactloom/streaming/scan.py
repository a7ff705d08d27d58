"""Scans from a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from contactloom.operators.addresses import email_lists
from contactloom.operators.delivery import webhook_payloads
from contactloom.operators.jobs import enqueue
from contactloom.operators.results import Results, empty_results, read_results
from contactloom.operators.skew import spread_join
from contactloom.options import ScanOptions
from contactloom.plans.scan import scan
from contactloom.session import stored
from contactloom.sources.requests import parse_requests, validate_requests


def _results_before(spark: SparkSession, path: str, batch_id: int, initial: Results) -> Results:
    return read_results(spark, f"{path}/results/{batch_id - 1}") if batch_id else initial


def scan_requests(
    requests: DataFrame,
    pages: DataFrame,
    path: str,
    batch_id: int,
    options: ScanOptions,
    initial: Results,
) -> None:
    """Serve one batch of requests (``request_id, body, requested_at``).

    Reads the results the batch before left behind and writes, each to a folder of this
    batch: the results, the jobs, the messages to send, and the requests turned down. The
    same batch run again writes the same folders again. The time of the batch is that of
    its newest request.
    """
    spark = requests.sparkSession
    checked = stored(validate_requests(parse_requests(requests)))
    newest = checked.agg(F.max("requested_at")).first()[0]
    as_of = F.lit(newest).cast("timestamp")
    good = checked.filter(F.col("error").isNull())
    seeds = good.select(F.col("request_id").alias("seed_id"), F.col("target").alias("url"),
                        "requested_at")
    before = _results_before(spark, path, batch_id, initial)
    done = scan(seeds, pages, before, as_of, options)
    for name, table in (("records", done.results.records), ("emails", done.results.emails)):
        table.write.mode("overwrite").parquet(f"{path}/results/{batch_id}/{name}")

    queued = enqueue(good, as_of).select(
        F.col("seq").alias("seed_id"), "job_id", "url", "webhook_url", "callback_id"
    )
    answered = done.responses.withColumnRenamed("error", "refused")
    jobs = stored(
        queued.join(answered, "seed_id").select(
            "job_id",
            "url",
            "webhook_url",
            "callback_id",
            F.when(F.col("refused").isNull(), "completed").otherwise("failed").alias("status"),
            F.when(F.col("refused").isNotNull(), F.concat(F.lit("Invalid URL: "), "url")).alias(
                "error"
            ),
            "from_cache",
            F.coalesce("pages_visited", F.lit(0)).alias("pages_visited"),
            F.coalesce("n_emails", F.lit(0)).alias("n_emails"),
            F.lit(None).cast("double").alias("crawl_seconds"),
            as_of.alias("completed_at"),
            "key",
            "scan_id",
        )
    )
    jobs.drop("key", "scan_id").write.mode("overwrite").parquet(f"{path}/jobs/batch={batch_id}")

    asked = jobs.select("key", "scan_id").distinct()
    found = done.answers.emails.join(asked, ["key", "scan_id"], "left_semi")
    lists = spread_join(
        jobs.select("job_id", "key", "scan_id"),
        email_lists(found, ["key", "scan_id"]),
        ["key", "scan_id"],
    )
    webhook_payloads(jobs, lists.select("job_id", "part", "emails"), as_of).write.mode(
        "overwrite"
    ).parquet(f"{path}/payloads/batch={batch_id}")
    checked.filter(F.col("error").isNotNull()).select("request_id", "error").write.mode(
        "overwrite"
    ).parquet(f"{path}/refused/batch={batch_id}")


def stream_scan(
    requests: DataFrame,
    pages: DataFrame,
    path: str,
    options: ScanOptions | None = None,
    initial: Results | None = None,
) -> DataStreamWriter:
    """A writer that serves every batch of a request stream; set its trigger and start it."""
    options = options or ScanOptions()
    first = initial or empty_results(requests.sparkSession)

    def serve(batch: DataFrame, batch_id: int) -> None:
        scan_requests(batch, pages, path, batch_id, options, first)

    return requests.writeStream.foreachBatch(serve).option("checkpointLocation", f"{path}/progress")
