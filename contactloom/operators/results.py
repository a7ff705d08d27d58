"""Stored scan results: lookup by key, expiry, upsert, invalidation.

A result is one record and any number of address rows. Addresses are rows, not an array
in the record, so the result of a huge site is spread like any other rows. ``key`` and
``scan_id`` tie the two tables together. An empty result is a valid one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.functions.emails import dedup_emails
from contactloom.functions.records import expires_at, from_record
from contactloom.functions.urls import url_key_raw
from contactloom.operators.skew import ROWS_PER_TASK, spread_join
from contactloom.session import stored

RECORD_SCHEMA = (
    "key string, scan_id string, cached_at timestamp, depth int, pages_visited int, n_emails int"
)
EMAIL_SCHEMA = "key string, scan_id string, email string"


class Results(NamedTuple):
    records: DataFrame
    emails: DataFrame


def empty_results(spark: SparkSession) -> Results:
    return Results(spark.createDataFrame([], RECORD_SCHEMA), spark.createDataFrame([], EMAIL_SCHEMA))


def read_results(spark: SparkSession, path: str) -> Results:
    return Results(
        spark.read.schema(RECORD_SCHEMA).parquet(f"{path}/records"),
        spark.read.schema(EMAIL_SCHEMA).parquet(f"{path}/emails"),
    )


def write_results(results: Results, path: str) -> None:
    """Write to a new folder; readers switch to it once it is complete."""
    results.records.write.parquet(f"{path}/records")
    results.emails.write.parquet(f"{path}/emails")


def publish_results(results: Results, path: str) -> int:
    """Publish records and addresses as one version of ``path``; returns the version.

    Readers of ``read_published`` see both tables of a version or neither.
    """
    from contactloom.operators.store import Published

    return Published(results.records.sparkSession, path).publish(
        {"records": results.records, "emails": results.emails}
    )


def read_published(spark: SparkSession, path: str, version: int | None = None) -> Results:
    """The newest (or the given) published version of ``path``."""
    from contactloom.operators.store import Published

    tables = Published(spark, path).read(version)
    return Results(tables["records"], tables["emails"])


def results_from_json(kept: DataFrame) -> Results:
    """Results kept as ``key, value`` with JSON values; an unreadable value is a miss."""
    record = from_record(F.col("value"))
    rows = kept.select("key", record.alias("r")).filter(F.col("r").isNotNull())
    mails = F.coalesce(dedup_emails(F.col("r.emails")), F.array().cast("array<string>"))
    scan_id = F.lit("import")
    return Results(
        rows.select(
            "key",
            scan_id.alias("scan_id"),
            F.col("r.timestamp").alias("cached_at"),
            F.coalesce("r.crawl_info.depth", F.lit(0)).alias("depth"),
            F.coalesce("r.crawl_info.pages_visited", F.lit(0)).alias("pages_visited"),
            F.size(mails).alias("n_emails"),
        ),
        rows.select("key", scan_id.alias("scan_id"), F.explode(mails).alias("email")),
    )


def live_records(records: DataFrame, as_of: Column, ttl_days: int) -> DataFrame:
    """Records whose time to live has not run out; reading does not renew it."""
    return records.filter(as_of < expires_at(F.col("cached_at"), ttl_days))


def lookup(
    requests: DataFrame,
    records: DataFrame,
    as_of: Column,
    ttl_days: int,
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Requests with the columns of the live record of their key, and ``hit``.

    Very many requests for one key are spread over several tasks.
    """
    live = live_records(records, as_of, ttl_days).withColumn("hit", F.lit(True))
    return spread_join(requests, live, ["key"], how="left", rows=rows).withColumn(
        "hit", F.coalesce("hit", F.lit(False))
    )


def split_hits(
    requests: DataFrame,
    records: DataFrame,
    as_of: Column,
    ttl_days: int,
    rows: int = ROWS_PER_TASK,
) -> tuple[DataFrame, DataFrame]:
    """Requests answered by a live record, with its columns; and all others."""
    looked_up = lookup(requests, records, as_of, ttl_days, rows)
    hits = looked_up.filter("hit").drop("hit")
    return hits, looked_up.filter("not hit").select(*requests.columns)


def upsert_results(old: Results, new: Results) -> Results:
    """``old`` with the results of ``new`` put in; per key the latest write wins.

    Only the keys of ``new`` are compared. The rows that win are written out first, so that
    their size is known: while they are few, the stored tables merely stream past a
    broadcast of their keys.
    """
    newest = new.records.groupBy("key").agg(
        F.max_by(F.struct(*new.records.columns), F.struct("cached_at", "scan_id")).alias("r")
    )
    written = F.struct("cached_at", "scan_id")
    current = old.records.select("key", written.alias("stored"))
    winners = stored(
        newest.select("r.*")
        .join(current, "key", "left")
        .filter(F.col("stored").isNull() | (written >= F.col("stored")))
        .select(*new.records.columns)
    )
    keys = winners.select("key")
    return Results(
        old.records.join(keys, "key", "left_anti").unionByName(winners),
        old.emails.join(keys, "key", "left_anti").unionByName(
            new.emails.join(winners.select("key", "scan_id"), ["key", "scan_id"], "left_semi")
        ),
    )


def invalidate(results: Results, urls: DataFrame, compat: bool = False) -> Results:
    """Without the results of the given URLs (one column ``url``)."""
    keys = urls.select(url_key_raw(F.col("url"), compat).alias("key")).distinct()
    return Results(
        results.records.join(keys, "key", "left_anti"),
        results.emails.join(keys, "key", "left_anti"),
    )


def purge_expired(results: Results, as_of: Column, ttl_days: int) -> Results:
    """Without records whose time to live has run out, and without their addresses."""
    live = live_records(results.records, as_of, ttl_days)
    keys = live.select("key").distinct()
    return Results(live, results.emails.join(keys, "key", "left_semi"))


def clear(results: Results) -> Results:
    return Results(results.records.limit(0), results.emails.limit(0))


def cache_stats(
    records: DataFrame, as_of: Column, ttl_days: int, enabled: bool = True
) -> DataFrame:
    """One row: whether results are kept, and how many are live."""
    live = live_records(records, as_of, ttl_days).filter(F.lit(enabled))
    return live.agg(
        F.lit(enabled).alias("enabled"), F.count(F.lit(1)).cast("long").alias("cached_urls")
    )
