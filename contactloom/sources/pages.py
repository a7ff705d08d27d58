"""Stored page snapshots and start URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.functions.urls import canonical_url, url_host
from contactloom.operators.skew import ROWS_PER_TASK, spread_join

PAGE_SCHEMA = "page_id long, url string, status int, html string"


def with_status(pages: DataFrame) -> DataFrame:
    """A snapshot table without a status column holds fetched pages only."""
    if "status" in pages.columns:
        return pages
    return pages.withColumn("status", F.lit(200))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page table from parquet. Columns not asked for later are never read."""
    return with_status(spark.read.parquet(path))


def stream_pages(
    spark: SparkSession, path: str, schema: str = PAGE_SCHEMA, **options: str
) -> DataFrame:
    """The same as a file stream."""
    return with_status(spark.readStream.schema(schema).options(**options).parquet(path))


def ok_pages(pages: DataFrame) -> DataFrame:
    """Only status 200 has content. Reached pages without content stay reached."""
    return pages.filter(F.col("status") == 200)


def latest_pages(
    pages: DataFrame, version: str = "page_id", rows: int = ROWS_PER_TASK
) -> DataFrame:
    """One snapshot per page, the one with the highest ``version``.

    Versions may repeat, within a page and across pages. Of several snapshots of a page with its highest
    version a hash of the whole row decides. To find the pages with several snapshots only URLs,
    versions and hashes are shuffled; of the markup only theirs is grouped.
    """
    named = pages.withColumn("url", canonical_url(F.col("url"))).filter(F.col("url").isNotNull())
    named = named.withColumn("_tie", F.xxhash64(*named.columns))
    repeated = (
        named.groupBy("url")
        .agg(
            F.max(F.struct(F.col(version).alias("version"), "_tie")).alias("_newest"),
            F.count(F.lit(1)).alias("_copies"),
        )
        .filter(F.col("_copies") > 1)
        .select("url", "_newest")
    )
    single = named.join(repeated.select("url"), "url", "left_anti")
    newest = (
        spread_join(named, repeated, ["url"], rows=rows)
        .filter(F.struct(F.col(version).alias("version"), "_tie").eqNullSafe(F.col("_newest")))
        .dropDuplicates(["url"])
    )
    return single.unionByName(newest.select(*single.columns)).select(*pages.columns)


def pages_of_hosts(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Pages on the given hosts (one column ``host``): the only ones a crawl can use."""
    return (
        pages.withColumn("host", url_host(canonical_url(F.col("url"))))
        .join(hosts.select("host").distinct(), "host", "left_semi")
        .drop("host")
    )


def read_seeds(df: DataFrame) -> DataFrame:
    """Start URLs in bulk; one URL is a table of one row."""
    return df.select(
        F.col("seed_id").cast("long").alias("seed_id"),
        F.col("url").cast("string").alias("url"),
        F.col("requested_at").cast("timestamp").alias("requested_at"),
    )
