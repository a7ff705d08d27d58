"""Parsed pages kept in a keyed store by host bucket, brought up to date snapshot by snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.functions.urls import canonical_url, url_host
from contactloom.operators.pages import page_contents
from contactloom.operators.skew import ROWS_PER_TASK
from contactloom.operators.store import KeyedStore
from contactloom.sources.pages import latest_pages, ok_pages


class ParsedSites:
    """What crawls need of pages (``url, hits, hrefs, target``), parsed once.

    Rows are keyed by canonical URL and dealt to buckets by host, so the pages of some
    hosts are read from their buckets alone, and no page is parsed again for a scan.
    ``update`` parses only snapshots newer (by ``version``) than the one held for their
    URL; a newer snapshot that was no good fetch removes the page, as it would in a scan
    of all snapshots. Of equal versions the one held stays.
    """

    def __init__(self, spark: SparkSession, path: str, version: str = "page_id", buckets: int = 64):
        self.version = version
        self.store = KeyedStore(spark, path, ["url"], ["page_version"], buckets, bucket_by=["host"])

    def update(self, pages: DataFrame, rows: int = ROWS_PER_TASK) -> int:
        newest = latest_pages(pages, self.version, rows=rows).withColumn(
            "host", url_host(F.col("url"))
        )
        if self.store.versions():
            held = self.store.read(keys=newest.select("host")).select("url", F.col("page_version").alias("_held"))
            newest = newest.join(held, "url", "left").filter(
                F.col("_held").isNull() | (F.col(self.version) > F.col("_held"))
            ).drop("_held")
        newest = newest.withColumn("page_version", F.col(self.version).cast("long"))
        good = ok_pages(newest)
        contents = page_contents(good, "host", "page_version")
        gone = newest.join(good.select(canonical_url(F.col("url")).alias("url")), "url", "left_anti")
        return self.store.commit(contents, gone.select("url", "host"))

    def contents(self, hosts: DataFrame) -> DataFrame:
        """``url, hits, hrefs, target`` of the pages on ``hosts`` (one column ``host``)."""
        return self.store.read(keys=hosts.select("host")).select("url", "hits", "hrefs", "target")
