"""New contacts from a stream of page snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.functions.urls import url_host
from contactloom.operators.pages import mail_pages


def stream_contacts(pages: DataFrame, time: str, delay: str) -> DataFrame:
    """Addresses per host, each pair once: ``time, host, email``.

    ``time`` is the event-time column of ``pages``. Pairs are remembered until the
    watermark, ``delay`` behind the newest page, has passed them; rows behind it are late
    and dropped.
    """
    timed = pages.withWatermark(time, delay)
    contents = mail_pages(timed, time)
    return (
        contents.select(
            time,
            url_host(F.col("url")).alias("host"),
            F.explode(F.array_distinct("hits")).alias("email"),
        )
        .dropDuplicatesWithinWatermark(["host", "email"])
    )
