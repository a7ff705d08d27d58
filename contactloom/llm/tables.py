"""Reading the given tables and helpers that all operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of at most two longs that are small enough to be sent to every executor.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if a count proves that it has at most ``rows`` rows.

    For stored tables, whose count is read from their footers. Beyond the bound the join
    is left to the planner, which shuffles both sides.
    """
    return F.broadcast(df) if df.count() <= rows else df


def text_key(text: Column) -> list[Column]:
    """96 bits that stand for a text: ``text_a``, ``text_b``."""
    return [F.xxhash64(text).alias("text_a"), F.hash(text).alias("text_b")]


def crc_fold(doc_id: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the id as text; NULL ids count as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), folds)


def by_size(texts: Iterable[str], most: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``most`` characters together, with the position of the first.

    A longer text is a run of its own, so memory is bounded by the longest text.
    """
    run: list[str] = []
    first = total = 0
    for i, text in enumerate(texts):
        if run and total + len(text) > most:
            yield first, run
            run, first, total = [], i, 0
        run.append(text)
        total += len(text)
    if run:
        yield first, run
