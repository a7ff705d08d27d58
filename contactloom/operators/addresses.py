"""Addresses and figures per start URL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators.skew import ROWS_PER_TASK, Ordered, Total, spread_join

# Most addresses in one message list; longer lists come in numbered parts.
LIST_LENGTH = 10_000


def reach_emails(
    reach: DataFrame, page_emails: DataFrame, rows: int = ROWS_PER_TASK
) -> DataFrame:
    """Distinct addresses on the reached pages: ``start, email``.

    A page reached by very many starts is spread over several tasks.
    """
    return (
        spread_join(reach.select("start", "url"), page_emails, ["url"], rows=rows)
        .select("start", "email")
        .distinct()
    )


def union_emails(*found: DataFrame) -> DataFrame:
    """Union of address tables without repeats."""
    merged = found[0]
    for other in found[1:]:
        merged = merged.unionByName(other)
    return merged.distinct()


def email_lists(
    found: DataFrame,
    by: Sequence[str],
    length: int = LIST_LENGTH,
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Sorted address lists: the columns of ``by``, ``part``, ``emails``.

    A list longer than ``length`` continues in parts 1, 2, …, each sorted and above the
    one before, so that no list outgrows a task. Rows must be distinct.
    """
    ranked = Ordered(found.select(*by, "email"), by, ["email"], rows).running(
        {"rank": Total(F.lit(1))}
    )
    return (
        ranked.result()
        .groupBy(*by, F.floor((F.col("rank") - 1) / length).cast("int").alias("part"))
        .agg(F.sort_array(F.collect_list("email")).alias("emails"))
    )


def pages_visited(reach: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Number of reached pages per start: ``start, pages_visited, max_depth_reached``.

    Given ``found`` (``start, email``), ``pages_visited`` is the number of addresses
    instead, for readers that expect that number under this name.
    """
    figures = reach.groupBy("start").agg(
        F.count(F.lit(1)).cast("int").alias("pages_visited"),
        F.max("depth").alias("max_depth_reached"),
    )
    if found is None:
        return figures
    mails = found.groupBy("start").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return figures.join(mails, "start", "left").select(
        "start", F.coalesce("n", F.lit(0)).alias("pages_visited"), "max_depth_reached"
    )
