"""Joins whose keys may be hot: one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more than 1/SALTS of all rows is hot; its rows are dealt over SALTS tasks.
# There are at most SALTS hot keys, so their list is small enough to send to every task.
SALTS = 1024


def hot_keys(counts: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Keys of ``counts`` whose ``count`` is above ``total / SALTS``: at most SALTS rows."""
    return counts.filter(F.col(count) * SALTS > total).select(*keys)


def spread_join(
    rows: DataFrame, keyed: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner"
) -> DataFrame:
    """``rows`` joined to ``keyed`` (one row per key) on ``keys``.

    Rows of a hot key get a salt drawn per row, and the hot keys of ``keyed`` are repeated
    once per salt, so a key that holds a third of ``rows`` is spread over SALTS tasks and
    no task gets more than a share of the others. Any salt finds its partner, so a row
    drawn again after a lost task still meets it. ``how`` is ``inner`` or ``left``.
    """
    flag = "_hot_" + "_".join(keys)
    marked = rows.join(F.broadcast(hot.withColumn(flag, F.lit(True))), keys, "left")
    salted = marked.withColumn(
        "_salt", F.when(F.col(flag), (F.rand(17) * SALTS).cast("int")).otherwise(F.lit(0))
    ).drop(flag)
    repeated = (
        keyed.join(F.broadcast(hot.withColumn(flag, F.lit(True))), keys, "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col(flag), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
            ),
        )
        .drop(flag)
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
