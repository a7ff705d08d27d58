"""Joins and running values that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.session import checkpointed, estimated_bytes

# Rows of one key that a single task may take.
ROWS_PER_TASK = 1_000_000
# Input of fewer bytes per allowed row is no trouble for a task even if it is all one key.
_BYTES_PER_ROW = 64
# Shares that rows without a key are dealt to; they match nothing, so nothing is repeated for them.
_KEYLESS_SHARES = 1_000


def heavy_keys(df: DataFrame, keys: Sequence[str], rows: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more than ``rows`` rows and the number of shares to cut each into.

    Counted with map-side partial sums. There are at most as many as all rows over ``rows``.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > rows)
        .select(*keys, F.ceil(F.col("_rows") / rows).cast("int").alias("_shares"))
    )


def _is_small(df: DataFrame, rows: int) -> bool:
    return estimated_bytes(df) <= rows * _BYTES_PER_ROW


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Inner or left equi-join whose left side may be dominated by a few keys.

    Rows of such a key are dealt over several tasks by a hash of the whole row, and
    the matching right rows are repeated once per share. Rows with a NULL key, which match nothing and which
    a left join keeps, are dealt likewise. All other keys join as usual, and so does a left side
    too small to need dealing.
    """
    keys = list(keys)
    if _is_small(left, rows):
        return left.join(right, keys, how)
    heavy = heavy_keys(left, keys, rows)
    shares = F.coalesce(F.col("_shares"), F.lit(1))
    keyless = reduce(or_, [F.col(key).isNull() for key in keys])
    dealt = (
        left.join(heavy, keys, "left")
        .withColumn(
            "_share",
            F.pmod(
                F.xxhash64(*left.columns), F.when(keyless, _KEYLESS_SHARES).otherwise(shares)
            ).cast("int"),
        )
        .drop("_shares")
    )
    repeated = (
        right.join(heavy, keys, "left")
        .withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
        .drop("_shares")
    )
    return dealt.join(repeated, [*keys, "_share"], how).drop("_share")


@dataclass(frozen=True)
class Last:
    """Last value that is not NULL."""

    value: Column


@dataclass(frozen=True)
class Total:
    """Sum of the values."""

    value: Column


@dataclass(frozen=True)
class Greatest:
    """Greatest value, NULL ignored."""

    value: Column


class Ordered:
    """Rows ordered within keys, ready for running values.

    While every key has at most ``rows`` rows, ordinary windows per key are used. If
    some key has more, the rows are cut into consecutive ranges of the whole order;
    running values are then computed per range, and what a range inherits from the
    ranges before it comes from one summary row per key and range. A key may thus span
    any number of tasks. The cut is checkpointed, so it is the same for all readers.
    Keys must not be NULL, and the order must be total within a key.
    """

    def __init__(
        self, df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = ROWS_PER_TASK
    ) -> None:
        self.keys = list(keys)
        self.order = list(order)
        self.df = df
        self.split = not _is_small(df, rows) and self._largest() > rows
        if self.split:
            parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            ranged = df.repartitionByRange(parts, *self.keys, *self.order)
            self.df = checkpointed(ranged.withColumn("_range", F.spark_partition_id()))

    def _largest(self) -> int:
        """Rows of the largest key."""
        return self.df.groupBy(*self.keys).count().agg(F.max("count")).first()[0] or 0

    def with_df(self, df: DataFrame) -> Ordered:
        """The same cut over changed rows (columns added, rows dropped)."""
        copy = object.__new__(Ordered)
        copy.keys, copy.order, copy.split, copy.df = self.keys, self.order, self.split, df
        return copy

    def running(
        self, values: dict[str, Last | Total | Greatest], before: bool = False
    ) -> Ordered:
        """Add running values up to each row, or up to the row before it."""
        groups = [*self.keys, "_range"] if self.split else self.keys
        window = (
            Window.partitionBy(*groups)
            .orderBy(*self.order)
            .rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
        )
        local = self.df.select(
            "*", *[_over(how, window).alias(name) for name, how in values.items()]
        )
        if not self.split:
            return self.with_df(local)
        return self.with_df(self._inherit(local, values))

    def _inherit(
        self, local: DataFrame, values: dict[str, Last | Total | Greatest]
    ) -> DataFrame:
        position = F.struct(*self.order)
        summary = self.df.groupBy(*self.keys, "_range").agg(
            *[_whole(how, position).alias(name) for name, how in values.items()]
        )
        earlier = (
            Window.partitionBy(*self.keys)
            .orderBy("_range")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = summary.select(
            *self.keys,
            "_range",
            *[
                _over(type(how)(F.col(name)), earlier).alias(f"_from_{name}")
                for name, how in values.items()
            ],
        )
        joined = local.join(carried, [*self.keys, "_range"])
        combined = {
            name: _combine(how, F.col(f"_from_{name}"), F.col(name)) for name, how in values.items()
        }
        return joined.select(
            *[F.col(c) for c in self.df.columns],
            *[column.alias(name) for name, column in combined.items()],
        )

    def result(self) -> DataFrame:
        return self.df.drop("_range") if self.split else self.df


def _over(how: Last | Total | Greatest, window) -> Column:
    if isinstance(how, Last):
        return F.last(how.value, ignorenulls=True).over(window)
    if isinstance(how, Total):
        return F.coalesce(F.sum(how.value).over(window), F.lit(0))
    return F.max(how.value).over(window)


def _whole(how: Last | Total | Greatest, position: Column) -> Column:
    if isinstance(how, Last):
        return F.max_by(how.value, F.when(how.value.isNotNull(), position))
    if isinstance(how, Total):
        return F.coalesce(F.sum(how.value), F.lit(0))
    return F.max(how.value)


def _combine(how: Last | Total | Greatest, inherited: Column, local: Column) -> Column:
    if isinstance(how, Last):
        return F.coalesce(local, inherited)
    if isinstance(how, Total):
        return inherited + local
    return F.greatest(inherited, local)
