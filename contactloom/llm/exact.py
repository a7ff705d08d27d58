"""Exact dedup: counting quotient filters per partition, merged, then byte verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm.spread import hot_keys, spread_join
from contactloom.llm.tables import BROADCAST_ROWS, table
from contactloom.session import stored

# A 64-bit fingerprint splits into a quotient (the slot of the filter) and the remainder
# stored in that slot's run.
QUOTIENT_BITS = 24
REMAINDER_BITS = 64 - QUOTIENT_BITS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; NULL is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


class CountingQuotientFilter:
    """A counting quotient filter in its canonical form.

    Slots are ordered by quotient; within the run of a quotient the remainders are sorted
    and each carries its count, which is what the filter's slots encode. Two filters of
    the same fingerprint width merge without loss by merging these sorted runs and adding
    the counts of equal remainders.
    """

    def __init__(self, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.remainders, self.counts = quotients, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        bits = fingerprints.astype(np.int64).view(np.uint64)
        return cls._runs(bits >> np.uint64(REMAINDER_BITS), bits & np.uint64((1 << REMAINDER_BITS) - 1),
                         np.ones(len(bits), dtype=np.int64))

    @classmethod
    def _runs(cls, quotients, remainders, counts) -> CountingQuotientFilter:
        if len(quotients) == 0:
            empty = np.zeros(0, dtype=np.uint64)
            return cls(empty, empty.copy(), np.zeros(0, dtype=np.int64))
        order = np.lexsort((remainders, quotients))
        q, r, c = quotients[order], remainders[order], counts[order]
        starts = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (r[1:] != r[:-1])])
        return cls(q[starts], r[starts], np.add.reduceat(c, starts))

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        return self._runs(
            np.concatenate([self.quotients, other.quotients]),
            np.concatenate([self.remainders, other.remainders]),
            np.concatenate([self.counts, other.counts]),
        )

    def count(self, fingerprint: int) -> int:
        bits = np.array([fingerprint], dtype=np.int64).view(np.uint64)[0]
        q, r = bits >> np.uint64(REMAINDER_BITS), bits & np.uint64((1 << REMAINDER_BITS) - 1)
        lo, hi = np.searchsorted(self.quotients, q, "left"), np.searchsorted(self.quotients, q, "right")
        at = lo + np.searchsorted(self.remainders[lo:hi], r)
        return int(self.counts[at]) if at < hi and self.remainders[at] == r else 0

    def table(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.quotients.astype(np.int64)), pa.array(self.remainders.astype(np.int64)),
             pa.array(self.counts)],
            ["quotient", "remainder", "n"],
        )


_SLOTS = "quotient long, remainder long, n long"


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One filter per partition, the filters of its batches merged; 8 bytes a row in memory."""
    built = CountingQuotientFilter.of(np.zeros(0, dtype=np.int64))
    for batch in batches:
        built = built.merge(CountingQuotientFilter.of(batch.column(0).to_numpy(zero_copy_only=False)))
    yield built.table()


def _fingerprint(quotient: Column, remainder: Column) -> Column:
    return F.shiftleft(quotient, REMAINDER_BITS).bitwiseOR(remainder)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of equal texts; texts are equal when identical after lower-casing A-Z only.

    Returns every row of ``docs`` with ``doc_id``, ``keep_id`` (the largest ``doc_id`` of
    its group; NULL ids rank below all others, and a group of NULL ids alone keeps NULL),
    ``group_size`` (rows of the group, repeated rows counted), ``kept`` (``doc_id`` equal to
    ``keep_id``, NULL equal to NULL: repeated rows of the kept id are all kept) and
    ``text_sha256`` (of the normalised text in UTF-8). A NULL text is the empty text; the
    empty table gives no rows; other columns of ``docs`` are not read.

    Each partition builds a counting quotient filter of 64-bit fingerprints of its texts;
    the filters merge without loss by quotient and remainder, so the count of a
    fingerprint is exact. Texts whose fingerprint counts once are alone; the others go to
    byte verification, where rows are grouped by the normalised text itself, combined in
    each task before they are shuffled, so a group of copies sends one row per task.
    Hot fingerprints and groups (more than 1/SALTS of all rows) are dealt over SALTS tasks.
    """
    rows = docs.select(
        F.col("doc_id"),
        normalised(F.col("text")).alias("_text"),
    ).select(
        "doc_id",
        "_text",
        F.xxhash64("_text").alias("_fp"),
        F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"),
    )
    merged = stored(
        rows.select("_fp")
        .mapInArrow(_filters, _SLOTS)
        .groupBy("quotient", "remainder")
        .agg(F.sum("n").alias("n"))
    )
    total = merged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = stored(
        merged.filter(F.col("n") > 1).select(_fingerprint(F.col("quotient"), F.col("remainder")).alias("_fp"), "n")
    )
    hot = hot_keys(many, ["_fp"], "n", total)
    if many.count() <= BROADCAST_ROWS:
        tagged = rows.join(F.broadcast(many.withColumn("_many", F.lit(True)).drop("n")), "_fp", "left")
    else:
        tagged = spread_join(rows, many.withColumn("_many", F.lit(True)).drop("n"), ["_fp"], hot, "left")
    alone = tagged.filter(F.col("_many").isNull()).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256"
    )
    candidates = tagged.filter(F.col("_many"))
    groups = stored(
        candidates.groupBy("_fp", "_text")
        .agg(
            F.max("doc_id").alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
            F.first("text_sha256").alias("text_sha256"),
        )
        .drop("_text")
    )
    verified = spread_join(
        candidates.select("doc_id", "_fp", "text_sha256"),
        groups,
        ["_fp", "text_sha256"],
        hot_keys(groups, ["_fp", "text_sha256"], "group_size", total),
    ).select("doc_id", "keep_id", "group_size", "text_sha256")
    return alone.unionByName(verified).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size,
       (d.doc_id IS NOT DISTINCT FROM g.keep_id) AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
