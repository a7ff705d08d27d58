"""A training corpus from raw documents, stage by stage.

Every stage reads what the one before it wrote. All but the last keep the columns of documents.
"""

from __future__ import annotations

import sys
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HERE = str(Path(__file__).resolve().parent)
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from contactloom.llm import language, lines, minhash, mixing, pieces  # noqa: E402
from contactloom.llm.tables import text_key  # noqa: E402
from contactloom.session import shared_dir, stored  # noqa: E402

# A language is taken as known from this score on. Short texts and texts in two languages score from 0.4 on.
LEAST_SCORE = 0.3
# Least share of common word shingles of near copies, in hundredths; op10 itself asks for 85.
NEAR_PERCENT = 80
# A pair at that share misses all bands once in 80,000 times.
NEAR_BANDS, NEAR_ROWS = 48, 7


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some certainty; ``lang`` is the predicted one.

    Rejected: texts that are NULL or have no letter, and those below ``LEAST_SCORE``. The model learns from
    the documents given.
    """
    model = language.train(docs)
    keep = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    return (
        language.identify(docs, model, keep=keep)
        .filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
        .withColumn("lang", F.col("lang_pred"))
        .select(*docs.columns)
    )


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are spread over many sources; ``n_chars`` is that of the new text."""
    return (
        lines.drop_boilerplate(docs)
        .withColumn("n_chars", F.length("text").cast("long"))
        .select(*docs.columns)
    )


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id.

    Near duplicates have ``NEAR_PERCENT`` hundredths of their five-word shingles in common, fewer than ``op10`` asks for,
    so the banding is one of this stage.
    Rows that repeat an id and a text are one document and stay together.
    """
    found = minhash.near_duplicates(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS, rows=NEAR_ROWS)
    kept = stored(
        found.filter("kept")
        .select(F.col("doc_id").alias("_id"), F.col("text_a").alias("_a"), F.col("text_b").alias("_b"))
        .distinct()
    )
    a, b = text_key(F.col("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (a == F.col("_a")) & (b == F.col("_b"))
    return docs.join(kept, same, "left_semi")


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them; a document that is taken twice is two rows."""
    copies = (
        mixing.whole_copies(mixing.mix_sources(docs))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("copies").alias("_n"))
    )
    copies = stored(copies)
    return (
        docs.join(copies, F.col("doc_id").eqNullSafe(F.col("_id")))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        .select(*docs.columns)
    )


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, with the text they decode to checked."""
    return pieces.sample_pieces(docs, pieces.load())


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_boilerplate),
    ("minhash", without_near_copies),
    ("mixing", mixed_to_weights),
    ("sentencepiece", encoded),
]

# Trained weights, minima and lattices are beyond SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}/{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
