"""Line dedup: removal of lines that are spread over many sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm.tables import small, table, text_key
from contactloom.session import stored

MIN_SITES = 10
LOG_REGISTERS = 10
# Greatest share of a text's characters that may go; beyond it the text is a copy as a whole.
MAX_SHARE = 0.5


def _line(line: Column) -> Column:
    return F.trim(line)


def _lines(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(text, "\n"), _line), lambda line: line != "")


def _key(line: Column) -> Column:
    """96 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _site(source: Column) -> Column:
    """Sites as text; NULL is a site of its own."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string")))


def boilerplate_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, log_registers: int = LOG_REGISTERS
) -> DataFrame:
    """Keys of the lines that occur on at least ``min_sites`` sites: ``line``, stored.

    A HyperLogLog sketch of sites is kept per line; sketches of a line merge wherever its
    rows meet, so a line that a third of all documents carry costs a sketch per task.
    The error of a sketch is below ``4 * 1.04 / sqrt(2 ** log_registers)`` but for one line in ten
    thousand and more; lines that are nearer to the threshold than that (and than one site) get an exact
    distinct count, from pairs of line and site made distinct before they are shuffled.
    """
    pairs = docs.select(
        F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _key))).alias("line"),
        _site(F.col("source")).alias("site"),
    )
    width = max(1.0, min_sites * 4 * 1.04 / 2 ** (log_registers / 2))
    spread = stored(
        pairs.groupBy("line")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log_registers))).alias("sites"))
        .filter(F.col("sites") >= min_sites - width)
    )
    sure = spread.filter(F.col("sites") > min_sites + width).select("line")
    near = small(spread.filter(F.col("sites") <= min_sites + width).select("line"))
    exact = (
        pairs.join(near, "line", "left_semi")
        .distinct()
        .groupBy("line")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_sites)
        .select("line")
    )
    return stored(sure.unionByName(exact))


def drop_boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    max_share: float = MAX_SHARE,
    log_registers: int = LOG_REGISTERS,
) -> DataFrame:
    """``docs`` without boilerplate lines, and ``n_lines, n_removed`` (lines that are not empty).

    A line counts by its trimmed text, once per document. Lines on ``min_sites`` or more
    sources (``boilerplate_lines``) are removed; the other lines stay as they are. If
    they hold more than ``max_share`` of the characters of a text's lines, the text is a copy as
    a whole; it stays untouched and is left to document dedup.

    A NULL text stays NULL, an empty one empty, both with zero lines. Equal rows get equal
    results. Rows are never dropped, all columns are kept; columns of the input called ``n_lines`` or
    ``n_removed`` are replaced. What to remove is found per text, not per id, so ids may repeat or be NULL.
    """
    marked = small(boilerplate_lines(docs, min_sites, log_registers))
    held = (
        docs.select(F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _key))).alias("line"), *text_key(F.col("text")))
        .join(marked, "line", "left_semi")
        .groupBy("text_a", "text_b")
        .agg(F.collect_set("line").alias("_marked"))
        .withColumnsRenamed({"text_a": "_a", "text_b": "_b"})
    )
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    given = docs.select(*names)
    a, b = text_key(F.col("text"))
    joined = given.join(held, (a == F.col("_a")) & (b == F.col("_b")), "left")

    def size(lines: Column) -> Column:
        return F.aggregate(lines, F.lit(0), lambda n, line: n + F.length(line))

    is_marked = lambda line: F.array_contains(F.col("_marked"), _key(line))
    full = _lines(F.col("text"))
    bad = F.filter(full, is_marked)
    touched = F.col("_marked").isNotNull()
    joined = joined.withColumn(
        "_cut", F.when(touched, size(bad) <= F.lit(max_share) * size(full)).otherwise(False)
    )
    cleaned = F.array_join(
        F.filter(F.split("text", "\n"), lambda line: ~is_marked(_line(line))), "\n"
    )
    return joined.select(
        *[
            F.when(F.col("_cut"), cleaned).otherwise(F.col("text")).alias("text") if c == "text" else joined[c]
            for c in names
        ],
        F.coalesce(F.size(full), F.lit(0)).alias("n_lines"),
        F.when(F.col("_cut"), F.size(bad)).otherwise(0).alias("n_removed"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without cross-site boilerplate lines."""
    docs = table(spark, sf_dir, "documents")
    return drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_removed")


ORACLE = f"""
WITH line AS (
  SELECT doc_id, source, k, raw, trim(raw, ' ') AS line FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw,
           generate_subscripts(string_split(text, chr(10)), 1) AS k
    FROM documents) s),
marked AS (
  SELECT line FROM line WHERE line <> '' GROUP BY line
  HAVING count(DISTINCT coalesce('s' || source, 'n')) >= {MIN_SITES}),
judged AS (
  SELECT line.*, marked.line IS NOT NULL AS bad FROM line LEFT JOIN marked ON marked.line = line.line),
doc AS (
  SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines,
         count(*) FILTER (WHERE bad) AS n_bad,
         coalesce(sum(length(line)) FILTER (WHERE bad), 0) <= {MAX_SHARE} * sum(length(line)) AS cut,
         coalesce(string_agg(raw, chr(10) ORDER BY k) FILTER (WHERE NOT bad), '') AS rest
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN doc.cut AND doc.n_bad > 0 THEN doc.rest ELSE d.text END AS text,
       coalesce(doc.n_lines, 0)::INTEGER AS n_lines,
       (CASE WHEN doc.cut THEN doc.n_bad ELSE 0 END)::INTEGER AS n_removed
FROM documents d LEFT JOIN doc USING (doc_id)"""
