"""Mixing sources to target weights: equal-token blocks by Sainte-Laguë apportionment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactloom.llm.tables import table
from contactloom.session import stored

BLOCK_WORDS = 64
SHARD_WORDS = 250_000
MOST_COPIES = 3
SEED = "mix-1"


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def capped_targets(sources: DataFrame, most_copies: int = MOST_COPIES) -> DataFrame:
    """``target`` of each source, from ``source_size`` and ``weight``.

    Shares of the total go by weight; a target stops at ``most_copies`` times its source's size and what is
    left is shared among the others. The fixed point is ``least(cap, level * weight)`` with
    one level for all: sources reach their caps in the order of cap per weight, so the level
    is found from running sums in that order. One row per source goes through one task.
    """
    cap = F.col("source_size") * most_copies
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_place")
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    ) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    open_ = F.col("_level") * F.col("weight") <= F.col("_cap")
    return (
        sources.withColumn("_cap", cap)
        .withColumn("_level", level)
        .withColumn("_row", F.row_number().over(order))
        .withColumn("_level", F.min_by(F.when(open_, F.col("_level")), F.when(open_, F.col("_row"))).over(every))
        .withColumn(
            "target",
            F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("weight")),
        )
        .drop("_cap", "_level", "_row")
    )


def sainte_lague(
    items: DataFrame, groups: Sequence[str], order: Sequence[str], weight: str, seats: str
) -> DataFrame:
    """``quota`` of each item: the ``seats`` of its group, given to the highest quotients.

    The quotients of an item are its weight over 1, 3, 5 and so on; ties go by ``order``.
    The seats won for certain follow from the group's total, and per group of ``m`` items at
    most ``2 m`` quotients around the last seat are ranked, however many seats there are.
    """
    group = Window.partitionBy(*groups)
    total, count = F.sum(weight).over(group), F.count(F.lit(1)).over(group)

    def seats_at(shift: Column) -> Column:
        rate = F.greatest(F.col(seats) + shift, F.lit(0.0)) / F.col("_total")
        return F.floor(F.col(weight) * rate + 0.5)

    bounds = (
        items.withColumn("_total", total)
        .withColumn("_half", count / 2.0)
        .withColumn("_sure", F.when(F.col("_total") > 0, seats_at(-F.col("_half"))).otherwise(0))
        .withColumn("_most", F.when(F.col("_total") > 0, seats_at(F.col("_half"))).otherwise(0))
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(group))
    )
    ranked = Window.partitionBy(*groups).orderBy(F.desc("_quotient"), *order)
    won = (
        bounds.filter("_most > _sure")
        .select(
            *groups,
            *order,
            "_open",
            weight,
            F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_k"),
        )
        .withColumn("_quotient", F.col(weight) / (2 * F.col("_k") - 1))
        .withColumn("_rank", F.row_number().over(ranked))
        .filter("_rank <= _open")
        .groupBy(*groups, *order)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    keys = [*groups, *order]
    return (
        bounds.join(won, keys, "left")
        .withColumn("quota", (F.col("_sure") + F.coalesce("_won", F.lit(0))).cast("long"))
        .drop("_total", "_half", "_sure", "_most", "_open", "_won")
    )


def _draw(*parts: Column) -> Column:
    """A seeded draw that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(SEED), *[p.cast("string") for p in parts]))


def mix_sources(
    docs: DataFrame,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    most_copies: int = MOST_COPIES,
) -> DataFrame:
    """How many words of each document the mix takes.

    ``doc_id, size, source_size, target, taken``, and ``place`` and ``shard``: the number of its source and its part of it.

    Sources in code point order, NULL last, weigh 1, 2, 3 and so on in turn and share as
    many words as there are (``capped_targets``). A source is cut into shards of about
    ``shard_words`` words by a draw per document, so a source with a third of all rows is
    many groups. Targets in blocks of ``block_words`` are apportioned to sources, then each
    source's quota to its shards. The words of a shard's documents, in drawn order, lie on one line
    that is cut into blocks; every block is taken quota/blocks times and the blocks with
    the least draws once more, so no document is taken more than ``most_copies`` times.

    Ids may be NULL or repeated: equal rows lie next to each other and the set of results
    stays the same. Documents without words take nothing. No rows give no rows. Other columns
    are left out.
    """
    sized = stored(
        docs.select("doc_id", "source", size_in_words(F.col("text")).alias("size"))
    )
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    sources = capped_targets(
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_place", F.row_number().over(by_code))
        .withColumn("weight", (F.col("_place") - 1) % 3 + 1),
        most_copies,
    )
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
    sources = stored(
        sainte_lague(
            sources.withColumn("_all", F.lit(0)).withColumn("_seats", blocks),
            ["_all"],
            ["_place"],
            "target",
            "_seats",
        ).select(
            "source",
            F.col("_place").alias("place"),
            "source_size",
            "target",
            F.col("quota").alias("source_quota"),
            F.ceil(F.col("source_size") / shard_words).alias("shards"),
        )
    )
    same = sized["source"].eqNullSafe(sources["source"])
    placed = (
        sized.join(sources, same)
        .select("doc_id", "size", "place", "source_size", "target", "source_quota", "shards")
        .withColumn(
            "shard",
            F.pmod(
                F.conv(F.substring(_draw(F.lit("shard"), F.col("doc_id")), 1, 8), 16, 10).cast("long"),
                F.greatest(F.col("shards"), F.lit(1)),
            ),
        )
    )
    worded = placed.filter("size > 0")
    shards = sainte_lague(
        worded.groupBy("place", "shard").agg(
            F.sum("size").alias("words"), F.first("source_quota").alias("source_quota")
        ),
        ["place"],
        ["shard"],
        "words",
        "source_quota",
    ).select(
        "place",
        "shard",
        "words",
        F.ceil(F.col("words") / block_words).alias("blocks"),
        F.least(F.col("quota"), F.ceil(F.col("words") / block_words) * most_copies).alias("quota"),
    )
    shards = stored(shards)
    drawn = Window.partitionBy("place", "shard").orderBy("_draw", "block")
    line = Window.partitionBy("place", "shard").orderBy("block")
    chosen = (
        shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("_draw", _draw(F.lit("block"), F.col("place"), F.col("shard"), F.col("block")))
        .withColumn("_more", (F.row_number().over(drawn) <= F.col("quota") % F.col("blocks")).cast("int"))
        .select(
            "place",
            "shard",
            "block",
            F.col("_more").alias("more"),
            F.coalesce(
                F.sum("_more").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("more_before"),
        )
    )
    order = Window.partitionBy("place", "shard").orderBy(
        _draw(F.lit("doc"), F.col("doc_id")), F.col("doc_id"), F.col("size")
    )
    laid = (
        worded.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_edges", F.array(F.col("_end") - F.col("size"), F.col("_end")))
        .select(
            "place",
            "shard",
            "doc_id",
            "size",
            "source_size",
            "target",
            F.explode("_edges").alias("_edge"),
            "_end",
        )
        .withColumn("block", F.floor(F.col("_edge") / block_words))
    )
    # Words of the chosen blocks up to an edge; the line's end lies in no block at times.
    # The planner takes the exploded blocks for as small as the shards, hence the hint.
    up_to = (
        laid.join(chosen.hint("merge"), ["place", "shard", "block"], "left")
        .join(
            shards.select(
                "place",
                "shard",
                "words",
                F.floor(F.col("quota") / F.col("blocks")).alias("each"),
                (F.col("quota") % F.col("blocks")).alias("extra"),
            ),
            ["place", "shard"],
        )
        .withColumn(
            "_upto",
            F.when(
                F.col("more").isNotNull(),
                F.col("more_before") * block_words
                + F.col("more") * (F.col("_edge") - F.col("block") * block_words),
            ).otherwise(F.col("extra") * block_words),
        )
    )
    end = F.col("_edge") == F.col("_end")
    taken = (
        up_to.groupBy("place", "shard", "doc_id", "size", "source_size", "target", "_end", "each")
        .agg(
            F.max(F.when(end, F.col("_upto"))).alias("_b"),
            F.max(F.when(~end, F.col("_upto"))).alias("_a"),
        )
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("each") * F.col("size") + F.col("_b") - F.col("_a")).cast("long").alias("taken"),
            "place",
            "shard",
        )
    )
    empty = placed.filter("size = 0").select(
        "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "place", "shard"
    )
    return taken.unionByName(empty)


def whole_copies(mix: DataFrame, most_copies: int = MOST_COPIES) -> DataFrame:
    """``doc_id, copies``: how often each document of a mix is taken as a whole.

    Shares taken of the documents of a shard are added up from the largest document down; a document gets a copy
    whenever the sum passes a half. So copies hold as many words as the mix takes, but for less than the largest document of each shard,
    and documents that the mix does not reach are left out.
    """
    share = F.col("taken") / F.col("size")
    order = Window.partitionBy("place", "shard").orderBy(F.desc("size"), _draw(F.lit("copy"), F.col("doc_id")))
    upto = F.sum(share).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        mix.filter("size > 0")
        .withColumn("_upto", F.round(upto, 9))
        .withColumn("_from", F.round(F.col("_upto") - share, 9))
        .withColumn("copies", F.floor(F.col("_upto") + 0.5) - F.floor(F.col("_from") + 0.5))
        .withColumn("copies", F.least(F.col("copies"), F.lit(most_copies)).cast("int"))
        .filter("copies > 0")
        .select("doc_id", "copies")
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix_sources(table(spark, sf_dir, "documents"))


def _seats(items: str, group: str, order: str, weight: str, seats: str) -> str:
    """Quotas seat by seat: all quotients ranked, as the rule has them."""
    return f"""
  SELECT {group}, {order}, count(*) FILTER (r <= {seats}) AS quota FROM (
    SELECT *, row_number() OVER (
             PARTITION BY {group} ORDER BY {weight}::DOUBLE / (2 * k - 1) DESC, {order}) AS r
    FROM (SELECT *, unnest(range(1, {seats}::BIGINT + 1)) AS k FROM {items}) q) q
  GROUP BY {group}, {order}"""


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
src AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source) s),
weighed AS (SELECT *, (place - 1) % 3 + 1 AS weight, {MOST_COPIES} * source_size AS cap FROM src),
levels AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, place) AS n,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
           / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(level, n) AS level FROM levels WHERE level * weight <= cap),
target AS (
  SELECT source, place, source_size, least(cap::DOUBLE, level.level * weight) AS target,
         greatest(ceil(source_size / {SHARD_WORDS}.0), 1)::BIGINT AS shards
  FROM levels, level),
seats AS (
  SELECT *, 0 AS every, round(sum(target) OVER () / {BLOCK_WORDS})::BIGINT AS seats FROM target),
of_source AS ({_seats("seats", "every", "place", "target", "seats")}),
placed AS (
  SELECT sized.*, target.place, target.source_size, target.target, of_source.quota AS source_quota,
         ('0x' || substr(md5('{SEED}|shard|' || doc_id), 1, 8))::BIGINT % shards AS shard
  FROM sized JOIN target ON target.source IS NOT DISTINCT FROM sized.source
  JOIN of_source ON of_source.place = target.place),
part AS (
  SELECT place, shard, sum(size)::BIGINT AS words, min(source_quota) AS source_quota
  FROM placed WHERE size > 0 GROUP BY place, shard),
of_part AS ({_seats("part", "place", "shard", "words", "source_quota")}),
shards AS (
  SELECT part.place, part.shard, ceil(words / {BLOCK_WORDS}.0)::BIGINT AS blocks,
         least(of_part.quota, {MOST_COPIES} * ceil(words / {BLOCK_WORDS}.0))::BIGINT AS quota
  FROM part JOIN of_part ON of_part.place = part.place AND of_part.shard = part.shard),
chosen AS (
  SELECT place, shard, block FROM (
    SELECT *, row_number() OVER (
             PARTITION BY place, shard
             ORDER BY md5('{SEED}|block|' || place || '|' || shard || '|' || block), block) AS r
    FROM (SELECT *, unnest(range(blocks)) AS block FROM shards) b) b
  WHERE r <= quota % blocks),
laid AS (
  SELECT *, sum(size) OVER (
           PARTITION BY place, shard ORDER BY md5('{SEED}|doc|' || doc_id), doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM placed WHERE size > 0),
more AS (
  SELECT l.doc_id, sum(least(stop, (block + 1) * {BLOCK_WORDS}) - greatest(stop - size, block * {BLOCK_WORDS})) AS words
  FROM laid l JOIN chosen c ON c.place = l.place AND c.shard = l.shard
   AND c.block * {BLOCK_WORDS} < stop AND (c.block + 1) * {BLOCK_WORDS} > stop - size
  GROUP BY l.doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target,
       CASE WHEN p.size = 0 THEN 0
            ELSE (s.quota // s.blocks) * p.size + coalesce(more.words, 0) END::BIGINT AS taken,
       p.place::INTEGER AS place, p.shard
FROM placed p LEFT JOIN shards s ON s.place = p.place AND s.shard = p.shard
LEFT JOIN more ON more.doc_id = p.doc_id"""
