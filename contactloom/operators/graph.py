"""Walking the link graph of many sites at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators.skew import ROWS_PER_TASK, heavy_keys, spread_join
from contactloom.session import checkpointed, fixed_layout


class CrawlNotFinished(RuntimeError):
    """The walk was still finding pages after the allowed number of rounds."""


def _laid_out(edges: DataFrame, parts: int) -> DataFrame:
    """Edges partitioned and sorted by their page, once for all rounds."""
    return checkpointed(edges.repartition(parts, "src").sortWithinPartitions("src"))


def _next_steps(front: DataFrame, edges: DataFrame, rows: int, size: int) -> DataFrame:
    """Rows of ``front`` joined with the links of their page.

    ``edges`` lies partitioned and sorted by page and is never shuffled. The front is split: pages that are
    in the front of at most ``rows`` walks join on the layout of the edges; of the others, which
    are few, the links are picked out and the walks are spread over several tasks. A page's own links come
    from one page text and need no spreading. A front of at most ``rows`` rows has no such page.
    """
    links = edges.withColumnRenamed("src", "url")
    if size <= rows:
        return front.join(links, "url")
    heavy = checkpointed(heavy_keys(front, ["url"], rows).select("url"))
    usual = front.join(heavy, "url", "left_anti").join(links, "url")
    busy = spread_join(
        front.join(heavy, "url", "left_semi"),
        checkpointed(links.join(heavy, "url", "left_semi")),
        ["url"],
        rows=rows,
    )
    return usual.unionByName(busy.select(*usual.columns))


def least_depth(state: DataFrame) -> DataFrame:
    """Least depth per start and page."""
    return state.groupBy("start", "url").agg(F.min("depth").alias("depth"))


def crawl(
    starts: DataFrame,
    edges: DataFrame,
    max_depth: int = 3,
    max_rounds: int | None = None,
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Pages within ``max_depth`` of each start: ``start, url, depth``.

    ``starts`` has a column ``start`` of canonical URLs, ``edges`` the columns
    ``src, dst, cost``. Each round follows the links of the pages whose depth has just
    improved and keeps the least depth per start and page, until nothing improves.
    Links without cost make the number of rounds independent of ``max_depth``.

    Edges and state keep one hash layout over all rounds; a round shuffles only its
    front and what the front has reached.
    """
    if max_depth < 0:
        return starts.limit(0).select(
            "start", F.col("start").alias("url"), F.lit(0).alias("depth")
        )
    with fixed_layout(starts.sparkSession) as parts:
        steps = _laid_out(edges.select("src", "dst", "cost"), parts)
        state = checkpointed(
            starts.select("start")
            .distinct()
            .select(
                "start",
                F.col("start").alias("url"),
                F.lit(0).alias("depth"),
                F.lit(True).alias("fresh"),
            )
            .repartition(parts, "start", "url")
        )
        rounds = 0
        while True:
            front = state.filter("fresh").select("start", "url", "depth")
            size = front.count()
            if not size:
                break
            if max_rounds is not None and rounds >= max_rounds:
                raise CrawlNotFinished(f"pages still being found after {rounds} rounds")
            rounds += 1
            reached = (
                _next_steps(front, steps, rows, size)
                .select(
                    "start",
                    F.col("dst").alias("url"),
                    (F.col("depth") + F.col("cost")).alias("depth"),
                )
                .filter(F.col("depth") <= max_depth)
            )
            known = state.select("start", "url", "depth", F.col("depth").alias("before"))
            found = least_depth(reached).withColumn("before", F.lit(None).cast("int"))
            state = checkpointed(
                known.unionByName(found)
                .groupBy("start", "url")
                .agg(F.min("depth").alias("depth"), F.min("before").alias("before"))
                .select(
                    "start",
                    "url",
                    "depth",
                    (F.col("before").isNull() | (F.col("depth") < F.col("before"))).alias("fresh"),
                )
            )
    return state.select("start", "url", "depth")


def crawl_exact(
    starts: DataFrame,
    edges: DataFrame,
    max_depth: int = 3,
    max_rounds: int | None = None,
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Pages a one-at-a-time walk in document order visits: ``start, url, depth``.

    Such a walk goes deep first and never comes back to a page, so a page first met too
    deep hides what lies behind it. Its tries happen in the order of the link positions
    along the path. The visit of a page is therefore the least path, in that order, that
    extends the visit of another page by one link within the depth bound. This has one
    solution, found by repeating the step for all pages at once until no path changes;
    paths never return to a page, so outdated ones die out. No site has to fit a task.

    ``edges`` needs the columns ``src, pos, dst, cost``.
    """
    no_path = F.array().cast("array<struct<pos: int, url: string>>")
    if max_depth < 0:
        return crawl(starts, edges, max_depth)
    with fixed_layout(starts.sparkSession) as parts:
        steps = _laid_out(edges.select("src", "pos", "dst", "cost"), parts)
        state = checkpointed(
            starts.select("start")
            .distinct()
            .select(
                "start",
                F.col("start").alias("url"),
                F.struct(no_path.alias("path"), F.lit(0).alias("depth")).alias("visit"),
                F.lit(True).alias("changed"),
            )
            .repartition(parts, "start", "url")
        )
        rounds = 0
        while state.filter("changed").limit(1).count():
            if max_rounds is not None and rounds >= max_rounds:
                raise CrawlNotFinished(f"paths still changing after {rounds} rounds")
            rounds += 1
            visited = state.filter(F.col("visit").isNotNull()).select("start", "url", "visit")
            size = visited.count()
            tries = (
                _next_steps(visited, steps, rows, size)
                .withColumn("depth", F.col("visit.depth") + F.col("cost"))
                .filter(F.col("depth") <= max_depth)
                .filter(F.col("dst") != F.col("start"))
                .filter(~F.array_contains(F.col("visit.path.url"), F.col("dst")))
                .select(
                    "start",
                    F.col("dst").alias("url"),
                    F.struct(
                        F.concat(
                            F.col("visit.path"),
                            F.array(F.struct(F.col("pos"), F.col("dst").alias("url"))),
                        ).alias("path"),
                        F.col("depth"),
                    ).alias("visit"),
                )
            )
            first = tries.groupBy("start", "url").agg(F.min("visit").alias("visit"))
            at_start = F.col("url") == F.col("start")
            known = visited.select(
                "start",
                "url",
                F.col("visit").alias("was"),
                F.when(at_start, F.col("visit")).alias("now"),
            )
            found = first.select(
                "start",
                "url",
                F.lit(None).cast(first.schema["visit"].dataType).alias("was"),
                F.col("visit").alias("now"),
            )
            state = checkpointed(
                known.unionByName(found)
                .groupBy("start", "url")
                .agg(F.min("was").alias("was"), F.min("now").alias("now"))
                .select(
                    "start",
                    "url",
                    F.col("now").alias("visit"),
                    (~F.col("was").eqNullSafe(F.col("now"))).alias("changed"),
                )
            )
    return state.filter(F.col("visit").isNotNull()).select("start", "url", "visit.depth")
