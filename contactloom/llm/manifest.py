"""Merkle manifest of a table: ternary trees per source, a tree of sources, proofs and
versions that path-copy the ancestors of tampered leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactloom.llm.tables import small, table
from contactloom.session import stored

# Every ARITY consecutive nodes of a level become one node of the next.
ARITY = 3
# Leaf fields in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LOCAL = (1 << 33) - 1


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts concatenated, in UTF-8."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, ``:`` and the value (integers decimal)."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(row: dict[str, Column]) -> Column:
    return digest(*(field(row[name]) for name in FIELDS))


def _group(source: Column) -> Column:
    """A key that is never NULL and orders as the sources do, NULL first, bytewise."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("s"), source))


def _positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``_pos`` (from 0 within ``_g`` in ``order``) and ``_n`` (rows of ``_g``).

    The rows are sorted by ranges, so a group that holds a third of all rows spreads over
    many tasks; each task numbers its rows, and offsets come from a table of one row per
    task and group, which is all that goes through one place.
    """
    ordered = stored(rows.orderBy("_g", *order).withColumn("_mid", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_local", F.col("_mid").bitwiseAND(F.lit(_LOCAL))
    )
    by_group = Window.partitionBy("_g")
    parts = (
        ordered.groupBy("_pid", "_g")
        .agg(F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
        .withColumn(
            "_before",
            F.coalesce(F.sum("_cnt").over(by_group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .withColumn("_n", F.sum("_cnt").over(by_group))
    )
    return (
        ordered.join(small(stored(parts)), ["_pid", "_g"])
        .withColumn("_pos", F.col("_before") + F.col("_local") - F.col("_first"))
        .drop("_mid", "_pid", "_local", "_first", "_cnt", "_before")
    )


def _hashes(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda k: k["hash"]), "")


def build(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees over ``nodes`` (``_g``, ``_pos``, ``_n``, ``hash``), one per ``_g``.

    While a group has more than one node, every ARITY consecutive ones (the last run may
    be shorter, even one) become the digest of their hashes. Returns ``links`` (``level``,
    ``_g``, ``_pos``, ``left``, ``right``: the hashes of the run's other nodes before and
    after it, for every node below a top) and ``tops`` (``_g``, ``level``, ``_pos``,
    ``hash``: the last node of each group). Each level is a group-by on blocks of ARITY,
    written to the shared folder.
    """
    level, links, tops = 0, None, None
    current = stored(nodes.select("_g", "_pos", "_n", "hash"))
    while True:
        top = current.filter(F.col("_n") == 1).select("_g", F.lit(level).alias("level"), "_pos", "hash")
        tops = top if tops is None else tops.unionByName(top)
        active = current.filter(F.col("_n") > 1)
        if active.isEmpty():
            break
        blocks = active.groupBy("_g", F.floor(F.col("_pos") / ARITY).alias("_up"), "_n").agg(
            F.sort_array(F.collect_list(F.struct("_pos", "hash"))).alias("_kids")
        )
        kid = blocks.select("_g", "_kids", F.explode("_kids").alias("_k"))
        link = kid.select(
            F.lit(level).alias("level"),
            "_g",
            F.col("_k._pos").alias("_pos"),
            _hashes(F.filter("_kids", lambda k: k["_pos"] < F.col("_k._pos"))).alias("left"),
            _hashes(F.filter("_kids", lambda k: k["_pos"] > F.col("_k._pos"))).alias("right"),
        )
        link = stored(link)
        links = link if links is None else links.unionByName(link)
        current = stored(
            blocks.select(
                "_g",
                F.col("_up").alias("_pos"),
                F.ceil(F.col("_n") / ARITY).cast("long").alias("_n"),
                digest(_hashes(F.col("_kids"))).alias("hash"),
            )
        )
        level += 1
    if links is None:
        links = nodes.sparkSession.createDataFrame([], "level int, _g string, _pos long, left string, right string")
    return links, stored(tops)


def _down(links: DataFrame, tops: DataFrame) -> DataFrame:
    """``_g, _pos, path, _h`` of every leaf: the sibling hashes from it to the top, and the
    number of levels of its own tree. ``tops`` carries ``path`` and ``_h`` of each top.

    Paths go down from parents to their ARITY children, one level at a time.
    """
    height = tops.agg(F.max("level")).first()[0]
    if height is None:  # no rows
        return tops.select("_g", "_pos", "path", "_h")
    above = None
    for level in range(height, -1, -1):
        here = tops.filter(F.col("level") == level).select("_g", "_pos", "path", "_h")
        if above is not None:
            inner = (
                links.filter(F.col("level") == level)
                .withColumn("_up", F.floor(F.col("_pos") / ARITY))
                .join(above.withColumnRenamed("_pos", "_up"), ["_g", "_up"])
                .select(
                    "_g",
                    "_pos",
                    F.concat(F.array(F.struct("left", "right")), F.col("path")).alias("path"),
                    "_h",
                )
            )
            here = here.unionByName(inner)
        above = stored(here)
    return above


def _fold(path: Column, start: Column) -> Column:
    """The hashes of the copied ancestors of a leaf of hash ``start``, leaf first."""
    return F.aggregate(
        path,
        F.array(start),
        lambda done, p: F.concat(done, F.array(digest(p["left"], F.element_at(done, -1), p["right"]))),
    )


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """The Merkle manifest of ``docs``: one row per row of ``docs``.

    A leaf is the digest of ``doc_id, source, lang, n_chars, text``, each ``-`` if NULL,
    else its UTF-8 byte count, ``:`` and its value. Per source, leaves ascend by
    ``doc_id`` (NULL first; equal ids by leaf); trees of arity 3 give one subroot per
    source; subroots, ordered by source (NULL first, UTF-8 bytewise), give the root. A
    lone leaf is its own subroot and a lone subroot the root.

    Returns ``doc_id``, ``source``, ``leaf``, ``subroot``, ``root``, ``path`` (per level
    up to the root: hashes of the run's other nodes before and after, ``left``, ``right``),
    ``proof_sha256`` (digest of all siblings, level by level, left to right; of the empty
    text without siblings). With ``tampered`` (a text column on ``docs``) each row also
    gets a version: ``tampered_leaf`` and ``copied`` (the hashes of its ancestors, copied
    with the new leaf while all other nodes are shared, leaf first, root last), and
    ``folded_root``, the last of them. The empty table gives no rows.
    """
    cols = {name: F.col(name) for name in FIELDS}
    rows = docs.select(
        "doc_id",
        "source",
        _group(F.col("source")).alias("_g"),
        leaf(cols).alias("leaf"),
        (leaf(cols | {"text": tampered}) if tampered is not None else F.lit(None).cast("string")).alias("tampered_leaf"),
    )
    leaves = stored(_positions(rows, [F.col("doc_id").asc_nulls_first(), F.col("leaf")]))
    links, tops = build(leaves.withColumnRenamed("leaf", "hash"))
    subroots = _positions(
        tops.select("_g", F.col("level").alias("_h"), F.col("hash")).withColumnRenamed("_g", "_source")
        .withColumn("_g", F.lit("")),
        [F.col("_source")],
    )
    subroots = stored(subroots)
    root_links, root_top = build(subroots)
    root_paths = _down(
        root_links, root_top.withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
        .withColumn("_h", F.lit(0))
    )
    group_tops = tops.join(
        subroots.select(F.col("_source").alias("_g"), F.col("_pos").alias("_rank"), F.col("_h")), "_g"
    ).join(root_paths.select(F.col("_pos").alias("_rank"), "path"), "_rank")
    paths = _down(links, group_tops.select("_g", "level", "_pos", "path", "_h"))
    done = leaves.join(paths, ["_g", "_pos"])
    original = _fold(F.col("path"), F.col("leaf"))
    result = done.select(
        "doc_id",
        "source",
        "leaf",
        F.element_at(_fold(F.slice("path", 1, F.col("_h")), F.col("leaf")), -1).alias("subroot"),
        F.element_at(original, -1).alias("root"),
        "path",
        digest(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")).alias("proof_sha256"),
        "tampered_leaf",
    )
    if tampered is None:
        return result.drop("tampered_leaf")
    copied = _fold(F.col("path"), F.col("tampered_leaf"))
    return result.withColumn("copied", copied).withColumn("folded_root", F.element_at(copied, -1))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Rows whose id has an even CRC-32 lose the line feeds of their text.
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), 2) == 0
    tampered = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest(docs, tampered).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
