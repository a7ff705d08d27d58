"""MinHash near-dedup with b-bit signatures."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm.components import components
from contactloom.llm.shingles import RUN_BYTES, WORDS, Shingler, mixed
from contactloom.llm.tables import by_size, small, table, text_key
from contactloom.session import stored

# A pair at the threshold misses all bands once in 26,000 times; one half as alike is rarely a candidate.
BANDS = 32
ROWS = 8
BITS = 2
# Least share of common shingles, in hundredths of the union.
PERCENT = 85

_SIGNED = "doc_id long, text_a long, text_b int, n_shingles long, class string, signature array<long>, bands array<long>"
_SETS = "class string, shingles array<long>"


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def _class_of(shingles: np.ndarray) -> str:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(offsets.astype(np.int32)), pa.array(np.ascontiguousarray(flat).view(np.int64))
    )


def _sign(words: int, bands: int, rows: int, bits: int):
    """Signatures of batches of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        draw = np.random.default_rng(7)
        k = bands * rows
        factor = draw.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shift = draw.integers(0, 2**63, k, dtype=np.uint64)
        step = draw.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        each = 64 // bits
        longs = -(-k // each)
        for batch in batches:
            texts = _texts(batch.column("text"))
            for at, part in by_size(texts, RUN_BYTES):
                flat, begin = shingler.sets(part)
                full = np.flatnonzero(np.diff(begin))
                n = len(part)
                least = np.zeros((n, k), np.uint64)
                if len(full):
                    where = begin[:-1][full]
                    for j in range(k):
                        least[full, j] = np.minimum.reduceat(flat * factor[j] + shift[j], where)
                low = mixed(least) & np.uint64(2**bits - 1)
                packed = np.zeros((n, longs), np.uint64)
                for j in range(k):
                    packed[:, j // each] |= low[:, j] << np.uint64(bits * (j % each))
                keys = mixed((least.reshape(n, bands, rows) * step).sum(2, dtype=np.uint64))
                some = np.diff(begin) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, n).cast(pa.int64()),
                        batch.column("text_a").slice(at, n),
                        batch.column("text_b").slice(at, n),
                        pa.array(np.diff(begin)),
                        pa.array(
                            [
                                _class_of(flat[begin[i] : begin[i + 1]]) if some[i] else None
                                for i in range(n)
                            ],
                            pa.string(),
                        ),
                        _lists(packed.ravel(), np.arange(n + 1) * longs),
                        _lists(keys.ravel(), np.arange(n + 1) * bands),
                    ],
                    names=[c.split()[0] for c in _SIGNED.split(", ")],
                )

    return run


def _shingle_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for _, part in by_size(_texts(batch.column("text")), RUN_BYTES):
                flat, begin = shingler.sets(part)
                names = [_class_of(flat[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), _lists(flat, begin)], names=["class", "shingles"]
                )

    return run


def sign(
    docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, bits: int = BITS
) -> DataFrame:
    """Per document: set size, a name for the set, packed low bits of the minima, band keys."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")), "text")
    return given.mapInArrow(_sign(words, bands, rows, bits), _SIGNED)


def estimated_similarity(left: Column, right: Column, hashes: int, bits: int = BITS) -> Column:
    """Similarity from two packed signatures, corrected for low bits that agree by chance.

    Lanes that differ are counted in whole longs: fold each lane's bits onto its lowest and count bits.
    """
    lanes = sum(1 << (bits * i) for i in range(64 // bits))
    mask = F.lit(lanes - 2**64 if lanes >= 2**63 else lanes)

    def differing(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        folded = x
        for i in range(1, bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, i))
        return F.bit_count(folded.bitwiseAND(mask))

    longs = -(-hashes * bits // 64)
    unequal = differing(left[0], right[0])
    for i in range(1, longs):
        unequal = unequal + differing(left[i], right[i])
    chance = 2.0**-bits
    return ((1 - unequal / float(hashes)) - chance) / (1 - chance)


def _cutoff(percent: int, hashes: int, bits: int) -> float:
    """Five standard errors below the wanted similarity."""
    s, chance = percent / 100, 2.0**-bits
    match = s + (1 - s) * chance
    return s - 5 * math.sqrt(match * (1 - match) / hashes) / (1 - chance)


def _confirmed(
    pairs: DataFrame, sets: DataFrame, percent: int
) -> DataFrame:
    """Pairs ``u, v`` of classes whose full sets are alike enough."""
    of = lambda side: sets.select(F.col("class").alias(side), F.col("shingles").alias(f"_{side}"))
    both = F.size(F.array_intersect("_u", "_v"))
    return (
        pairs.join(of("u"), "u")
        .join(of("v"), "v")
        .withColumn("_both", both)
        .filter(100 * F.col("_both") >= percent * (F.size("_u") + F.size("_v") - F.col("_both")))
        .select("u", "v")
    )


def _beside_head(star: DataFrame, sets: DataFrame) -> DataFrame:
    """How each class differs from its bucket's head: ``head, class, n, lost, shared``.

    ``n`` is the size of its set, ``lost`` the number of the head's shingles that it lacks, ``shared`` the number of
    shingles it has beyond the head's that another class of this head has too.
    """
    of = lambda side: sets.select(F.col("class").alias(side), F.col("shingles").alias(f"_{side}"))
    apart = stored(
        star.join(of("head"), "head")
        .join(of("class"), "class")
        .select(
            "head",
            "class",
            F.size("_class").alias("n"),
            F.size(F.array_except("_head", "_class")).alias("lost"),
            F.array_except("_class", "_head").alias("_new"),
        )
    )
    new = apart.select("head", "class", F.explode("_new").alias("shingle"))
    common = new.groupBy("head", "shingle").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    shared = (
        new.join(common, ["head", "shingle"])
        .groupBy("head", "class")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    return (
        apart.withColumn("_added", F.size("_new"))
        .drop("_new")
        .join(shared, ["head", "class"], "left")
        .withColumn("shared", F.coalesce("shared", F.lit(0)))
    )


def _may_be_alike(percent: int) -> Column:
    """Whether two classes of one head, ``u`` and ``v``, can be alike enough at all.

    They differ by what one differs from the head and the other does not. Of what they lost they have at most the
    lesser number in common, of what they added at most the lesser number that is shared. If even then
    the difference is too large for the sizes, they are not alike; this lets no alike pair go.
    """
    apart = sum(F.col(f"{x}.lost") + F.col(f"{x}._added") for x in "uv")
    common = F.least("u.lost", "v.lost") + F.least("u.shared", "v.shared")
    # Similarity s of sets of n and m allows a difference of (1 - s) / (1 + s) * (n + m).
    return (100 + percent) * (apart - 2 * common) <= (100 - percent) * (F.col("u.n") + F.col("v.n"))


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    words: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    bits: int = BITS,
) -> DataFrame:
    """Groups of near-duplicate texts: ``doc_id, n_shingles, component_id, kept``, and the text's key.

    Sets of distinct word shingles are signed with ``bands * rows`` minima. Documents of
    equal sets are one class. Classes that share all minima of a band are candidates; the
    packed low bits estimate their similarity and only pairs clearly below it are let go; the rest
    is confirmed on the full sets, read again from the texts of the candidates alone.

    No bucket is expanded into all its pairs. First every member is compared with the one member of its
    bucket that meets the most others in all bands, in most cases the text the others were copied from. Then only members of buckets that are still in different components are
    compared with each other, so groups of near copies cost one pair per member; no link
    between components is lost, and links inside one do not change the result.

    A text without words (NULL, empty, blank) has no shingles and stays alone. Rows that
    repeat an id are rows of their own with the same result if their texts are equal. NULL ids are least
    of nothing: a component takes the least id there is, a document alone without an id has a NULL
    component and is kept. Other columns are left out. No rows give no rows.
    """
    hashes = bands * rows
    signed = stored(sign(docs, words, bands, rows, bits))
    classes = stored(
        signed.filter("class IS NOT NULL")
        .groupBy("class")
        .agg(
            F.min_by(F.struct("doc_id", "text_a", "text_b"), F.coalesce("doc_id", F.lit(2**63 - 1))).alias("_of"),
            F.any_value("signature").alias("signature"),
            F.any_value("bands").alias("bands"),
        )
        .select("class", "_of.*", "signature", "bands")
    )
    members = classes.select("class", F.posexplode("bands").alias("band", "key"))
    sizes = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    buckets = stored(members.join(sizes, ["band", "key"]))
    met = buckets.groupBy("class").agg(F.sum("_n").alias("_met"))
    heads = (
        buckets.join(met, "class")
        .groupBy("band", "key")
        .agg(F.max(F.struct("_met", "class")).alias("_most"))
        .select("band", "key", F.col("_most.class").alias("head"))
    )
    pairs = buckets.drop("_n").join(heads, ["band", "key"]).filter("class <> head")
    signatures = classes.select("class", "signature")
    cutoff = _cutoff(percent, hashes, bits)

    def likely(pairs: DataFrame) -> DataFrame:
        for side in ("u", "v"):
            own = signatures.select(F.col("class").alias(side), F.col("signature").alias(f"_{side}"))
            pairs = pairs.join(own, side)
        alike = estimated_similarity(F.col("_u"), F.col("_v"), hashes, bits) >= cutoff
        return pairs.filter(alike).select("u", "v")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Full sets of some classes, from the texts of one document each."""
        sources = classes.join(wanted, "class", "left_semi").select(
            F.col("doc_id").alias("_id"), F.col("text_a").alias("_a"), F.col("text_b").alias("_b")
        )
        sources = small(stored(sources))
        given = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), "text", *text_key(F.col("text"))
        )
        same = (
            (given["text_a"] == sources["_a"])
            & (given["text_b"] == sources["_b"])
            & given["doc_id"].eqNullSafe(sources["_id"])
        )
        texts = given.join(sources, same, "left_semi").select("text")
        return texts.mapInArrow(_shingle_sets(words), _SETS).dropDuplicates(["class"])

    first = stored(
        likely(
            pairs.select(
                F.least("head", "class").alias("u"), F.greatest("head", "class").alias("v")
            ).distinct()
        )
    )
    ends = first.select(F.explode(F.array("u", "v")).alias("class")).distinct()
    links = stored(_confirmed(first, sets_of(ends), percent))
    roots = stored(components(links))
    rest = pairs.join(roots, F.col("class") == F.col("node"), "left").select(
        "band", "key", "head", "class", F.coalesce("root", "class").alias("root")
    )
    mixed_buckets = (
        rest.groupBy("band", "key")
        .agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"))
        .filter("_lo < _hi")
        .select("band", "key")
    )
    apart = stored(rest.join(mixed_buckets, ["band", "key"], "left_semi"))
    star = apart.select("head", "class").distinct()
    sets = stored(sets_of(star.select(F.explode(F.array("head", "class")).alias("class")).distinct()))
    rows = stored(
        apart.join(_beside_head(star, sets), ["head", "class"]).join(signatures, "class")
    )
    u, v = rows.alias("u"), rows.alias("v")
    cross = u.join(
        v,
        (F.col("u.band") == F.col("v.band"))
        & (F.col("u.key") == F.col("v.key"))
        & (F.col("u.class") < F.col("v.class"))
        & (F.col("u.root") != F.col("v.root"))
        & _may_be_alike(percent)
        & (
            estimated_similarity(F.col("u.signature"), F.col("v.signature"), hashes, bits)
            >= cutoff
        ),
    ).select(F.col("u.class").alias("u"), F.col("v.class").alias("v"))
    cross = stored(cross.distinct().join(first, ["u", "v"], "left_anti"))
    if not cross.isEmpty():
        roots = components(links.unionByName(_confirmed(cross, sets, percent)))
    root_of = stored(
        classes.select("class", "doc_id")
        .join(roots, F.col("class") == F.col("node"), "left")
        .select("class", "doc_id", F.coalesce("root", "class").alias("root"))
    )
    least = root_of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = root_of.join(least, "root").select("class", "component_id")
    component = component.withColumnRenamed("class", "_class")
    return (
        signed.select("doc_id", "n_shingles", "class", "text_a", "text_b")
        .join(component, F.col("class") == F.col("_class"), "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("class").isNull(), F.col("doc_id"))
            .otherwise(F.col("component_id"))
            .alias("component_id"),
            "text_a",
            "text_b",
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
