"""Document fingerprints by randomised edit embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactloom.llm.components import components
from contactloom.llm.shingles import mixed
from contactloom.llm.tables import table
from contactloom.session import stored

# Samples of the walk per octave of its length.
SAMPLES = 64
GRAM = 4
# Characters of a run of texts that are walked together.
RUN_CHARS = 3_000_000
BANDS, BAND_DIGITS = 24, 5
LEAST = 0.8

_SYMBOLS, _PERIOD = 64, 4096
_OCTAVES = 40
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _sample_positions(samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps of a walk in order, and how many steps each stands for."""
    draw = np.random.default_rng(17)
    at, weight = [np.zeros(1, np.int64)], [np.ones(1)]
    for o in range(_OCTAVES):
        low, n = 1 << o, 1 << o
        if n <= samples:
            at.append(np.arange(low, low + n))
            weight.append(np.ones(n))
        else:
            # One step out of each of equal stretches.
            stretch = n / samples
            own = low + ((np.arange(samples) + draw.random(samples)) * stretch).astype(np.int64)
            at.append(own)
            weight.append(np.full(samples, stretch))
    return np.concatenate(at), np.concatenate(weight)


class Walks:
    """Random walks over texts that are shared by all texts.

    The walk of a text stays at a character for some steps and goes on to the next: at each
    step a coin, drawn from the step's number and the character, says which. Two texts that differ by
    few edits fall into step again soon after each edit, so the steps at which their walks
    see different characters (Hamming distance) tell of the edits between them. A step shows a
    4-bit hash of the ``GRAM`` characters from where the walk stands.
    """

    def __init__(self, samples: int = SAMPLES) -> None:
        draw = np.random.default_rng(5)
        coin = draw.random((_SYMBOLS, _PERIOD)) < 0.5
        coin[:, -1] = True
        stay = np.zeros((_SYMBOLS, _PERIOD), np.int32)
        left = np.zeros(_SYMBOLS, np.int32)
        for _ in range(2):
            for j in range(_PERIOD - 1, -1, -1):
                left = np.where(coin[:, j], 1, left + 1)
                stay[:, j] = left
        self.stay = stay.ravel()
        self.stay_list = self.stay.tolist()
        self.step = draw.integers(0, 2**63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.at, self.weight = _sample_positions(samples)
        self.total = np.concatenate(([0.0], np.cumsum(self.weight)))

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int32) * _PERIOD

    def leave(self, symbols: np.ndarray, begin: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For each character the step at which the walk leaves it; ``start`` is each text's first step.

        Texts go side by side, one character at a time, while many are left, then one by one.
        """
        out = np.zeros(len(symbols), np.int64)
        length = np.diff(begin)
        order = np.argsort(-length, kind="stable")
        at, j = begin[:-1][order].copy(), start[order].astype(np.int64)
        low_first = np.sort(length)
        i, n = 0, int((length > 0).sum())
        while n >= 48:
            own, step = at[:n], j[:n]
            step += self.stay[symbols[own] + (step & (_PERIOD - 1))]
            out[own] = step
            own += 1
            i += 1
            n = len(length) - int(np.searchsorted(low_first, i, "right"))
        stay = self.stay_list
        for r in range(n):
            a, b = int(at[r]), int(begin[order[r] + 1])
            step, steps = int(j[r]), []
            for s in symbols[a:b].tolist():
                step += stay[s + (step & (_PERIOD - 1))]
                steps.append(step)
            out[a:b] = steps
        return out

    def read(self, codes: np.ndarray, leave: np.ndarray) -> str:
        """Fingerprint: one hex digit per sampled step that the walk over ``codes`` reaches."""
        if not len(codes):
            return ""
        at = self.at[: np.searchsorted(self.at, leave[-1])]
        where = np.searchsorted(leave, at, "right")
        value = np.zeros(len(at), np.uint64)
        last = len(codes)
        for k in range(GRAM):
            inside = where + k < last
            value += np.where(inside, codes[np.minimum(where + k, last - 1)], 0).astype(np.uint64) * self.step[k]
        return _HEX[(mixed(value) >> np.uint64(60)).astype(np.int64)].tobytes().decode()

    def likeness(self, a: str, b: str) -> float:
        """Share of steps at which two walks agree, by stratified samples, corrected for chance.

        Steps that only the longer walk has count as different. Nothing is like nothing (1).
        """
        n, most = min(len(a), len(b)), max(len(a), len(b))
        if not most:
            return 1.0
        x = np.frombuffer(a[:n].encode(), np.uint8)
        y = np.frombuffer(b[:n].encode(), np.uint8)
        agree = float(self.weight[:n][x == y].sum())
        chance = self.total[n] / 16
        return float(min(1.0, max(0.0, (agree - chance) / (self.total[most] - chance))))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def fingerprints(texts: list[str], walks: Walks) -> list[str]:
    codes, begin = _codes(texts)
    leave = walks.leave(walks.symbols(codes), begin, np.zeros(len(texts), np.int64))
    return [walks.read(codes[a:b], leave[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]


def _with_edited(
    texts: list[str], heads: list[str], walks: Walks
) -> tuple[list[str], list[str], list[str]]:
    """Fingerprints of texts, the texts with their last third replaced by ``heads``, and theirs.

    The walk over an edited text is that over the text up to the edit, so only new ends are walked.
    """
    codes, begin = _codes(texts)
    leave = walks.leave(walks.symbols(codes), begin, np.zeros(len(texts), np.int64))
    keep = np.diff(begin) - np.diff(begin) // 3
    start = np.array(
        [leave[b + k - 1] if k else 0 for b, k in zip(begin[:-1], keep, strict=True)], np.int64
    )
    new, new_begin = _codes(heads)
    new_leave = walks.leave(walks.symbols(new), new_begin, start)
    own, other, edited = [], [], []
    for i, text in enumerate(texts):
        a, b, k = begin[i], begin[i + 1], keep[i]
        c, d = new_begin[i], new_begin[i + 1]
        own.append(walks.read(codes[a:b], leave[a:b]))
        edited.append(text[:k] + heads[i])
        other.append(
            walks.read(
                np.concatenate((codes[a : a + k], new[c:d])),
                np.concatenate((leave[a : a + k], new_leave[c:d])),
            )
        )
    return own, other, edited


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(samples: int, run_chars: int):
    """Rows of sorted stretches: each is edited with and compared to the row after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = Walks(samples)

        def emit(rows: list[tuple], names: list, kind: pa.DataType) -> pa.RecordBatch:
            """All rows but the last, which only serves as the next one."""
            texts = [r[2] for r in rows]
            nexts = [*texts[1:], ""]
            heads = [n[: len(t) // 3] for t, n in zip(texts, nexts, strict=True)]
            own, other, edited = _with_edited(texts, heads, walks)
            shown = [i for i, r in enumerate(rows[:-1]) if not r[3] and rows[i + 1][0] == r[0]]
            sha = [hashlib.sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest() for i in shown]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][1] for i in shown], kind),
                    pa.array([len(texts[i]) for i in shown], pa.int64()),
                    pa.array(sha, pa.string()),
                    pa.array([own[i] for i in shown], pa.string()),
                    pa.array([other[i] for i in shown], pa.string()),
                    pa.array([walks.likeness(own[i], other[i]) for i in shown], pa.float64()),
                    pa.array([walks.likeness(own[i], own[i + 1]) for i in shown], pa.float64()),
                ],
                names=names,
            )

        rows, size = [], 0
        names = ["doc_id", *[c.split()[0] for c in _OUT.split(", ")]]
        kind = pa.int64()
        for batch in batches:
            kind = batch.column("doc_id").type
            for row in zip(
                batch.column("bucket").to_pylist(),
                batch.column("doc_id").to_pylist(),
                batch.column("text").to_pylist(),
                batch.column("guest").to_pylist(),
                strict=True,
            ):
                rows.append(row)
                size += len(row[2])
                if size > run_chars and len(rows) > 1:
                    yield emit(rows, names, kind)
                    rows, size = rows[-1:], len(rows[-1][2])
        if len(rows) > 1:
            yield emit(rows, names, kind)

    return run


def fingerprint_documents(
    docs: DataFrame, samples: int = SAMPLES, run_chars: int = RUN_CHARS
) -> DataFrame:
    """Fingerprints of whole texts and of their edited forms.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. A text is
    edited by putting the first characters of the next document, in descending order of ids, in place of
    its last third; after the last comes the first. ``near_edited`` and ``near_next`` are the likeness of the
    fingerprint to that of the edited text and of the next text.

    The order is made without sending all rows through one task: ids are cut into as many ranges as there are
    shuffle partitions, by quantiles, and each range gets a copy of the first row of the
    range after it. So texts are shuffled once.

    A NULL text counts as empty. NULL ids come last; rows of equal ids follow each other by a hash of their text. A single row
    is its own next. No rows give no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = F.col("doc_id")
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = docs.agg(
        F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)
    ).first()[0]
    # Ranges by number from the greatest ids down; NULL ids have the last.
    higher = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(bounds or []))]), lambda x: x >= ids))
    bucket = F.when(ids.isNull(), F.lit(parts)).otherwise(higher)
    given = given.withColumn("bucket", bucket.cast("int"))
    heads = (
        docs.select("doc_id", bucket.cast("int").alias("bucket"))
        .groupBy("bucket")
        .agg(F.max("doc_id").alias("head"))
    )
    # As many rows as there are ranges.
    turn = Window.orderBy("bucket")
    every = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hosts = stored(
        heads.withColumn("_host", F.coalesce(F.lag("bucket").over(turn), F.last("bucket").over(every)))
    )
    same = given["bucket"] == hosts["bucket"]
    guests = given.join(
        F.broadcast(hosts), same & given["doc_id"].eqNullSafe(hosts["head"])
    ).select("doc_id", "text", F.col("_host").alias("bucket"), F.lit(True).alias("guest"))
    laid = (
        given.select("doc_id", "text", "bucket", F.lit(False).alias("guest"))
        .unionByName(guests)
        .repartition(parts, "bucket")
        .sortWithinPartitions(
            "bucket", "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text")
        )
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return laid.mapInArrow(_neighbours(samples, run_chars), f"doc_id {kind}, {_OUT}")


def _bands(samples: int, bands: int, digits: int):
    """Band keys: digits of a fingerprint at drawn places of its last two whole octaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = Walks(samples)
        draw = np.random.default_rng(23)
        places = draw.random((bands, digits))
        for batch in batches:
            names, keys = batch.column("fingerprint").to_pylist(), []
            for fp in names:
                own = []
                n = len(fp)
                if n:
                    steps = int(walks.at[n - 1]) + 1
                    # A text near the edge of an octave is keyed in both, to meet its neighbours.
                    for octave in {int(np.log2(steps * s)) for s in (0.8, 1.0)}:
                        low = int(np.searchsorted(walks.at, 1 << max(0, octave - 1)))
                        high = min(n, int(np.searchsorted(walks.at, 1 << octave)))
                        high = max(high, low + 1)
                        at = (low + places * (high - low)).astype(int)
                        for b in range(bands):
                            part = "".join(fp[p] if p < n else "-" for p in at[b])
                            own.append(f"{octave}:{b}:{part}")
                keys.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("fingerprint"), pa.array(keys, pa.list_(pa.string()))],
                names=["fingerprint", "keys"],
            )

    return run


def near_texts(
    prints: DataFrame,
    least: float = LEAST,
    samples: int = SAMPLES,
    bands: int = BANDS,
    digits: int = BAND_DIGITS,
) -> DataFrame:
    """Groups of like texts from ``doc_id, fingerprint``: ``doc_id, group_id, kept``.

    Equal fingerprints are one class. Bit-sampled bands of the embedding give buckets; each member is verified
    against the least of its bucket by the likeness of whole fingerprints, and classes that verify are united.
    The group is named by its least id; documents whose text is empty stay alone.
    """
    classes = stored(prints.filter("fingerprint <> ''").select("fingerprint").distinct())
    keyed = classes.mapInArrow(
        _bands(samples, bands, digits), "fingerprint string, keys array<string>"
    ).select("fingerprint", F.explode("keys").alias("key"))
    keyed = stored(keyed)
    heads = keyed.groupBy("key").agg(F.min("fingerprint").alias("head"))
    pairs = keyed.join(heads, "key").filter("fingerprint <> head").select("head", "fingerprint").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = Walks(samples)
        for batch in batches:
            alike = [
                walks.likeness(a, b) >= least
                for a, b in zip(batch.column("head").to_pylist(), batch.column("fingerprint").to_pylist(), strict=True)
            ]
            yield batch.filter(pa.array(alike, pa.bool_()))

    links = stored(pairs.mapInArrow(verify, "head string, fingerprint string"))
    roots = components(links.select(F.col("head").alias("u"), F.col("fingerprint").alias("v")))
    rooted = prints.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "doc_id",
        F.when(F.col("fingerprint") != "", F.coalesce("root", "fingerprint")).alias("_root"),
    )
    least_ids = rooted.filter("_root IS NOT NULL").groupBy("_root").agg(F.min("doc_id").alias("group_id"))
    return (
        rooted.join(least_ids, "_root", "left")
        .select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("group_id")))
    )


def op2_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))
