"""Language identification: sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm.shingles import mixed
from contactloom.llm.tables import by_size, crc_fold, table

FOLDS, HELD_OUT = 4, 2
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
# Labelled documents that the weights are fitted on, at most, and n-gram buckets of each.
SAMPLE = 3_000
SAMPLE_BUCKETS = 4_096
# Characters handled at once.
RUN_CHARS = 1_000_000
UNKNOWN = "und"


class Grams:
    """Hashed character n-grams of whole texts: lower-cased letters, all else one blank each."""

    def __init__(self, buckets: int, orders: tuple[int, ...]) -> None:
        self.buckets, self.orders = buckets, orders
        # Letters of the first three planes; codes above are asked for one distinct code at a time.
        self.letter = np.array([chr(c).isalpha() for c in range(0x30000)])
        draw = np.random.default_rng(11)
        self.gap = " " * max(1, max(orders) - 1)
        self.step = draw.integers(0, 2**63, max(orders), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        low = [t.lower() for t in texts]
        joined = self.gap.join([*low, " "])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.concatenate(([0], np.cumsum([len(t) + len(self.gap) for t in low])))
        return codes, begin

    def buckets_of(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Per order the bucket of the n-gram from each position; where texts begin; which have a letter.

        Blanks between texts keep n-grams from running into the next one.
        """
        codes, begin = self._codes(texts)
        letter = self.letter[np.minimum(codes, len(self.letter) - 1)]
        high = codes >= len(self.letter)
        if high.any():
            above = np.unique(codes[high])
            letters = above[np.array([chr(int(c)).isalpha() for c in above], dtype=bool)]
            letter[high] = np.isin(codes[high], letters)
        value = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
        some = np.add.reduceat(letter, begin[:-1]) > 0
        out, total = [], np.zeros(len(value), np.uint64)
        for j in range(max(self.orders)):
            total[: len(value) - j] += value[j:] * self.step[j]
            if j + 1 in self.orders:
                out.append((mixed(total + np.uint64(j)) % np.uint64(self.buckets)).astype(np.int32))
        return out, begin, some

    def ends(self, begin: np.ndarray, order: int) -> np.ndarray:
        """Last position of each text, exclusive, from which an n-gram of this order starts.

        One blank behind the text counts; a text that is shorter keeps one n-gram.
        """
        return np.maximum(begin[1:] - len(self.gap) + 2 - order, begin[:-1] + 1)


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def _document_counts(buckets: int, orders: tuple[int, ...]):
    """Documents that hold each bucket, one partial table per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total, n = Grams(buckets, orders), np.zeros(buckets + 1, np.int64), 0
        for batch in batches:
            for _, part in by_size(_texts(batch.column("text")), RUN_CHARS):
                got, begin, some = grams.buckets_of(part)
                ends = [grams.ends(begin, o) for o in orders]
                seen = np.zeros(buckets, np.uint8)
                for i in np.flatnonzero(some):
                    for g, e in zip(got, ends, strict=True):
                        seen[g[begin[i] : e[i]]] = 1
                    total[:-1] += seen
                    seen[:] = 0
                n += int(some.sum())
        total[-1] = n
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array(total[full])], names=["bucket", "n"]
        )

    return run


def _sparse(buckets: int, orders: tuple[int, ...], most: int):
    """Term frequencies of documents: their most frequent buckets and shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(buckets, orders)
        for batch in batches:
            texts, langs, rows = _texts(batch.column("text")), batch.column("lang"), []
            for _, part in by_size(texts, RUN_CHARS):
                got, begin, _ = grams.buckets_of(part)
                ends = [grams.ends(begin, o) for o in orders]
                for i in range(len(part)):
                    own = np.concatenate([g[begin[i] : e[i]] for g, e in zip(got, ends, strict=True)])
                    ids, n = np.unique(own, return_counts=True)
                    top = np.sort(np.argsort(-n, kind="stable")[:most])
                    rows.append((ids[top], (n / n.sum()).astype(np.float32)[top]))
            yield pa.RecordBatch.from_arrays(
                [
                    langs,
                    pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[1] for r in rows], pa.list_(pa.float32())),
                ],
                names=["lang", "ids", "shares"],
            )

    return run


@dataclass(frozen=True)
class Model:
    langs: list[str]
    # Weight times inverse document frequency over temperature, per bucket and language.
    weight: np.ndarray
    bias: np.ndarray


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def _ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]],
    target: np.ndarray,
    k: int,
    buckets: int,
    passes: int = 4,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.002,
    l2: float = 0.001,
) -> np.ndarray:
    """Weights by follow-the-regularised-leader per coordinate, with elastic net; the last row is the bias."""
    z = np.zeros((buckets + 1, k))
    n = np.zeros((buckets + 1, k))

    def leader(ids: np.ndarray) -> np.ndarray:
        zi, ni = z[ids], n[ids]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    draw = np.random.default_rng(3)
    for _ in range(passes):
        for r in draw.permutation(len(rows)):
            ids, x = rows[r]
            w = leader(ids)
            error = _softmax(x @ w)
            error[target[r]] -= 1
            g = x[:, None] * error
            squared = n[ids] + g * g
            z[ids] += g - (np.sqrt(squared) - np.sqrt(n[ids])) / alpha * w
            n[ids] = squared
    return leader(np.arange(buckets + 1))


def _temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    rows = np.arange(len(target))
    loss = lambda t: -np.log(_softmax(logits / np.exp(t))[rows, target] + 1e-12).mean()
    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(
    docs: DataFrame,
    sample: int = SAMPLE,
    buckets: int = BUCKETS,
    orders: tuple[int, ...] = ORDERS,
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
) -> Model | None:
    """A model from the rows outside the held-out fold that have a language and a text.

    Inverse document frequencies are counted over all of these rows. Weights are fitted on the ``sample``
    rows of the least draws (by a hash of the id and text), each with its
    ``SAMPLE_BUCKETS`` most frequent n-gram buckets, so what comes to the driver is bounded. Every
    fifth of them is left out of the fit and sets the temperature. Without rows there is no model.
    """
    known = docs.filter(
        F.col("text").isNotNull()
        & F.col("lang").isNotNull()
        & (crc_fold(F.col("doc_id"), folds) != held_out)
    )
    counts = (
        known.select("text")
        .mapInArrow(_document_counts(buckets, orders), "bucket int, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    seen = np.zeros(buckets + 1)
    seen[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    chosen = (
        known.select("text", "lang", F.xxhash64("doc_id", "text").alias("_draw"))
        .orderBy("_draw", "lang")
        .limit(sample)
        .select("text", "lang")
    )
    got = chosen.mapInArrow(
        _sparse(buckets, orders, SAMPLE_BUCKETS), "lang string, ids array<int>, shares array<float>"
    ).toPandas()
    if not len(got):
        return None
    langs = sorted(set(got["lang"]))
    target = np.array([langs.index(x) for x in got["lang"]])
    # Shares are small; the factor brings them to a scale that suits the learning rate.
    scale = 20.0
    rows = [
        (np.append(ids, buckets), np.append(np.asarray(x) * idf[ids] * scale, 1.0))
        for ids, x in zip(got["ids"], got["shares"], strict=True)
    ]
    left = np.arange(len(rows)) % 5 == 4
    fit = np.flatnonzero(~left)
    w = _ftrl([rows[i] for i in fit], target[fit], len(langs), buckets)
    heat = 1.0
    if left.any():
        logits = np.stack([rows[i][1] @ w[rows[i][0]] for i in np.flatnonzero(left)])
        heat = _temperature(logits, target[left])
    weight = (w[:-1] * idf[:, None] * scale / heat).astype(np.float32)
    return Model(langs, weight, (w[-1] / heat).astype(np.float64))


def _predict(model: Model | None, buckets: int, orders: tuple[int, ...], kept_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(buckets, orders)
        for batch in batches:
            texts = _texts(batch.column("text"))
            lang = np.full(len(texts), UNKNOWN, object)
            score = np.zeros(len(texts))
            for at, part in by_size(texts, RUN_CHARS) if model else ():
                got, begin, some = grams.buckets_of(part)
                k = len(model.langs)
                logits, n = np.zeros((len(part), k)), np.zeros(len(part))
                for order, ids in zip(orders, got, strict=True):
                    end = grams.ends(begin, order)
                    edges = np.stack([begin[:-1], end], 1).ravel()
                    # The runs between texts fall on every second place and are left out.
                    for c in range(k):
                        logits[:, c] += np.add.reduceat(model.weight[:, c][ids], edges)[::2]
                    n += end - begin[:-1]
                p = _softmax(logits / n[:, None] + model.bias)
                best = p.argmax(1)
                for i in np.flatnonzero(some):
                    lang[at + i], score[at + i] = model.langs[best[i]], p[i, best[i]]
            names = [c for c in batch.schema.names if c in kept_names]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(lang, pa.string()), pa.array(score)],
                names=[*names, "lang_pred", "score"],
            )

    return run


def identify(
    docs: DataFrame,
    model: Model | None,
    buckets: int = BUCKETS,
    orders: tuple[int, ...] = ORDERS,
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The columns ``keep``, and ``held_out, lang_pred, score`` of every whole text.

    A text that is NULL or has no letter is ``und`` with score 0, and so are all without a model.
    Every row gives a row, whatever its id; other columns are left out.
    """
    fold = (crc_fold(F.col("doc_id"), folds) == held_out).alias("held_out")
    given = docs.select(*keep, fold, *[c for c in ("text",) if c not in keep])
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return given.mapInArrow(
        _predict(model, buckets, orders, [*keep, "held_out"]),
        f"{kinds}, held_out boolean, lang_pred string, score double",
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
