"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm.shingles import mixed
from contactloom.llm.tables import by_size, crc_fold, table

FOLDS, HELD_OUT = 3, 1
# Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 24, 12
HIDDEN, WORD_SIZE, CHAR_SIZE = 8, 8, 8
CHAR_BUCKETS = 1 << 13
VOCABULARY = 20_000
# Labelled documents of each class that are fitted on, at most, and the characters of each.
SAMPLE = 1_500
SAMPLE_CHARS = 4_000
EPOCHS = 6
LEAST_TOXIC = 0.7
RUN_CHARS = 1_000_000
RUN_WINDOWS = 4_096


class Words:
    """Words of texts (runs of letters and digits, lower-cased) as hashes with their characters."""

    def __init__(self) -> None:
        self.inside = np.array([chr(c).isalnum() for c in range(0x30000)])
        self.base, self.powers, self.inverses = 0x9E3779B97F4A7C15, None, None
        self.powers = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, RUN_CHARS * 5 // 4)
            for name, b in (("powers", self.base), ("inverses", pow(self.base, -1, 2**64))):
                steps = np.full(n, np.uint64(b))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Character codes (32 between words), words' starts and ends and hashes, where texts begin."""
        low = [t.lower() for t in texts]
        codes = np.frombuffer((" " + " ".join(low) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
        first = 1 + np.concatenate(([0], np.cumsum([len(t) + 1 for t in low])))
        inside = self.inside[np.minimum(codes, len(self.inside) - 1)]
        codes = np.where(inside, codes, np.uint32(32))
        change = np.diff(inside.astype(np.int8))
        start, end = np.flatnonzero(change == 1) + 1, np.flatnonzero(change == -1) + 1
        self._grow(len(codes) + 1)
        values = mixed(codes.astype(np.uint64)) * self.powers[: len(codes)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
        hashes = mixed((sums[end] - sums[start]) * self.inverses[start])
        return codes, start, end, hashes, np.searchsorted(start, first)

    @staticmethod
    def trigrams(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the three-character runs of each word and its blanks, and where each word's begin."""
        size = end - start
        begin = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(start - begin[:-1], size) + np.arange(begin[-1])
        a, b, c = (codes[at + k].astype(np.uint64) for k in (-1, 0, 1))
        value = mixed(a * np.uint64(0x1F123BB5) + b * np.uint64(0x5F356495CB1) + c * np.uint64(0x9E3779B97F4A7))
        return (value % np.uint64(CHAR_BUCKETS)).astype(np.int32), begin


def windows_of(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of every window. Windows overlap and cover each text whole."""
    n = np.diff(begin)
    count = np.where(n > 0, np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = begin[:-1][text] + place * STRIDE
    return first, np.minimum(WINDOW, begin[1:][text] - first), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights by name. Suffix 0 reads forward, 1 backward."""

    vocabulary: np.ndarray  # sorted hashes
    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(vocabulary: np.ndarray) -> Network:
        draw = np.random.default_rng(1)
        size, h = WORD_SIZE + CHAR_SIZE, HIDDEN
        of = lambda scale, *shape: (draw.standard_normal(shape) * scale).astype(np.float32)
        w = {"word": of(0.1, len(vocabulary) + 1, WORD_SIZE), "char": of(0.1, CHAR_BUCKETS, CHAR_SIZE)}
        for d in "01":
            w |= {f"x{d}": of(size**-0.5, size, 3 * h), f"b{d}": np.zeros(3 * h, np.float32), f"h{d}": of(h**-0.5, h, 3 * h)}
        w |= {"a": of(0.3, 2 * h), "o": of(0.3, 2 * h), "c": np.array([-1.0], np.float32)}
        return Network(vocabulary, w)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the vocabulary; the place after the last stands for all other words."""
        n = len(self.vocabulary)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(0, n - 1))
        return np.where(self.vocabulary[at] == hashes, at, n) if n else np.zeros(len(hashes), int)

    def inputs(self, ids: np.ndarray, grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Input of each word: its own vector and the mean of its trigrams'."""
        chars = np.add.reduceat(self.w["char"][grams], begin[:-1], axis=0) / np.diff(begin)[:, None]
        return np.concatenate((self.w["word"][ids], chars), 1).astype(np.float32)

    def forward(self, rows: np.ndarray, valid: np.ndarray, projected: list[np.ndarray], keep: bool = False):
        """Logits of windows; ``rows`` are the words of each (n, WINDOW), ``projected`` the words' gates."""
        n, h = len(rows), HIDDEN
        every = np.empty((2, WINDOW, n, h), np.float32)
        full = valid.all(0)
        kept = []
        for d in (0, 1):
            state, u = np.zeros((n, h), np.float32), self.w[f"h{d}"]
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                g = projected[d][rows[:, t]]
                m = state @ u
                gates = _sigmoid(g[:, : 2 * h] + m[:, : 2 * h])
                new = np.tanh(g[:, 2 * h :] + gates[:, h:] * m[:, 2 * h :])
                after = new + gates[:, :h] * (state - new)
                if not full[t]:
                    after = np.where(valid[:, t, None], after, state)
                if keep:
                    kept.append((d, t, state, gates, m[:, 2 * h :], new))
                state = every[d, t] = after
        score = every[0] @ self.w["a"][:h] + every[1] @ self.w["a"][h:]
        score = np.where(valid.T, score, -1e9)
        alpha = np.exp(score - score.max(0))
        alpha /= alpha.sum(0)
        pooled = np.concatenate([(alpha[:, :, None] * every[d]).sum(0) for d in (0, 1)], 1)
        logit = pooled @ self.w["o"] + self.w["c"][0]
        return (logit, (every, kept, alpha, pooled)) if keep else logit

    def gradient(self, rows, valid, ids, grams, begin, error, state, x) -> dict[str, np.ndarray]:
        """Gradient of the weights, from the error at each window's logit."""
        every, kept, alpha, pooled = state
        h, w = HIDDEN, self.w
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["c"][0] = error.sum()
        g["o"] = pooled.T @ error
        down = error[:, None] * w["o"]
        into = np.stack([(every[d] * down[None, :, d * h : (d + 1) * h]).sum(2) for d in (0, 1)]).sum(0)
        at_score = alpha * (into - (alpha * into).sum(0))
        at_state = np.empty_like(every)
        for d in (0, 1):
            part = slice(d * h, (d + 1) * h)
            at_state[d] = alpha[:, :, None] * down[None, :, part] + at_score[:, :, None] * w["a"][part]
            g["a"][part] = (at_score[:, :, None] * every[d]).sum((0, 1))
        at_input = np.zeros_like(x)
        carried = [np.zeros((len(rows), h), np.float32) for _ in (0, 1)]
        at_gates = [np.zeros((len(x), 3 * h), np.float32) for _ in (0, 1)]
        for d, t, before, gates, m, new in reversed(kept):
            e = at_state[d, t] + carried[d]
            ok = valid[:, t, None]
            z, r = gates[:, :h], gates[:, h:]
            live = np.where(ok, e, 0)
            at_new = live * (1 - z) * (1 - new * new)
            at_z = live * (before - new) * z * (1 - z)
            at_r = at_new * m * r * (1 - r)
            at_m = np.concatenate((at_z, at_r, at_new * r), 1)
            g[f"h{d}"] += before.T @ at_m
            carried[d] = at_m @ w[f"h{d}"].T + live * z + np.where(ok, 0, e)
            at_g = np.concatenate((at_z, at_r, at_new), 1)
            g[f"b{d}"] += at_g.sum(0)
            np.add.at(at_gates[d], rows[:, t], at_g)
        for d in (0, 1):
            g[f"x{d}"] = x.T @ at_gates[d]
            at_input += at_gates[d] @ w[f"x{d}"].T
        np.add.at(g["word"], ids, at_input[:, :WORD_SIZE])
        size = np.diff(begin)
        spread = np.repeat(at_input[:, WORD_SIZE:] / size[:, None], size, 0)
        np.add.at(g["char"], grams, spread)
        return g

    def project(self, x: np.ndarray) -> list[np.ndarray]:
        """Gate inputs per direction; a row of zeros at the end stands for no word."""
        return [
            np.concatenate((x @ self.w[f"x{d}"] + self.w[f"b{d}"], np.zeros((1, 3 * HIDDEN), np.float32)))
            for d in (0, 1)
        ]


def _window_words(first: np.ndarray, length: np.ndarray, word_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    valid = np.arange(WINDOW)[None, :] < length[:, None]
    at = np.minimum(first[:, None] + np.arange(WINDOW)[None, :], len(word_of) - 1)
    return word_of[at], valid


def fit(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS) -> Network:
    """A network fitted on labelled texts.

    A text's logit is its greatest window's. At first every window of a text has the text's
    label; afterwards only its greatest window counts. The last step shifts and scales the logits so that
    left-out texts fit their labels best.
    """
    words = Words()
    codes, start, end, hashes, begin = words.split(texts)
    known, where, word_of = np.unique(hashes, return_index=True, return_inverse=True)
    text_of = np.repeat(np.arange(len(texts)), np.diff(begin))
    pairs = np.unique(np.stack([word_of, text_of]), axis=1)[0]
    spread = np.bincount(pairs, minlength=len(known))
    # Words of one document alone tell of it and not of toxicity.
    often = np.flatnonzero(spread >= 3)
    often = often[np.argsort(-spread[often], kind="stable")[:VOCABULARY]]
    net = Network.fresh(np.sort(known[often]))
    ids = net.word_ids(known)
    grams, grams_begin = words.trigrams(codes, start[where], end[where])
    first, length, text = windows_of(begin)
    window_begin = np.searchsorted(text, np.arange(len(texts) + 1))
    draw = np.random.default_rng(2)
    order = draw.permutation(np.flatnonzero(np.diff(window_begin)))
    left, used = order[: len(order) // 7], order[len(order) // 7 :]
    share = max(1e-3, toxic[used].mean()) if len(used) else 0.5
    weight = np.where(toxic > 0, 0.5 / share, 0.5 / max(1e-3, 1 - share))
    moment = {k: np.zeros_like(v) for k, v in net.w.items()}
    square = {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0

    def subset(at: np.ndarray):
        """Words and trigrams that the windows hold, renumbered."""
        rows, valid = _window_words(first[at], length[at], word_of)
        own, back = np.unique(rows, return_inverse=True)
        rows = np.where(valid, back.reshape(rows.shape), len(own))
        size = np.diff(grams_begin)[own]
        own_begin = np.concatenate(([0], np.cumsum(size)))
        places = np.repeat(grams_begin[own] - own_begin[:-1], size) + np.arange(own_begin[-1])
        return rows, valid, ids[own], grams[places], own_begin

    def logits(at: np.ndarray) -> np.ndarray:
        out = []
        for a in range(0, len(at), RUN_WINDOWS):
            rows, valid, own, g, gb = subset(at[a : a + RUN_WINDOWS])
            out.append(net.forward(rows, valid, net.project(net.inputs(own, g, gb))))
        return np.concatenate(out)

    for epoch in range(epochs):
        every = epoch < 1
        for a in range(0, len(used), 32):
            docs = draw.permutation(used)[:32] if a == 0 else used[a : a + 32]
            at = np.concatenate([np.arange(window_begin[i], window_begin[i + 1]) for i in docs])
            if not every:
                values = logits(at)
                of = text[at]
                at = np.array([at[of == i][np.argsort(-values[of == i])[:2]] if not toxic[i] else at[of == i][[values[of == i].argmax()]] for i in docs], dtype=object)
                at = np.concatenate(list(at)).astype(np.int64)
            rows, valid, own, g, gb = subset(at)
            x = net.inputs(own, g, gb)
            logit, state = net.forward(rows, valid, net.project(x), keep=True)
            label, size = toxic[text[at]], np.diff(window_begin)[text[at]] if every else 1.0
            error = ((_sigmoid(logit) - label) * weight[text[at]] / size / len(docs)).astype(np.float32)
            rows_x = np.where(valid, rows, len(x))
            padded = np.concatenate((x, np.zeros((1, x.shape[1]), np.float32)))
            grad = net.gradient(rows_x, valid, np.append(own, len(net.vocabulary)), np.append(g, 0), np.append(gb, gb[-1] + 1), error, state, padded)
            step += 1
            for k, v in grad.items():
                moment[k] = 0.9 * moment[k] + 0.1 * v
                square[k] = 0.999 * square[k] + 0.001 * v * v
                rate = 0.01 * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                net.w[k] -= rate * moment[k] / (np.sqrt(square[k]) + 1e-8)
        used = draw.permutation(used)
    check = left if len(left) and 0 < toxic[left].sum() < len(left) else used
    if len(check):
        top = np.array([logits(np.arange(window_begin[i], window_begin[i + 1])).max() for i in check])
        a, b = _scaling(top, toxic[check])
        net.w["o"] = (net.w["o"] * a).astype(np.float32)
        net.w["c"] = (net.w["c"] * a + b).astype(np.float32)
    return net


def _scaling(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Scale and shift of least log loss, by Newton steps with a small pull to (1, 0)."""
    a, b, pull = 1.0, 0.0, 1.0
    for _ in range(30):
        p = _sigmoid(a * logit + b)
        s = p * (1 - p)
        ga, gb = ((p - label) * logit).sum() + pull * (a - 1), (p - label).sum() + pull * b
        haa, hab, hbb = (s * logit * logit).sum() + pull, (s * logit).sum(), s.sum() + pull
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return max(a, 0.1), b


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    sample_chars: int = SAMPLE_CHARS,
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
) -> Network | None:
    """A network from labelled documents outside the held-out fold.

    Fitted on at most ``sample`` documents of each label, of the least draws by a hash of the id, and of
    at most ``sample_chars`` characters, so that what comes to the driver is bounded. Without
    such documents there is no network.
    """
    drawn = F.xxhash64("doc_id", F.lit("toxic"))
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_fold(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    parts = []
    for label in (0, 1):
        # Thrice as many ids as wanted, since some texts are too long.
        ids = known.filter(F.col("toxic") == label).orderBy(drawn, "doc_id").limit(3 * sample)
        own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
        fitting = own.filter(F.col("text").isNotNull() & (F.length("text") <= sample_chars))
        parts.append(fitting.orderBy(drawn, "doc_id", "text").limit(sample).select("text", "toxic"))
    got = parts[0].unionByName(parts[1]).toPandas()
    if not len(got):
        return None
    return fit(got["text"].tolist(), got["toxic"].to_numpy(np.float64))


def _score(net: Network | None, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            score = np.zeros(len(texts))
            for at, part in by_size(texts, RUN_CHARS) if net else ():
                codes, start, end, hashes, begin = words.split(part)
                if not len(start):
                    continue
                known, where, word_of = np.unique(hashes, return_index=True, return_inverse=True)
                grams, gb = words.trigrams(codes, start[where], end[where])
                projected = net.project(net.inputs(net.word_ids(known), grams, gb))
                first, length, text = windows_of(begin)
                top = np.full(len(part), -np.inf)
                for a in range(0, len(first), RUN_WINDOWS):
                    own = slice(a, a + RUN_WINDOWS)
                    rows, valid = _window_words(first[own], length[own], word_of)
                    rows = np.where(valid, rows, len(known))
                    np.maximum.at(top, text[own], net.forward(rows, valid, projected))
                some = np.isfinite(top)
                score[at : at + len(part)][some] = _sigmoid(top[some])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(score),
                    pa.array((score >= least).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score_toxicity(
    docs: DataFrame,
    net: Network | None,
    least: float = LEAST_TOXIC,
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    The score is that of the most toxic of all overlapping windows. A text without words (NULL, empty, blank)
    scores 0, and so do all without a network. Every row gives a row; other columns are left out.
    """
    given = docs.select(
        "doc_id", (crc_fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "text"
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(
        _score(net, least), f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
