"""Word shingles of whole texts as 64-bit hashes, in numpy over runs of texts."""

from __future__ import annotations

import numpy as np

WORDS = 5
# Bytes handled at once.
RUN_BYTES = 1_500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Shingler:
    """Distinct shingle hashes per text.

    Words are runs of bytes other than the six ASCII white spaces, with A-Z lower-cased. A word's
    hash is a polynomial over random byte values, so one running sum gives the hashes of
    all words. A shingle's is a polynomial over its scrambled word hashes. A text of fewer
    words than ``words`` has one shingle, the whole sequence; without words it has none.
    """

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        draw = np.random.default_rng(20240131)
        values = draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        fold = np.arange(256)
        fold[65:91] += 32
        self.values = values[fold]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.step = draw.integers(1, 2**63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(draw.integers(1, 2**62)) * 2 + 1
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, RUN_BYTES)
            base, back = self.base, pow(self.base, -1, 2**64)
            for name, b in (("powers", base), ("inverses", back)):
                steps = np.full(n, np.uint64(b & (2**64 - 1)))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of all texts, one after the other, and where each text's begin."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        buffer = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self._grow(len(buffer) + 1)
        lengths = np.array([len(r) + 1 for r in raw], np.int64)
        first = np.concatenate(([0], np.cumsum(lengths)))
        inside = ~self.space[buffer]
        change = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        start = np.flatnonzero(change == 1)
        end = np.flatnonzero(change == -1)
        sums = np.concatenate(
            (np.zeros(1, np.uint64), np.cumsum(self.values[buffer] * self.powers[: len(buffer)]))
        )
        word = mixed((sums[end] - sums[start]) * self.inverses[start] + _ODD)
        of = np.searchsorted(first, start, "right") - 1
        count = np.bincount(of, minlength=len(texts))
        begin = np.concatenate(([0], np.cumsum(count)))
        whole = max(0, len(word) - self.words + 1)
        value = np.zeros(whole, np.uint64)
        for j in range(self.words):
            value += word[j : j + whole] * self.step[j]
        value = mixed(value)
        out, sizes = [], np.zeros(len(texts), np.int64)
        for i in range(len(texts)):
            n, at = int(count[i]), int(begin[i])
            if n >= self.words:
                got = np.unique(value[at : at + n - self.words + 1])
            elif n:
                total = (word[at : at + n] * self.step[:n]).sum(dtype=np.uint64)
                got = mixed(np.array([total, np.uint64(n)]) ^ _ODD)
                got = got[:1] + got[1:]
            else:
                continue
            out.append(got)
            sizes[i] = len(got)
        flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
        return flat, np.concatenate(([0], np.cumsum(sizes)))
