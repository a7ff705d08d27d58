"""Periodic runs of words: Lyndon arrays under both orders, roots extended into runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm.tables import table

# Words are runs of characters other than space and \t \n \v \f \r.
WORD = regex.compile(r"[^\x20\x09-\x0D]+")
# A run is reported from this length on, and from this many periods on.
LEAST_LENGTH = 24
LEAST_EXPONENT = 3


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def planted(words: list[str], h: int | None) -> list[str]:
    """The words with a periodic tail where ``h % 10 == 0``: word ``i >= a`` becomes
    word ``a + (i - a) % p`` with ``g = h // 10``, ``a = g % n``, ``p = 1 + (n - a) // (3 + g % 8)``.
    A NULL ``h`` (NULL id) plants nothing."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _rank_levels(x: np.ndarray) -> list[np.ndarray]:
    """Ranks of the substrings of length 1, 2, 4, ... at each position (prefix doubling),
    for common extensions: equal ranks at level ``t`` mean equal substrings of length
    ``2**t``, both inside.
    """
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    levels = [rank]
    step = 1
    while step < n and rank.max() + 1 < n:
        second = np.full(n, -1, dtype=np.int64)
        second[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + (second + 1), return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        step *= 2
    return levels


def _lce(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common extensions of the positions ``i`` and ``j`` (``j`` apart from ``i``)."""
    n = len(levels[0])
    out = np.zeros(len(i), dtype=np.int64)
    i, j = i.copy(), j.copy()
    for t in range(len(levels) - 1, -1, -1):
        inside = (i < n) & (j < n) & (i >= 0) & (j >= 0)
        rank = levels[t]
        eq = np.zeros(len(i), dtype=bool)
        eq[inside] = rank[i[inside]] == rank[j[inside]]
        out[eq] += 1 << t
        i[eq] += 1 << t
        j[eq] += 1 << t
    return out


def lyndon_array(x: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each position (past the end counts as smallest),
    by the grouping of phase one of Baier's suffix sorter.

    Positions start in groups of their first word, ordered as the words are. Groups are
    taken from the greatest down; each position of the group taken looks for its previous
    position in a group not yet taken (jumping over taken ones by their own such pointers),
    and that position's Lyndon prefix grows to end where the taken one's ends. Grown
    positions leave their group for a new one right after it, one per number of times they
    grew in this step. When all groups are taken, the prefixes are the Lyndon words.
    Linear in practice: each position is taken once; pointer jumps skip taken stretches.
    """
    n = len(x)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    values, first = np.unique(x, return_inverse=True)
    group_of = first.tolist()
    g0 = len(values)
    order = np.argsort(first, kind="stable")
    bounds = np.searchsorted(first[order], np.arange(g0 + 1)).tolist()
    pos = order.tolist()
    members = [pos[bounds[g]:bounds[g + 1]] for g in range(g0)]
    after = list(range(1, g0)) + [-1]
    before = list(range(-1, g0 - 1))
    length = [1] * n
    previous = [-1] * n
    taken = [False] * n
    group = g0 - 1
    while group >= 0:
        current = members[group]
        members[group] = None
        if len(current) > 1 or (current and group_of[current[0]] != group):
            current = [i for i in current if group_of[i] == group]
        for i in current:
            taken[i] = True
        grown = []
        for i in current:
            j = i - 1
            while j >= 0 and taken[j]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                length[j] = i + length[i] - j
                grown.append(j)
        if grown:
            if len(grown) == 1:
                split = {group_of[grown[0]]: {1: grown}}
            else:
                times = {}
                for j in grown:
                    times[j] = times.get(j, 0) + 1
                split = {}
                for j, t in times.items():
                    split.setdefault(group_of[j], {}).setdefault(t, []).append(j)
            for old, by_times in split.items():
                place = old
                for t in sorted(by_times):
                    new = len(members)
                    moved = sorted(by_times[t])
                    members.append(moved)
                    for j in moved:
                        group_of[j] = new
                    nxt = after[place]
                    after.append(nxt)
                    before.append(place)
                    if nxt >= 0:
                        before[nxt] = new
                    after[place] = new
                    place = new
        group = before[group]
    return np.array(length, dtype=np.int64)


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of the sequence: maximal stretches of smallest
    period ``p`` and length at least ``2p``, sorted by start, then period.

    Each run has a Lyndon root (under the order of the words or its reverse) that is the
    longest Lyndon word at its place; so the roots of the Lyndon arrays of both orders,
    extended to both sides by common extensions, give all runs.
    """
    n = len(ids)
    if n < 2:
        return []
    forward = _rank_levels(ids)
    backward = _rank_levels(ids[::-1])
    found = []
    for order in (ids, ids.max() - ids):
        length = lyndon_array(order)
        k = np.arange(n)
        right = _lce(forward, k, k + length)
        # Common extension to the left: backwards from k-1 and k+length-1.
        back = _lce(backward, n - k, n - k - length)
        start = k - back
        end = k + length + right
        keep = end - start >= 2 * length
        found.append(np.stack([start[keep], (end - start)[keep], length[keep]], axis=1))
    every = np.unique(np.concatenate(found), axis=0)
    order = np.lexsort((every[:, 2], every[:, 0]))
    return [tuple(int(v) for v in row) for row in every[order]]


def may_hold_a_run(ids: np.ndarray) -> bool:
    """False only if the sequence has no run of length ``>= max(24, 3 * period)``.

    In such a run of period ``q`` and length ``L`` every word before the last ``q`` recurs
    ``q`` words later, so ``L - q >= max(2q, 24 - q)`` consecutive positions have their
    next equal word at most ``q`` ahead. With ``m`` the least power of two from ``q`` on
    (``q <= m < 2q``) those positions form a stretch of at least ``max(m + 1, 24 - m)``
    with their next equal word at most ``m`` ahead. Texts without such a stretch for any
    ``m`` are left out of the Lyndon arrays: they have no run.
    """
    n = len(ids)
    if n < LEAST_LENGTH:
        return False
    order = np.argsort(ids, kind="stable")
    same = ids[order][1:] == ids[order][:-1]
    ahead = np.full(n, 2 * n + 1, dtype=np.int64)
    ahead[order[:-1][same]] = order[1:][same] - order[:-1][same]
    m = 1
    while m <= n:
        edges = np.flatnonzero(np.diff(np.r_[0, (ahead <= m).astype(np.int8), 0]))
        if len(edges) and (edges[1::2] - edges[::2]).max() >= max(m + 1, LEAST_LENGTH - m):
            return True
        m *= 2
    return False


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def summary(words: list[str]) -> dict:
    """Runs of length ``>= max(24, 3 * period)`` of a word list and what remains when every
    word of such a run after its first period is dropped."""
    n = len(words)
    ids = np.unique(np.array(words, dtype=object), return_inverse=True)[1].astype(np.int64) if n else np.zeros(0, np.int64)
    found = [r for r in runs(ids) if r[1] >= max(LEAST_LENGTH, LEAST_EXPONENT * r[2])] if may_hold_a_run(ids) else []
    cover = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        cover[start + period] += 1
        cover[start + length] -= 1
    kept = np.cumsum(cover)[:n] == 0
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    return {
        "n_words": n,
        "n_runs": len(found),
        "start": best[0] if best else None,
        "length": best[1] if best else None,
        "period": best[2] if best else None,
        "exponent_milli": 1000 * best[1] // best[2] if best else None,
        "runs_sha256": _sha("".join(f"{s},{l},{p}\n" for s, l, p in found)),
        "collapsed_sha256": _sha(" ".join(w for w, k in zip(words, kept) if k)),
    }


_OUT = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, "
    "exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, crcs = (batch.column(i).to_pylist() for i in range(3))
        rows = [summary(planted(words_of(t), h)) | {"doc_id": d} for d, t, h in zip(ids, texts, crcs)]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(k, pa.int64() if k not in ("runs_sha256", "collapsed_sha256") else pa.string()) for k in _NAMES]))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): its runs of words.

    Words are numbered from 0; rows with ``crc32(decimal doc_id) % 10 == 0`` get a planted
    periodic tail first (``planted``). Returns ``doc_id``, ``n_words``, ``n_runs`` (runs of
    length ``>= max(24, 3 * period)``), for the run of greatest length/period (ties: least
    start, then period) ``start``, ``length``, ``period``, ``exponent_milli`` (all NULL
    without a run), ``runs_sha256`` (every run as ``start,length,period`` and a line feed,
    by start then period) and ``collapsed_sha256`` (the words left, joined by one space,
    when each run loses all but its first period). A NULL or empty text has no words: no
    runs and both digests of the empty text. Rows are independent; a task holds one text's
    arrays at a time, about 8 bytes a word per doubling level.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return docs.select("doc_id", "text", crc.alias("_crc")).mapInArrow(_summaries, _OUT)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
