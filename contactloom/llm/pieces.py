"""SentencePiece segmentations sampled without replacement, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm.shingles import mixed
from contactloom.llm.tables import by_size, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
RUN_CHARS = 1_000_000
# Characters of the texts whose paths are held at a time.
SLICE_CHARS = 250_000

_BLANK = 0x2581
# Stands for a blank mark that is in the text itself; no piece holds it.
_OWN_MARK = 0x110000
_BASE = 0x9E3779B97F4A7C15
_FILTER = 1 << 20
_BUCKET_BITS = 16
_WORD = 2**64 - 1
_BLOCK = 1 << 13
# Characters that are hashed at a time, and how far the powers of the base are tabled.
_HASH_BITS = 16
# Steps of a path whose branches are drawn at first, and how far a draw can lie above its mass:
# the least uniform draw is 2 ** -54.
_STEPS, _REACH = 400, 54 * float(np.log(2))
_A, _B, _C = (np.uint64(x) for x in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x9FB21C651E98DF25))


def _mixed_int(x: int) -> int:
    """``mixed`` of one value."""
    x &= _WORD
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _WORD
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _WORD
    return x ^ x >> 31


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, by value, and the number of each item's value."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(x), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return order[new], number


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id. ``scores`` are log weights; pieces of special kinds have none."""

    pieces: list[str]
    scores: list[float | None]
    byte_ids: list[int]
    # Bytes that each id decodes to.
    raw: list[bytes]


def load(path: str = MODEL) -> Vocabulary:
    """Read a model file on the driver; what tasks need of it is shipped with them.

    Pieces of a byte-pair model have ranks, not probabilities; the weight of a piece is one over its rank (Zipf).
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    normal = [i for i, p in enumerate(model.pieces) if p.type == 1]
    rank = {i: k + 1 for k, i in enumerate(normal)}
    byte_ids, raw = [0] * 256, []
    for i, p in enumerate(model.pieces):
        if p.type == 6:
            byte_ids[int(p.piece[1:-1], 16)] = i
            raw.append(bytes([int(p.piece[1:-1], 16)]))
        else:
            raw.append(p.piece.replace("▁", " ").encode() if i in rank else b"")
    scores = [-float(np.log(rank[i] + 1)) if i in rank else None for i in range(len(model.pieces))]
    return Vocabulary([p.piece for p in model.pieces], scores, byte_ids, raw)


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text that ids stand for, without the blank put before it."""
    raw = vocabulary.raw
    return b"".join([raw[i] for i in ids]).decode("utf-8", "replace")[1:]


@dataclass(frozen=True)
class _Lattice:
    """Edges of distinct units in a row, those of a node side by side, shortest first.

    Nodes with the same rest of their unit are one node, so an edge also knows where it leads.
    """

    # First edge of each node, and the number of all edges.
    first: np.ndarray
    # Running sums of the chances of a node's edges; the last is infinite, so that it exceeds any draw.
    chance: np.ndarray
    log_q: np.ndarray
    # Log chance of the node's other edges.
    log_rest: np.ndarray
    # First edge of the node that an edge leads to; -1 at the end of the unit.
    after: np.ndarray
    ids: np.ndarray


class _Branches:
    """Draws of what a path leaves from its edge ``skip`` on, bounded by the path's own.

    The masses fall along the path. Draws are made for the first steps, and for the others only when
    they could be greater than what is there: no draw lies more than ``_REACH`` above its mass.
    """

    def __init__(self, path, log_q, log_rest, skip: int, before: float, bound: float, seed: int) -> None:
        self.path, self.log_q, self.log_rest = path, log_q, log_rest
        self.skip, self.before, self.bound = skip, before, bound
        self.own = np.uint64(_mixed_int(seed * int(_B)))
        self.taken: dict[int, list[int]] = {}
        self.upto = skip
        self.draws = np.zeros(0)
        self.more()

    def more(self) -> None:
        a = self.upto
        b = min(len(self.path), a + max(_STEPS, a - self.skip))
        log_q = self.log_q[a:b]
        x = mixed(self.own + np.arange(a, b, dtype=np.uint64) * _A)
        e = -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        mass = self.before + np.cumsum(log_q) - log_q + self.log_rest[self.path[a:b]]
        with np.errstate(divide="ignore"):
            draw = mass - np.log(np.exp(mass - self.bound) + e)
        self.draws = np.concatenate((self.draws, draw)) if a > self.skip else draw
        self.before += float(log_q.sum())
        self.upto = b

    def best(self) -> float:
        while (top := self.draws.max(initial=-np.inf)) < self.before + _REACH:
            if self.upto == len(self.path):
                break
            self.more()
        return float(top)


class Sampler:
    """Perturbed A-star search over the lattices of texts.

    A text's lattice falls into units that no piece crosses (a blank run with the word behind it,
    and characters that no piece holds). Units repeat, so the backward sums of each
    distinct unit of a run of texts are computed once, for all units at the same time. They
    turn weights into the exact chance of each edge, given where a path stands.

    The best sample of a text follows edges by chance and gets a Gumbel draw. What it leaves
    falls into branches: the same path up to some edge, then another edge. Each branch has its
    mass and a Gumbel draw that is bounded by its parent's; the branch with the greatest draw holds the
    next sample, and so on. So samples are distinct and come in the order of their draws.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        normal = [i for i, s in enumerate(vocabulary.scores) if s is not None]
        text = [vocabulary.pieces[i] for i in normal]
        self.longest = max(map(len, text))
        self.powers, self.inverses = (self._powers(b, 1 << _HASH_BITS) for b in (_BASE, pow(_BASE, -1, 2**64)))
        # Hashes of all pieces and of what they begin with, from sums over the pieces in a row.
        size = np.array([len(t) for t in text], np.int64)
        sums = self._sums(np.frombuffer("".join(text).encode("utf-32-le"), np.uint32))
        ends = np.cumsum(size)
        first = np.repeat(ends - size, size)
        begun = (sums[1:] - sums[first]) * self._inverse(first)
        hashes = begun[ends - 1]
        order = np.argsort(hashes)
        # A greatest hash behind the last, and where the hashes of each run of first bits begin.
        self.hashes = np.append(hashes[order], np.uint64(_WORD))
        self.bucket = np.searchsorted(self.hashes[:-1], np.arange(1 << _BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - _BUCKET_BITS))
        self.ids = np.array(normal, np.int32)[order]
        self.scores = np.array([vocabulary.scores[i] for i in normal], np.float32)[order]
        # Whether some piece may begin with a run of characters, by its hash.
        self.begins = np.zeros(_FILTER, bool)
        self.begins[(begun % np.uint64(_FILTER)).astype(np.int64)] = True
        self.held = np.zeros(_OWN_MARK + 1, bool)
        self.held[[ord(c) for t in text for c in t]] = True
        self.single = np.zeros(_OWN_MARK + 1, bool)
        self.single[[ord(t) for t in text if len(t) == 1]] = True
        self.byte_score = -float(np.log(len(vocabulary.pieces)))
        self.byte_ids = np.array(vocabulary.byte_ids, np.int32)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        steps = np.full(n, np.uint64(base))
        steps[:1] = 1
        return np.multiply.accumulate(steps)

    def _inverse(self, at: np.ndarray) -> np.ndarray:
        """The inverse of the base to the power of a place, from two short tables."""
        step = pow(_BASE, -1 << _HASH_BITS, 2**64)
        far = self._powers(step, int(at.max(initial=0) >> _HASH_BITS) + 1)
        return self.inverses[at & (1 << _HASH_BITS) - 1] * far[at >> _HASH_BITS]

    def _sums(self, codes: np.ndarray) -> np.ndarray:
        """Running sums of the characters' hashes times powers of the base, block by block."""
        out = np.zeros(len(codes) + 1, np.uint64)
        step = pow(_BASE, 1 << _HASH_BITS, 2**64)
        far = 1
        for low in range(0, len(codes), 1 << _HASH_BITS):
            values = mixed(codes[low : low + (1 << _HASH_BITS)].astype(np.uint64))
            values *= self.powers[: len(values)]
            values *= np.uint64(far)
            values[:1] += out[low : low + 1]
            np.cumsum(values, out=out[low + 1 : low + 1 + len(values)])
            far = far * step & _WORD
        return out

    def _units(self, texts: list[str]):
        """Codes of all texts, starts of units, and where each text's units begin."""
        joined = " " + " ".join(texts) if texts else ""
        codes = np.frombuffer(bytearray(joined, "utf-32-le", "surrogatepass"), np.int32)
        codes[codes == _BLANK] = _OWN_MARK
        codes[codes == 32] = _BLANK
        first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        blank = codes == _BLANK
        alone = ~self.held[codes]
        cut = np.zeros(len(codes), bool)
        cut[0] = True
        cut[1:] = (blank[1:] & ~blank[:-1]) | alone[1:] | alone[:-1]
        cut[first[:-1]] = True
        start = np.flatnonzero(cut)
        return codes, start, first, np.searchsorted(start, first)

    def _place(self, h: np.ndarray) -> np.ndarray:
        """Where the first hash of a piece stands that is not less."""
        place = self.bucket[(h >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)]
        less = np.flatnonzero(self.hashes[place] < h)
        while len(less):
            place[less] += 1
            less = less[self.hashes[place[less]] < h[less]]
        return place

    def _edges(self, codes: np.ndarray, sums: np.ndarray, at: np.ndarray, longer: np.ndarray):
        """Edges of nodes by length, and how many each node has.

        Per length: nodes, which of their edges it is, scores and ids. ``longer``: from which node on
        at least 1, 2, ... characters are left.
        """
        count = np.zeros(len(at), np.int32)
        found = []
        # Characters that are no piece are spelt in bytes; longer spellings are written out later.
        odd = np.flatnonzero(~self.single[codes[at]])
        if len(odd):
            c = codes[at[odd]]
            real = np.where(c == _OWN_MARK, _BLANK, c)
            n_bytes = 1 + (real > 0x7F) + (real > 0x7FF) + (real > 0xFFFF)
            ids = np.where(real < 0x80, self.byte_ids[np.minimum(real, 127)], -real - 1)
            found.append((1, odd, count[odd], n_bytes * self.byte_score, ids))
            count[odd] = 1
        node, begin, inverse = np.arange(len(at)), sums[at], self._inverse(at)
        for k in range(1, min(self.longest, len(longer) - 1) + 1):
            # Only what some piece begins with can be longer.
            low = int(np.searchsorted(node, longer[k - 1]))
            node, at, begin, inverse = node[low:], at[low:], begin[low:], inverse[low:]
            h = (sums[at + k] - begin) * inverse
            begun = np.flatnonzero(self.begins[(h % np.uint64(_FILTER)).astype(np.int64)])
            node, at, begin, inverse, h = node[begun], at[begun], begin[begun], inverse[begun], h[begun]
            place = self._place(h)
            right = np.flatnonzero(self.hashes[place] == h)
            own, place = node[right], place[right]
            found.append((k, own, count[own], self.scores[place], self.ids[place]))
            count[own] += 1
        return found, count

    def _lattice(self, codes: np.ndarray, sums: np.ndarray, start: np.ndarray, size: np.ndarray):
        """The lattice of the given units, and the first edge of each unit.

        What can follow a node depends on the rest of its unit alone, so nodes with the same
        rest are one.
        """
        base = np.concatenate(([0], np.cumsum(size)))
        left = np.repeat(base[1:], size) - np.arange(base[-1])
        at = np.repeat(start - base[:-1], size) + np.arange(base[-1])
        rest = (np.repeat(sums[start + size], size) - sums[at]) * self._inverse(at) + left.astype(np.uint64) * _A
        some, row = _distinct(rest)
        del rest
        # By length, so that nodes with as much left, and those with more, are slices.
        left = left[some]
        order = np.argsort(left.astype(np.min_scalar_type(left.max(initial=0))), kind="stable")
        some = some[order]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        row = rank[row]
        left, at = left[order], at[some]
        n = len(some)
        longer = np.searchsorted(left, np.arange(1, int(left.max(initial=0)) + 2))
        found, count = self._edges(codes, sums, at, longer)
        first = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
        # The end of a unit is a node without edges.
        score, ids = np.empty(first[-1]), np.empty(first[-1], np.int32)
        target, turn = np.full(first[-1], n, np.int32), np.empty(first[-1], np.int16)
        for k, own, nth, of, which in found:
            edge = first[own] + nth
            score[edge], ids[edge], turn[edge] = of, which, nth
            inner = int(np.searchsorted(own, longer[k]))
            target[edge[inner:]] = row[some[own[inner:]] + k]
        del found
        chance, back = np.empty(first[-1]), np.zeros(n + 1)
        for low, high in zip(longer[:-1].tolist(), longer[1:].tolist(), strict=True):
            if low == high:
                continue
            own = slice(int(first[low]), int(first[high]))
            line = np.repeat(np.arange(high - low), count[low:high])
            s = score[own] + back[target[own]]
            top = np.maximum.reduceat(s, first[low:high] - first[low])
            total = np.zeros((high - low, int(count[low:high].max())))
            total[line, turn[own]] = np.exp(s - top[line])
            np.cumsum(total, 1, out=total)
            whole = total[:, -1]
            back[low:high] = top + np.log(whole)
            chance[own] = total[line, turn[own]] / whole[line]
        chance[first[1:] - 1] = 1.0
        q = np.diff(chance, prepend=0.0)
        q[first[:-1]] = chance[first[:-1]]
        with np.errstate(divide="ignore"):
            log_q, log_rest = np.log(q), np.log1p(-np.minimum(q, 1.0))
        log_rest[q > 1 - 1e-13] = -np.inf
        chance[first[1:] - 1] = np.inf
        begin = first.astype(np.int32)
        begin[-1] = -1
        return _Lattice(first, chance, log_q, log_rest, begin[target], ids), begin[row[base[:-1]]]

    @staticmethod
    def _draw(seed: int, a: int, b: int) -> float:
        """A draw in (0, 1) that depends on seed and place only."""
        x = _mixed_int(_mixed_int(seed + a * int(_A)) + b * int(_B))
        return ((x >> 11) + 0.5) * 2.0**-53

    def _follow(self, lattice: _Lattice, start: np.ndarray, seed: np.ndarray, place: np.ndarray):
        """A path by chance through each unit: edges by unit, and where each unit's begin."""
        n = len(start)
        kept, count = [], np.zeros(n, np.int64)
        seed = mixed(seed + place.astype(np.uint64) * _A)
        # Few units at a time, so that what a step gathers stays in the processor's cache.
        for low in range(0, n, _BLOCK):
            at, own = start[low : low + _BLOCK], seed[low : low + _BLOCK]
            unit, t = np.arange(low, low + len(at)), 0
            while len(at):
                x = mixed(own + np.array([t], np.uint64) * _B) >> np.uint64(11)
                u = (x.astype(np.float64) + 0.5) * 2.0**-53
                # The first edge whose running sum exceeds the draw.
                edge = at.copy()
                beyond = np.flatnonzero(u >= lattice.chance[edge])
                while len(beyond):
                    edge[beyond] += 1
                    beyond = beyond[u[beyond] >= lattice.chance[edge[beyond]]]
                kept.append((t, unit, edge))
                count[unit] += 1
                at = lattice.after[edge]
                on = np.flatnonzero(at >= 0)
                at, own, unit = at[on], own[on], unit[on]
                t += 1
        begin = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(begin[-1], np.int32)
        for t, unit, edge in kept:
            out[begin[unit] + t] = edge
        return begin, out

    def sample(self, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """Per text up to ``k`` samples: ids, log chance, Gumbel draw, log inclusion score."""
        out: list = [[(np.zeros(0, np.int32), 0.0, 0.0, 0.0)] for _ in texts]
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        begin, start, lattice = self._walks([texts[i] for i in full])
        at = 0
        # The lattice is that of the whole run; paths are many times longer than texts, so they go by slices.
        for _, part in by_size((texts[i] for i in full), SLICE_CHARS):
            own = range(at, at + len(part))
            units = slice(int(begin[at]), int(begin[own.stop]))
            bounds = begin[at : own.stop + 1] - units.start
            text_of = np.repeat(np.arange(len(part)), np.diff(bounds))
            place = np.arange(bounds[-1]) - bounds[text_of]
            seed = mixed(seeds[full[at : own.stop]].astype(np.uint64))
            drawn = [
                self._follow(lattice, start[units], mixed(seed + x)[text_of], place)
                for x in np.arange(1, k + 1, dtype=np.uint64) * _C
            ]
            for j, i in enumerate(own):
                out[full[i]] = self._search(int(bounds[j]), int(bounds[j + 1]), seed[j], drawn, lattice, k)
            at = own.stop
        return out

    def _walks(self, texts: list[str]):
        """Where each text's units begin, the first edges of the units, and the lattice of all texts."""
        codes, start, _, begin = self._units(texts)
        size = np.diff(np.append(start, len(codes)))
        sums = self._sums(codes)
        # The code of a unit and its length; the cut of a text keeps units inside it.
        name = mixed((sums[start + size] - sums[start]) * self._inverse(start)) + size.astype(np.uint64)
        where, unit = _distinct(name)
        del name
        lattice, first = self._lattice(codes, sums, start[where], size[where])
        return begin, first[unit], lattice

    def _search(self, a, b, seed, drawn, lattice, k):
        """Best-first search of one text, whose units are ``a`` to ``b``."""
        last, number = 2**40, int(seed)

        begin, edges = drawn[0]
        path = edges[int(begin[a]) : int(begin[b])]
        log_q = lattice.log_q[path]
        gumbel = -np.log(-np.log(self._draw(number, 0, last + 99)))
        found = [(path, log_q, gumbel)]
        agenda = [_Branches(path, log_q, lattice.log_rest, 0, 0.0, gumbel, number)]
        bounds = [begin[a : b + 1] - begin[a]]
        while len(found) < k:
            best = max(range(len(agenda)), key=lambda j: agenda[j].best())
            branch = agenda[best]
            bound, old, taken = branch.best(), branch.path, branch.taken
            if not np.isfinite(bound):
                break
            s = branch.skip + int(branch.draws.argmax())
            r = len(found)
            # The edges beside the path's own that are not taken yet.
            here = int(np.searchsorted(lattice.first, old[s], "right")) - 1
            low, high = int(lattice.first[here]), int(lattice.first[here + 1])
            row = np.diff(np.minimum(lattice.chance[low:high], 1.0), prepend=0.0)
            banned = taken.setdefault(s, [int(old[s]) - low])
            row[banned] = 0.0
            rest = row.sum()
            u = self._draw(number, s, last + 200 + r)
            pick = int(np.searchsorted(np.cumsum(row), u * rest, "right"))
            pick = min(pick, int(np.flatnonzero(row)[-1]))
            w = int(np.searchsorted(bounds[best], s, "right")) - 1
            steps = [low + pick]
            at, t = int(lattice.after[low + pick]), 0
            while at >= 0:
                u = self._draw(number, s, last + 1_000 * (r + 1) + t)
                while u >= lattice.chance[at]:
                    at += 1
                steps.append(at)
                at, t = int(lattice.after[at]), t + 1
            begin, edges = drawn[r]
            tail = edges[int(begin[a + w + 1]) : int(begin[b])]
            path = np.concatenate((old[:s], np.array(steps, np.int32), tail))
            log_q = lattice.log_q[path]
            before = float(log_q[:s].sum())
            # What is left of the branch after this edge.
            banned.append(pick)
            left = rest - row[pick]
            mass = before + np.log(left) if left > 1e-15 else -np.inf
            e = -np.log(self._draw(number, s, last + 500 + r))
            branch.draws[s - branch.skip] = (
                mass - np.log(np.exp(mass - bound) + e) if np.isfinite(mass) else -np.inf
            )
            found.append((path, log_q, bound))
            agenda.append(
                _Branches(path, log_q, lattice.log_rest, s + 1, before + float(log_q[s]), bound, number + r)
            )
            bounds.append(
                np.concatenate((bounds[best][: w + 1], s + len(steps) + begin[a + w + 1 : b + 1] - begin[a + w + 1]))
            )
        rest = max(x.best() for x in agenda)
        result = []
        for path, log_q, g in found:
            log_p = float(log_q.sum())
            chosen = lattice.ids[path]
            if (chosen < 0).any():
                chosen = np.concatenate(
                    [
                        [c] if c >= 0 else self.byte_ids[list(chr(-c - 1).encode("utf-8", "surrogatepass"))]
                        for c in chosen.tolist()
                    ]
                ).astype(np.int32)
            result.append((chosen, log_p, float(g), _log_inclusion(log_p, rest)))
        return result


def _log_inclusion(log_p: float, threshold: float) -> float:
    """Log chance that a path's draw lies above the threshold: ``log(1 - exp(-exp(log_p - threshold)))``."""
    if threshold == -np.inf:
        return 0.0
    x = log_p - threshold
    return float(x) if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))


_OUT = "sample int, n_pieces int, log_prob double, draw double, log_inclusion double, ids array<int>, round_trip boolean"


def _round_trips(raw: pa.Array, ids: np.ndarray, offsets: np.ndarray, texts: list[str]) -> list[bool]:
    """Whether each list of ids decodes to its text, behind the blank put before it. ``raw``: bytes of each id."""
    _, ends, data = raw.take(pa.array(ids)).buffers()
    at = np.frombuffer(ends, np.int64)[offsets].tolist()
    plain = memoryview(data or b"")
    return [bytes(plain[a + 1 : b]) == t.encode() for a, b, t in zip(at, at[1:], texts, strict=False)]


def _encode(vocabulary: Vocabulary, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, raw = Sampler(vocabulary), pa.array(vocabulary.raw, pa.large_binary())
        names = ["doc_id", *[c.split()[0] for c in _OUT.split(", ")]]
        for batch in batches:
            seeds = batch.column("seed").to_numpy(zero_copy_only=False)
            for at, part in by_size((t.as_py() or "" for t in batch.column("text")), RUN_CHARS):
                found = sampler.sample(part, seeds[at : at + len(part)].view(np.uint64), k)
                rows = [(i, j, *s) for i, own in enumerate(found) for j, s in enumerate(own)]
                lists = [r[2] for r in rows]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                ids = np.concatenate(lists).astype(np.int32)
                back = _round_trips(raw, ids, offsets, [part[r[0]] for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array([at + r[0] for r in rows], pa.int64())),
                        pa.array([r[1] for r in rows], pa.int32()),
                        pa.array(np.diff(offsets)),
                        *[pa.array([r[c] for r in rows], pa.float64()) for c in (3, 4, 5)],
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                        pa.array(back, pa.bool_()),
                    ],
                    names=names,
                )

    return run


def sample_pieces(docs: DataFrame, vocabulary: Vocabulary, samples: int = SAMPLES) -> DataFrame:
    """Distinct sampled segmentations of whole texts, best draw first.

    ``doc_id, sample, n_pieces, log_prob, draw, log_inclusion, ids, round_trip``: ``log_prob`` is the chance of the
    segmentation, ``draw`` its Gumbel draw, ``log_inclusion`` the chance that it is among the samples given the greatest
    draw that is not, and ``round_trip`` tells whether the ids decode to the text.

    Draws depend on the id alone (NULL is an id), so repeated rows and reruns get the same samples. A text with
    fewer segmentations than ``samples`` gives all of them; NULL and empty texts have one, without pieces, that decodes to the
    empty text. Other columns are left out. Texts are handled in runs, so memory is bounded by the longest text.
    """
    seed = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("seed")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", seed, "text").mapInArrow(
        _encode(vocabulary, samples), f"doc_id {kind}, {_OUT}"
    )


def op9_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of all documents."""
    return sample_pieces(table(spark, sf_dir, "documents"), load())
