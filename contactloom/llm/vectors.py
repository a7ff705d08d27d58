"""Embedding near-dedup by a forest of random-projection trees."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm.components import components
from contactloom.llm.tables import table
from contactloom.session import dropped, short_lived_shuffles, stored

LEAST_COSINE = 0.93
TREES = 8
LEAF = 2_000
# Share of a node's rows, around the split, that go to both sides.
SPILL = 0.1
SEED = 20240131
# A label's sample for its dense places holds so many rows of a leaf; a place of half as many is dense.
DENSE_SAMPLE = 32
# Rows of a block that is compared with another, in leaves.
BLOCK_LEAVES = 4
# Levels of splits; far more than any table needs.
MOST_LEVELS = 60
# Nodes of at most so many bytes of doubles are split further, and compared, by one task.
BRANCH_BYTES = 32 << 20
# Rows that are sent through a shuffle at once, as a multiple of the rows there are.
AT_ONCE = 1.5
# Linked pairs of a branch that are looked at together.
PAIRS = 1_000_000

_LINKS = "id long, links long, head long"
# Columns of rows of a branch that go there as one, in Spark and in Arrow.
_PACKED = {
    "branch": ("long", pa.int64()),
    "space": ("string", pa.string()),
    "size": ("int", pa.int32()),
    "ids": ("binary", pa.binary()),
    "vecs": ("binary", pa.binary()),
    "copies": ("binary", pa.binary()),
}


def _mixed(z: np.ndarray) -> np.ndarray:
    """64-bit numbers, mixed (the finalizer of SplitMix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _root_key(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") ^ SEED


def _child_keys(key: int) -> list[int]:
    return _mixed(np.array([key, key], np.uint64) + np.array([1, 2], np.uint64)).tolist()


def _directions(keys: np.ndarray, size: int) -> np.ndarray:
    """The directions nodes are split along, a row of normal numbers drawn from each node's key."""
    half = (size + 1) // 2
    steps = np.arange(1, 2 * half + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    even = (_mixed(keys[:, None] + steps) >> np.uint64(11)) * 2.0**-53
    radius, angle = np.sqrt(-2 * np.log1p(-even[:, :half])), 2 * np.pi * even[:, half:]
    return np.concatenate([radius * np.cos(angle), radius * np.sin(angle)], 1)[:, :size]


@dataclass
class _Forest:
    """Nodes of all trees by number. Children are numbered in a row; a leaf has none (-1).

    Rows up to ``high`` along a node's direction go to its first child, rows from ``low`` on to the second.
    Cuts are single precision, so hardly a place is equal to one, and places that are computed
    again fall on the same side.
    """

    key: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    # Numbers of the roots, a tree after another, of each space that is larger than a leaf.
    roots: dict[str, list[int]]

    def add(self, keys: list[int]) -> int:
        """New leaves; the number of the first."""
        first, none = len(self.key), np.zeros(len(keys), np.float32)
        self.key = np.concatenate([self.key, np.array(keys, np.uint64)])
        self.low, self.high = np.concatenate([self.low, none]), np.concatenate([self.high, none])
        self.child = np.concatenate([self.child, np.full(len(keys), -1, np.int32)])
        return first

    def graft(self, grown: list[tuple[int, bytes]]) -> None:
        """Put the nodes that were grown below leaves, as ``_grown`` writes them, in the places of these."""
        parts = [(at, np.frombuffer(nodes, _NODE).copy()) for at, nodes in grown]
        first = len(self.key)
        for at, nodes in parts:
            self.low[at], self.high[at] = nodes["low"][0], nodes["high"][0]
            # The first of the nodes is the leaf itself.
            self.child[at] = first if len(nodes) > 1 else -1
            nodes["child"][nodes["child"] > 0] += first - 1
            first += len(nodes) - 1
        for name in ("key", "low", "high", "child"):
            setattr(self, name, np.concatenate([getattr(self, name), *[nodes[name][1:] for _, nodes in parts]]))


_NODE = np.dtype([("key", np.uint64), ("low", np.float32), ("high", np.float32), ("child", np.int32)])


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows of ``x``, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def _numbers(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Rows of a column of vectors of one length, written as bytes of numbers of a kind."""
    if not len(column):
        return np.zeros((0, 0), kind)
    parts = []
    for part in [column] if isinstance(column, pa.Array) else column.chunks:
        part = part.cast(pa.large_binary())
        ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        parts.append(np.frombuffer(part.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(parts).view(kind).reshape(len(column), -1)


def _stacked(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Unit vectors of such a column."""
    return _units(_numbers(column, kind)) if len(column) else np.zeros((0, 0))


def _bytes_of(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """``n`` values: the bytes of the rows of each matrix at the positions beside it, else NULL."""
    sizes = np.zeros(n, np.int64)
    for at, x in parts:
        sizes[at] = x.shape[1] * x.itemsize
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = np.empty(ends[-1], np.uint8)
    for at, x in parts:
        own = np.ascontiguousarray(x).view(np.uint8).reshape(len(at), -1)
        if len(parts) == 1:
            data = own.ravel()
        else:
            data[ends[at][:, None] + np.arange(own.shape[1])] = own
    mask = pa.py_buffer(np.packbits(sizes > 0, bitorder="little"))
    out = pa.Array.from_buffers(pa.large_binary(), n, [mask, pa.py_buffer(ends), pa.py_buffer(data)])
    return out.cast(pa.binary())


def _normal(kind: str, columns: list[str]):
    """The class of each row, a digest of its label and unit vector, and the vector as given, as bytes.

    Both NULL where the vector is NULL, empty, zero or not finite; the class also where the label is NULL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, labels = batch.column("embedding"), batch.column("label").to_pylist()
            classes: list[bytes | None] = [None] * len(column)
            given = []
            at = column.offsets.to_numpy().astype(np.int64)
            values = column.values
            blank = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
            values = values.to_numpy(zero_copy_only=False).astype(kind)
            sizes = np.diff(at)
            whole = column.is_valid().to_numpy(zero_copy_only=False) & (blank[at[1:]] == blank[at[:-1]])
            for size in np.unique(sizes[whole & (sizes > 0)]).tolist():
                rows = np.flatnonzero(whole & (sizes == size))
                x = values[at[rows][:, None] + np.arange(size)]
                top = np.abs(x).max(1)
                good = np.isfinite(top) & (top > 0)
                x, rows = x[good], rows[good]
                if len(rows):
                    given.append((rows, x))
                    for i, unit in zip(rows.tolist(), _units(x), strict=True):
                        if labels[i] is not None:
                            classes[i] = hashlib.md5(f"{labels[i]}|".encode() + unit.tobytes(), usedforsecurity=False).digest()
            made = {"class": pa.array(classes, pa.binary())}
            if "vec" in columns:
                made["vec"] = _bytes_of(given, len(column))
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in columns], names=columns)

    return run


def _places(x: np.ndarray, rows: np.ndarray, nodes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each row of ``x`` along the direction of the node beside it."""
    out, order = np.empty(len(rows)), np.argsort(nodes, kind="stable")
    for a in range(0, len(rows), 8_192):
        part = order[a : a + 8_192]
        known, at = np.unique(nodes[part], return_inverse=True)
        along = _directions(keys[known], x.shape[1])
        # Row by row in one fixed order, so a place does not depend on what is computed beside it.
        out[part] = np.einsum("ij,ij->i", x[rows[part]], along[at])
    return out


def _reached(x: np.ndarray, rows: np.ndarray, nodes: np.ndarray, forest: _Forest) -> tuple[np.ndarray, np.ndarray]:
    """The leaves that are reached by rows of ``x`` from the nodes beside them: rows, leaves."""
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        first = forest.child[nodes]
        ends.append((rows[first < 0], nodes[first < 0]))
        rows, nodes, first = rows[first >= 0], nodes[first >= 0], first[first >= 0]
        if not len(rows):
            return np.concatenate([r for r, _ in ends]), np.concatenate([n for _, n in ends])
        place = _places(x, rows, nodes, forest.key)
        left, right = place <= forest.high[nodes], place >= forest.low[nodes]
        rows = np.concatenate([rows[left], rows[right]])
        nodes = np.concatenate([first[left], first[right] + 1])


def _by_space(batch: pa.RecordBatch, kind: str, spaces: dict[str, list[int]]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Each of the spaces that a batch has rows of, with their positions and unit vectors."""
    held = batch.column("space").dictionary_encode()
    codes = held.indices.to_numpy()
    for code, space in enumerate(held.dictionary.to_pylist()):
        if space in spaces:
            rows = np.flatnonzero(codes == code)
            yield space, rows, _stacked(batch.column("vec").take(pa.array(rows)), kind)


def _open_places(forest: _Forest, kind: str, wanted: np.ndarray):
    """Places of all rows along the directions of those nodes that are ``wanted`` (a flag a node): ``node, place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for space, _, x in _by_space(batch, kind, forest.roots):
                for root in forest.roots[space]:
                    rows, nodes = _reached(x, np.arange(len(x)), np.full(len(x), root), forest)
                    rows, nodes = rows[wanted[nodes]], nodes[wanted[nodes]]
                    place = _places(x, rows, nodes, forest.key)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(place)], names=["node", "place"])

    return run


def _ranks(spill: float) -> list[float]:
    return [0.5 - spill / 2, 0.5 + spill / 2]


def _tops(rows: DataFrame, forest: _Forest, sizes: dict[str, tuple[int, int]], spill: float, kind: str) -> int:
    """Split all nodes of more rows than a task should hold, level by level; the number of levels.

    ``sizes`` has the number of rows of a space and of those that a task should hold. Cuts are taken from quantile
    sketches with partial aggregates, so a node may hold any number of rows; rows are not written anew, but
    go down from the roots again at each level.
    """
    share = 0.5 + spill / 2
    left = [(root, n, held) for space, (n, held) in sizes.items() for root in forest.roots[space]]
    for level in range(MOST_LEVELS):
        left = [x for x in left if x[1] > x[2]]
        if not left:
            return level
        wanted = np.zeros(len(forest.key), bool)
        wanted[[node for node, _, _ in left]] = True
        placed = rows.mapInArrow(_open_places(forest, kind, wanted), "node long, place double")
        cuts = {
            r["node"]: np.array(r["cut"], np.float32)
            for r in placed.groupBy("node").agg(F.percentile_approx("place", _ranks(spill), 2_000).alias("cut")).collect()
        }
        # A node whose places are all equal stays a leaf.
        left = [x for x in left if x[0] in cuts and cuts[x[0]][0] < cuts[x[0]][1]]
        first = forest.add([k for node, _, _ in left for k in _child_keys(int(forest.key[node]))])
        for i, (node, _, _) in enumerate(left):
            forest.low[node], forest.high[node] = cuts[node]
            forest.child[node] = first + 2 * i
        left = [(first + 2 * i + side, int(n * share), held) for i, (_, n, held) in enumerate(left) for side in (0, 1)]
    return MOST_LEVELS


def _grown(key: int, x: np.ndarray, leaf: int, spill: float) -> bytes:
    """The nodes below a node of the rows ``x``: itself first, children numbered among them."""
    nodes, todo = [[key, 0.0, 0.0, -1]], [(0, np.arange(len(x)), 0)]
    while todo:
        node, own, depth = todo.pop()
        if len(own) <= leaf or depth == MOST_LEVELS:
            continue
        place = _places(x, own, np.zeros(len(own), np.int64), np.array([nodes[node][0]], np.uint64))
        ranks = [math.ceil(share * len(own)) - 1 for share in _ranks(spill)]
        low, high = np.partition(place, ranks)[ranks].astype(np.float32)
        left, right = own[place <= high], own[place >= low]
        # A cut that parts no row from the others ends the node as a leaf.
        if low == high or max(len(left), len(right)) == len(own):
            continue
        nodes[node][1:] = low, high, len(nodes)
        todo += [(len(nodes), left, depth + 1), (len(nodes) + 1, right, depth + 1)]
        nodes += [[k, 0.0, 0.0, -1] for k in _child_keys(nodes[node][0])]
    return np.array([tuple(x) for x in nodes], _NODE).tobytes()


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Numbers of a kind whose bytes are the values of a column."""
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for part in column.chunks for x in part])


def _grow_branches(forest: _Forest, kind: str, leaf: int, spill: float):
    """The nodes below a branch, from all its rows."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        branch = key[0].as_py()
        x = _units(_joined(rows["vecs"], kind).reshape(-1, rows["size"][0].as_py()))
        grown = _grown(int(forest.key[branch]), x, leaf, spill)
        return pa.table({"branch": pa.array([branch], pa.int64()), "nodes": pa.array([grown], pa.binary())})

    return run


def _to_branches(forest: _Forest, kind: str, tree: int, part: int, parts: int, columns: list[str]):
    """The branches of a tree (nodes that a task can hold) that each row is in: one part of them.

    Rows of a branch that are met together go there as one row, their values one after another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = batch.column("id").to_numpy(), batch.column("copies").to_numpy()
            out: dict[str, list] = {c: [] for c in columns}
            for space, at, x in _by_space(batch, kind, forest.roots):
                given = _numbers(batch.column("vec").take(pa.array(at)), kind)
                rows, nodes = _reached(x, np.arange(len(x)), np.full(len(x), forest.roots[space][tree]), forest)
                rows, nodes = rows[nodes % parts == part], nodes[nodes % parts == part]
                order = np.argsort(nodes, kind="stable")
                known, starts = np.unique(nodes[order], return_index=True)
                for branch, own in zip(known.tolist(), np.split(rows[order], starts[1:]), strict=True):
                    made = {"branch": branch, "space": space, "size": x.shape[1], "ids": ids[at[own]].tobytes()}
                    made |= {"vecs": given[own].tobytes(), "copies": copies[at[own]].tobytes()}
                    for c in columns:
                        out[c].append(made[c])
            yield pa.RecordBatch.from_arrays([pa.array(out[c], _PACKED[c][1]) for c in columns], names=columns)

    return run


def _near_pairs(x: np.ndarray, own: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs among the rows ``own`` of ``x``, which ascend; the first of a pair is less.

    Single precision tells which rows may have links; their cosines are computed in double precision.
    """
    short = x[own].astype(np.float32)
    bound = np.float32(least - (x.shape[1] + 4) * 2.0**-23)
    for a in range(0, len(own), 128):
        cosine = short[a : a + 128] @ short[a:].T
        np.fill_diagonal(cosine, -2)
        rows = np.flatnonzero(cosine.max(1) >= bound)
        if len(rows):
            columns = np.flatnonzero((cosine[rows] >= bound).any(0))
            left, right = own[a + rows], own[a + columns]
            u, v = np.nonzero(x[left] @ x[right].T >= least)
            u, v = left[u], right[v]
            yield u[u < v], v[u < v]


def _met(x: np.ndarray, u: np.ndarray, v: np.ndarray, root: int, forest: _Forest, below: np.ndarray | None) -> np.ndarray:
    """Which of the pairs of rows are both in one leaf of a tree; of those ``below`` a number, if given."""
    rows, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    held, leaves = _reached(x, rows, np.full(len(rows), root), forest)
    entries = np.sort(np.searchsorted(rows, held).astype(np.int64) << 32 | leaves)
    first, last = np.searchsorted(entries, u << 32), np.searchsorted(entries, (u + 1) << 32)
    met = np.zeros(len(u), bool)
    todo = np.arange(len(u))
    while len(todo := todo[(first[todo] < last[todo]) & ~met[todo]]):
        leaf = entries[first[todo]] & 0xFFFFFFFF
        wanted = v[todo] << 32 | leaf
        found = entries[np.minimum(np.searchsorted(entries, wanted), len(entries) - 1)] == wanted
        met[todo] = found if below is None else found & (leaf < below[todo])
        first[todo] += 1
    return met


def _compare(least: float, kind: str, forest: _Forest | None = None, tree: int = 0):
    """Links inside the leaves of a branch; without a forest inside the group, as one leaf.

    A pair counts in the first leaf that holds both: by the number of the tree, then of the leaf.
    """
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if forest:
            names, copies = _joined(table["ids"], "<i8"), _joined(table["copies"], "<i8")
            x = _joined(table["vecs"], kind).reshape(len(names), -1)
        else:
            names, copies, x = table["id"].to_numpy(), table["copies"].to_numpy(), _numbers(table["vec"], kind)
        order = np.argsort(names)
        names, copies, x = names[order], copies[order].astype(np.float64), _units(x[order])
        links, root = np.zeros(len(names)), np.arange(len(names))
        if forest:
            roots = forest.roots[table["space"][0].as_py()]
            rows, nodes = _reached(x, np.arange(len(x)), np.full(len(x), key[0].as_py()), forest)
            order = np.lexsort([rows, nodes])
            rows, nodes = rows[order], nodes[order]
            starts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
            leaves = [(int(nodes[a]), own) for a, own in zip(starts, np.split(rows, starts[1:]), strict=True)]
        else:
            leaves = [(0, np.arange(len(x)))]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def settle() -> None:
            nonlocal root, waiting
            if not held:
                return
            u, v, leaf = (np.concatenate(part) for part in zip(*held, strict=True))
            held.clear()
            waiting = 0
            root = _united(root, u, v)
            for t in range(tree + 1 if forest else 0):
                met = _met(x, u, v, roots[t], forest, leaf if t == tree else None) if len(u) else np.zeros(0, bool)
                u, v, leaf = u[~met], v[~met], leaf[~met]
            links[:] += np.bincount(u, copies[v], len(links)) + np.bincount(v, copies[u], len(links))

        for leaf, own in leaves:
            for u, v in _near_pairs(x, own, least):
                held.append((u, v, np.full(len(u), leaf)))
                waiting += len(u)
                if waiting >= PAIRS:
                    settle()
        settle()
        some = (links > 0) | (root != np.arange(len(root)))
        return pa.table({"id": names[some], "links": links[some].astype(np.int64), "head": names[root[some]]})

    return run


def _united(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least row of each group after the rows ``u`` are linked to ``v``."""
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return root
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]


def _compare_blocks(least: float, kind: str):
    """Links of a block of inner rows with a block of a place's rows.

    Inner rows count all their links; other rows those with inner rows. Of the links of a slab
    only those that unite groups are looked at one by one, so memory is bounded by the blocks.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        names, place = np.unique(table["id"].to_numpy(), return_inverse=True)
        x = _stacked(table["vec"], kind)
        copies = table["copies"].to_numpy().astype(np.float64)
        left = table["left"].to_numpy()
        inner, other = np.flatnonzero(left), np.flatnonzero(~left)
        outside = ~table["inner"].to_numpy()[other]
        links, root = np.zeros(len(names)), np.arange(len(names))
        at = place[other]
        for a in range(0, len(inner), 256):
            own = inner[a : a + 256]
            near = x[own] @ x[other].T >= least
            near &= place[own][:, None] != at
            links[place[own]] += near @ copies[other]
            links[at[outside]] += copies[own] @ near[:, outside]
            while len(at):
                apart = near & (root[place[own]][:, None] != root[at])
                rows, columns = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
                if not len(rows):
                    break
                u = np.concatenate([own[rows], own[apart[:, columns].argmax(0)]])
                v = np.concatenate([other[apart[rows].argmax(1)], other[columns]])
                root = _united(root, place[u], place[v])
        some = (links > 0) | (root != np.arange(len(root)))
        return pa.table({"id": names[some], "links": links[some].astype(np.int64), "head": names[root[some]]})

    return run


def _linked(rows: DataFrame, least: float, block: int, kind: str, most: int) -> list[DataFrame]:
    """Exact links ``id, links, head`` of the inner rows of places: ``place, id, vec, copies, inner, here``.

    All rows of a place are compared with those that are inner ``here``, in pairs of blocks that are dealt over tasks.
    ``inner`` tells whether a row is an inner one of any place, which then counts its links. Each row goes to
    many pairs of blocks, so these are taken in turns of about ``most`` rows, and the rows of a turn are
    gone before the next. There are no more places than centres, so their sizes are few.
    """
    sizes = rows.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.count_if("here").alias("m")).filter("m > 0").collect()
    blocks, turns, moved = [], set(), 0
    for place, n, m in sizes:
        across, own = -(-n // block), -(-m // block)
        cost = -(-m // own) * across + n
        blocks.append((place, across, own, moved, cost))
        turns |= {(moved + i * cost) // most for i in range(own)}
        moved += own * cost
    shape = f"place {rows.schema['place'].dataType.simpleString()}, _all long, _own long, _start long, _cost long"
    dealt = rows.join(F.broadcast(rows.sparkSession.createDataFrame(blocks, shape)), "place")
    number = F.xxhash64("id")
    plain = [F.col(c) for c in ("place", "id", "vec", "copies", "inner")]

    def side(left: bool, turn: int) -> DataFrame:
        def now(own: Column) -> Column:
            return F.floor((F.col("_start") + own * F.col("_cost")) / most) == turn

        def upto(blocks: str) -> Column:
            return F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)

        if left:
            mine = F.pmod(number, F.col("_own"))
            given = dealt.filter("here").filter(now(mine)).select("*", mine.alias("i"), F.explode(upto("_all")).alias("j"))
        else:
            given = dealt.select("*", F.explode(F.filter(upto("_own"), now)).alias("i"), F.pmod(number, F.col("_all")).alias("j"))
        return given.select(*plain, F.lit(left).alias("left"), "i", "j")

    found = []
    for turn in sorted(turns):
        both = side(True, turn).unionByName(side(False, turn))
        found.append(stored(both.groupBy("place", "i", "j").applyInArrow(_compare_blocks(least, kind), _LINKS)))
    return found


def _centres(least: float, kind: str):
    """Rows of one label such that each row is linked to one of them, those of most links first."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("links", "descending"), ("id", "ascending")])
        x = _stacked(table["vec"], kind)
        met, picked = np.zeros(len(x), bool), []
        for i in range(len(x)):
            if not met[i]:
                picked.append(i)
                met |= x @ x[i] >= least
        return table.select(["space", "id", "vec"]).take(pa.array(picked, pa.int64()))

    return run


def _around(centres: dict[str, tuple[np.ndarray, np.ndarray]], least: float, kind: str):
    """The centre a row is linked to, the nearest, and all centres whose links it may share."""
    # Rows linked to a row that is linked to the centre are within twice the angle.
    reach = 2 * least * least - 1 - 1e-9 if least > 0 else -2.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core: list[int | None] = [None] * len(batch)
            near: list[list[int]] = [[] for _ in core]
            for space, rows, vectors in _by_space(batch, kind, centres):
                names, x = centres[space]
                for a in range(0, len(rows), 512):
                    cosine = vectors[a : a + 512] @ x.T
                    best = cosine.argmax(1)
                    for k, i in enumerate(rows[a : a + 512].tolist()):
                        if cosine[k, best[k]] >= least:
                            core[i] = int(names[best[k]])
                        near[i] = names[cosine[k] >= reach].tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(core, pa.int64()), pa.array(near, pa.list_(pa.int64()))],
                names=[*batch.schema.names, "core", "near"],
            )

    return run


def _without_dense(rows: DataFrame, least: float, leaf: int, kind: str) -> tuple[DataFrame, list[DataFrame]]:
    """Rows that are left for the trees, and all links of the rows that are not: ``id, links, head``.

    Trees part groups of more than a leaf of near vectors at every level. So rows with about half a leaf of links or more,
    as told by a sample of their label, are centres; all rows linked to a centre are compared exactly
    with all rows that can be linked to them (those within twice the angle). Rounds go on until no sample of
    what is left holds such a row. ``rows`` is a stored table, ``id, space, vec, copies``, which is dropped
    when other rows are returned.
    """
    rate, found, turn = min(1.0, DENSE_SAMPLE / leaf), [], 0
    while True:
        large = stored(rows.groupBy("space").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > leaf).select("space"))
        if large.isEmpty():
            return rows, found
        most = rows.count()
        drawn = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1_000_000)) < round(rate * 1_000_000)
        sample = stored(rows.filter(drawn).join(F.broadcast(large), "space", "left_semi").select("space", "id", "vec"))
        yes = F.lit(True)
        asked = sample.select(F.col("space").alias("place"), "id", "vec", F.lit(1).cast("long").alias("copies"), yes.alias("inner"), yes.alias("here"))
        sampled = _linked(asked, least, BLOCK_LEAVES * leaf, kind, most)
        if not sampled:
            return rows, found
        degrees = _united_rows(sampled).groupBy("id").agg(F.sum("links").alias("links"))
        dense = sample.join(degrees.filter(F.col("links") >= max(1, rate * leaf / 2)), "id")
        picked = dense.groupBy("space").applyInArrow(_centres(least, kind), "space string, id long, vec binary").collect()
        dropped(sample, *sampled)
        if not picked:
            return rows, found
        centres: dict[str, tuple[list[int], list[bytes]]] = {}
        for r in picked:
            names, given = centres.setdefault(r["space"], ([], []))
            names.append(r["id"])
            given.append(bytes(r["vec"]))
        known = {
            space: (np.array(names, np.int64), _stacked(pa.array(given, pa.binary()), kind))
            for space, (names, given) in centres.items()
        }
        placed = stored(
            rows.mapInArrow(_around(known, least, kind), "id long, space string, vec binary, copies long, core long, near array<long>")
        )
        dropped(rows)
        around = placed.select(F.explode("near").alias("place"), "id", "vec", "copies", "core").select(
            "place", "id", "vec", "copies",
            F.col("core").isNotNull().alias("inner"),
            F.col("core").eqNullSafe(F.col("place")).alias("here"),
        )
        found += _linked(around, least, BLOCK_LEAVES * leaf, kind, most)
        rows, turn = stored(placed.filter("core IS NULL").drop("core", "near")), turn + 1
        dropped(placed)


def _united_rows(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _forest_links(rows: DataFrame, least: float, trees: int, leaf: int, spill: float, kind: str, branch_bytes: int) -> list[DataFrame]:
    """Links ``id, links, head`` inside the leaves of all trees.

    The upper levels of the trees are split by sketches over all rows. Below them, a branch is a node that one task
    can hold: its rows go there, a tree after another, first to split it down to the leaves, then to be
    compared inside them. Only the rows of one tree (at most ``AT_ONCE`` times all rows) are on their way at a time.
    What goes to every task is 20 bytes a node, some nodes for each ``leaf`` rows of a tree.
    """
    sizes = stored(rows.groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("vec")).alias("bytes")).filter(F.col("n") > leaf))
    item = np.dtype(kind).itemsize
    held = {r["space"]: (r["n"], max(leaf, branch_bytes * item // (8 * r["bytes"]))) for r in sizes.collect()}
    one = rows.join(F.broadcast(sizes.select("space")), "space", "left_anti")
    found = [stored(one.groupBy("space").applyInArrow(_compare(least, kind), _LINKS))]
    dropped(sizes)
    if not held:
        return found
    forest = _Forest(*[np.zeros(0, t) for t in (np.uint64, np.float32, np.float32, np.int32)], roots={})
    for space in sorted(held):
        first = forest.add([_root_key(f"{tree}/{space}") for tree in range(trees)])
        forest.roots[space] = list(range(first, first + trees))
    levels = _tops(rows, forest, held, spill, kind)
    tops = replace(forest, **{name: getattr(forest, name).copy() for name in ("key", "low", "high", "child")})
    parts = max(1, math.ceil((1 + spill) ** levels / AT_ONCE))
    turns = [(tree, part) for tree in range(trees) for part in range(parts)]

    def branches(tree: int, part: int, columns: list[str]):
        schema = ", ".join(f"{c} {_PACKED[c][0]}" for c in columns)
        return rows.mapInArrow(_to_branches(tops, kind, tree, part, parts, columns), schema).groupBy("branch")

    grown = []
    for turn in turns:
        split = branches(*turn, ["branch", "size", "vecs"]).applyInArrow(_grow_branches(tops, kind, leaf, spill), "branch long, nodes binary")
        grown += [(r["branch"], bytes(r["nodes"])) for r in split.collect()]
    forest.graft(grown)
    for turn in turns:
        found.append(stored(branches(*turn, list(_PACKED)).applyInArrow(_compare(least, kind, forest, turn[0]), _LINKS)))
    return found


def near_vectors(
    vectors: DataFrame,
    least: float = LEAST_COSINE,
    trees: int = TREES,
    leaf: int = LEAF,
    spill: float = SPILL,
    branch_bytes: int = BRANCH_BYTES,
) -> DataFrame:
    """Near-duplicate vectors of one label: ``vec_id, n_links, component_id, kept``.

    Equal directions of a label are one class with a number of copies. Classes in dense places, with
    half a leaf of links or more, are compared exactly (``_without_dense``). Each tree splits the other
    classes of a label until leaves are small (a label within a leaf is one leaf); within leaves all cosines
    are computed in double precision by matrix products. A link found in several trees counts in the
    first leaf that holds both, so counts need no table of pairs: a branch of a tree gives a row per
    vector, its number of links and the head of its group.

    Vectors are written once, as they are given. Rows on their way to blocks or leaves are a bounded multiple of
    all rows at a time, and are gone before the next are sent, as are tables that are no longer read.

    Labels or vectors that are NULL, and vectors that are zero, empty or hold NULL or values that are not
    finite link with nothing. Vectors of different lengths never link. Rows that repeat an id with one
    vector count as copies of each other. NULL ids are greater than all others. Rows without a group have
    themselves as component. Other columns are left out.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, array = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    with short_lived_shuffles(vectors.sparkSession):
        given = vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(array).alias("embedding")
        )
        rows = stored(given.mapInArrow(_normal(kind, ["vec_id", "class"]), "vec_id long, class binary"))
        keyed = given.mapInArrow(_normal(kind, ["vec_id", "label", "class", "vec"]), "vec_id long, label string, class binary, vec binary")
        classes = stored(
            keyed.filter("class IS NOT NULL")
            .select("vec_id", "class", "vec", F.concat_ws("/", "label", F.length("vec")).alias("space"))
            .groupBy("class")
            .agg(
                F.any_value("space").alias("space"),
                F.any_value("vec").alias("vec"),
                F.count(F.lit(1)).alias("copies"),
                F.min("vec_id").alias("least_id"),
            )
            .withColumn("id", F.monotonically_increasing_id())
        )
        names = stored(classes.select("id", "class", "copies", "least_id"))
        left, found = _without_dense(classes.select("id", "space", "vec", "copies"), least, leaf, kind)
        found += _forest_links(left, least, trees, leaf, spill, kind, branch_bytes)
        dropped(left)
        links = _united_rows(found)
        totals = stored(links.groupBy("id").agg(F.sum("links").alias("links")))
        group = components(links.select(F.col("head").alias("u"), F.col("id").alias("v")))
        joined = stored(
            names.join(totals, "id", "left")
            .join(group, F.col("id") == F.col("node"), "left")
            .select(
                "class",
                "least_id",
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("root", "id").alias("root"),
            )
        )
        dropped(names, totals, *found)
    least_ids = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = joined.join(least_ids, "root").select(
        F.col("class").alias("_class"), "n_links", "component_id"
    )
    alone = F.col("_class").isNull()
    return (
        rows.join(found, F.col("class") == F.col("_class"), "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def op6_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
