"""Multiprobe p-stable hashing: the candidate search for problems 5, 6 and 7.

Each of ``tables`` hash tables has ``coarse`` functions floor((a.x + b) / width) that route a vector to a group of rows.
A vector is stored in its own group and asks in ``groups`` of them: its own and perturbed ones in the order of their
estimated success (the squared distances to the crossed boundaries). Within a group further functions part the stored
vectors into buckets, as many as its size asks for, and an asking vector visits ``buckets`` of them in the same order.

Vectors travel as 16-bit codes of their directions, with the length of what the code leaves out. So every cosine comes
with a bound of its error (about 5e-5), and callers fetch exact vectors only for the pairs that the bound leaves open.

A group grows with the square root of the collection, and the number of tables and visited groups follows from the
success estimated for pairs of a given cosine (``Hashing.planned``), so recall stays as the collection grows. A group of
too many rows, for instance a hot cluster, becomes a grid of blocks. Tasks hold the stored vectors of one block; asking
vectors stream past them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.session import spread

DIM = 64
#: Probability that one function of width 2.5 maps two unrelated unit vectors to one cell.
P_FAR = 0.57
#: Most functions that part a group into buckets.
MOST_FINE = 24


def valid(vec: Column, dim: int = DIM) -> Column:
    """A vector of ``dim`` finite values that are not all zero."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & (F.size(vec) == dim) & ok & F.exists(vec, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class Hashing:
    """``groups`` and ``buckets``: how many a vector visits, its own included. A visited group costs a copy of the
    vector, a visited bucket only time. ``stored`` and ``asked`` bound the rows of one block."""

    coarse: int
    tables: int = 2
    groups: int = 2
    buckets: int = 8
    bucket: int = 600
    width: float = 2.5
    stored: int = 400_000
    asked: int = 2_000_000
    dim: int = DIM
    seed: int = 20

    @staticmethod
    def planned(n: int, cos: float = 0.95, success: float = 0.93, per_root: float = 42.0, most_group: int = 300_000, **more) -> Hashing:
        """For ``n`` stored vectors: the fewest copies of a vector with which two of cosine ``cos`` meet in at least the
        share ``success`` of all cases, at least two tables and two groups."""
        group = min(per_root * math.sqrt(max(n, 1)), most_group)
        base = Hashing(coarse=max(0, round(math.log(max(n, 1) / group) / -math.log(P_FAR))), **more)
        for copies in range(4, 65):
            for tables in range(2, copies // 2 + 1):
                if copies % tables == 0:
                    h = replace(base, tables=tables, groups=copies // tables)
                    if h.success(cos, int(group)) >= success:
                        return h
        return replace(base, tables=8, groups=8)

    def fine(self, stored: int) -> int:
        """Functions that part so many stored vectors into buckets."""
        return min(MOST_FINE, max(1, round(math.log(max(stored, 1) / self.bucket) / -math.log(P_FAR)) + 1))

    def functions(self, table: int) -> tuple[np.ndarray, np.ndarray]:
        return _functions(self.seed, table, self.dim, self.coarse, self.width)

    def cells(self, x: np.ndarray, table: int, fine: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers, and the distance to the lower boundary of each cell, of the coarse or the first ``fine`` functions."""
        a, b = self.functions(table)
        part = slice(0, self.coarse) if fine is None else slice(self.coarse, self.coarse + fine)
        f = (x @ a[:, part] + b[part]) / np.float32(self.width)
        h = np.floor(f)
        return h.astype(np.int64), (f - h) * np.float32(self.width)

    @lru_cache(500)  # noqa: B019
    def success(self, cos: float, group: int, n: int = 2000, mutual: bool = False) -> float:
        """Estimated share of pairs of this cosine that meet: simulated on ``n`` random pairs. ``mutual``: either may ask."""
        rng = np.random.default_rng(5)
        a, b = rng.standard_normal((2, n, self.dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(1, keepdims=True) * a
        b *= math.sqrt(1 - cos * cos) / np.linalg.norm(b, axis=1, keepdims=True)
        return float(self.meets(a.astype(np.float32), (cos * a + b).astype(np.float32), group, mutual).mean())

    def meets(self, a: np.ndarray, b: np.ndarray, group: int, mutual: bool = False) -> np.ndarray:
        """Whether a visits the bucket of b in any table (``mutual``: or b that of a), for a group of this size."""
        met = np.zeros(len(a), bool)
        for t in range(self.tables):
            cells = [[self.cells(x, t, fine) for fine in (None, self.fine(group))] for x in (a, b)]
            for x, y in ((0, 1), (1, 0)) if mutual else ((0, 1),):
                both = [
                    (probes(*cells[x][level], self.width, count) == _code(cells[y][level][0])[:, None]).any(1)
                    for level, count in ((0, self.groups), (1, self.buckets))
                ]
                met |= both[0] & both[1]
        return met


@lru_cache(64)
def _functions(seed: int, table: int, dim: int, coarse: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, table])
    m = coarse + MOST_FINE
    return rng.standard_normal((dim, m)).astype(np.float32), rng.uniform(0, width, m).astype(np.float32)


def _code(h: np.ndarray) -> np.ndarray:
    """One number for the cells of several functions; never the one of no cell."""
    out = np.full(h.shape[:-1], 17, np.int64)
    with np.errstate(over="ignore"):
        for j in range(h.shape[-1]):
            out = (out * np.int64(1_000_003)) ^ (h[..., j] + 4096)
    return np.where(out == NOWHERE, 1, out)


NOWHERE = np.int64(-(2**63))


@lru_cache(16)
def _sets(nearest: int, depth: int) -> tuple[tuple[int, ...], ...]:
    return tuple(s for d in range(1, depth + 1) for s in combinations(range(nearest), d))


def probes(h: np.ndarray, low: np.ndarray, width: float, count: int) -> np.ndarray:
    """Codes of ``count`` cells for each row, its own first, then perturbed ones in the order of the summed squared
    distances to the crossed boundaries; sets of up to three of the six nearest boundaries. ``NOWHERE`` if there are fewer."""
    n, m = h.shape
    out = np.full((n, count), NOWHERE, np.int64)
    if not n:
        return out
    out[:, 0] = _code(h)
    if not m or count < 2:
        return out
    d = np.concatenate([low, np.float32(width) - low], 1) ** 2
    near = min(6, 2 * m)
    order = np.argsort(d, axis=1, kind="stable")[:, :near]
    score, function = np.take_along_axis(d, order, 1), order % m
    sets = [s for s in _sets(near, 3) if len(s) <= m]
    cost = np.empty((n, len(sets)), np.float32)
    for i, s in enumerate(sets):
        cost[:, i] = score[:, s].sum(1)
        for a, b in combinations(s, 2):  # both boundaries of one cell can't be crossed
            cost[function[:, a] == function[:, b], i] = np.inf
    take = min(count - 1, len(sets))
    best = np.argpartition(cost, take - 1, axis=1)[:, :take] if take < len(sets) else np.broadcast_to(np.arange(take), (n, take))
    best = np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, 1), axis=1, kind="stable"), 1)
    step = np.where(order < m, -1, 1)
    member = np.zeros((len(sets), near), bool)
    for i, s in enumerate(sets):
        member[i, list(s)] = True
    rows = np.arange(n)
    for j in range(take):
        moved, on = h.copy(), member[best[:, j]]
        for c in range(near):
            moved[rows, function[:, c]] += np.where(on[:, c], step[:, c], 0)
        out[:, j + 1] = np.where(np.isfinite(cost[rows, best[:, j]]), _code(moved), NOWHERE)
    return out


def matrix(column: pa.Array, dim: int = DIM) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def _layout(dim: int) -> np.dtype:
    return np.dtype([("scale", "<f4"), ("rest", "<f4"), ("mark", "<u4"), ("q", "<i2", (dim,))])


def encode(x: np.ndarray) -> np.ndarray:
    """Directions as 16-bit codes: scale, length of what the code leaves out, and a mark of the exact vector, by which
    equal codes of different vectors stay apart."""
    u = unit(x)
    out = np.zeros(len(x), _layout(x.shape[1]))
    out["scale"] = np.nextafter(np.abs(u).max(1, initial=0).astype(np.float32), np.float32(2))
    step = out["scale"].astype(np.float64)[:, None] / 32767
    out["q"] = np.rint(u / step).astype(np.int16)
    out["rest"] = np.nextafter(np.linalg.norm(u - out["q"] * step, axis=1).astype(np.float32), np.float32(1))
    raw = np.ascontiguousarray(x.astype(np.float32)).view(np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        odd = np.arange(1, 2 * x.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out["mark"] = ((raw * odd).sum(1) >> np.uint64(32)).astype(np.uint32)
    return out


def packed(codes: np.ndarray) -> pa.Array:
    size = codes.dtype.itemsize
    offsets = np.arange(len(codes) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(codes).tobytes())])


def unpacked(column: pa.Array, dim: int = DIM) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros(0, _layout(dim))
    at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32, 1, column.offset * (8 if pa.types.is_large_binary(column.type) else 4))[0]
    return np.frombuffer(column.buffers()[2], _layout(dim), len(column), int(at))


def decoded(codes: np.ndarray) -> np.ndarray:
    """The coded directions in single precision."""
    return codes["q"].astype(np.float32) * (codes["scale"] / np.float32(32767))[:, None]


def coded_vectors(vectors: DataFrame, *keys: str) -> DataFrame:
    """``keys, code`` of ``keys, vec``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), packed(encode(matrix(b.column("vec"))))], names=[*keys, "code"])

    schema = T.StructType([*(vectors.schema[k] for k in keys), T.StructField("code", T.BinaryType())])
    return vectors.select(*keys, "vec").mapInArrow(run, schema)


#: Roles of a routed row: stored only, stored and asking, asking only.
STORED, BOTH, ASKING = 0, 1, 2
ROUTED = T.StructType([
    T.StructField("tab", T.IntegerType()), T.StructField("grp", T.LongType()), T.StructField("kind", T.IntegerType()),
    T.StructField("role", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("code", T.BinaryType()),
])
COUNTED = T.StructType([*ROUTED.fields[:3], T.StructField("n_stored", T.LongType()), T.StructField("n_asks", T.LongType())])
HITS = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("nn", T.LongType()),
    T.StructField("cos", T.FloatType()), T.StructField("err", T.FloatType()),
])


def _routes(b: pa.RecordBatch, hashing: Hashing, centres: dict[int, np.ndarray]):
    """(table, rows, group codes, roles) of a batch."""
    x, kind = matrix(b.column("vec"), hashing.dim), np.asarray(b.column("kind"))
    u = hash_input(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-30)), kind, centres)
    stored, asks = (np.asarray(b.column(c).cast(pa.int8())).astype(bool) for c in ("stored", "asks"))
    own = np.where(stored, np.where(asks, BOTH, STORED), ASKING)
    for t in range(hashing.tables):
        h, low = hashing.cells(u, t)
        code = probes(h, low, hashing.width, hashing.groups)
        for j in range(hashing.groups):
            rows = np.flatnonzero((stored | asks if j == 0 else asks) & (code[:, j] != NOWHERE))
            if len(rows):
                yield t, rows, code[rows, j], own[rows] if j == 0 else np.full(len(rows), ASKING)


def route(vectors: DataFrame, hashing: Hashing, centres: dict[int, list[float]] | None = None) -> DataFrame:
    """Rows ``kind, id, stored, asks, vec`` -> one row for each group that the vector is stored in or asks.

    ``centres`` holds, for a kind, a vector to subtract before hashing (the offset of one modality from another).
    """
    centres = {k: np.asarray(v, np.float64) for k, v in (centres or {}).items()}

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            codes, kind, ids = encode(matrix(b.column("vec"), hashing.dim)), np.asarray(b.column("kind")), np.asarray(b.column("id"))
            for t, rows, grp, role in _routes(b, hashing, centres):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), t, np.int32)), pa.array(grp), pa.array(kind[rows].astype(np.int32)), pa.array(role.astype(np.int32)), pa.array(ids[rows]), packed(codes[rows])],
                    names=ROUTED.names,
                )

    return vectors.select("kind", "id", "stored", "asks", "vec").mapInArrow(run, ROUTED)


def group_sizes(vectors: DataFrame, hashing: Hashing, centres: dict[int, list[float]] | None = None) -> DataFrame:
    """``tab, grp, kind, n_stored, n_asks`` of the rows that ``route`` makes, counted before the shuffle."""
    centres = {k: np.asarray(v, np.float64) for k, v in (centres or {}).items()}

    def run(batches):
        counts: dict[tuple[int, int, int], list[int]] = {}

        def flush():
            keys = list(counts)
            columns = [*zip(*keys, strict=True)] or [()] * 3
            columns += [*zip(*counts.values(), strict=True)] or [()] * 2
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=COUNTED.names)

        for b in batches:
            if not b.num_rows:
                continue
            kind = np.asarray(b.column("kind"))
            for t, rows, grp, role in _routes(b, hashing, centres):
                for v in np.unique(kind):
                    on = kind[rows] == v
                    for asking, part in ((False, role != ASKING), (True, role != STORED)):
                        for g, n in zip(*np.unique(grp[on & part], return_counts=True), strict=True):
                            counts.setdefault((t, int(g), int(v)), [0, 0])[asking] += int(n)
            if len(counts) > 200_000:
                yield flush()
        yield flush()

    found = vectors.select("kind", "id", "stored", "asks", "vec").mapInArrow(run, COUNTED)
    return found.groupBy("tab", "grp", "kind").agg(F.sum("n_stored").alias("n_stored"), F.sum("n_asks").alias("n_asks"))


def hash_input(u: np.ndarray, kind: np.ndarray, centres: dict[int, np.ndarray]) -> np.ndarray:
    u = u.astype(np.float32)
    for k, centre in centres.items():
        at = kind == k
        r = u[at] - centre.astype(np.float32)
        u[at] = r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), np.float32(1e-12))
    return u


def _ranks(q: np.ndarray, cos: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by q and falling cosine, the rank of each place in it, and the first place of its q."""
    order = np.lexsort((tie, -cos, q))
    qs = q[order]
    first = np.maximum.accumulate(np.where(np.r_[True, qs[1:] != qs[:-1]], np.arange(len(qs)), 0))
    return order, np.arange(len(qs)) - first, first


def _best(q: np.ndarray, cos: np.ndarray, tie: np.ndarray, k: int, near: float = 2.5e-4, spare: int = 8) -> np.ndarray:
    """Positions of the k best of each q, and of up to ``spare`` more that are as good within ``near``."""
    if not len(q):
        return np.zeros(0, int)
    order, rank, first = _ranks(q, cos, tie)
    c = cos[order]
    kth = c[np.minimum(first + k - 1, len(c) - 1)]
    return order[(rank < k) | ((rank < k + spare) & (c >= kth - near))]


def _bucket_hits(s: np.ndarray, least: np.ndarray, k: int):
    """Row and column of entries of at least the row's threshold, the k best of a row if it has more than 4 k."""
    over = s >= least[:, None]
    many = over.sum(1) > 4 * k
    r, c = np.nonzero(over & ~many[:, None]) if many.any() else np.nonzero(over)
    if many.any():
        at = np.flatnonzero(many)
        top = np.argpartition(-s[at], k, axis=1)[:, :k]
        r, c = np.r_[r, np.repeat(at, k)], np.r_[c, top.ravel()]
    return r, c


class Forest:
    """Links kept of all that are met: vectors joined by any chain of links are joined by kept ones, at most one a vector."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def grow(self, n: int) -> None:
        self.parent = np.r_[self.parent, np.arange(len(self.parent), n)] if n > len(self.parent) else self.parent

    def shrink(self, n: int) -> None:
        """Forget the last nodes; roots are never among them, because a tree hangs below its first node."""
        self.parent = self.parent[:n]

    def root(self, at: np.ndarray) -> np.ndarray:
        out = self.parent[at]
        while (up := self.parent[out]).size and (up != out).any():
            out = up
        self.parent[at] = out
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root(a), self.root(b)
            on = ra != rb
            a, b, low, high = a[on], b[on], np.minimum(ra, rb)[on], np.maximum(ra, rb)[on]
            # Each tree hangs itself below the lowest one that it meets, so no circle arises.
            order = np.lexsort((low, high))
            pick = order[np.r_[True, high[order][1:] != high[order][:-1]]] if len(order) else order
            self.parent[high[pick]] = low[pick]
            self.kept.append((a[pick], b[pick]))


@dataclass(frozen=True)
class Search:
    """What a block's search keeps. ``mutual``: a stored vector that asks also takes visitors of its kind as neighbours.
    ``joined``: where links of at least this cosine join what the ``k`` best leave apart, they come too, with a negative ``err``.
    ``spare``: most hits beyond the ``k`` best of a block that come because they may be as good; none are needed where the codes' cosines decide."""

    hashing: Hashing
    least: dict[int, float]
    k: int
    centres: dict[int, np.ndarray]
    selfless: bool = False
    mutual: bool = False
    joined: float | None = None
    spare: int = 8


class Block:
    """The stored vectors of one block, and the asking ones that stream past them."""

    def __init__(self, search: Search, table: int, chunk: int = 50_000):
        self.s, self.table, self.chunk = search, table, chunk
        self.parts: list[pa.RecordBatch] = []
        self.visitors: list[pa.RecordBatch] = []
        self.waiting = 0
        self.built = False

    def add(self, b: pa.RecordBatch):
        """Rows in the order of their roles."""
        n_stored = int((np.asarray(b.column("role")) != ASKING).sum())
        if n_stored:
            self.parts.append(b.slice(0, n_stored))
        if n_stored < b.num_rows:
            self.visitors.append(b.slice(n_stored))
            self.waiting += b.num_rows - n_stored
            if self.waiting >= self.chunk:
                yield from self.visit()

    def visit(self):
        if not self.built:
            yield from self.build()
        if self.visitors:
            t = pa.Table.from_batches(self.visitors)
            self.visitors, self.waiting = [], 0
            if len(self.ids):
                yield from self.ask(unpacked(t.column("code"), self.s.hashing.dim), np.asarray(t.column("id")), np.asarray(t.column("kind")), None)

    def build(self):
        """Order the stored vectors by bucket; then those that ask visit."""
        self.built, h = True, self.s.hashing
        if self.parts:
            t = pa.Table.from_batches(self.parts)
            codes, ids, kind, role = unpacked(t.column("code"), h.dim), *(np.asarray(t.column(c)) for c in ("id", "kind", "role"))
        else:
            codes, ids, kind, role = np.zeros(0, _layout(h.dim)), *(np.zeros(0, np.int64) for _ in range(3))
        self.parts = []
        rows = _distinct(codes, ids)
        codes, ids, kind, role = codes[rows], ids[rows], kind[rows], role[rows]
        self.fine = h.fine(len(ids))
        x = decoded(codes)
        code = _code(h.cells(hash_input(x, kind, self.s.centres), self.table, self.fine)[0])
        order = np.argsort(code, kind="stable")
        code, self.x, self.ids, self.kind, self.asks = code[order], x[order], ids[order], kind[order], role[order] == BOTH
        self.rest = codes["rest"][order]
        self.starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
        self.ends, self.keys = np.r_[self.starts[1:], len(code)].astype(int), code[self.starts]
        self.forest = Forest(len(ids)) if self.s.joined is not None else None
        self.taken: list[tuple[np.ndarray, ...]] = []
        self.links: list[tuple[np.ndarray, ...]] = []
        self.trees: list[tuple[np.ndarray, ...]] = []
        own = np.flatnonzero(self.asks)
        own = own[np.isin(self.kind[own], list(self.s.least))]
        codes = codes[order]
        for at in range(0, len(own), self.chunk):
            rows = own[at : at + self.chunk]
            yield from self.ask(codes[rows], self.ids[rows], self.kind[rows], rows)

    def ask(self, codes: np.ndarray, ids: np.ndarray, kind: np.ndarray, places: np.ndarray | None):
        """``places``: where the asking vectors stand among the stored ones; None for visitors."""
        h, s = self.s.hashing, self.s
        if places is None:
            rows = np.concatenate([at[_distinct(codes[at], ids[at])] for v in s.least if len(at := np.flatnonzero(kind == v))] or [np.zeros(0, int)])
            codes, ids, kind = codes[rows], ids[rows], kind[rows]
        x, rest = decoded(codes), codes["rest"]
        cells, low = h.cells(hash_input(x, kind, s.centres), self.table, self.fine)
        code = probes(cells, low, h.width, h.buckets)
        pos = np.minimum(np.searchsorted(self.keys, code), max(0, len(self.keys) - 1))
        q, j = np.nonzero(self.keys[pos] == code) if len(self.keys) else (np.zeros(0, int),) * 2
        bucket = pos[q, j]
        order = np.argsort(bucket, kind="stable")
        q, bucket = q[order], bucket[order]
        # Where no bucket is met, there are no edges at all.
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
        ends = np.r_[edges[1:], len(bucket)].astype(int) if len(bucket) else edges
        least = np.array([s.least[int(v)] for v in kind], np.float32)
        n = len(self.ids)
        if self.forest is not None and places is None:
            self.forest.grow(n + len(ids))
        node = places if places is not None else n + np.arange(len(ids))
        found: list[tuple[np.ndarray, ...]] = []
        for lo, hi in zip(edges, ends, strict=True):
            begin, end = self.starts[bucket[lo]], self.ends[bucket[lo]]
            bank, bank_rest = self.x[begin:end], self.rest[begin:end]
            step = max(1, 4_000_000 // (end - begin))
            for at in range(lo, hi, step):
                part = q[at : min(hi, at + step)]
                cos = x[part] @ bank.T
                if self.forest is not None:
                    sure = cos >= np.float32(s.joined) + rest[part][:, None] + bank_rest[None, :] + np.float32(4e-6)
                    sure &= self.forest.root(node[part])[:, None] != self.forest.root(np.arange(begin, end))[None, :]
                    r, c = np.nonzero(sure)
                    self.forest.add(node[part[r]], begin + c)
                r, c = _bucket_hits(cos, least[part] - rest[part] - bank_rest.max() - np.float32(4e-6), s.k + 8)
                found.append((part[r], begin + c, cos[r, c]))
        q, b, cos = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32))
        if s.selfless and len(q):
            other = ids[q] != self.ids[b]
            q, b, cos = q[other], b[other], cos[other]
        err = rest[q] + self.rest[b] + np.float32(4e-6)
        on = cos + err >= least[q]
        q, b, cos, err = q[on], b[on], cos[on], err[on]
        top = _best(q, cos, self.ids[b], s.k, spare=s.spare)
        yield _hits(kind[q[top]], ids[q[top]], self.ids[b[top]], cos[top], err[top])
        if self.forest is not None:
            self.links.append((ids[q[top]], self.ids[b[top]], cos[top] - err[top] >= s.joined))
        if s.mutual and places is None:
            on = np.flatnonzero(self.asks[b] & (self.kind[b] == kind[q]))
            on = on[_best(b[on], cos[on], ids[q[on]], s.k, spare=s.spare)]
            self.taken.append((b[on], ids[q[on]], cos[on], err[on]))
            if sum(len(t[0]) for t in self.taken) > 4 * self.s.k * max(n, 50_000):
                self.take()
        if self.forest is not None:
            self._joined(ids, x, rest, kind)
            self.forest.shrink(n)

    def take(self):
        b, nn, cos, err = (np.concatenate(c) for c in zip(*self.taken, strict=True))
        top = _best(b, cos, nn, self.s.k, spare=self.s.spare)
        self.taken = [(b[top], nn[top], cos[top], err[top])]

    def _joined(self, ids, x, rest, kind) -> None:
        """New links of the forest; the block's own nodes come before those of visitors."""
        n = len(self.ids)
        kept, self.forest.kept = self.forest.kept, []
        if not kept:
            return
        a, b = (np.concatenate(c) for c in zip(*kept, strict=True))

        def side(at, mine, other):
            inside = at < n
            out = np.empty((len(at), *mine.shape[1:]), mine.dtype)
            out[inside] = mine[at[inside]]
            out[~inside] = other[at[~inside] - n]
            return out

        cos = np.einsum("ij,ij->i", side(a, self.x, x), side(b, self.x, x))
        err = side(a, self.rest, rest) + side(b, self.rest, rest) + np.float32(4e-6)
        self.trees.append((side(a, self.kind, kind), side(a, self.ids, ids), side(b, self.ids, ids), cos, err))

    def _bridges(self) -> pa.RecordBatch:
        """Links of the forest that join what the best links leave apart, from both ends."""
        kind, ia, ib, cos, err = (np.concatenate(c) for c in zip(*self.trees, strict=True))
        la, lb, sure = (np.concatenate(c) for c in zip(*self.links, strict=True))
        names, at = np.unique(np.concatenate([ia, ib, la[sure], lb[sure]]), return_inverse=True)
        a, b, la, lb = np.split(at, np.cumsum([len(ia), len(ib), int(sure.sum())]))
        forest = Forest(len(names))
        forest.add(la, lb)
        place = {(int(x), int(y)): i for i, (x, y) in reversed(list(enumerate(zip(a, b, strict=True))))}
        forest.kept = []
        forest.add(a, b)
        at = np.array([place[int(x), int(y)] for p, q in forest.kept for x, y in zip(p, q, strict=True)], int)
        return _hits(np.r_[kind[at], kind[at]], np.r_[ia[at], ib[at]], np.r_[ib[at], ia[at]], np.r_[cos[at], cos[at]], -np.r_[err[at], err[at]])

    def end(self):
        yield from self.visit()
        if self.taken:
            self.take()
            b, nn, cos, err = self.taken[0]
            yield _hits(self.kind[b], self.ids[b], nn, cos, err)
        if self.forest is not None and self.trees:
            yield self._bridges()


def _hits(kind, ids, nn, cos, err) -> pa.RecordBatch:
    columns = (kind.astype(np.int32), ids.astype(np.int64), nn.astype(np.int64), cos.astype(np.float32), err.astype(np.float32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=HITS.names)


def nearest(vectors: DataFrame, hashing: Hashing, least: dict[int, float], k: int, centres: dict[int, list[float]] | None = None, by_kind: bool = False, **kept) -> DataFrame:
    """``kind, id, nn, cos, err``: for each asking vector its up to ``k`` nearest stored vectors of at least
    ``least[kind]`` in any visited bucket, and those that may be as good within ``err``, the bound of the error of ``cos``.

    Identical vectors are one, named by their smallest id. A hit from several tables comes several times.
    ``kept``: options of ``Search``.
    """
    vectors = without_hot_copies(vectors)
    routed = route(vectors, hashing, centres)
    by = ["tab", "grp", *(["kind"] if by_kind else [])]  # with by_kind, a group of its own for each kind
    sizes = group_sizes(vectors, hashing, centres).groupBy(*by).agg(F.sum("n_stored").alias("n_stored"), F.sum("n_asks").alias("n_asks"))
    hot = sizes.filter((F.col("n_stored") > hashing.stored) | (F.col("n_asks") > hashing.asked))
    # A grid over the few groups that are too large; the list has at most (rows / stored) entries.
    grid = {tuple(r[c] for c in by): (max(1, -(-r.n_stored // hashing.stored)), max(1, -(-r.n_asks // hashing.asked))) for r in hot.collect()}
    if grid:
        cells = vectors.sparkSession.createDataFrame([(*g, *n) for g, n in grid.items()], "tab int, grp bigint, " + ("kind int, " if by_kind else "") + "nb int, nq int")
        routed = routed.join(F.broadcast(cells), by, "left").fillna(1, ["nb", "nq"])
        hb, hq = (F.pmod(F.xxhash64("code", F.lit(s)), F.col(n)).cast("int") for s, n in (("b", "nb"), ("q", "nq")))
        # Stored rows stand in one column of the grid and asking rows in one row of it.
        routed = routed.withColumn("cb", F.explode(F.when(F.col("role") != STORED, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array(hb)))).withColumn(
            "cq", F.explode(F.when(F.col("role") != ASKING, F.sequence(F.lit(0), F.col("nq") - 1)).otherwise(F.array(hq)))
        )
        stored, asks = (F.col("role") != ASKING) & (F.col("cb") == hb), (F.col("role") != STORED) & (F.col("cq") == hq)
        routed = routed.withColumn("role", F.when(stored & asks, BOTH).when(stored, STORED).when(asks, ASKING)).filter("role is not null").select(*ROUTED.names, "cb", "cq")
        by = [*by, "cb", "cq"]
    search = Search(hashing, least, k, {key: np.asarray(v, np.float64) for key, v in (centres or {}).items()}, **kept)

    def run(batches):
        key, block = None, None
        for b in batches:
            if not b.num_rows:
                continue
            columns = [np.asarray(b.column(c)) for c in by]
            new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                here = tuple(int(c[lo]) for c in columns)
                if here != key:
                    if block is not None:
                        yield from block.end()
                    key, block = here, Block(search, here[0])
                yield from block.add(b.slice(lo, hi - lo))
        if block is not None:
            yield from block.end()

    # Stored rows come first, so a task holds these alone.
    return spread(routed, *by).sortWithinPartitions(*by, "role", "id").mapInArrow(run, HITS)


def exact_cosines(pairs: DataFrame, a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """``pairs`` with ``cos`` of the vectors ``vec`` of ``id`` in a (by ``keys``, if others than the id) and ``nn`` in b, in
    double precision, rounded to 12 decimals. Only for the pairs that coded vectors leave open."""
    keys = keys or ("id",)
    both = pairs.join(a.select(*keys, F.col("vec").alias("_a")), list(keys)).join(b.select(F.col("id").alias("nn"), F.col("vec").alias("_b")), "nn")

    def run(batches):
        for t in batches:
            x, y = (unit(matrix(t.column(c))) for c in ("_a", "_b"))
            cos = np.round(np.einsum("ij,ij->i", x, y), 12) if t.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in names), pa.array(cos)], names=[*names, "cos"])

    names = [c for c in pairs.columns if c != "cos"]
    schema = T.StructType([*(pairs.schema[c] for c in names), T.StructField("cos", T.DoubleType())])
    return both.select(*names, "_a", "_b").mapInArrow(run, schema)


def hot_vectors(vectors: DataFrame, share: int = 1000) -> dict[int, int]:
    """Hash -> smallest id of vectors of which more than one row in ``share`` is a copy; at most ``share`` of them."""
    n = vectors.count()
    counts = vectors.groupBy(F.xxhash64("kind", "vec").alias("h")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return {r.h: r.id for r in counts.filter((F.col("n") > 1) & (F.col("n") * share > n)).collect()}


def without_hot_copies(vectors: DataFrame) -> DataFrame:
    """One row for each hot vector; rarer copies stay, and a block makes one of them where they meet."""
    hot = hot_vectors(vectors)
    if not hot:
        return vectors
    table = vectors.sparkSession.createDataFrame(list(hot.items()), "h bigint, first bigint")
    marked = vectors.withColumn("h", F.xxhash64("kind", "vec")).join(F.broadcast(table), "h", "left")
    return marked.filter("first is null or first = id").drop("h", "first")


def _distinct(codes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of rows with identical vectors the one of the smallest id."""
    rows = np.argsort(ids, kind="stable")
    whole = np.ascontiguousarray(codes[rows]).view(np.dtype((np.void, codes.dtype.itemsize))).ravel()
    _, first = np.unique(whole, return_index=True)
    return rows[np.sort(first)]


def mean_direction(vectors: DataFrame, dim: int = DIM) -> list[float]:
    """Mean of the unit vectors of a column ``vec``; ``dim`` rows leave the executors."""

    def run(batches):
        total, n = np.zeros(dim), 0
        for b in batches:
            if b.num_rows:
                total += unit(matrix(b.column("vec"), dim)).sum(0)
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(total), pa.array(np.full(dim, n))], names=["place", "total", "n"])

    sums = vectors.select("vec").mapInArrow(run, "place int, total double, n bigint").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = [0.0] * dim
    for r in sums.collect():
        mean[r.place] = r.total / r.n if r.n else 0.0
    return mean
