"""Neighbour graph index: built once by neighbour descent, stored as a table, and searched best-first.

The bank is cut into shards of at most ``most`` vectors; each has a graph of its own and is searched by all queries, and a
window merges the shards' answers. Build and search are array work on one shard, for all its vectors or queries at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.operators.knn import HITS, QUERY_BLOCK, _rows, top_k

INDEX = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("e", T.ArrayType(T.DoubleType())), T.StructField("out", T.ArrayType(T.LongType()))])
#: Shards up to this size get their exact neighbours: descent would compare as many.
EXACT = 4096


def partitions(bank: DataFrame, shards: int) -> DataFrame:
    return bank.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))


def _best(s: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row by score, then by number; a number counts once."""
    order = np.lexsort((-s, at), axis=1)
    a, v = np.take_along_axis(at, order, 1), np.take_along_axis(s, order, 1)
    v[:, 1:][a[:, 1:] == a[:, :-1]] = -np.inf
    order = np.lexsort((a, -v), axis=1)[:, :k]
    return np.take_along_axis(v, order, 1), np.take_along_axis(a, order, 1)


def _scores(x: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.round(np.einsum("ij,ikj->ik", x[rows], x[at]), 9)


def descent(x: np.ndarray, k: int, rounds: int = 30, still: float = 0.001, sample: int = 12, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """``k`` near neighbours of each row: scores and row numbers. Every row meets neighbours of its neighbours, and those
    it is a neighbour of, until fewer than one entry in a thousand changes."""
    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return np.zeros((n, 0)), np.zeros((n, 0), int)
    if n <= EXACT:
        s = np.round(x @ x.T, 9)
        np.fill_diagonal(s, -np.inf)
        at = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(s, at, 1), at
    rng = np.random.default_rng(seed)
    s, at = np.full((n, k), -np.inf), rng.integers(0, n, (n, k))
    for i in range(rounds):
        before = at.copy()
        changed = 0
        back = np.full((n, sample), -1)
        to, frm = at[:, :sample].ravel(), np.repeat(np.arange(n), min(sample, k))
        order = rng.permutation(len(to))
        back[to[order], rng.integers(0, sample, len(to))] = frm[order]
        back = np.where(back < 0, rng.integers(0, n, back.shape), back)
        for lo in range(0, n, 2048):
            rows = np.arange(lo, min(n, lo + 2048))
            near = np.concatenate([before[rows][:, rng.permutation(k)[:sample]], back[rows]], 1)
            far = before[near][:, :, rng.permutation(k)[:sample]].reshape(len(rows), -1)
            cand = np.concatenate([near, far], 1)
            v = _scores(x, rows, cand)
            v[cand == rows[:, None]] = -np.inf
            own = s[rows] if i else np.where(before[rows] == rows[:, None], -np.inf, _scores(x, rows, before[rows]))
            s[rows], at[rows] = _best(np.concatenate([own, v], 1), np.concatenate([before[rows], cand], 1), k)
            changed += int((at[rows] != before[rows]).sum())
        if changed <= still * n * k:
            break
    return s, at


def build(bank: DataFrame, degree: int = 32, intermediate: int = 64, shards: int = 1, most: int = 200_000) -> DataFrame:
    """``shard, vec_id, e, out``: links of each vector to the best ``degree`` of its ``intermediate`` neighbours and of those it is one of,
    within its shard. The number of shards follows the bank."""
    shards = max(shards, -(-bank.count() // most))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("vec_id")), kind="stable")
        ids, x = np.asarray(table.column("vec_id"))[order], _rows(table.column("e"))[order]
        s, at = descent(x, intermediate)
        rows = np.repeat(np.arange(len(ids)), at.shape[1])
        a, b, v = np.r_[rows, at.ravel()], np.r_[at.ravel(), rows], np.r_[s.ravel(), s.ravel()]
        on = np.isfinite(v)
        order = np.lexsort((b[on], -v[on], a[on]))
        a, b = a[on][order], b[on][order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        a, b = a[new], b[new]
        first = np.maximum.accumulate(np.where(np.r_[True, a[1:] != a[:-1]], np.arange(len(a)), 0)) if len(a) else a
        on = np.arange(len(a)) - first < degree
        a, b = a[on], b[on]
        out = np.split(ids[b], np.searchsorted(a, np.arange(1, len(ids)))) if len(ids) else []
        shard = table.column("shard").take(pa.array(np.zeros(len(ids), int)))
        return pa.Table.from_arrays([shard, pa.array(ids), pa.array(list(x), pa.list_(pa.float64())), pa.array([list(o) for o in out], pa.list_(pa.int64()))], names=INDEX.names)

    return partitions(bank.select("vec_id", "e"), shards).groupBy("shard").applyInArrow(run, INDEX)


def search(queries: DataFrame, index: DataFrame, k: int, iterations: int, itopk: int = 64, exclude_self: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score`` from an index of ``build``: ``iterations`` bounds the expanded nodes for each
    query, ``itopk`` the tracked ones. Blocks of queries meet shards in a grid; nothing passes through the driver."""
    shards = [r.shard for r in index.select("shard").distinct().collect()]
    nq = max(1, -(-queries.count() // QUERY_BLOCK))
    q = queries.select("query_id", "e", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("cq"), F.explode(F.array(*map(F.lit, shards)) if shards else F.array().cast("array<int>")).alias("shard"))
    b = index.select("shard", "vec_id", "e", "out", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("cq"))

    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(b.column("vec_id")), kind="stable")
        ids, x = np.asarray(b.column("vec_id"))[order], _rows(b.column("e"))[order]
        qid, qs = np.asarray(q.column("query_id")), _rows(q.column("e"))
        if not len(ids) or not len(qid):
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=HITS.names)
        out = b.column("out").to_pylist()
        width = max(1, max(len(out[i]) for i in order))
        links = np.full((len(ids), width), -1)
        for row, i in enumerate(order):
            links[row, : len(out[i])] = np.searchsorted(ids, out[i])
        found = []
        for lo in range(0, len(qid), 256):
            found.append(_walk(qs[lo : lo + 256], x, links, iterations, max(itopk, k + 1)))
        s, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        hit = np.isfinite(s)
        if exclude_self:
            hit &= ids[np.maximum(at, 0)] != qid[:, None]
        hit &= np.cumsum(hit, axis=1) <= k
        r, c = np.nonzero(hit)
        return pa.Table.from_arrays([pa.array(qid[r]), pa.array(ids[at[r, c]]), pa.array(s[r, c])], names=HITS.names)

    hits = q.groupBy("shard", "cq").cogroup(b.groupBy("shard", "cq")).applyInArrow(run, HITS)
    return top_k(hits, k).select("query_id", "rank", "vec_id", "score")


def _walk(q: np.ndarray, x: np.ndarray, links: np.ndarray, iterations: int, itopk: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once: scores and row numbers of the tracked nodes, best first."""
    n, m = len(x), len(q)
    entry = np.arange(0, n, max(1, n // 16))[:16]
    at = np.broadcast_to(entry, (m, len(entry))).copy()
    s, seen = np.round(q @ x[entry].T, 9), np.zeros((m, n), bool)
    done = np.zeros((m, n), bool)
    seen[:, entry] = True
    rows = np.arange(m)
    for _ in range(iterations):
        open_ = np.where(np.isfinite(s) & ~done[rows[:, None], np.maximum(at, 0)], s, -np.inf)
        place = open_.argmax(1)
        live = np.isfinite(open_[rows, place])
        if not live.any():
            break
        r = rows[live]
        node = at[r, place[live]]
        done[r, node] = True
        new = links[node]
        fresh = (new >= 0) & ~seen[r[:, None], np.maximum(new, 0)]
        seen[np.repeat(r, fresh.sum(1)), new[fresh]] = True
        v = np.full((m, links.shape[1]), -np.inf)
        a = np.full((m, links.shape[1]), -1)
        v[r] = np.where(fresh, np.round(np.einsum("ij,ikj->ik", q[r], x[np.maximum(new, 0)]), 9), -np.inf)
        a[r] = np.where(fresh, new, -1)
        s, at = np.concatenate([s, v], 1), np.concatenate([at, a], 1)
        order = np.lexsort((at, -s), axis=1)[:, :itopk]
        s, at = np.take_along_axis(s, order, 1), np.take_along_axis(at, order, 1)
    order = np.lexsort((at, -s), axis=1)
    return np.take_along_axis(s, order, 1), np.take_along_axis(at, order, 1)
