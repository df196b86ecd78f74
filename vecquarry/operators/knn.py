"""Exact similarity top-k join: every query against the whole bank.

``blocked`` multiplies blocks of queries and bank rows and keeps a running top k for each query. Queries that fit in
``BROADCAST_BYTES`` go to the bank's partitions, and the bank isn't shuffled; more of them are cut into blocks, and each pair
of a query block and a bank block is one cell of a grid, so neither side passes through the driver. ``catalyst`` is the declarative form for
query sides of the same size (window group limit before and after the exchange). All return the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.functions.vec import dot, l2_normalize

HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
#: Largest query side that is sent to every executor.
BROADCAST_BYTES = 64 << 20
#: Rows of a block of queries and of a block of the bank.
QUERY_BLOCK, BANK_BLOCK = 20_000, 200_000


def unit_vectors(df: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``vec_id, e``: the normalised vectors in double precision."""
    return df.select(F.col(key).alias("vec_id"), l2_normalize(F.col(vec)).alias("e"))


def top_k(hits: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _rows(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def exact_topk(queries: DataFrame, bank: DataFrame, k: int, strategy: str = "blocked", exclude_self: bool = False, digits: int = 9) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best of ``vec_id, e`` for each of ``query_id, e``; ties by ``vec_id``.

    Fewer than k rows come out where the bank is smaller; empty sides give no rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if strategy not in ("blocked", "catalyst"):
        raise ValueError(f"unknown strategy {strategy!r}")
    # One pass over the ids and lengths of the queries; their vectors stay where they are.
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("e")), F.lit(0)).alias("d")).first()
    small = 8 * size.d <= BROADCAST_BYTES
    if strategy == "catalyst" and small:
        q = queries.select("query_id", F.col("e").alias("qe"))
        pairs = bank.crossJoin(F.broadcast(q)) if not exclude_self else bank.join(F.broadcast(q), F.col("vec_id") != F.col("query_id"))
        hits = pairs.select("query_id", "vec_id", F.round(dot(F.col("qe"), F.col("e")), digits).alias("score"))
        return top_k(hits, k).select("query_id", "rank", "vec_id", "score")
    if small:
        t = queries.select("query_id", "e").toArrow()
        shared = bank.sparkSession.sparkContext.broadcast((np.asarray(t.column("query_id")), _rows(t.column("e"))))

        def run(batches):
            best = Best(*shared.value, k, exclude_self, digits)
            for b in batches:
                best.meet(_rows(b.column("e")), np.asarray(b.column("vec_id")))
            yield best.hits()

        hits = bank.select("vec_id", "e").mapInArrow(run, HITS)
    else:
        n_bank = bank.count()
        nq, nb = -(-size.n // QUERY_BLOCK), max(1, -(-n_bank // BANK_BLOCK))
        own = {key: F.pmod(F.xxhash64(key), F.lit(n)).cast("int") for key, n in (("query_id", nq), ("vec_id", nb))}
        q = queries.select("query_id", "e", own["query_id"].alias("cq"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("cb"))
        b = bank.select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("cq"), own["vec_id"].alias("cb"))

        def cell(q: pa.Table, b: pa.Table) -> pa.Table:
            best = Best(np.asarray(q.column("query_id")), _rows(q.column("e")), k, exclude_self, digits)
            order = np.argsort(np.asarray(b.column("vec_id")), kind="stable")
            x, ids = _rows(b.column("e"))[order], np.asarray(b.column("vec_id"))[order]
            for at in range(0, len(ids), 10_000):
                best.meet(x[at : at + 10_000], ids[at : at + 10_000])
            return pa.Table.from_batches([best.hits()])

        hits = q.groupBy("cq", "cb").cogroup(b.groupBy("cq", "cb")).applyInArrow(cell, HITS)
    return top_k(hits, k).select("query_id", "rank", "vec_id", "score")


class Best:
    """A running top k for a block of queries; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool, digits: int):
        self.ids, self.q, self.k, self.exclude_self, self.digits = ids, q, k, exclude_self, digits
        self.bar = np.full(len(ids), -np.inf)
        self.kept = [np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)]
        self.new: list[list[np.ndarray]] = []

    def meet(self, x: np.ndarray, ids: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        for at in range(0, len(self.ids), 2048):
            part = slice(at, at + 2048)
            s = np.round(self.q[part] @ x.T, self.digits)
            if self.exclude_self:
                s[self.ids[part][:, None] == ids[None, :]] = -np.inf
            m = min(self.k, len(ids))
            # Ties at the k-th place stay for the merge.
            kth = np.maximum(self.bar[part], -np.partition(-s, m - 1, axis=1)[:, m - 1] if m == self.k else -np.inf)
            r, c = np.nonzero((s >= kth[:, None]) & (s > -np.inf))
            self.new.append([r + at, ids[c], s[r, c]])
        if sum(len(n[0]) for n in self.new) > 4 * self.k * len(self.ids):
            self.merge()

    def merge(self) -> None:
        q, ids, s = (np.concatenate(c) for c in zip(self.kept, *self.new, strict=True))
        self.new = []
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        first = np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], np.arange(len(q)), 0)) if len(q) else q
        rank = np.arange(len(q)) - first
        on = rank < self.k
        last = rank == self.k - 1
        self.bar[q[last]] = s[last]
        self.kept = [q[on], ids[on], s[on]]

    def hits(self) -> pa.RecordBatch:
        self.merge()
        q, ids, s = self.kept
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q].astype(np.int64)), pa.array(ids.astype(np.int64)), pa.array(s)], names=HITS.names)


def candidate_pack(hits: DataFrame, c: int) -> DataFrame:
    """``query_id, cand``: the first ``c`` ids of each query as an array, best first."""
    kept = hits.filter(F.col("rank") <= c).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("l"))
    return kept.select("query_id", F.transform("l", lambda x: x["vec_id"]).alias("cand"))


def hydrate(hits: DataFrame, side: DataFrame, *columns: str) -> DataFrame:
    """Hits with side columns of their ids; ids that aren't there get nulls."""
    return hits.join(side.select("vec_id", *columns), "vec_id", "left")
