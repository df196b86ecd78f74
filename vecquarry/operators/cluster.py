"""Spherical clustering and coarse cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.operators.knn import _rows

CELLED = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("cell_id", T.IntegerType()), T.StructField("cell_score", T.DoubleType())])


def seeds(bank: DataFrame, cells: int) -> np.ndarray:
    """The vectors of the smallest ids as first centroids."""
    return np.array([r.e for r in bank.orderBy("vec_id").limit(cells).collect()])


def farthest_first(bank: DataFrame, cells: int, sample: int = 20_000) -> np.ndarray:
    """Deterministic spread seeding on a bounded sample (lowest hash of the id): each next seed is the least similar one."""
    x = np.array([r.e for r in bank.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()])
    chosen = [0]
    far = np.maximum(0, 1 - x @ x[0])
    while len(chosen) < min(cells, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.maximum(0, 1 - x @ x[chosen[-1]]))
    return x[chosen]


def assign(bank: DataFrame, centroids: np.ndarray, digits: int = 9) -> DataFrame:
    """``vec_id, cell_id, cell_score``; the centroids (cells x dim) are broadcast, ties go to the lowest cell."""
    shared = bank.sparkSession.sparkContext.broadcast(np.asarray(centroids))

    def run(batches):
        c = shared.value
        for b in batches:
            if b.num_rows:
                s = np.round(_rows(b.column("e")) @ c.T, digits)
                best = s.argmax(1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(s[np.arange(len(s)), best])], names=CELLED.names)

    return bank.select("vec_id", "e").mapInArrow(run, CELLED)


def lloyd(bank: DataFrame, centroids: np.ndarray, rounds: int, tol: float = 0.0) -> np.ndarray:
    """Spherical Lloyd rounds; per-partition sums are added by cell, so only cells x dim numbers reach the driver.

    An empty cell keeps a zero vector. Stops early once the mean angular shift is below ``tol``.
    """
    dim = centroids.shape[1]
    schema = T.StructType([T.StructField("cell_id", T.IntegerType()), *(T.StructField(f"s{i}", T.DoubleType()) for i in range(dim))])
    for _ in range(rounds):
        shared = bank.sparkSession.sparkContext.broadcast(centroids)

        def run(batches, shared=shared):
            c = shared.value
            sums, seen = np.zeros((len(c), dim)), np.zeros(len(c), bool)
            for b in batches:
                if b.num_rows:
                    x = _rows(b.column("e"))
                    best = np.round(x @ c.T, 9).argmax(1)
                    np.add.at(sums, best, x)
                    seen[best] = True
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(sums[at, i]) for i in range(dim))], names=schema.names)

        total = bank.select("vec_id", "e").mapInArrow(run, schema).groupBy("cell_id").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(dim))).collect()
        new = np.zeros_like(centroids)
        for r in total:
            v = np.array(r[1:])
            new[r.cell_id] = v / (np.linalg.norm(v) + 1e-8)
        shift = float(np.mean(np.arccos(np.clip((new * centroids).sum(1), -1, 1))))
        centroids = new
        if shift < tol:
            break
    return centroids


def kmeans(bank: DataFrame, cells: int, rounds: int = 50, tol: float = 1e-4) -> tuple[np.ndarray, DataFrame]:
    """Centroids and labels of the convergent version."""
    c = lloyd(bank, farthest_first(bank, cells), rounds, tol)
    return c, assign(bank, c)


def spill_cells(bank: DataFrame, centroids: np.ndarray, top: int = 8, beta: float = 0.1) -> DataFrame:
    """``vec_id, cell_id, spill_id``: among the ``top`` nearest cells other than the own one, that with the least
    ``(r'.r)^2 + beta |r'|^2`` over residuals r (own, as a unit vector) and r' (other); null with a single cell."""
    shared = bank.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("cell_id", T.IntegerType()), T.StructField("spill_id", T.IntegerType())])

    def run(batches):
        c = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _rows(b.column("e"))
            s = np.round(x @ c.T, 9)
            order = np.lexsort((np.broadcast_to(np.arange(len(c)), s.shape), -s), axis=1)[:, :top]
            own = order[:, 0]
            r = x - c[own]
            r /= np.linalg.norm(r, axis=1, keepdims=True) + 1e-8
            other = x[:, None, :] - c[order[:, 1:]]
            cost = np.round((other * r[:, None, :]).sum(2) ** 2 + beta * (other**2).sum(2), 9)
            spill = [None] * len(x) if cost.shape[1] == 0 else [int(o[1 + j]) for o, j in zip(order, np.lexsort((order[:, 1:], cost), axis=1)[:, 0], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(spill, pa.int32())], names=schema.names)

    return bank.select("vec_id", "e").mapInArrow(run, schema)


def cell_targets(exact: DataFrame, cells: DataFrame, spill: DataFrame | None = None, eps: float = 0.05) -> DataFrame:
    """``query_id, cell_id, target``: shares of the cells of the exact neighbours; with ``spill`` also ``eps`` spread
    over the distinct spill cells, renormalised."""
    own = exact.join(cells.select("vec_id", "cell_id"), "vec_id").groupBy("query_id", "cell_id").agg(F.count("*").cast("double").alias("c"))
    w = Window.partitionBy("query_id")
    own = own.select("query_id", "cell_id", (F.col("c") / F.sum("c").over(w)).alias("c"))
    if spill is not None:
        more = exact.join(spill.select("vec_id", "spill_id"), "vec_id").filter("spill_id is not null").select("query_id", F.col("spill_id").alias("cell_id")).distinct()
        more = more.select("query_id", "cell_id", (F.lit(eps) / F.count("*").over(w)).alias("c"))
        own = own.select("query_id", "cell_id", (F.col("c") * (1 - eps)).alias("c")).unionByName(more).groupBy("query_id", "cell_id").agg(F.sum("c").alias("c"))
    return own.select("query_id", "cell_id", F.round(F.col("c") / F.sum("c").over(w), 9).alias("target"))
