"""Inverted-file search: cells, probes and the equi-join on the cell; multi-index assignment."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.functions.vec import bank_fingerprint, dot
from vecquarry.operators.cluster import assign, kmeans
from vecquarry.operators.knn import _rows, top_k

PROBES = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("cell_id", T.IntegerType()), T.StructField("probe", T.IntegerType())])


def probes(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """``query_id, cell_id, probe`` of the ``nprobe`` nearest cells, clamped to the cells there are."""
    shared = queries.sparkSession.sparkContext.broadcast(centroids)
    n = max(1, min(nprobe, len(centroids)))

    def run(batches):
        c = shared.value
        for b in batches:
            if b.num_rows:
                s = np.round(_rows(b.column("e")) @ c.T, 9)
                order = np.lexsort((np.broadcast_to(np.arange(len(c)), s.shape), -s), axis=1)[:, :n]
                q = np.repeat(np.asarray(b.column("query_id")), n)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(order)))], names=PROBES.names)

    return queries.select("query_id", "e").mapInArrow(run, PROBES)


def scored(queries: DataFrame, celled: DataFrame, centroids: np.ndarray, nprobe: int, exclude_self: bool = False, digits: int = 9) -> DataFrame:
    """``query_id, probe, vec_id, score`` of every bank vector in a probed cell; ``celled``: vec_id, e, cell_id."""
    p = probes(queries, centroids, nprobe).join(queries.select("query_id", F.col("e").alias("qe")), "query_id")
    pairs = celled.join(p, "cell_id")
    if exclude_self:
        pairs = pairs.filter("vec_id != query_id")
    return pairs.select("query_id", "probe", "vec_id", F.round(dot(F.col("qe"), F.col("e")), digits).alias("score"))


def search(queries: DataFrame, celled: DataFrame, centroids: np.ndarray, k: int, nprobe: int, exclude_self: bool = False) -> DataFrame:
    return top_k(scored(queries, celled, centroids, nprobe, exclude_self), k).select("query_id", "rank", "vec_id", "score")


def sweep(queries: DataFrame, celled: DataFrame, centroids: np.ndarray, k: int, budgets: list[int], exclude_self: bool = False) -> DataFrame:
    """``budget, query_id, rank, vec_id, score``: one search at the largest budget, cut down for each smaller one."""
    hits = scored(queries, celled, centroids, max(budgets), exclude_self)
    each = hits.withColumn("budget", F.explode(F.filter(F.array(*map(F.lit, sorted(budgets))), lambda b: b >= F.col("probe"))))
    w = Window.partitionBy("budget", "query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("budget", "query_id", "rank", "vec_id", "score")


def build(bank: DataFrame, cells: int, path: str | None = None) -> tuple[np.ndarray, DataFrame]:
    """Centroids and the bank with cells. With ``path`` the index is stored under the bank's fingerprint, partitioned by
    cell so that probes prune files, and read back if it is there with the same size and dimension."""
    spark = bank.sparkSession
    if path:
        name = f"{bank_fingerprint(bank, 'vec_id', 'e').first()[0]}_cells{cells}"
        at = os.path.join(path, name)
        try:
            c = spark.read.parquet(f"{at}/centroids").orderBy("cell_id").collect()
            return np.array([r.c for r in c]), spark.read.parquet(f"{at}/bank")
        except Exception as e:  # not there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    centroids, labels = kmeans(bank, cells)
    celled = bank.join(labels.select("vec_id", "cell_id"), "vec_id")
    if path:
        celled.write.partitionBy("cell_id").parquet(f"{at}/bank")
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell_id int, c array<double>").coalesce(1).write.parquet(f"{at}/centroids")
        celled = spark.read.parquet(f"{at}/bank")
    return centroids, celled


def imi_assign(bank: DataFrame, left: np.ndarray, right: np.ndarray) -> DataFrame:
    """``vec_id, c1, c2``: the cells of both halves, under one codebook each."""
    half = left.shape[1]
    halves = bank.select("vec_id", F.slice("e", 1, half).alias("a"), F.slice("e", half + 1, 10_000).alias("b"))
    c1 = assign(halves.select("vec_id", F.col("a").alias("e")), left).select("vec_id", F.col("cell_id").alias("c1"))
    c2 = assign(halves.select("vec_id", F.col("b").alias("e")), right).select("vec_id", F.col("cell_id").alias("c2"))
    return c1.join(c2, "vec_id")


def imi_search(queries: DataFrame, bank: DataFrame, left: np.ndarray, right: np.ndarray, k: int, budget: int) -> DataFrame:
    """The ``budget`` cell pairs of the highest summed half scores, then exact scores within them."""
    cells = imi_assign(bank, left, right)
    shared = bank.sparkSession.sparkContext.broadcast((left, right))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("c1", T.IntegerType()), T.StructField("c2", T.IntegerType())])
    n = max(1, min(budget, len(left) * len(right)))

    def run(batches):
        lo, hi = shared.value
        for b in batches:
            if b.num_rows:
                x = _rows(b.column("e"))
                h = lo.shape[1]
                s = np.round((x[:, :h] @ lo.T)[:, :, None] + (x[:, h:] @ hi.T)[:, None, :], 9).reshape(len(x), -1)
                order = np.argsort(-s, axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column("query_id")), n)), pa.array((order // len(hi)).ravel().astype(np.int32)), pa.array((order % len(hi)).ravel().astype(np.int32))], names=schema.names)

    p = queries.select("query_id", "e").mapInArrow(run, schema).join(queries.select("query_id", F.col("e").alias("qe")), "query_id")
    pairs = bank.join(cells, "vec_id").join(p, ["c1", "c2"])
    return top_k(pairs.select("query_id", "vec_id", F.round(dot(F.col("qe"), F.col("e")), 9).alias("score")), k).select("query_id", "rank", "vec_id", "score")
