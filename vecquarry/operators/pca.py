"""Mean, Gram matrix, principal directions, and what a number of them keeps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.operators.knn import _rows


def mean_vector(bank: DataFrame) -> DataFrame:
    return bank.select(F.posexplode("e").alias("i", "x")).groupBy("i").agg(F.round(F.avg("x"), 9).alias("mean"))


def gram(bank: DataFrame, center: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Gram matrix, mean and count: dim x dim partial sums a partition, added by row of the matrix."""
    head = bank.select(F.size("e").alias("d")).limit(1).collect()
    dim = head[0].d if head else 0
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("g", T.ArrayType(T.DoubleType()))])

    def run(batches):
        # Row dim holds the sums, and its last entry the count.
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            if b.num_rows:
                x = np.c_[_rows(b.column("e")), np.ones(b.num_rows)]
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array(list(total))], names=schema.names)

    sums = bank.select("e").mapInArrow(run, schema).groupBy("i").agg(*(F.sum(F.col("g")[j]).alias(f"g{j}") for j in range(dim + 1))).orderBy("i").collect()
    full = np.array([r[1:] for r in sums]).reshape(dim + 1, dim + 1)
    n = int(full[-1, -1])
    mu = full[-1, :-1] / max(n, 1)
    g = full[:-1, :-1] - (n * np.outer(mu, mu) if center else 0)
    return g, mu, n


def gram_table(bank: DataFrame, center: bool = True) -> DataFrame:
    g, _, _ = gram(bank, center)
    rows = [(i, j, round(float(g[i, j]), 6) + 0.0) for i in range(len(g)) for j in range(i, len(g))]
    return bank.sparkSession.createDataFrame(rows, "i int, j int, g double")


def fit(bank: DataFrame, keep: int, center: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions (keep x dim, orthonormal, the largest entry of each positive), mean, and variances."""
    g, mu, n = gram(bank, center)
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(-values)[:keep]
    w = vectors[:, order].T
    w *= np.sign(w[np.arange(len(w)), np.abs(w).argmax(1)])[:, None]
    return w, mu, np.maximum(values[order], 0) / max(n - 1 if center else n, 1)


def transform(bank: DataFrame, w: np.ndarray, mu: np.ndarray | None = None, center: bool = False, normalize: bool = True, keys: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Projected vectors. By default the mean isn't subtracted and the result is normalised; both are options."""
    shared = bank.sparkSession.sparkContext.broadcast((w, mu if center else None))
    schema = T.StructType([*(bank.schema[k] for k in keys), T.StructField("e", T.ArrayType(T.DoubleType()))])

    def run(batches):
        w, mu = shared.value
        for b in batches:
            if b.num_rows:
                x = _rows(b.column("e"))
                y = (x if mu is None else x - mu) @ w.T
                if normalize:
                    y = y / (np.linalg.norm(y, axis=1, keepdims=True) + 1e-8)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(list(y))], names=schema.names)

    return bank.select(*keys, "e").mapInArrow(run, schema)


def explained_variance(bank: DataFrame, keep: int) -> DataFrame:
    """``component, variance, cumulative_share``."""
    g, _, n = gram(bank, True)
    _, _, var = fit(bank, keep)
    share = np.cumsum(var) / max(np.trace(g) / max(n - 1, 1), 1e-300)
    return bank.sparkSession.createDataFrame([(i + 1, round(float(v), 9), round(float(s), 9)) for i, (v, s) in enumerate(zip(var, share, strict=True))], "component int, variance double, cumulative_share double")


def cosine_retention(bank: DataFrame, w: np.ndarray, dims: list[int]) -> DataFrame:
    """``dim, retention``: mean cosine between a vector and its reconstruction from the first ``dim`` directions."""
    shared = bank.sparkSession.sparkContext.broadcast(w)
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])

    def run(batches):
        w = shared.value
        sums, n = np.zeros(len(dims)), 0
        for b in batches:
            if b.num_rows:
                x = _rows(b.column("e"))
                y = x @ w.T
                size = np.linalg.norm(x, axis=1) + 1e-12
                # The reconstruction's length is that of its coordinates, and its dot with x the square of that.
                sums += [float((np.linalg.norm(y[:, :d], axis=1) / size).sum()) for d in dims]
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(dims, np.int32)), pa.array(sums), pa.array(np.full(len(dims), n))], names=schema.names)

    return bank.select("e").mapInArrow(run, schema).groupBy("dim").agg(F.round(F.sum("s") / F.sum("n"), 9).alias("retention"))


def save(spark, path: str, w: np.ndarray, mu: np.ndarray | None, center: bool) -> None:
    """A fitted rotation as a table: one row for each direction, and one (-1) for the mean if there is one."""
    rows = [(i, [float(x) for x in row], center) for i, row in enumerate(w)] + ([(-1, [float(x) for x in np.ravel(mu)], center)] if mu is not None else [])
    spark.createDataFrame(rows, "direction int, w array<double>, center_for_fit boolean").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> tuple[np.ndarray, np.ndarray | None, bool]:
    """Directions, mean and ``center_for_fit`` of a stored rotation."""
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.direction)  # as many rows as kept directions
    w = np.array([r.w for r in rows if r.direction >= 0])
    mu = next((np.array(r.w) for r in rows if r.direction < 0), None)
    return w, mu, bool(rows and rows[0].center_for_fit)
