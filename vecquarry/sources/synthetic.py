"""Seeded Gaussian vectors of unit length, made on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecquarry.functions.vec import l2_normalize


def vectors(spark: SparkSession, n: int, dim: int, seed: int = 0, key: str = "vec_id") -> DataFrame:
    """``<key>, e``; the same for the same seed, whatever the number of partitions."""

    def normal(i: int):
        # Box-Muller over hashes of the id: no state, so no dependence on the partitioning.
        u, v = ((F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i), F.lit(s)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52)) for s in (0, 1))
        return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)

    return spark.range(n).select(F.col("id").alias(key), l2_normalize(F.array(*(normal(i) for i in range(dim)))).alias("e"))


def smoke_set(spark: SparkSession, n: int = 50_000, dim: int = 128, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A bank of ``n`` vectors and min(1000, max(10, n / 50)) queries."""
    m = min(1000, max(10, n // 50))
    return vectors(spark, n, dim, seed), vectors(spark, m, dim, seed + 1, "query_id")
