"""Vector functions as column expressions: no UDF, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product, folded from the left in double precision."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, eps: float = EPS) -> Column:
    # As an array the norm is computed once; within a lambda it would be computed again for each element.
    n = F.array_repeat(norm(v) + F.lit(eps), F.size(v))
    return F.zip_with(as_double(v), n, lambda x, y: x / y)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def mix(a: Column, b: Column, share: Column | float) -> Column:
    """``(1 - share) a + share b``."""
    p = F.lit(share) if not isinstance(share, Column) else share
    return F.zip_with(as_double(a), as_double(b), lambda x, y: (F.lit(1.0) - p) * x + p * y)


def unit_norm_stats(df: DataFrame, vec: str, tol: float = 1e-4) -> DataFrame:
    """Mean, least and largest norm, and whether all are 1 within ``tol`` (with numpy's relative part)."""
    n = norm(F.col(vec))
    return df.select(n.alias("n")).agg(
        F.round(F.avg("n"), 9).alias("mean_norm"), F.round(F.min("n"), 9).alias("min_norm"), F.round(F.max("n"), 9).alias("max_norm"),
        F.bool_and(F.abs(F.col("n") - 1) <= tol + 1e-5).alias("all_unit"),
    )


def is_normalized(df: DataFrame, vec: str, tol: float = 1e-3) -> DataFrame:
    """True for an empty table, false if any norm isn't finite or leaves the tolerance."""
    n = norm(F.col(vec))
    ok = ~F.isnan(n) & (n < float("inf")) & (F.abs(n - 1) <= tol)
    return df.agg(F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(True)).alias("is_normalized"))


def bank_fingerprint(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Order-independent fingerprint ``N{rows}_D{dim}_{12 hex}`` of a bank."""
    h = F.bit_xor(F.xxhash64(F.col(key), F.col(vec)))
    size = F.max(F.size(vec))
    text = F.concat_ws("_", F.concat(F.lit("N"), F.count("*")), F.concat(F.lit("D"), F.coalesce(size, F.lit(0))), F.substring(F.sha2(F.coalesce(h, F.lit(0)).cast("string"), 256), 1, 12))
    return df.agg(text.alias("fingerprint"))
