"""Recall, pair hits, speed statistics and summaries of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(pred: DataFrame, exact: DataFrame, k: int, *by: str) -> DataFrame:
    """Shared ids of the first k of both lists over k times the number of queries of ``exact``."""
    n = exact.agg(F.countDistinct("query_id").alias("n"), F.max("rank").alias("deep"))
    p = pred.filter(F.col("rank") <= k).select(*by, "query_id", "vec_id")
    e = exact.filter(F.col("rank") <= k).select("query_id", "vec_id")
    shared = p.join(e, ["query_id", "vec_id"]).groupBy(*by).agg(F.count("*").alias("shared"))
    share = F.col("shared") / (F.least(F.lit(k), F.col("deep")) * F.col("n"))
    return shared.crossJoin(F.broadcast(n)).select(*by, F.lit(k).alias("k"), F.round(share, 9).alias("recall"))


def pair_hit(pred: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Share of the queries of ``query_id, gt_vec_id`` whose paired id is among their first k."""
    p = pred.filter(F.col("rank") <= k).select("query_id", F.col("vec_id").alias("gt_vec_id"), F.lit(1).alias("hit"))
    return pairs.join(p, ["query_id", "gt_vec_id"], "left").agg(F.lit(k).alias("k"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 9).alias("pair_hit"))


def truth_check(found: DataFrame, truth: DataFrame, k: int, n_queries: int = 100, least: float = 0.999) -> DataFrame:
    """``k, n_queries, recall, passed``: own exact lists against published ones, over the queries of the smallest ids."""
    some = found.select("query_id").distinct().orderBy("query_id").limit(n_queries)
    f, t = (df.filter(F.col("rank") <= k).join(some, "query_id").select("query_id", "vec_id") for df in (found, truth))
    shared = f.join(t, ["query_id", "vec_id"]).agg(F.count("*").alias("shared"))
    share = F.round(F.col("shared") / (F.col("n_queries") * k), 9)
    return shared.crossJoin(some.agg(F.count("*").cast("int").alias("n_queries"))).select(F.lit(k).alias("k"), "n_queries", share.alias("recall"), (share >= least).alias("passed"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def qps_stats(results: DataFrame, *by: str) -> DataFrame:
    """Mean, median, population deviation, least and largest speed."""
    r = results.filter(finite(F.col("qps")))
    return r.groupBy(*by).agg(
        F.count("*").alias("n_runs"), F.round(F.avg("qps"), 6).alias("qps_mean"), F.round(F.median("qps"), 6).alias("qps_median"),
        F.round(F.stddev_pop("qps"), 6).alias("qps_std"), F.round(F.min("qps"), 6).alias("qps_min"), F.round(F.max("qps"), 6).alias("qps_max"),
    )


def recall_summary(results: DataFrame, *by: str) -> DataFrame:
    r = results.filter(finite(F.col("recall")))
    return r.groupBy(*by).agg(F.round(F.avg("recall"), 9).alias("avg_recall"), F.round(F.max("recall"), 9).alias("max_recall"), F.round(F.min("recall"), 9).alias("min_recall"))


def weighted_recall(results: DataFrame, *by: str) -> DataFrame:
    """Recall weighted by budget; missing or not-finite recall counts as 0, and repeated measurements by their mean."""
    value = F.when(finite(F.col("recall")), F.col("recall")).otherwise(0.0)
    per = results.groupBy(*by, "budget").agg(F.avg(value).alias("r"))
    return per.groupBy(*by).agg(F.round(F.sum(F.col("budget") * F.col("r")) / F.sum("budget"), 9).alias("weighted_recall"))


def cosine_validation(df: DataFrame, cos: str = "cos") -> DataFrame:
    """Mean, deviation, extremes and share of at least 0.99 of a cosine between stored and re-encoded vectors."""
    return df.agg(
        F.count(cos).alias("n"), F.round(F.avg(cos), 9).alias("mean_cos"), F.round(F.stddev_pop(cos), 9).alias("std_cos"), F.round(F.min(cos), 9).alias("min_cos"),
        F.round(F.max(cos), 9).alias("max_cos"), F.round(F.avg((F.col(cos) >= 0.99).cast("int")), 9).alias("share_99"),
    )


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count(key).alias("n"), F.countDistinct(key).alias("n_distinct"), (F.count(key) - F.countDistinct(key)).alias("n_duplicates"))
