"""Losses over packs and query moves, each one aggregate row; ``scores``: query_id, pos, vec_id, score (the student's)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_query() -> Window:
    return Window.partitionBy("query_id")



def listwise_kl(scores: DataFrame, teacher: DataFrame, tau: float = 0.07) -> DataFrame:
    """KL(teacher || student) of the softmax over each pack, mean over queries, times tau squared."""
    s = scores.join(teacher.select("query_id", "vec_id", "p"), ["query_id", "vec_id"])
    s = s.withColumn("t", F.col("p") / (F.sum("p").over(by_query()) + 1e-12)).withColumn("z", (F.col("score") - F.max("score").over(by_query())) / tau)
    s = s.withColumn("logq", F.col("z") - F.log(F.sum(F.exp("z")).over(by_query())))
    term = F.when(F.col("t") > 0, F.col("t") * (F.log("t") - F.col("logq"))).otherwise(0.0)
    per = s.groupBy("query_id").agg(F.sum(term).alias("kl"))
    return per.agg(F.round(F.avg("kl") * tau * tau, 9).alias("loss"))


def frontier_gap(scores: DataFrame, k: int, margin: float) -> DataFrame:
    """relu(margin - (s_k - s_{k+1})) over queries with more than k candidates, mean; 0 if there are none."""
    r = F.row_number().over(by_query().orderBy(F.desc("score"), "vec_id"))
    at = scores.withColumn("r", r).filter(F.col("r").isin(k, k + 1)).groupBy("query_id")
    gap = at.agg(F.max(F.when(F.col("r") == k, F.col("score"))).alias("a"), F.max(F.when(F.col("r") == k + 1, F.col("score"))).alias("b")).filter("b is not null")
    return gap.agg(F.round(F.coalesce(F.avg(F.greatest(F.lit(0.0), F.lit(margin) - (F.col("a") - F.col("b")))), F.lit(0.0)), 9).alias("loss"))


def gap_margin(budget: int) -> float:
    return 0.05 if budget <= 30 else 0.03


def cone(cosine: Column, threshold: Column) -> Column:
    return F.greatest(F.lit(0.0), threshold - cosine)


def cone_identity(moves: DataFrame, threshold: Column) -> DataFrame:
    """``moves``: query_id, cos (of the moved and the original query)."""
    return moves.agg(F.round(F.avg(cone(F.col("cos"), threshold)), 9).alias("loss"))


def legacy_identity(moves: DataFrame) -> DataFrame:
    """Mean squared move; ``moves``: query_id, dist."""
    return moves.agg(F.round(F.avg(F.col("dist") * F.col("dist")), 9).alias("loss"))


def barycentric_identity(moved: DataFrame, original: DataFrame, exact: DataFrame, bank: DataFrame, beta: float = 0.15, top: int = 8) -> DataFrame:
    """Squared distance of the moved query to a mix of the original and the rank-weighted mean of its best images.

    ``moved`` and ``original``: query_id, e; ``exact``: query_id, rank, vec_id; ``bank``: vec_id, e.
    """
    weight = F.exp(-0.1 * (F.col("rank") - 1))
    pos = exact.filter(F.col("rank") <= top).join(bank, "vec_id").select("query_id", weight.alias("w"), F.posexplode("e").alias("i", "x"))
    bary = pos.groupBy("query_id", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))

    def long(df, name):
        return df.select("query_id", F.posexplode("e").alias("i", name))

    def unit(name):
        return F.col(name) / F.greatest(F.sqrt(F.sum(F.col(name) * F.col(name)).over(by_query())), F.lit(1e-12))

    j = bary.withColumn("b", unit("x")).join(long(original, "t"), ["query_id", "i"]).join(long(moved, "q"), ["query_id", "i"])
    j = j.withColumn("c", (1 - beta) * F.col("t") + beta * F.col("b")).withColumn("c", unit("c"))
    per = j.groupBy("query_id").agg(F.sum((F.col("q") - F.col("c")) * (F.col("q") - F.col("c"))).alias("d"))
    return per.agg(F.round(F.avg("d"), 9).alias("loss"))


def cell_cross_entropy(cell_scores: DataFrame, targets: DataFrame, tau: float = 0.07) -> DataFrame:
    """``cell_scores``: query_id, cell_id, score over all cells; ``targets``: query_id, cell_id, target."""
    s = cell_scores.withColumn("z", (F.col("score") - F.max("score").over(by_query())) / tau)
    s = s.withColumn("logq", F.col("z") - F.log(F.sum(F.exp("z")).over(by_query())))
    per = s.join(targets, ["query_id", "cell_id"]).groupBy("query_id").agg(F.sum(-F.col("target") * F.col("logq")).alias("ce"))
    return per.agg(F.round(F.avg("ce") * tau * tau, 9).alias("loss"))


def trust_region(moves: DataFrame, dim: int, margin: float = 0.20) -> DataFrame:
    """Mean of the moves beyond a margin that grows with the root of the dimension."""
    m = margin * math.sqrt(dim / 512.0)
    return moves.agg(F.round(F.avg(F.greatest(F.lit(0.0), F.col("dist") - m)), 9).alias("loss"))


def trust_weight(w_id: Column, epoch: Column) -> Column:
    return 0.5 * w_id * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (epoch - 1) / F.lit(2.0)))


def total(kl: Column, identity: Column, gap: Column, cell: Column, trust: Column, epoch: Column, w_kl: float = 1.0, w_id: float = 0.1, w_gap: float = 0.1, w_cell: float = 0.1) -> Column:
    """The weighted sum; the cell part falls and the trust part rises with the epoch."""
    fall = F.lit(1.0) - 0.4 * F.least(F.lit(1.0), epoch / F.lit(3.0))
    return w_kl * kl + w_id * identity + w_gap * gap + w_cell * fall * cell + trust_weight(F.lit(w_id), epoch) * trust
