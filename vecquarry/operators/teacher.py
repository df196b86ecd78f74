"""Candidate packs and teacher distributions over them, in long form: ``query_id, vec_id`` rows instead of padded arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR = -1e9


def by_query() -> Window:
    return Window.partitionBy("query_id")


def mixed_pack(base: DataFrame, student: DataFrame, c_base: int, c_student: int, c_total: int) -> DataFrame:
    """``query_id, pos, vec_id``: the first ``c_base`` base hits, then the first ``c_student`` student hits, without
    repeats (the first place stays), cut to ``c_total``."""
    a = base.filter(F.col("rank") <= c_base).select("query_id", "vec_id", F.col("rank").alias("p"))
    b = student.filter(F.col("rank") <= c_student).select("query_id", "vec_id", (F.col("rank") + c_base).alias("p"))
    first = a.unionByName(b).filter("vec_id >= 0").groupBy("query_id", "vec_id").agg(F.min("p").alias("p"))
    return first.withColumn("pos", F.row_number().over(by_query().orderBy("p"))).filter(F.col("pos") <= c_total).select("query_id", "pos", "vec_id")


def head_scores(pack: DataFrame, head: DataFrame) -> DataFrame:
    """Pack rows with the largest head score of their id, else a floor."""
    best = head.groupBy("query_id", "vec_id").agg(F.max("score").alias("s"))
    return pack.join(best, ["query_id", "vec_id"], "left").select("query_id", "pos", "vec_id", F.coalesce("s", F.lit(FLOOR)).alias("head_score"))


def in_exact(pack: DataFrame, exact: DataFrame) -> DataFrame:
    """Pack rows with the best rank (from 0) of their id in the exact list, null if it isn't there."""
    best = exact.groupBy("query_id", "vec_id").agg((F.min("rank") - 1).alias("exact_rank"))
    return pack.join(best, ["query_id", "vec_id"], "left")


def uniform_teacher(pack: DataFrame, exact: DataFrame) -> DataFrame:
    hit = F.col("exact_rank").isNotNull().cast("double")
    n = F.sum(hit).over(by_query())
    return in_exact(pack, exact).select("query_id", "pos", "vec_id", F.when(n > 0, hit / n).otherwise(0.0).alias("p"))


def ranked_teacher(pack: DataFrame, exact: DataFrame, gamma: float = 0.15) -> DataFrame:
    w = F.coalesce(F.exp(-gamma * F.col("exact_rank")), F.lit(0.0))
    return in_exact(pack, exact).select("query_id", "pos", "vec_id", (w / (F.sum(w).over(by_query()) + 1e-12)).alias("p"))


def ann_teacher(scored: DataFrame, tau: float = 0.07) -> DataFrame:
    z = F.exp((F.col("head_score") - F.max("head_score").over(by_query())) / tau)
    return scored.withColumn("z", z).select("query_id", "pos", "vec_id", (F.col("z") / F.sum("z").over(by_query())).alias("p"))


def mixed_teacher(ann: DataFrame, exact: DataFrame, share: float) -> DataFrame:
    """``share`` of the index teacher and the rest of the exact one, renormalised; 0 or 1 switch one of them off."""
    both = ann.select("query_id", "pos", "vec_id", F.col("p").alias("pa")).join(exact.select("query_id", "vec_id", F.col("p").alias("pe")), ["query_id", "vec_id"])
    p = share * F.col("pa") + (1 - share) * F.col("pe")
    return both.withColumn("m", p).select("query_id", "pos", "vec_id", (F.col("m") / (F.sum("m").over(by_query()) + 1e-12)).alias("p"))
