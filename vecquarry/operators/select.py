"""Choosing checkpoints, build settings and example queries from result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_checkpoint(scores: DataFrame, *by: str) -> DataFrame:
    """``scores``: by..., variant, weighted_recall; the best projected variant of each group, ties to the first name."""
    w = Window.partitionBy(*by).orderBy(F.desc("weighted_recall"), "variant")
    return scores.filter(F.col("variant").startswith("proj_")).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r").withColumnRenamed("variant", "best_variant")


def generalization_checkpoint(scores: DataFrame, self_backend: str | None, other_backend: str, *by: str) -> DataFrame:
    """The variant that serves the other backend best without losing the own one.

    Score: 0.7 other + 0.3 self (only other where there is no own backend). A variant must keep 85 % of the baseline on
    the other backend and 80 % of the best own score; if none does, the best score on the other backend wins.
    """
    other = scores.filter(F.col("backend") == other_backend).select(*by, "variant", F.col("weighted_recall").alias("other"))
    base = other.filter("variant = 'baseline'").select(*by, F.col("other").alias("base"))
    v = other.filter(F.col("variant").startswith("proj_")).join(base, list(by))
    if self_backend:
        own = scores.filter(F.col("backend") == self_backend).select(*by, "variant", F.col("weighted_recall").alias("own"))
        v = v.join(own, [*by, "variant"]).withColumn("best_own", F.max("own").over(Window.partitionBy(*by)))
        v = v.withColumn("score", F.round(0.7 * F.col("other") + 0.3 * F.col("own"), 9)).withColumn("ok", (F.col("other") >= 0.85 * F.col("base")) & (F.col("own") >= 0.80 * F.col("best_own")))
    else:
        v = v.withColumn("score", F.col("other")).withColumn("ok", F.col("other") >= 0.85 * F.col("base"))
    v = v.withColumn("any_ok", F.max("ok").over(Window.partitionBy(*by)))
    v = v.filter("ok or not any_ok").withColumn("value", F.when(F.col("any_ok"), F.col("score")).otherwise(F.col("other")))
    w = Window.partitionBy(*by).orderBy(F.desc("value"), "variant")
    return v.withColumn("r", F.row_number().over(w)).filter("r = 1").select(*by, F.col("variant").alias("chosen"), "value", F.col("any_ok").alias("constrained"))


#: Simplified names of backends, and the other backend that a checkpoint should generalise to.
BACKENDS = {"cagra": "cuvs_cagra", "cagra_only": "cuvs_cagra", "ivf": "ivf", "ivf_only": "ivf", "exact_k": "exact_k"}
OTHER = {"cuvs_cagra": "ivf", "ivf": "cuvs_cagra", "exact_k": "ivf"}


def selection_summary(scores: DataFrame, backend: str, *by: str) -> DataFrame:
    """``by..., mode, chosen, value``: the best and the generalising checkpoint of a backend; only the latter for ``exact_k``."""
    own = BACKENDS.get(backend, backend)
    exact = own == "exact_k"
    general = generalization_checkpoint(scores, None if exact else own, OTHER.get(own, "ivf"), *by)
    out = general.select(*by, F.lit("generalization").alias("mode"), "chosen", "value")
    if exact:
        return out
    best = best_checkpoint(scores.filter(F.col("backend") == own).select(*by, "variant", "weighted_recall"), *by)
    return best.select(*by, F.lit("best").alias("mode"), F.col("best_variant").alias("chosen"), F.col("weighted_recall").alias("value")).unionByName(out)


def best_config(trials: DataFrame, *by: str) -> DataFrame:
    """Of build settings the one of best recall, then speed, then number."""
    w = Window.partitionBy(*by).orderBy(F.desc("recall"), F.desc("qps"), "config_id")
    return trials.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def parameter_grid(spark, skip: DataFrame | None = None, most: int | None = None, **values: list) -> DataFrame:
    """All combinations of the given values in order, without those to skip, cut to the first ``most`` trials."""
    grid = None
    for name, options in values.items():
        df = spark.createDataFrame([(i, v) for i, v in enumerate(options)], f"o_{name} int, {name} {'int' if isinstance(options[0], int) else 'string'}")
        grid = df if grid is None else grid.crossJoin(df)
    if skip is not None:
        grid = grid.join(skip, list(values), "left_anti")
    order = [f"o_{n}" for n in values]
    grid = grid.withColumn("config_id", F.row_number().over(Window.orderBy(*order)))
    return (grid.filter(F.col("config_id") <= most) if most else grid).select("config_id", *values)


def nearest_config(configs: DataFrame, dataset: str, dim: int, n: int) -> DataFrame:
    """The cached setting of the same data set and dimension whose bank size is nearest to ``n``."""
    d = F.abs(F.col("n") - n)
    return configs.filter((F.col("dataset") == dataset) & (F.col("dim") == dim)).withColumn("distance", d).orderBy("distance", "config_id").limit(1)


def query_improvement(base: DataFrame, projected: DataFrame, top: int = 3) -> DataFrame:
    """Relative gain of the mean of the first ``top`` scores; the plain difference where the base isn't positive."""

    def mean(df, name):
        return df.filter(F.col("rank") <= top).groupBy("query_id").agg(F.avg("score").alias(name))

    gain = F.col("p") - F.col("b")
    value = F.when(F.col("b") > 0, gain / (F.abs("b") + 1e-8)).otherwise(gain)
    j = mean(base, "b").join(mean(projected, "p"), "query_id")
    return j.select("query_id", F.round("b", 9).alias("base_mean"), F.round("p", 9).alias("proj_mean"), F.round(value, 6).alias("improvement"))


def improved_queries(improvement: DataFrame, threshold: float = 0.05) -> DataFrame:
    return improvement.filter(F.col("improvement") >= threshold)


def overlap_labels(base: DataFrame, projected: DataFrame) -> DataFrame:
    """Each retrieved id of a query: in both lists, only in the base, or only in the projected one."""
    b = base.select("query_id", "vec_id", F.col("rank").alias("base_rank"))
    p = projected.select("query_id", "vec_id", F.col("rank").alias("proj_rank"))
    label = F.when(F.col("base_rank").isNull(), "proj_only").when(F.col("proj_rank").isNull(), "base_only").otherwise("both")
    return b.join(p, ["query_id", "vec_id"], "full").select("query_id", "vec_id", "base_rank", "proj_rank", label.alias("label"))


def pending(experiments: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """Experiments without a result yet."""
    return experiments.join(done, list(key), "left_anti")


def shown(hits: DataFrame, n: int, last: bool = False) -> DataFrame:
    """Of each query's hits the first ``n`` ranks, or the ``last`` n of them."""
    if not last:
        return hits.filter(F.col("rank") <= n)
    deep = hits.groupBy("query_id").agg(F.max("rank").alias("_deep"))
    return hits.join(deep, "query_id").filter(F.col("rank") > F.col("_deep") - n).drop("_deep")
