"""Analytics of loss histories in long form: ``series, i, value`` (and ``epoch``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecquarry.operators.splits import global_rank

#: Rows of a series that one task works on.
BLOCK = 100_000


def blocks(df: DataFrame, before: int, after: int, size: int = BLOCK) -> DataFrame:
    """``df`` with the place ``r`` of a row in its series, its length ``n``, and ``block``; each block also has the ``before`` rows
    ahead of it and the ``after`` behind it, not ``own``. Windows by series and block see what windows by series would,
    however long a series is."""
    ranked = global_rank(df.withColumn("_tie", F.xxhash64(*df.columns)), "series", "i", "_tie").drop("_tie")
    ends = ranked.groupBy("series").agg(F.min("rank").alias("low"), F.count("*").alias("n"))
    r = ranked.join(ends, "series").withColumn("r", F.col("rank") - F.col("low") + 1).drop("rank", "low")
    first, last = (F.floor((F.greatest(F.lit(1), F.least("n", F.col("r") + d)) - 1) / size) for d in (-after, before))
    return r.withColumn("block", F.explode(F.sequence(first, last))).withColumn("own", F.floor((F.col("r") - 1) / size) == F.col("block"))


_W = ("series", "block")


def stats(df: DataFrame, last: int = 100) -> DataFrame:
    """Initial, final, extremes, mean, deviation, improvement, and the mean step over the last values (0 if too few)."""
    s = blocks(df, 1, 0).withColumn("step", F.col("value") - F.lag("value").over(Window.partitionBy(*_W).orderBy("r")))
    s = s.filter("own").withColumn("back", F.col("n") - F.col("r") + 1)
    per = s.groupBy("series").agg(
        F.count("*").alias("n"), F.min_by("value", "i").alias("initial"), F.max_by("value", "i").alias("final"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.avg(F.when(F.col("back") < last, F.col("step"))).alias("rate"),
    )
    gain = F.col("initial") - F.col("final")
    return per.select(
        "series", "n", *(F.round(c, 6).alias(n) for c, n in (("initial", "initial"), ("final", "final"), ("lo", "min"), ("hi", "max"), ("mean", "mean"), ("std", "std"))),
        F.round(gain, 6).alias("improvement"), F.round(F.when(F.col("initial") != 0, 100 * gain / F.col("initial")).otherwise(0.0), 6).alias("improvement_pct"),
        F.round(F.when(F.col("n") >= last, F.col("rate")).otherwise(0.0), 9).alias("convergence_rate"),
    )


def trend(stats_df: DataFrame, band: float = 1e-3) -> DataFrame:
    d = F.col("improvement")
    return stats_df.select("series", F.when(d > band, "decreasing").when(F.abs(d) <= band, "stable").otherwise("increasing").alias("trend"))


def iterations_to_share(df: DataFrame, share: float = 0.9) -> DataFrame:
    """The first i at which ``share`` of the improvement is reached."""
    ends = df.groupBy("series").agg(F.min_by("value", "i").alias("a"), F.max_by("value", "i").alias("b"))
    return df.join(ends, "series").filter(F.col("value") <= F.col("a") - share * (F.col("a") - F.col("b"))).groupBy("series").agg(F.min("i").alias("first_i"))


def epoch_means(df: DataFrame) -> DataFrame:
    per = df.groupBy("series", "epoch").agg(F.avg("value").alias("m"))
    best = F.row_number().over(Window.partitionBy("series").orderBy(F.round("m", 9), "epoch")) == 1
    return per.select("series", "epoch", F.round("m", 9).alias("mean_value"), best.alias("best"))


def moving_average(df: DataFrame, window: int = 50) -> DataFrame:
    """Centred box average; beyond the ends the nearest value counts; shorter series stay as they are."""
    lo, hi = window // 2, window - window // 2 - 1
    rows = blocks(df, lo, hi).join(df.groupBy("series").agg(F.min_by("value", "i").alias("first"), F.max_by("value", "i").alias("last")), "series")
    box = Window.partitionBy(*_W).orderBy("r").rowsBetween(-lo, hi)
    n, r = F.col("n"), F.col("r")
    before, after = F.greatest(F.lit(0), F.lit(lo + 1) - r), F.greatest(F.lit(0), r + hi - n)
    value = (F.sum("value").over(box) + before * F.col("first") + after * F.col("last")) / window
    smooth = rows.withColumn("smoothed", F.round(F.when(n < window, F.col("value")).otherwise(value), 6))
    return smooth.filter("own").select("series", "i", "smoothed")


def improvements(df: DataFrame) -> DataFrame:
    """Improvement since the first value, and over the value before."""
    rows = blocks(df, 1, 0).join(df.groupBy("series").agg(F.min_by("value", "i").alias("first")), "series")
    before = F.lag("value").over(Window.partitionBy(*_W).orderBy("r"))
    return rows.select("series", "i", F.round(F.col("first") - F.col("value"), 6).alias("cumulative"), F.round(before - F.col("value"), 6).alias("step"), "own").filter("own").drop("own")


def enabled(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Series whose weight isn't 0; series without a weight stay."""
    return df.join(weights.filter("weight = 0").select("series"), "series", "left_anti")
