"""Result sinks: retrieval lists, evaluation summaries and timing logs as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecquarry.operators.metrics import qps_stats, recall_summary


def retrieval(hits: DataFrame, *columns: str) -> DataFrame:
    """One row for each query: ``query_id, results`` with rank, score and the given columns, best first."""
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", *columns))).alias("results"))


def write_retrieval(hits: DataFrame, path: str, *columns: str) -> None:
    retrieval(hits, *columns).write.mode("overwrite").json(path)


def evaluation(results: DataFrame, config: dict, info: dict) -> DataFrame:
    """One JSON document: results, configuration, data set and a summary of recall for each variant and k."""
    rows = F.array_sort(F.collect_list(F.struct("dataset", "backend", "variant", "budget", "at_k", "recall", "qps")))
    ok = results.filter(F.col("recall").isNotNull() & ~F.isnan("recall"))
    per = ok.groupBy("variant", "at_k").agg(F.round(F.avg("recall"), 9).alias("avg"), F.max("recall").alias("max"), F.min("recall").alias("min"))
    summary = per.agg(F.array_sort(F.collect_list(F.struct("variant", "at_k", "avg", "max", "min"))).alias("summary"))
    maps = [F.create_map(*[F.lit(str(x)) for kv in d.items() for x in kv]).alias(n) if d else F.lit(None).cast("map<string,string>").alias(n) for n, d in (("config", config), ("info", info))]
    doc = results.agg(rows.alias("results")).crossJoin(summary).select("results", "summary", *maps)
    return doc.select(F.to_json(F.struct("*")).alias("document"))


def write_qps(results: DataFrame, path: str) -> None:
    """One line for each variant and budget: its recall, and mean, median, deviation and extremes of its speed."""
    per = results.groupBy("variant", "budget").agg(F.round(F.avg("recall"), 9).alias("recall"))
    qps_stats(results, "variant", "budget").join(per, ["variant", "budget"]).write.mode("overwrite").json(path)


def write_shootout(results: DataFrame, path: str, selection: DataFrame | None = None) -> None:
    """One line for each backend, variant and k with average and extreme recall; with ``selection`` (``backend, mode, chosen``) also which
    checkpoint each mode chose for the backend."""
    per = recall_summary(results, "backend", "variant", "at_k")
    if selection is not None:
        per = per.join(selection.groupBy("backend").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "chosen")))).alias("selected")), "backend", "left")
    per.write.mode("overwrite").json(path)


def append_timing(spark: SparkSession, path: str, event: str, seconds: float, **extra) -> None:
    """Append one ``event, duration_sec, ts, extra`` line."""
    row = spark.createDataFrame([(event, float(seconds), {k: str(v) for k, v in extra.items()})], "event string, duration_sec double, extra map<string,string>")
    row.withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").json(path)


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("event string, duration_sec double, ts timestamp, extra map<string,string>").json(path)


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """A loss history document in long form: ``series, i, epoch, value``."""
    doc = spark.read.schema("iterations array<bigint>, epochs array<bigint>, losses map<string,array<double>>").json(path, multiLine=True)
    one = doc.select("iterations", "epochs", F.explode("losses").alias("series", "values"))
    x = F.arrays_zip("iterations", "epochs", "values")
    return one.select("series", F.explode(x).alias("x")).select("series", F.col("x.iterations").alias("i"), F.col("x.epochs").alias("epoch"), F.col("x.values").alias("value"))
