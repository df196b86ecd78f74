"""Running top-k over a stream of new bank vectors: each micro-batch is searched and merged into the stored lists."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vecquarry.operators.knn import exact_topk, top_k


def merged(old: DataFrame | None, new: DataFrame, k: int) -> DataFrame:
    """The k best of both lists; a vector that stands in both counts once."""
    columns = ["query_id", "vec_id", "score"]
    both = new.select(columns) if old is None else old.select(columns).unionByName(new.select(columns))
    return top_k(both.distinct(), k).select("query_id", "rank", "vec_id", "score")


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The lists of the last finished batch, or of the last one before a number."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return None
    done = [s.getPath().getName() for s in fs.listStatus(fs_path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    batches = sorted(int(n.removeprefix("batch=")) for n in done if n.startswith("batch="))
    batches = [b for b in batches if before is None or b < before]
    return spark.read.parquet(os.path.join(path, f"batch={batches[-1]}")) if batches else None


def start(stream: DataFrame, queries: DataFrame, k: int, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """``stream``: vec_id, e. Each batch writes a folder of its own, so a batch that is run again gives the same lists."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hits = exact_topk(queries, batch, k)
        merged(current(spark, path, number), hits, k).write.mode("overwrite").parquet(os.path.join(path, f"batch={number}"))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
