"""NumPy shards and archives: one task for each file, read through the cluster's file system as binary files."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTORS = T.StructType([T.StructField("stem", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType()))])


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def read_arrays(spark: SparkSession, pattern: str, member: str | None = None) -> DataFrame:
    """``stem, pos, vec`` of two-dimensional ``.npy`` files, or of one array of ``.npz`` archives (``member``, else
    ``queries``, else the first)."""

    def run(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if isinstance(a, np.lib.npyio.NpzFile):
                    name = member or ("queries" if "queries" in a.files else a.files[0])
                    a = a[name]
                if a.ndim != 2:
                    raise ValueError(f"{path} isn't two-dimensional")
                for s in range(0, len(a), 10_000):
                    part = a[s : s + 10_000].astype(np.float32)
                    yield pd.DataFrame({"stem": _stem(path), "pos": np.arange(s, s + len(part)), "vec": list(part)})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, VECTORS)


def with_ids(vectors: DataFrame) -> DataFrame:
    """A running ``id`` over the files in order of their names: offsets from the counts of the files."""
    sizes = vectors.groupBy("stem").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.length("stem"), "stem").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("stem", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))
    return vectors.join(F.broadcast(offsets), "stem").select((F.col("offset") + F.col("pos")).alias("id"), "stem", "pos", "vec")


def paired(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """Rows of both sides with the same ``stem, pos``; an error if a file has different numbers of rows on both sides.
    Files that only one side has are skipped."""
    n = left.groupBy("stem").agg(F.count("*").alias("a")).join(right.groupBy("stem").agg(F.count("*").alias("b")), "stem").filter("a != b")
    bad = n.limit(5).collect()
    if bad:
        raise ValueError("different numbers of rows: " + ", ".join(f"{r.stem} ({r.a}, {r.b})" for r in bad))
    return left.join(right.select("stem", "pos", *columns), ["stem", "pos"])


def positional_parquet(spark: SparkSession, pattern: str, *columns: str) -> DataFrame:
    """``stem, pos`` and columns of Parquet files, with each row's place in its file."""
    df = spark.read.parquet(pattern).select(*columns, F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("pos"))
    return df.withColumn("stem", F.regexp_replace("f", r"\.[^.]*$", "")).drop("f")
