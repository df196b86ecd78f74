"""Retrieval caches: a folder of Parquet tables partitioned by split, and the readers of the supported data sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecquarry.functions.vec import l2_normalize


@dataclass(frozen=True)
class Reader:
    """``own_bank``: each split searches its own images, not those of train; ``normalize``: vectors are normalised on read."""

    splits: tuple[str, ...]
    own_bank: bool = False
    normalize: bool = True

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        df = spark.read.parquet(path)
        missing = {"row_id", "split", "image_features", "text_features", "knn_indices"} - set(df.columns)
        if missing:
            raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
        there = {r.split for r in df.select("split").distinct().collect()}
        if not set(self.splits) <= there:
            raise ValueError(f"{path} lacks splits {', '.join(sorted(set(self.splits) - there))}")
        return df

    def _vec(self, name: str):
        return l2_normalize(F.col(name)) if self.normalize else F.col(name).cast("array<double>")

    def bank(self, df: DataFrame, split: str = "train") -> DataFrame:
        of = split if self.own_bank else "train"
        return df.filter(F.col("split") == of).filter("image_features is not null").select(F.col("row_id").alias("vec_id"), self._vec("image_features").alias("e"))

    def queries(self, df: DataFrame, split: str) -> DataFrame:
        return df.filter(F.col("split") == split).filter("text_features is not null").select(F.col("row_id").alias("query_id"), self._vec("text_features").alias("e"))

    def exact(self, df: DataFrame, split: str) -> DataFrame:
        """Stored neighbours in long form: ``query_id, rank, vec_id``."""
        rows = df.filter(F.col("split") == split).select(F.col("row_id").alias("query_id"), F.posexplode("knn_indices").alias("p", "vec_id"))
        return rows.filter("vec_id >= 0").select("query_id", (F.col("p") + 1).alias("rank"), "vec_id")

    def pairs(self, df: DataFrame, split: str) -> DataFrame:
        """``query_id, gt_vec_id``; without a pair column each text belongs to the image of its row."""
        gt = F.nullif(F.col("text_to_image"), F.lit(-1)) if "text_to_image" in df.columns else F.col("row_id")
        return df.filter(F.col("split") == split).select(F.col("row_id").alias("query_id"), gt.alias("gt_vec_id"))


READERS = {
    "laion": Reader(("train",)),
    "datacomp": Reader(("train",)),
    "t2i": Reader(("train",)),
    "coco": Reader(("train", "val"), own_bank=True),
    "flickr30k": Reader(("train", "val", "test", "inbound"), own_bank=True, normalize=False),
}


def reader(name: str) -> Reader:
    if name not in READERS:
        raise ValueError(f"unknown data set {name!r}; known: {', '.join(sorted(READERS))}")
    return READERS[name]


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy("split").parquet(path)


RANKING = ("split", "text_id", "text_features", "text_to_image", "knn_indices", "knn_distances")


def write_ranking(images: DataFrame, texts: DataFrame, hits: DataFrame, path: str, info: dict | None = None) -> None:
    """A ranking cache: ``images`` (split, image_id, image_features, image_filename, image_path) are the banks, ``texts`` (split, text_id, text_features, text_to_image, -1 without a
    pair) the queries with their neighbour lists and scores from ``hits`` (query_id, rank, vec_id, score), and ``metadata`` the sizes
    and ``info``. Three tables below ``path``."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score")))
    lists = hits.groupBy(F.col("query_id").alias("text_id")).agg(rows.alias("l"))
    out = texts.join(lists, "text_id", "left").withColumn("knn_indices", F.transform("l", lambda x: x["vec_id"])).withColumn("knn_distances", F.transform("l", lambda x: x["score"].cast("float")))
    images.write.mode("overwrite").partitionBy("split").parquet(f"{path}/images")
    out.withColumn("text_to_image", F.coalesce("text_to_image", F.lit(-1).cast("bigint"))).select(*RANKING).write.mode("overwrite").partitionBy("split").parquet(f"{path}/texts")
    meta = texts.groupBy("split").agg(F.count("*").alias("size"), F.max(F.size("text_features")).alias("embedding_dim"))
    notes = F.create_map(*[F.lit(str(x)) for kv in (info or {}).items() for x in kv]) if info else F.lit(None).cast("map<string,string>")
    meta.withColumn("info", notes).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def read_ranking(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Banks, queries with their lists, and sizes."""
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("images", "texts", "metadata"))


def existing(df: DataFrame, flag: str = "image_exists") -> DataFrame:
    """Only rows whose image exists; a null flag counts as missing."""
    return df.filter(F.coalesce(F.col(flag), F.lit(False)))
