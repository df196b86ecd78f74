"""Caption annotations in JSON and images in tar shards."""

from __future__ import annotations

import io
import json
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.functions.text import image_path

COCO = "images array<struct<id:bigint,file_name:string>>, annotations array<struct<id:bigint,image_id:bigint,caption:string>>"
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")


def read_coco(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """``image_id, file_name, captions`` of images that have captions and, with ``files`` (file_name), an existing file."""
    doc = spark.read.schema(COCO).json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.col("i.file_name").alias("file_name"))
    notes = doc.select(F.explode("annotations").alias("a")).select("a.image_id", "a.id", "a.caption").filter("caption is not null")
    captions = notes.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "caption"))), lambda x: x["caption"]).alias("captions"))
    out = images.join(captions, "image_id")
    return out.join(files.select("file_name").distinct(), "file_name", "left_semi") if files is not None else out


def with_image_paths(df: DataFrame, listing: DataFrame, uid: str = "uid") -> DataFrame:
    """``image_path`` and ``image_exists`` from a table of file names; the first extension in order of preference wins."""
    names = listing.select("file_name", F.regexp_replace("file_name", r"\.[^.]*$", "").alias("u"))
    per = names.groupBy("u").agg(F.collect_set("file_name").alias("names"))
    j = df.join(per, F.col(uid) == F.col("u"), "left")
    none = F.array().cast("array<string>")
    return j.select(*df.columns, image_path(F.col(uid), F.coalesce("names", none)).alias("image_path"), F.col("names").isNotNull().alias("image_exists"))


MEMBER = T.StructType([
    T.StructField("shard", T.StringType()), T.StructField("key", T.StringType()), T.StructField("uid", T.StringType()),
    T.StructField("ext", T.StringType()), T.StructField("image", T.BinaryType()), T.StructField("error", T.StringType()),
])


def read_tar(spark: SparkSession, pattern: str) -> DataFrame:
    """Each JSON member of tar shards with the image member of its base name (the first extension in order of
    preference); a broken member gives a row with ``error``. One task reads a shard as a stream."""

    def run(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows, shard = [], path.rsplit("/", 1)[-1]
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    by = {m.name: m for m in tar.getmembers() if m.isfile()}
                    for name, m in by.items():
                        if not name.endswith(".json"):
                            continue
                        base = name[: -len(".json")]
                        image = next((by[base + e] for e in EXTENSIONS if base + e in by), None)
                        try:
                            uid = json.load(tar.extractfile(m)).get("uid")
                            if image is None:
                                rows.append((shard, base, uid, None, None, "no image"))
                            else:
                                rows.append((shard, base, uid, "." + image.name.rsplit(".", 1)[1], tar.extractfile(image).read(), None))
                        except (ValueError, AttributeError, tarfile.TarError) as e:
                            rows.append((shard, base, None, None, None, str(e)[:200]))
                yield pd.DataFrame(rows, columns=MEMBER.names)

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, MEMBER)
