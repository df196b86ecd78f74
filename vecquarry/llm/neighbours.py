"""Most similar vectors for every vector (problem 5) by multiprobe p-stable hashing.

Identical vectors are searched once: hot ones are dropped before the shuffle and others where they meet in a group, and
only the smallest ids that a top-k could need are listed again at the end.

Defined results: rows without a key and invalid vectors (null, short, not finite, all zero) neither ask nor answer; equal cosines, rounded to
12 decimals, go to the smaller id; a row without a neighbour above the threshold gives no row; an empty table gives
none. Candidate search is approximate: the tests measure its recall against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecquarry.llm.vechash import Hashing, exact_cosines, mean_direction, nearest, valid
from vecquarry.session import cut

II, TI = 0, 1


def members(df: DataFrame, key: str, vec: str, *by: str) -> DataFrame:
    """``member, id``: every row with a valid vector, and the smallest id of the identical ones (of the same ``by``)."""
    rows = df.filter(valid(F.col(vec)) & F.col(key).isNotNull()).select(F.col(key).alias("member"), *by, F.xxhash64(vec).alias("h1"), F.hash(vec).alias("h2"))
    reps = rows.groupBy("h1", "h2", *by).agg(F.min("member").alias("id"))
    return rows.join(reps, ["h1", "h2", *by]).select("member", "id", *by)


def in_question(hits: DataFrame, few: DataFrame, k: int, least: dict[int, float]) -> DataFrame:
    """``kind, id, nn, cos, rows, open``: the hits that can be among the first k, with the rows of each, and whether only an
    exact cosine can tell (``open``).

    Sorted by cosine, hits whose bounds overlap form a block; their order matters only where the k-th row falls within
    the block. An image's own row takes a place of its own.
    """
    w = Window.partitionBy("kind", "id").orderBy(F.desc("cos"), "nn")
    lo, hi = F.col("cos") - F.col("err"), F.col("cos") + F.col("err")
    # One exchange: both the merging of tables and the windows follow the asking vector.
    h = hits.repartition("kind", "id").groupBy("kind", "id", "nn").agg(F.max("cos").alias("cos"), F.max("err").alias("err"))
    h = h.withColumn("r", F.row_number().over(w)).withColumn("floor", F.min(F.when(F.col("r") <= k + 1, lo)).over(Window.partitionBy("kind", "id")))
    h = h.filter((F.col("r") <= k + 1) | (hi >= F.col("floor"))).drop("r", "floor").join(few, "nn")
    size, before = F.size("rows"), w.rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("new", F.coalesce(hi < F.min(lo).over(before), F.lit(True)).cast("int")).withColumn("before", F.coalesce(F.sum(size).over(before), F.lit(0)))
    h = h.withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    block = Window.partitionBy("kind", "id", "block")
    places = F.when(F.col("kind") == II, k + 1).otherwise(k)
    h = h.withColumn("begin", F.min("before").over(block)).withColumn("end", F.max(F.col("before") + size).over(block)).withColumn("n", F.count("*").over(block))
    h = h.filter(F.col("begin") < places)
    bar = F.when(F.col("kind") == II, least[II]).otherwise(least[TI])
    parts = (F.col("n") > 1) & (F.col("end") > places)
    return h.select("kind", "id", "nn", "cos", "rows", (parts | (F.abs(F.col("cos") - bar) <= F.col("err"))).alias("open"))


def similar_vectors(df: DataFrame, key: str = "row_id", image: str = "image_features", text: str = "text_features", k: int = 5,
                    least_ii: float = 0.90, least_ti: float = 0.705, hashing: Hashing | None = None) -> DataFrame:
    """``direction, <key>, nn_<key>, cos``: the k nearest images of each image and of each text vector. Which rows come out
    is decided by exact cosines; ``cos`` itself may be off by 0.0002 where its place isn't in doubt."""
    df = df.filter(F.col(key).isNotNull())
    images, texts = (df.filter(valid(F.col(c))).select(F.col(key).alias("id"), F.col(c).alias("vec")) for c in (image, text))
    img_members, txt_members = members(df, key, image), members(df, key, text)
    hashing = hashing or Hashing.planned(images.count())
    flag = F.lit(True)
    asked = images.select(F.lit(II).alias("kind"), "id", flag.alias("stored"), flag.alias("asks"), "vec").unionByName(
        texts.select(F.lit(TI).alias("kind"), "id", F.lit(False).alias("stored"), flag.alias("asks"), "vec")
    )
    # Text vectors lie off the images by a common offset; without it they lie next to their images.
    centre = mean_direction(texts)
    least = {II: least_ii, TI: least_ti}
    hits = nearest(asked, hashing, least, k + 1, {TI: centre}, mutual=True)
    # Of identical images only the k + 1 smallest ids can be in a top k.
    few = img_members.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("member"))).filter(F.col("r") <= k + 1)
    few = few.groupBy(F.col("id").alias("nn")).agg(F.array_sort(F.collect_list("member")).alias("rows"))
    placed = cut(in_question(hits, few, k, least))
    both = images.withColumn("kind", F.lit(II)).unionByName(texts.withColumn("kind", F.lit(TI)))
    open_ = exact_cosines(placed.filter("open").drop("open"), both, images, "kind", "id")
    open_ = open_.filter(F.col("cos") >= F.when(F.col("kind") == II, least_ii).otherwise(least_ti))
    # In a block that isn't in question any order gives the same rows.
    best = placed.filter("not open").select("kind", "id", "nn", F.col("cos").cast("double"), "rows").unionByName(open_.select("kind", "id", "nn", "cos", "rows"))
    listed = best.select("kind", "id", "cos", F.explode("rows").alias("nn_row"))
    listed = listed.withColumn("r", F.row_number().over(Window.partitionBy("kind", "id").orderBy(F.desc("cos"), "nn_row"))).filter(F.col("r") <= k + 1)
    asking = img_members.select(F.lit(II).alias("kind"), "id", "member").unionByName(txt_members.select(F.lit(TI).alias("kind"), "id", "member"))
    lists = listed.groupBy("kind", "id").agg(F.array_sort(F.collect_list(F.struct("r", "nn_row", "cos"))).alias("l"))
    out = asking.join(lists, ["kind", "id"])
    others = F.when(F.col("kind") == II, F.filter("l", lambda x: x["nn_row"] != F.col("member"))).otherwise(F.col("l"))
    out = out.select("kind", "member", F.explode(F.slice(others, 1, k)).alias("x"))
    return out.select(F.when(F.col("kind") == II, "ii").otherwise("ti").alias("direction"), F.col("member").alias(key), F.col("x.nn_row").alias(f"nn_{key}"), F.col("x.cos").alias("cos"))
