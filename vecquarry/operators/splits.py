"""Building and checking splits, captions and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecquarry.session import cut


def hash_order(key: Column, seed: int = 0) -> Column:
    """A pseudo-random order that any engine with md5 reproduces."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def global_rank(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``rank``, from 1 in the order of columns that no two rows share: a range-partitioned sort and the sizes of
    the partitions before. No task holds more than its range."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n")).collect()  # one row for each partition
    before, rows = 0, []
    for r in sorted(sizes, key=lambda r: r["_part"]):
        rows.append((r["_part"], before))
        before += r.n
    offsets = df.sparkSession.createDataFrame(rows, "_part bigint, _before bigint")
    ranked = placed.join(F.broadcast(offsets), "_part")
    return ranked.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")


def permutation_split(df: DataFrame, key: str, up_to: int, n_queries: int, seed: int = 0) -> DataFrame:
    """``<key>, split``: the first ``up_to`` of the permutation are train and the next ``n_queries`` val; where rows are
    short, train gives way; other rows are left out."""
    n = df.count()
    up_to = min(up_to, max(0, n - n_queries))
    ranked = global_rank(df.select(key, hash_order(F.col(key), seed).alias("h")), "h", key)
    return ranked.filter(F.col("rank") <= up_to + n_queries).select(key, F.when(F.col("rank") <= up_to, "train").otherwise("val").alias("split"))


def four_way(captions: DataFrame, held_out: DataFrame, group: str, key: str, caption: str, n_val: int = 10_000, n_test: int = 10_000, n_inbound: int = 10_000, seed: int = 0) -> DataFrame:
    """``split, <group>, <key>, caption, pair``: train, val, test and inbound of rows ``group (image), key, caption``.

    train: one caption of each image; val: for up to ``n_val`` of these images another caption than the one in train (that one
    where there is no other), paired with the train image; test and inbound: one caption of each of up to so many images of
    ``held_out``, test paired with its own image, inbound asked against the images of train and without a pair.
    Raises if an image is on both sides.
    """
    if captions.select(group).join(held_out.select(group), group, "left_semi").limit(1).count():
        raise ValueError("held-out images also stand in train")
    train = one_caption(captions, group, key, caption, seed)
    other = captions.filter(usable(F.col(caption))).join(train.select(group, F.col(caption).alias("_own")), group).filter(F.col(caption) != F.col("_own"))
    other = one_caption(other, group, key, caption, seed + 1)

    def some(df: DataFrame, n: int, s: int) -> DataFrame:
        return df.orderBy(hash_order(F.col(group), s), group).limit(n)

    picked = some(train, n_val, seed + 2)
    val = picked.join(other.select(group, F.col(key).alias("_k"), F.col(caption).alias("_c")), group, "left").select(group, F.coalesce("_k", key).alias(key), F.coalesce("_c", caption).alias(caption))
    out = one_caption(held_out, group, key, caption, seed)
    parts = (("train", train, True), ("val", val, True), ("test", some(out, n_test, seed + 3), True), ("inbound", some(out, n_inbound, seed + 4), False))
    rows = None
    for name, df, paired in parts:
        pair = F.col(group) if paired else F.lit(None).cast(df.schema[group].dataType)
        part = df.select(F.lit(name).alias("split"), group, key, F.col(caption).alias("caption"), pair.alias("pair"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, in hash order of the key."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def usable(text: Column) -> Column:
    return text.isNotNull() & (F.length(F.trim(text)) > 0)


def explode_captions(images: DataFrame, captions: str = "captions") -> DataFrame:
    """One row for each caption of an image, with its place."""
    other = [c for c in images.columns if c != captions]
    return images.select(*other, F.posexplode(captions).alias("place", "caption"))


def one_caption(df: DataFrame, group: str, key: str, caption: str, seed: int = 0) -> DataFrame:
    """One caption of each image, the first in hash order of the row."""
    w = Window.partitionBy(group).orderBy(hash_order(F.col(key), seed), key)
    return df.filter(usable(F.col(caption))).withColumn("r", F.row_number().over(w)).filter("r = 1").select(group, key, caption)


def alternative_caption(df: DataFrame, group: str, key: str, caption: str, seed: int = 0) -> DataFrame:
    """For each image a caption other than the one of ``one_caption``, or that one where there is no other."""
    first = one_caption(df, group, key, caption, seed).select(group, F.col(caption).alias("train_caption"))
    other = df.filter(usable(F.col(caption))).join(first, group).filter(F.col(caption) != F.col("train_caption"))
    other = one_caption(other, group, key, caption, seed + 1).select(group, F.col(caption).alias("other"))
    return first.join(other, group, "left").select(group, "train_caption", F.coalesce("other", "train_caption").alias("alt_caption"))


def leakage(df: DataFrame, name: str, split: str = "split", train: str = "train") -> DataFrame:
    """For each other split: how many names of it also stand in train."""
    named = df.filter(F.col(name).isNotNull()).select(name, split).distinct()
    t = named.filter(F.col(split) == train).select(name, F.lit(1).alias("leaks"))
    return named.filter(F.col(split) != train).join(t, name, "left").groupBy(split).agg(F.count("*").alias("n_names"), F.count("leaks").alias("n_leaking"))


def split_info(df: DataFrame, *vectors: str) -> DataFrame:
    """Rows and, for each vector column, present vectors and largest dimension of each split."""
    aggs = [F.count("*").alias("n_rows")]
    for v in vectors:
        aggs += [F.count(v).alias(f"n_{v}"), F.max(F.size(F.when(F.col(v).isNotNull(), F.col(v)))).alias(f"dim_{v}")]
    return df.groupBy("split").agg(*aggs)


def knn_violations(cache: DataFrame, k: int) -> DataFrame:
    """Counts of broken neighbour lists of each split: null, short, padded, repeated, or pointing at no train image."""
    bank = cache.filter("split = 'train' and image_features is not null").select(F.col("row_id").alias("nn"), F.lit(1).alias("there"))
    ids = F.col("knn_indices")
    per = cache.select("split", "row_id", ids.isNull().alias("missing"), (F.size(ids) < k).alias("short"), F.exists(ids, lambda x: x < 0).alias("padded"), (F.size(F.array_distinct(ids)) < F.size(ids)).alias("repeated"))
    wrong = cache.select("row_id", F.explode(F.array_distinct("knn_indices")).alias("nn")).filter("nn >= 0").join(bank, "nn", "left").filter("there is null").select("row_id").distinct().withColumn("dangling", F.lit(True))
    j = per.join(wrong, "row_id", "left")
    return j.groupBy("split").agg(F.count("*").alias("n_rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"n_{c}") for c in ("missing", "short", "padded", "repeated", "dangling")))


def verify_by_uid(stored: DataFrame, source: DataFrame, uid: str, text: str, vec: str, key: str, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Stored rows against the last source row of their uid: ``uid, same_text, same_vector`` (null uid never matches)."""
    w = Window.partitionBy(uid).orderBy(F.desc(key))
    last = source.withColumn("r", F.row_number().over(w)).filter("r = 1").select(F.col(uid).alias("u"), F.col(text).alias("t"), F.col(vec).alias("v"))
    close = F.forall(F.zip_with(F.col(vec).cast("array<double>"), F.col("v").cast("array<double>"), lambda a, b: ~F.isnan(a - b) & (F.abs(a - b) <= atol + rtol * F.abs(b))), lambda x: F.coalesce(x, F.lit(False)))
    same = F.coalesce(F.size(vec) == F.size("v"), F.lit(False)) & F.coalesce(close, F.lit(False))
    return stored.join(last, F.col(uid) == F.col("u")).select(key, uid, F.col(text).eqNullSafe(F.col("t")).alias("same_text"), same.alias("same_vector"))


def union_banks(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Both banks under new ids: the second's follow the first's largest."""
    top = a.agg(F.coalesce(F.max(key), F.lit(-1)).alias("top"))
    low = b.agg(F.coalesce(F.min(key), F.lit(0)).alias("low"))
    moved = b.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(low)).withColumn(key, F.col(key) - F.col("low") + F.col("top") + 1).drop("top", "low")
    return a.unionByName(moved.select(*a.columns))
