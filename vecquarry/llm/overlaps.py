"""Same or near-same records across splits (problem 6) by content-defined chunks.

Each distinct normalised text is cut where a rolling hash over its last ``window`` words says so, so an edit disturbs only
the chunks around it: at most ``window + 1`` of them. Chunk digests are joined across the splits, and the lengths of
the shared ones are summed: each record has an overlap fraction, and a record that misses more chunks than the edits
allowed can disturb has no near partner and leaves the search. For the rest two near-same texts must share two of the
``(window + 1) * edits + 2`` chunks that are rarest over the whole collection: pairs of those are the key of the pair join, and
common chunks cost nothing. Texts with too few chunks for that are cut at every word, where one edit changes one chunk.
An exact word edit distance verifies the pairs. Images enter with the hash
codes of ``vechash`` in the place of chunk digests and are verified by their exact cosine.

Defined results: null texts, invalid vectors and rows without a key or split never match; exact copies are matched as one normal form, so a group of
copies costs one row until its pairs are listed; a pair that matches in several ways comes out once; empty tables give
no rows; texts of any length are chunked whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.llm.copies import normal_forms
from vecquarry.llm.lookalike import text_id
from vecquarry.llm.neighbours import members
from vecquarry.llm.vechash import Hashing, exact_cosines, nearest, valid
from vecquarry.session import cut

CHUNK = T.StructType([
    T.StructField("nid", T.LongType()), T.StructField("sides", T.IntegerType()), T.StructField("fine", T.BooleanType()),
    T.StructField("digest", T.LongType()), T.StructField("n_words", T.IntegerType()),
])
#: Words that the rolling hash sees.
WINDOW = 2


def _word_hash(words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words.astype(object), categorize=True)


def cut_points(hashes: np.ndarray, window: int, every: int) -> np.ndarray:
    """Where a chunk ends: the rolling polynomial hash of the last ``window`` word hashes falls into one class."""
    with np.errstate(over="ignore"):
        roll = hashes.copy()
        for i in range(1, window):
            shifted = np.r_[np.zeros(i, np.uint64), hashes[:-i]] if len(hashes) > i else np.zeros(len(hashes), np.uint64)
            roll = roll * np.uint64(0x9E3779B97F4A7C15) + shifted
        mixed = (roll ^ (roll >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(33)) % np.uint64(every) == 0


def chunk_texts(texts: DataFrame, edits: int = 2, shared: int = 2, window: int = WINDOW, every: int = 2) -> DataFrame:
    """``nid, sides, seq`` (words joined by blanks) -> ``nid, sides, fine, digest, n_words``; a repeated chunk of a text has its
    own digest for each turn."""
    few = (window + 1) * edits + shared - 1

    def run(frames):
        for pdf in frames:
            if pdf.empty:
                continue
            words = [np.asarray(t.split(" "), object) for t in pdf["seq"]]
            sizes = np.array([len(w) for w in words])
            text = np.repeat(np.arange(len(pdf)), sizes)
            h = _word_hash(np.concatenate(words))
            first = np.r_[0, np.cumsum(sizes)[:-1]]
            end = np.zeros(len(h), bool)
            end[np.cumsum(sizes) - 1] = True
            for s, n in zip(first, sizes, strict=True):
                end[s : s + n] |= cut_points(h[s : s + n], window, every)
            coarse = np.bincount(text[end], minlength=len(pdf))
            for fine in (False, True):
                at = np.flatnonzero(end) if not fine else np.arange(len(h))
                start = np.r_[0, at[:-1] + 1]
                with np.errstate(over="ignore"):
                    place = np.arange(len(h)) - np.repeat(start, at - start + 1)
                    mult = np.power(np.uint64(6364136223846793005), (place + 1).astype(np.uint64))
                    digest = np.add.reduceat(h * mult + np.uint64(1442695040888963407), start)
                out = pd.DataFrame({"text": text[start], "digest": digest.astype(np.int64)})
                out["n_words"] = (at - start + 1).astype(np.int32)
                # An edit changes the number of chunks by at most ``window``, so a text's partner may have too few of them.
                out = out[coarse[out["text"]] <= few + window * edits] if fine else out[coarse[out["text"]] > few]
                turn = out.groupby(["text", "digest"]).cumcount().to_numpy()
                with np.errstate(over="ignore"):
                    out["digest"] = (out["digest"].to_numpy() ^ (turn * 0x5851F42D4C957F2D).astype(np.int64)) + (17 if fine else 0)
                yield pd.DataFrame({"nid": pdf["nid"].to_numpy()[out["text"]], "sides": pdf["sides"].to_numpy()[out["text"]], "fine": fine, "digest": out["digest"].to_numpy(), "n_words": out["n_words"].to_numpy()})

    return texts.select("nid", "sides", "seq").mapInPandas(run, CHUNK)


def word_distance(a: list, b: list, most: int) -> int:
    """Words to insert, delete or replace; ``most + 1`` if more than that."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b or min(len(a), len(b)) == 0:
        return min(max(len(a), len(b)), most + 1)
    row = list(range(len(b) + 1))
    for x, wa in enumerate(a, 1):
        prev, row[0] = row[0], x
        lo, hi = max(1, x - most), min(len(b), x + most)
        if lo > 1:
            prev, row[lo - 1] = row[lo - 1], most + 1
        for y in range(lo, hi + 1):
            prev, row[y] = row[y], min(row[y] + 1 if y < x + most else most + 1, row[y - 1] + 1, prev + (wa != b[y - 1]))
        if min(row[lo - 1 : hi + 1]) > most:
            return most + 1
    return min(row[len(b)], most + 1)


def digests(texts: DataFrame, edits: int = 2, shared: int = 2) -> DataFrame:
    """``nid, sides, fine, overlap, lost, l``: for each text and way of cutting the share of its words in chunks that the
    other side of the split has too, the number of its other chunks, and its chunks as ``(freq, digest)``, rarest first."""
    chunks = chunk_texts(texts, edits, shared)
    # Rarity over the whole collection; a chunk is shared where both sides have it.
    counts = chunks.groupBy("digest").agg(F.count("*").alias("freq"), (F.bit_or("sides") == 3).alias("shared"))
    n = F.when(F.col("shared"), F.col("n_words")).otherwise(0)
    return chunks.join(counts, "digest").groupBy("nid", "sides", "fine").agg(
        F.round(F.sum(n) / F.sum("n_words"), 6).alias("overlap"), F.count_if(~F.col("shared")).alias("lost"), F.array_sort(F.collect_list(F.struct("freq", "digest"))).alias("l")
    )


def near_texts(texts: DataFrame, edits: int = 2, shared: int = 2, window: int = WINDOW) -> DataFrame:
    """``nid, sides, seq`` of distinct normal forms -> ``nid_a, nid_b, distance``.

    ``sides`` is 1 for train, 2 for evaluation, 3 for both; a is in train and b in evaluation. Two near texts differ in at
    most ``(window + 1) * edits`` chunks (``edits`` where every word is one), so of the rarest ``... + shared`` they have ``shared``
    in common: the join key is a pair of those.
    """
    disturbed = F.when(F.col("fine"), edits).otherwise((window + 1) * edits)
    listed = digests(texts, edits, shared).filter(F.col("lost") <= disturbed)
    rare = F.transform(F.filter(F.slice("l", 1, disturbed + shared), lambda x: x["freq"] > 1), lambda x: x["digest"])
    listed = listed.select("nid", "sides", F.array_sort(rare).alias("l"))
    keys = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, (window + 1) * edits + shared), lambda y: F.xxhash64(x, y))))
    listed = listed.select("nid", "sides", F.explode(keys).alias("key"))
    a = listed.filter("sides in (1, 3)").select(F.col("nid").alias("nid_a"), "key")
    b = listed.filter("sides in (2, 3)").select(F.col("nid").alias("nid_b"), "key")
    pairs = a.join(b, "key").filter("nid_a != nid_b").select("nid_a", "nid_b").distinct()
    w = texts.select("nid", "seq")
    pairs = pairs.join(w.select(F.col("nid").alias("nid_a"), F.col("seq").alias("w_a")), "nid_a").join(w.select(F.col("nid").alias("nid_b"), F.col("seq").alias("w_b")), "nid_b")

    @F.pandas_udf(T.IntegerType())
    def verify(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([word_distance(p.split(" "), q.split(" "), edits) for p, q in zip(x, y, strict=True)], dtype="int32")

    return pairs.withColumn("distance", verify("w_a", "w_b")).select("nid_a", "nid_b", "distance").filter(F.col("distance") <= edits)


def text_classes(df: DataFrame, key: str, text: str, split: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """``row, side, nid, tid`` of the rows, with their class of copies and of running texts of the same words, and ``nid, sides,
    seq`` of the latter.

    A list of named fields has no ``tid``; a running text of the same words is a copy of it, but meets others. Texts are
    keyed once and travel as hashes from there on.
    """
    side = F.when(F.col(split) == "train", 1).when(F.col(split).isin("val", "test"), 2)
    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("row"), side.alias("side"), F.col(text).alias("t")).filter("side is not null")
    forms = cut(normal_forms(rows, "t", seq=True).filter(F.col("n_words") >= min_words))
    rows = rows.select("row", "side", *(c.alias(n) for c, n in zip(text_id(F.col("t")), ("h1", "h2"), strict=True))).join(forms.select("h1", "h2", "k1", "k2", "s1", "s2", "listed"), ["h1", "h2"])
    # A class is named by its smallest row, and a class of running texts by its own smallest.
    own = F.when(~F.col("listed"), F.col("row"))
    texts = rows.groupBy("k1", "k2", "s1", "s2").agg(F.min("row").alias("first"), F.min(own).alias("tid"), F.bit_or(F.when(~F.col("listed"), F.col("side"))).alias("sides"))
    classes = texts.groupBy("k1", "k2").agg(F.min("first").alias("nid"))
    texts = cut(texts.join(classes, ["k1", "k2"]).select("s1", "s2", "nid", "tid", "sides"))
    rows = cut(rows.join(texts.select("s1", "s2", "nid", "tid"), ["s1", "s2"]).select("row", "side", "nid", F.when(~F.col("listed"), F.col("tid")).alias("tid")))
    seqs = forms.filter("not listed").groupBy("s1", "s2").agg(F.first("seq").alias("seq"))
    return rows, cut(texts.filter("tid is not null").join(seqs, ["s1", "s2"]).select(F.col("tid").alias("nid"), F.col("sides").cast("int").alias("sides"), "seq"))


def _pairs(rows: DataFrame, a: str = "nid_a", b: str = "nid_b", links: DataFrame | None = None) -> DataFrame:
    """Row pairs over the splits: within one class, or over linked classes (a in train, b in evaluation)."""
    t = rows.filter("side = 1").select(F.col("row").alias("row_t"), F.col("nid").alias(a))
    e = rows.filter("side = 2").select(F.col("row").alias("row_e"), F.col("nid").alias(b if links is not None else a))
    both = t.join(links, a).join(e, b) if links is not None else t.join(e, a)
    return both.select(F.least("row_t", "row_e").alias("row_a"), F.greatest("row_t", "row_e").alias("row_b"))


def cross_split_pairs(df: DataFrame, key: str = "row_id", text: str = "text", vec: str = "b32_img", split: str = "split",
                      min_words: int = 6, edits: int = 2, least: float = 0.998) -> DataFrame:
    """``<key>_a, <key>_b, way`` of every row pair over the train and an evaluation split (way: copy, near, image)."""
    df = df.filter(F.col(key).isNotNull())
    rows, classes = text_classes(df, key, text, split, min_words)
    copies = _pairs(rows).withColumn("way", F.lit("copy"))
    near = near_texts(classes, edits).select("nid_a", "nid_b")
    near = _pairs(rows.select("row", "side", F.col("tid").alias("nid")), links=near).withColumn("way", F.lit("near"))

    side = F.when(F.col(split) == "train", 1).when(F.col(split).isin("val", "test"), 2)
    sided = df.select(F.col(key), F.col(vec), side.alias("side")).filter("side is not null")
    m = members(sided, key, vec, "side")
    # Kind 0 stands for train and 1 for evaluation, so a vector of both sides is found on both.
    asked = sided.filter(valid(F.col(vec))).select((F.col("side") - 1).alias("kind"), F.col(key).alias("id"), (F.col("side") == 1).alias("stored"), (F.col("side") == 2).alias("asks"), F.col(vec).alias("vec"))
    # Every link counts, so k follows the largest group: a near pair links representatives, and copies are listed after.
    n = asked.count()
    hits = nearest(asked, Hashing.planned(n, cos=least), {1: least}, max(n, 1)).groupBy("id", "nn").agg(F.max("cos").alias("cos"), F.max("err").alias("err"))
    hits = cut(hits.withColumn("sure", F.col("cos") - F.col("err") >= least).select("id", "nn", "sure"))
    train, evaluation = (asked.filter(F.col("kind") == v).select("id", "vec") for v in (0, 1))
    open_ = exact_cosines(hits.filter("not sure"), evaluation, train).filter(F.col("cos") >= least)
    hits = hits.filter("sure").select("id", "nn").unionByName(open_.select("id", "nn"))
    vrows = m.select(F.col("member").alias("row"), "side", F.col("id").alias("nid"))
    image = _pairs(vrows, links=hits.select(F.col("nn").alias("nid_a"), F.col("id").alias("nid_b"))).withColumn("way", F.lit("image"))
    return copies.unionByName(near).unionByName(image).select(F.col("row_a").alias(f"{key}_a"), F.col("row_b").alias(f"{key}_b"), "way")


def overlap_fractions(df: DataFrame, key: str = "row_id", text: str = "text", split: str = "split", min_words: int = 6, edits: int = 2) -> DataFrame:
    """``<key>, overlap``: for each evaluation row with such a text the share of its words in chunks that train has too; 1 for a
    copy. Where a text is cut in both ways, the larger share counts."""
    rows, classes = text_classes(df.filter(F.col(key).isNotNull()), key, text, split, min_words)
    per = digests(classes, edits).groupBy(F.col("nid").alias("tid")).agg(F.max("overlap").alias("overlap"))
    # Lists of named fields are no running text: only copies of them overlap.
    sides = rows.groupBy("nid").agg(F.bit_or("side").alias("sides"))
    rows = rows.filter("side = 2").join(sides, "nid").join(per, "tid", "left")
    return rows.select(F.col("row").alias(key), F.when(F.col("sides") == 3, 1.0).otherwise(F.coalesce("overlap", F.lit(0.0))).alias("overlap"))


def overlap_report(df: DataFrame, key: str = "row_id", text: str = "text", split: str = "split", source: str = "source", min_words: int = 6, edits: int = 2) -> DataFrame:
    """Per evaluation split and source: rows, rows with a same or near-same training row, their share, and the mean
    fraction of a text that overlaps with train."""
    pairs = cross_split_pairs(df, key, text)
    hit = pairs.select(F.explode(F.array(f"{key}_a", f"{key}_b")).alias(key)).distinct().withColumn("hit", F.lit(1))
    fractions = overlap_fractions(df, key, text, split, min_words, edits)
    rows = df.filter(F.col(split).isin("val", "test")).select(key, split, source).join(hit, key, "left").join(fractions, key, "left")
    share = F.round(F.count("hit") / F.count("*"), 6)
    return rows.groupBy(split, source).agg(F.count("*").alias("n_rows"), F.count("hit").alias("n_overlapping"), share.alias("share"), F.round(F.avg("overlap"), 6).alias("mean_overlap"))
