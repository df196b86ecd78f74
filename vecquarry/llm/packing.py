"""Filling fixed-capacity containers (problem 8): shortest-pack-first over the length histogram.

Sizes are tokens of a public byte-pair vocabulary whose file is a parameter. Documents larger than a container are cut
into full pieces and a rest; nothing else is cut. The histogram of piece lengths has at most ``capacity`` entries, so
the packing is planned on the driver whatever the number of documents: lengths are placed longest first, each into the
packs with the most free space among those it fits. The plan, a list of patterns with counts, is joined back to the
pieces by their rank among pieces of the same length; ranks come from counts per length and salt, and a length has the more
salts the more pieces it has, so one that a third of all pieces have is ranked by many tasks.

Defined results: rows without a key are left out; null and empty texts have no tokens and are left out; ties of length are ranked by id; an empty table
gives an empty plan; extra columns are dropped.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.session import cut

VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The file in the folder of public tokenizers: an installed package, or the folder in ``TOKENIZER_DIR``."""
    folder = os.environ.get("TOKENIZER_DIR")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


# Fixed value: the public split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Token counts. No token of this split pattern spans a blank before a visible character, so counts of such parts
    are remembered; the memory is bounded."""

    def __init__(self, path: str, most: int = 500_000):
        self.encode, self.most, self.seen = encoding(path).encode_ordinary, most, {}
        self.parts = re.compile(r" (?=\S)")

    def __call__(self, text: str) -> int:
        first, *rest = self.parts.split(text)
        total, seen = len(self.encode(first)), self.seen
        for w in rest:
            n = seen.get(w)
            if n is None:
                n = len(self.encode(" " + w))
                if len(seen) < self.most:
                    seen[w] = n
            total += n
        return total


SIZE = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_tokens", T.IntegerType())])


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``id, n_tokens`` of every text that is neither null nor empty."""
    path = path or vocabulary_path()
    # The file goes to every executor, wherever it lies on the driver.
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches):
        count = Counter(SparkFiles.get(name))
        for b in batches:
            n = [count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int32())], names=SIZE.names)

    return df.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")).filter("length(text) > 0").mapInArrow(run, SIZE)


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """``id, piece, n`` : documents larger than ``capacity`` in full pieces and a rest."""
    full, rest = F.floor(F.col("n_tokens") / capacity).cast("int"), F.col("n_tokens") % capacity
    n = full + (rest > 0).cast("int")
    cut_up = sizes.filter("n_tokens > 0").select("id", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"), full.alias("full"), rest.alias("rest"))
    return cut_up.select("id", "piece", F.when(F.col("piece") < F.col("full"), capacity).otherwise(F.col("rest")).cast("int").alias("n"))


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths of a container, number of such containers)``; lengths longest first, into the emptiest open packs."""
    open_packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # free space -> pattern -> count
    done: dict[tuple[int, ...], int] = defaultdict(int)
    spaces: list[int] = []  # free spaces in use, ascending
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = spaces[-1] if spaces else -1
            if space < length:
                # No open pack has room: as many new ones as there are pieces.
                _add(open_packs, spaces, done, capacity - length, (length,), left)
                break
            pattern, count = open_packs[space].popitem()
            if not open_packs[space]:
                del open_packs[space]
                spaces.pop()
            used = min(left, count)
            # Of the rest of these packs, that stay open at this space.
            if count > used:
                _add(open_packs, spaces, done, space, pattern, count - used)
            _add(open_packs, spaces, done, space - length, (*pattern, length), used)
            left -= used
    for packs in open_packs.values():
        for pattern, count in packs.items():
            done[pattern] += count
    return sorted(done.items(), reverse=True)


def _add(open_packs, spaces, done, space, pattern, count):
    if space <= 0:
        done[pattern] += count
        return
    if space not in open_packs:
        from bisect import insort

        insort(spaces, space)
    open_packs[space][pattern] = open_packs[space].get(pattern, 0) + count


def slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """For each length: first rank, first container and slot of each run of equal slots; and the number of containers."""
    at: dict[int, int] = defaultdict(int)
    runs: dict[int, list] = defaultdict(list)
    container = 0
    for pattern, count in plan:
        for slot, length in enumerate(pattern):
            runs[length].append((at[length], container, slot))
            at[length] += count
        container += count
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}, container


PLACED = T.StructType([
    T.StructField("container_id", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("id", T.LongType()),
    T.StructField("piece", T.IntegerType()), T.StructField("n", T.IntegerType()),
])


def pack(sizes: DataFrame, capacity: int, most: int = 200_000) -> DataFrame:
    """``container_id, slot, id, piece, n`` of every piece of ``id, n_tokens``; a task ranks about ``most`` pieces at a time."""
    p = pieces(sizes, capacity)
    per = p.groupBy("n").agg(F.ceil(F.count("*") / most).cast("int").alias("salts"))  # at most ``capacity`` rows
    p = p.join(F.broadcast(per), "n").withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.col("salts")).cast("int"))
    # At most ``capacity`` counts, and one more for each ``most`` pieces.
    counts = p.groupBy("n", "salt").agg(F.count("*").alias("c")).orderBy("n", "salt").collect()
    histogram: dict[int, int] = defaultdict(int)
    offset = {}
    for r in counts:
        offset[r.n, r.salt] = histogram[r.n]
        histogram[r.n] += r.c
    runs, _ = slots(shortest_pack_first(dict(histogram), capacity))
    shared = sizes.sparkSession.sparkContext.broadcast((offset, runs))
    ranked = p.withColumn("r", F.row_number().over(Window.partitionBy("n", "salt").orderBy("id", "piece")) - 1)

    def run(batches):
        offset, runs = shared.value
        for b in batches:
            n, salt, r = (np.asarray(b.column(c)) for c in ("n", "salt", "r"))
            container, slot = np.zeros(len(n), np.int64), np.zeros(len(n), np.int32)
            order = np.argsort(n, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else []:
                size = int(n[at[0]])
                rank = r[at] + np.array([offset[size, int(s)] for s in salt[at]])
                start, first, place = runs[size]
                k = np.searchsorted(start, rank, side="right") - 1
                container[at], slot[at] = first[k] + rank - start[k], place[k]
            yield pa.RecordBatch.from_arrays([pa.array(container), pa.array(slot), b.column("id"), b.column("piece"), b.column("n")], names=PLACED.names)

    return ranked.select("id", "piece", "n", "salt", "r").mapInArrow(run, PLACED)


def pack_all(docs: DataFrame, packs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``pack_name, container_id, slot, <key>, piece, n_tokens`` for every capacity; texts are tokenized once."""
    sizes = cut(token_counts(docs, key, text))
    out = None
    for r in packs.orderBy("capacity_tokens").collect():
        placed = pack(sizes, r.capacity_tokens).select(F.lit(r.pack_name).alias("pack_name"), "container_id", "slot", F.col("id").alias(key), "piece", F.col("n").alias("n_tokens"))
        out = placed if out is None else out.unionByName(placed)
    return out


def fill_report(docs: DataFrame, packs: DataFrame) -> DataFrame:
    """For each capacity: containers, pieces, tokens, the share of space filled, and the fewest containers possible."""
    per = pack_all(docs, packs).groupBy("pack_name").agg(F.countDistinct("container_id").alias("n_containers"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    per = per.join(F.broadcast(packs), "pack_name")
    cap = F.col("capacity_tokens")
    return per.select("pack_name", cap, "n_containers", "n_pieces", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * cap), 6).alias("filled"), F.ceil(F.col("n_tokens") / cap).alias("least_containers"))
