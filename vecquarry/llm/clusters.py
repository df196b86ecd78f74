"""Grouping vectors into similarity clusters (problem 7).

An approximate nearest-neighbour graph starts from the buckets of ``vechash`` and is refined by neighbour descent: every
vector meets the neighbours of its neighbours, until fewer than one link in a hundred is new. The graph also holds links
weaker than those of a cluster. Modularity-based community detection with several levels parts it: vectors join their
nearest neighbour, then communities join the one with which modularity gains most, until no union gains. The
communities are the clusters; links of at least the threshold only verify their members. From the second level
on, the weight between two communities is that of all their similar pairs, estimated from typical members, because a
vector's list holds only its nearest. Clusters are described by their members of the highest internal weighted degree.

Modularity is taken within each connected component of the graph, so that a cluster doesn't depend on how many other rows
there are (over a whole collection it merges whatever has a single link). ``resolution`` is the share of the expected
weight that a union must exceed.

Defined results: invalid vectors and rows without a key belong to no cluster; identical vectors are one node and count with all their rows;
a member without a link of at least the threshold into its community is a cluster of its own; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.llm.neighbours import members
from vecquarry.llm.vechash import Hashing, coded_vectors, decoded, nearest, unpacked, valid
from vecquarry.session import cut, spread

LINKS = T.StructType([T.StructField("id", T.LongType()), T.StructField("nn", T.LongType()), T.StructField("cos", T.FloatType())])


def _ranked(links: DataFrame, k: int) -> DataFrame:
    """``id, nn, cos, old, bridge, r``: the links to the k best of ``id``, with their rank, and bridges; a link met in several places has its largest cosine."""
    w = Window.partitionBy("id").orderBy(F.desc("cos"), "nn")
    one = links.repartition("id").groupBy("id", "nn").agg(*(F.max(c).alias(c) for c in ("cos", "old", "bridge")))
    return one.withColumn("r", F.row_number().over(w)).filter((F.col("r") <= k) | F.col("bridge"))


def descend(links: DataFrame, codes: DataFrame, k: int, least: float, sent: int = 2, meets: int = 6) -> DataFrame:
    """One round of neighbour descent: each vector goes to its ``sent`` best neighbours, where it meets the others sent
    there (each the next ``meets`` in the order of ids); pairs of at least ``least`` enter the lists."""
    to = links.filter(F.col("r") <= sent).select("id", F.col("nn").alias("at"), "old")
    # Where nobody is new, all have met before.
    to = to.join(to.filter("old = 0").select("at").distinct(), "at", "left_semi").select("id", "at")
    here = spread(to.join(codes, "id"), "at").sortWithinPartitions("at", "id").select("at", "id", "code")

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks()
            if not t.num_rows:
                continue
            yield from meet(t)
            # The last rows meet those of the next batch.
            rest = t.slice(max(0, t.num_rows - meets)).to_batches()[0]

    def meet(t):
        at, ids = np.asarray(t.column("at")), np.asarray(t.column("id"))
        x = decoded(unpacked(t.column("code")))
        for s in range(1, meets + 1):
            i = np.flatnonzero(at[:-s] == at[s:])
            cos = np.einsum("ij,ij->i", x[i], x[i + s])
            i, cos = i[cos >= least], cos[cos >= least]
            a, b = ids[i], ids[i + s]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[a, b]), pa.array(np.r_[b, a]), pa.array(np.r_[cos, cos])], names=LINKS.names)

    found = here.mapInArrow(run, LINKS).withColumns({"old": F.lit(0), "bridge": F.lit(False)})
    return _ranked(links.select("id", "nn", "cos", F.lit(1).alias("old"), "bridge").unionByName(found).filter("id != nn"), k)


def neighbour_graph(vectors: DataFrame, codes: DataFrame, n: int, k: int = 6, least: float = 0.90, weak: float = 0.85, still: float = 0.01) -> DataFrame:
    """``a, b, w, near`` (a < b): undirected links of at least ``weak`` among ``kind, id, vec``; only vectors of one kind
    meet. ``near`` are the links to the k best of either end. The others are of at least ``least`` and
    join what the k best leave apart, for instance two clumps of more than k near copies each."""
    flag = F.lit(True)
    asked = vectors.select("kind", "id", flag.alias("stored"), flag.alias("asks"), "vec")
    found = nearest(asked, Hashing.planned(n), {0: weak, 1: weak}, k, by_kind=True, selfless=True, mutual=True, joined=least, spare=0)
    links = cut(_ranked(found.select("id", "nn", "cos", F.lit(0).alias("old"), (F.col("err") < 0).alias("bridge")), k))
    while True:
        new = cut(descend(links, codes, k, weak), instead=links)
        kept = new.filter(F.col("r") <= k).agg(F.count("*").alias("n"), F.sum("old").alias("old")).first()
        links = new
        if kept.n - (kept.old or 0) <= still * kept.n:
            break
    ends = links.select(F.least("id", "nn").alias("a"), F.greatest("id", "nn").alias("b"), F.col("cos").cast("double").alias("w"), (F.col("r") <= k).alias("near"))
    return ends.groupBy("a", "b").agg(F.round(F.max("w"), 6).alias("w"), F.max("near").alias("near"))


def _both(pairs: DataFrame, *more: str) -> DataFrame:
    """``id, to, w`` from both ends of ``a, b, w``."""
    a, b = (pairs.select(F.col(x).alias("id"), F.col(y).alias("to"), "w", *more) for x, y in (("a", "b"), ("b", "a")))
    return a.unionByName(b)


def merged(best: DataFrame) -> DataFrame:
    """``id, com``: every node of ``id, to`` joins the one it points to, and so on; a tree is named by the smaller of the two
    nodes that point at each other. Weights are the same from both ends and ties go to the smaller id, so there is no longer circle."""
    back = best.select(F.col("id").alias("to"), F.col("to").alias("back"))
    top = (F.col("back") == F.col("id")) & (F.col("id") < F.col("to"))
    state = cut(best.join(back, "to", "left").select("id", F.when(F.coalesce(top, F.lit(False)), F.col("id")).otherwise(F.col("to")).alias("com")))
    while True:
        far = state.select(F.col("id").alias("com"), F.col("com").alias("far"))
        state = cut(state.select("id", "com").join(far, "com", "left").select("id", F.coalesce("far", "com").alias("com"), F.coalesce(F.col("far") != F.col("com"), F.lit(False)).alias("moved")), instead=state)
        if not state.filter("moved").limit(1).count():
            return state.select("id", "com")


def _typical(pairs: DataFrame, named: DataFrame, most: int = 4) -> DataFrame:
    """``com, id, n``: the ``most`` members of the highest degree of each linked community, and the number of all its members."""
    linked = pairs.select(F.explode(F.array("a", "b")).alias("com")).distinct()
    top = F.row_number().over(Window.partitionBy("com").orderBy(F.desc("degree"), "id"))
    here = named.join(linked, "com", "left_semi")
    return here.withColumn("r", top).filter(F.col("r") <= most).select("com", "id").join(here.groupBy("com").agg(F.count("*").alias("n")), "com")


def codes_of(codes: DataFrame, ids: DataFrame, most: int = 10_000_000) -> DataFrame:
    """The rows of ``codes`` with an ``id`` of ``ids``. Up to ``most`` ids go to all tasks, 8 bytes each, so no other code is
    shuffled; more are joined."""
    if ids.count() > most:
        return codes.join(ids.select("id"), "id", "left_semi")
    sent = codes.sparkSession.sparkContext.broadcast(np.unique(ids.select("id").toArrow().column("id").to_numpy()))

    def run(batches):
        wanted = sent.value
        for b in batches:
            at = np.asarray(b.column("id"))
            there = wanted[np.minimum(np.searchsorted(wanted, at), len(wanted) - 1)] == at if len(wanted) else np.zeros(len(at), bool)
            yield b.filter(pa.array(there))

    return codes.mapInArrow(run, codes.schema)


def _estimated(pairs: DataFrame, typical: DataFrame, codes: DataFrame, weak: float) -> DataFrame:
    """``a, b, w``: the weight of all similar pairs of two linked communities, estimated from their ``typical`` members:
    the neighbour lists hold only a few links a vector, and none between two clumps of near copies."""
    reps = typical.join(codes, "id").groupBy("com").agg(F.collect_list("code").alias("codes"), F.first("n").alias("n"))
    pairs = pairs.select("a", "b")
    for end in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("com").alias(end), F.col("codes").alias(f"c_{end}"), F.col("n").alias(f"n_{end}")), end)

    def run(batches):
        for t in batches:
            w = np.zeros(t.num_rows)
            x, y = (t.column(c) for c in ("c_a", "c_b"))
            vx, vy = (decoded(unpacked(c.flatten())) for c in (x, y))
            ox, oy = (np.r_[0, np.cumsum(np.asarray(c.value_lengths()))] for c in (x, y))
            for i in range(t.num_rows):
                cos = vx[ox[i] : ox[i + 1]] @ vy[oy[i] : oy[i + 1]].T
                w[i] = np.where(cos >= weak, cos, 0).mean()
            w = np.round(w * np.asarray(t.column("n_a")) * np.asarray(t.column("n_b")), 6)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(w)], names=["a", "b", "w"])

    return pairs.mapInArrow(run, "a bigint, b bigint, w double").filter("w > 0")


def communities(links: DataFrame, codes: DataFrame, resolution: float = 0.1, weak: float = 0.85) -> DataFrame:
    """``id, com, top`` of the nodes in ``a, b, w, near``: modularity over several levels, within each connected component.
    ``top`` is the cosine of the nearest neighbour, which is in the same community.

    Vectors first join their nearest neighbour. On each further level a community joins the one with which modularity
    gains most, if it gains, until none does. From the second level on the links are weighed by ``_estimated``.
    """
    ends = _both(links, "near")
    nodes = ends.groupBy("id").agg(F.max(F.struct("w", (-F.col("to")).alias("to"))).alias("best"), F.sum("w").alias("k"), F.round(F.coalesce(F.sum(F.when(F.col("near"), F.col("w"))), F.lit(0.0)), 6).alias("degree"))
    nodes = cut(nodes.select("id", (-F.col("best.to")).alias("to"), F.col("best.w").alias("top"), "k", "degree"))
    named = cut(nodes.join(merged(nodes.select("id", "to")), "id").select("id", "com", "k", "degree", "top"))

    def over(pairs: DataFrame, names: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(names.select(F.col("id").alias(end), F.col("com").alias(f"c{end}")), end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
        pairs = pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
        return pairs.groupBy("a", "b").agg(F.round(F.sum("w"), 6).alias("w"))

    pairs = cut(over(links.select("a", "b", "w"), named))
    part, level = components(pairs.select("a", "b")), 1
    while True:
        if level > 1:
            typical = cut(_typical(pairs, named))
            # Communities that unite were linked, so from here on the typical ones are among the typical ones of their parts.
            codes = cut(codes_of(codes, typical)) if level == 2 else codes
            pairs = cut(_estimated(pairs, typical, codes, weak), instead=pairs)
        if not pairs.limit(1).count():
            return named.select("id", "com", "top")
        sums = named.groupBy(F.col("com").alias("id")).agg((F.count("*") * (F.count("*") - 1)).cast("double").alias("within"), F.sum("k").alias("k"))
        if level > 1:
            sums = sums.join(_both(pairs).groupBy("id").agg(F.sum("w").alias("w")), "id", "left").select("id", (F.col("within") + F.coalesce("w", F.lit(0.0))).alias("k"))
        weighed = sums.join(part, "id")
        weighed = cut(weighed.join(weighed.groupBy("root").agg(F.sum("k").alias("total")), "root").select("id", "k", "total"))
        gain = F.round(F.col("w") - resolution * F.col("ka") * F.col("kb") / F.col("total"), 9)
        gains = pairs.join(weighed.select(F.col("id").alias("a"), F.col("k").alias("ka"), "total"), "a").join(weighed.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
        gains = gains.select("a", "b", gain.alias("w")).filter("w > 0")
        best = cut(_both(gains).groupBy("id").agg(F.max(F.struct("w", (-F.col("to")).alias("to"))).alias("best")).select("id", (-F.col("best.to")).alias("to")))
        if not best.limit(1).count():
            return named.select("id", "com", "top")
        joins = merged(best)
        named = cut(named.join(joins.select(F.col("id").alias("com"), F.col("com").alias("new")), "com", "left").select("id", F.coalesce("new", "com").alias("com"), "k", "degree", "top"), instead=named)
        pairs = cut(over(pairs, joins), instead=pairs)
        level += 1


def components(pairs: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``id, root`` of the nodes in ``a, b``: smallest labels spread over links, with pointer jumping, until none changes."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("to"))).distinct()
    both = cut(both)
    state = cut(both.groupBy("id").agg(F.least(F.min("to"), F.first("id")).alias("root")))
    for _ in range(most_rounds):
        low = both.join(state.select(F.col("id").alias("to"), "root"), "to").groupBy("id").agg(F.min("root").alias("low"))
        step = state.select("id", "root").join(low, "id").select("id", F.least("root", "low").alias("mid"), F.col("root").alias("old"))
        jump = step.join(state.select(F.col("id").alias("mid"), F.col("root").alias("far")), "mid", "left")
        state = cut(jump.select("id", "old", F.least("mid", F.coalesce("far", "mid")).alias("root")), instead=state)
        if state.filter("root != old").limit(1).count() == 0:
            return state.select("id", "root")
    raise RuntimeError("labels still change")


def verified(com: DataFrame, least: float) -> DataFrame:
    """``id, cluster``: members with a link of at least ``least`` into their community; its smallest such id names it."""
    inside = com.filter(F.col("top") >= least).select("id", "com")
    return inside.join(inside.groupBy("com").agg(F.min("id").alias("cluster")), "com").select("id", "cluster")


def degrees(named: DataFrame, links: DataFrame) -> DataFrame:
    """``id, degree``: the weighted degree of each member within its cluster, over the links to nearest neighbours."""
    links = links.filter("near")
    for end in ("a", "b"):
        links = links.join(named.select(F.col("id").alias(end), F.col("cluster").alias(f"c{end}")), end)
    inside = links.filter("ca = cb").select(F.explode(F.array("a", "b")).alias("id"), "w")
    return inside.groupBy("id").agg(F.round(F.sum("w"), 6).alias("degree"))


def clusters(tables: dict[str, tuple[DataFrame, str, str]], least: float = 0.90, k: int = 6, resolution: float = 0.1, degree: bool = False) -> DataFrame:
    """``tab, row, first, size`` for every row with a valid vector, with ``degree`` also its weighted degree within the cluster;
    up to two tables, ``name: (df, key, vec)``."""
    names = list(tables)
    nodes, rows = None, None
    for i, (df, key, vec) in enumerate(tables.values()):
        # One id space: the table's number is the lowest bit.
        v = df.filter(valid(F.col(vec)) & F.col(key).isNotNull()).select(F.lit(i).alias("kind"), (F.col(key) * 2 + i).alias("id"), F.col(vec).alias("vec"))
        m = members(df, key, vec).select(F.lit(i).alias("kind"), F.col("member").alias("row"), (F.col("id") * 2 + i).alias("id"))
        nodes, rows = (v, m) if nodes is None else (nodes.unionByName(v), rows.unionByName(m))
    codes = cut(coded_vectors(nodes, "id"))
    links = cut(neighbour_graph(nodes, codes, nodes.count(), k, least))
    named = verified(communities(links, codes, resolution), least)
    more = ["degree"] if degree else []
    if degree:
        named = cut(named)
        named = named.join(degrees(named, links), "id", "left")
    full = rows.join(named, "id", "left").select("kind", "row", F.coalesce("cluster", "id").alias("cluster"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in more))
    per = full.groupBy("cluster").agg(F.min("row").alias("first"), F.count("*").alias("size"))
    tab = F.element_at(F.array(*map(F.lit, names)), F.col("kind") + 1)
    return full.join(per, "cluster").select(tab.alias("tab"), "row", "first", "size", *more)


def clusters_found(tables: dict[str, tuple[DataFrame, str, str]], least: float = 0.90, min_size: int = 3) -> DataFrame:
    c = clusters(tables, least).filter(F.col("size") >= min_size)
    return c.select("tab", F.col("first").alias("first_row_id"), F.col("row").alias("row_id"))


def described(tables: dict[str, tuple[DataFrame, str, str]], least: float = 0.90, typical: int = 3) -> DataFrame:
    """One row for each cluster: its size and its rows of the highest internal weighted degree, best first."""
    w = Window.partitionBy("tab", "first").orderBy(F.desc("degree"), "row")
    top = clusters(tables, least, degree=True).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= typical)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("r", "row"))), lambda x: x["row"])
    return top.groupBy("tab", F.col("first").alias("first_row_id")).agg(F.max("size").alias("size"), rows.alias("typical_row_ids"))
