"""End-to-end evaluation: query variants against index backends over budgets, and batch retrieval.

A backend takes (queries, bank, index, k, budget) and returns hits; ``budget`` is cells for the inverted file, cell pairs
for the multi-index and expanded nodes for the graph. Each variant is compared with its own exact neighbours, or with
those of the original queries (``truth="original"``).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecquarry.operators import cluster, graph, ivf, knn, metrics, model, pca
from vecquarry.session import cut


def _ivf_index(bank: DataFrame, cells: int):
    c, labels = cluster.kmeans(bank, cells)
    return c, cut(bank.join(labels.select("vec_id", "cell_id"), "vec_id"))


def _imi_index(bank: DataFrame, cells: int):
    s = cluster.farthest_first(bank, cells)
    half = s.shape[1] // 2
    return s[:, :half], s[:, half:]


#: name -> (build index, search)
BACKENDS: dict[str, tuple[Callable, Callable]] = {
    "ivf": (_ivf_index, lambda q, b, i, k, n: ivf.search(q, i[1], i[0], k, n)),
    "imi": (_imi_index, lambda q, b, i, k, n: ivf.imi_search(q, b, i[0], i[1], k, n)),
    "graph": (lambda bank, cells: cut(graph.build(bank)), lambda q, b, i, k, n: graph.search(q, i, k, n, itopk=max(64, 2 * k))),
    "exact": (lambda bank, cells: None, lambda q, b, i, k, n: knn.exact_topk(q, b, k)),
}


def evaluate(bank: DataFrame, variants: dict[str, DataFrame], backends: list[str], budgets: list[int], at_k: list[int], cells: int = 16, truth: str = "own", repeats: int = 1) -> DataFrame:
    """``backend, variant, budget, at_k, recall, qps`` for every combination; qps from the median of ``repeats`` runs."""
    unknown = set(backends) - set(BACKENDS)
    if unknown:
        raise ValueError(f"unknown backends: {', '.join(sorted(unknown))}")
    spark, deepest = bank.sparkSession, max(at_k)
    own = {name: knn.exact_topk(q, bank, deepest).persist() for name, q in variants.items()}
    first = next(iter(variants))
    counts = {name: q.count() for name, q in variants.items()}
    rows = []
    for b in backends:
        build, search = BACKENDS[b]
        index = build(bank, cells)
        for name, q in variants.items():
            exact = own[name if truth == "own" else first]
            for n in budgets:
                took = []
                for _ in range(repeats):
                    t = time.perf_counter()
                    hits = search(q, bank, index, deepest, n).persist()
                    hits.count()
                    took.append(time.perf_counter() - t)
                    if len(took) < repeats:
                        hits.unpersist()
                for k in at_k:
                    found = metrics.recall(hits, exact, k).collect()
                    rows.append((b, name, n, k, found[0].recall if found else 0.0, counts[name] / sorted(took)[len(took) // 2]))
                hits.unpersist()
    for x in own.values():
        x.unpersist()
    return spark.createDataFrame(rows, "backend string, variant string, budget int, at_k int, recall double, qps double")


def em_refresh(queries: DataFrame, bank: DataFrame, weights: dict, k: int, rotation=None) -> DataFrame:
    """New exact lists: queries are projected, rotated if there is a rotation, and searched in the (rotated) bank."""
    q = model.project(queries, weights)
    if rotation is not None:
        q, bank = pca.transform(q, rotation, keys=("query_id",)), pca.transform(bank, rotation)
    return knn.exact_topk(q, bank, k)


def batch_retrieval(queries: DataFrame, bank: DataFrame, side: DataFrame, k: int, cells: int, nprobe: int, index_path: str | None = None) -> DataFrame:
    """Inverted-file search with the stored index, hydrated with side columns: ``query_id, rank, vec_id, score, ...``."""
    c, celled = ivf.build(bank, cells, index_path)
    hits = ivf.search(queries, celled, c, k, nprobe)
    return knn.hydrate(hits, side, *[x for x in side.columns if x != "vec_id"])


def budget_gain(results: DataFrame, base: str = "baseline") -> DataFrame:
    """Recall of each variant minus that of the baseline at the same backend, budget and k."""
    b = results.filter(F.col("variant") == base).select("backend", "budget", "at_k", F.col("recall").alias("base"))
    return results.filter(F.col("variant") != base).join(b, ["backend", "budget", "at_k"]).select("backend", "variant", "budget", "at_k", F.round(F.col("recall") - F.col("base"), 9).alias("gain"))
