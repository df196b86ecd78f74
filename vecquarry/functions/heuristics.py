"""Schedules, index sizes and recommended settings, as column expressions and plain functions."""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


def lambda_ann(budget: Column, epoch: Column) -> Column:
    """Weight of the index teacher: falls with the budget; the first epoch is capped at small budgets."""
    base = F.greatest(F.lit(0.6), F.lit(0.9) - (budget - 10) * F.lit(0.3) / F.lit(90.0))
    cap = F.when(budget <= 20, 0.6).when(budget <= 30, 0.7).otherwise(1.0)
    return F.when(epoch == 1, F.least(base, cap)).otherwise(base)


def pack_size(budget: Column, most: int = 256) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(96), 6 * budget))


def student_share(epoch: Column) -> Column:
    """Share of the student in packs and query mixing: 0 in epoch 1, 1 from epoch 3."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (epoch - 1) / F.lit(2.0)))


def cone_threshold(budget: Column, epoch: Column) -> Column:
    by_budget = F.greatest(F.lit(0.85), F.lit(0.95) - F.lit(0.1) * (budget - 10) / F.lit(90.0))
    by_epoch = F.greatest(F.lit(0.8), F.lit(0.95) - F.lit(0.15) * (epoch - 1) / F.lit(10.0))
    return F.least(by_budget, by_epoch)


def nlist_sqrt(n: Column, hint: Column) -> Column:
    return F.least(F.greatest(F.lit(16), F.floor(4 * F.sqrt(n)).cast("int")), hint)


def nlist_bucketed(n: Column) -> Column:
    return F.when(n < 100_000, 1024).when(n < 1_000_000, 2048).when(n < 10_000_000, 4096).otherwise(8192)


def em_candidates(n: Column, k: Column) -> Column:
    by_k = F.greatest(2 * k, k + 64, F.lit(256))
    by_n = F.greatest(F.lit(512), F.least(F.lit(2048), F.floor(F.lit(0.0005) * n).cast("int")))
    return F.least(F.lit(4096), F.greatest(by_k, by_n))


def em_iterations(n: Column) -> Column:
    grown = F.lit(60) + 20 * F.greatest(F.lit(0.0), F.log10(F.greatest(n, F.lit(1))) - 6)
    return F.least(F.lit(140), F.greatest(F.lit(60), F.round(grown).cast("int")))


def _build(nlist: int, m: int, efc: int, batch: int, pack: int, **more) -> dict:
    return {"ivf_nlist": nlist, "M_cells": nlist, "hnsw_M": m, "hnsw_efC": efc, "batch_size": batch, "C_pack": pack, **more}


# Recommended settings by the number of rows above which they hold, largest first, under their public names.
COCO_EVALUATION = {"eval_split": "val", "eval_topk": 10, "eval_ph": True, "eval_r5": False, "num_threads": 16}
RECOMMENDED = {
    "laion": [(500_000, _build(2048, 32, 200, 1024, 256)), (100_000, _build(1024, 24, 150, 512, 128)), (-1, _build(512, 16, 100, 256, 64))],
    "coco": [(50_000, _build(2048, 64, 400, 1024, 256, **COCO_EVALUATION)), (10_000, _build(1024, 32, 200, 512, 128, **COCO_EVALUATION)), (-1, _build(64, 16, 100, 32, 32, **COCO_EVALUATION))],
    "flickr30k": [(50_000, _build(256, 64, 400, 1024, 128, lr=1e-3, epochs=5)), (9_999, _build(128, 32, 200, 512, 64, lr=2e-3, epochs=10)), (-1, _build(64, 16, 100, 256, 32, lr=5e-3, epochs=15))],
    "t2i": [(-1, _build(4096, 32, 200, 8192, 256, epochs=8, lr=1e-3, budgets=tuple(range(10, 101, 10))))],
}


def recommended(dataset: str, n: int) -> dict:
    """Settings for a data set of ``n`` rows; none for an unknown name."""
    return next((dict(settings) for above, settings in RECOMMENDED.get(dataset, ()) if n > above), {})


def apply_recommended(config, dataset: str, n: int):
    """A copy of the dataclass ``config`` with recommended values where it still has its defaults."""
    default = type(config)()
    names = {f.name for f in fields(config)}
    change = {k: v for k, v in recommended(dataset, n).items() if k in names and getattr(config, k) == getattr(default, k)}
    return replace(config, **change)


def resolve_path(paths, dataset: str) -> str:
    """A string is the path; a mapping is looked up by data set, then ``default``."""
    if isinstance(paths, str):
        return paths
    found = paths.get(dataset, paths.get("default"))
    if found is None:
        raise ValueError(f"no path for data set {dataset!r}")
    return found


def head_k(candidates: Column, k_eval: Column) -> Column:
    """Length of a search head: the number of candidates between 128 and 512, and no shorter than the evaluated list."""
    return F.greatest(F.least(F.greatest(candidates, F.lit(128)), F.lit(512)), k_eval)


def fit_head(ids: Column, length: int, pad: int = -1) -> Column:
    """An array cut or padded to ``length``."""
    return F.slice(F.concat(F.coalesce(ids, F.array().cast("array<bigint>")), F.array_repeat(F.lit(pad).cast("bigint"), length)), 1, length)
