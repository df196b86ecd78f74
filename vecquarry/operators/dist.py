"""Distances between distributions of vectors: Gaussian 2-Wasserstein and the shift report."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecquarry.operators.pca import gram


def _root(m: np.ndarray) -> np.ndarray:
    v, q = np.linalg.eigh((m + m.T) / 2)
    return (q * np.sqrt(np.maximum(v, 0))) @ q.T


def w2_of_moments(mu1: np.ndarray, c1: np.ndarray, mu2: np.ndarray, c2: np.ndarray) -> float:
    r = _root(c1)
    square = float(((mu1 - mu2) ** 2).sum() + np.trace(c1 + c2 - 2 * _root(r @ c2 @ r)))
    return math.sqrt(max(square, 0.0)) if math.isfinite(square) else float("nan")


def moments(bank: DataFrame, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    g, mu, n = gram(bank, True)
    return mu, g / max(n - 1, 1) + ridge * np.eye(len(g))


def gaussian_w2(a: DataFrame, b: DataFrame) -> float:
    """2-Wasserstein distance of the Gaussians fitted to two tables of ``e``; only dim x dim numbers reach the driver."""
    return w2_of_moments(*moments(a), *moments(b))


def halves(bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two disjoint halves by hash of the id."""
    h = F.pmod(F.xxhash64("vec_id"), F.lit(2))
    return bank.filter(h == 0), bank.filter(h == 1)


def shift_report(bank: DataFrame, queries: DataFrame, projected: DataFrame) -> DataFrame:
    """Distance of bank halves, of the bank to the queries and to the projected ones, the ratios and the improvement."""
    one, two = halves(bank)
    m1, m2, mq, mp = (moments(x) for x in (one, two, queries, projected))
    within, text, proj = w2_of_moments(*m1, *m2), w2_of_moments(*m1, *mq), w2_of_moments(*m1, *mp)

    def over(x: float) -> float:
        return x / within if within else float("nan")

    gain = 100 * (text - proj) / text if text else float("nan")
    row = [round(x, 6) for x in (within, text, proj, over(text), over(proj), gain)]
    return bank.sparkSession.createDataFrame([tuple(row)], "w2_bank double, w2_query double, w2_projected double, ratio_query double, ratio_projected double, improvement_pct double")
