"""Labelled training rows for the classifiers: a bounded sample, chosen by a hash of the id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh


#: A sample of so many ids may be broadcast.
SENT = 200_000


def remainder(key: Column, folds: int) -> Column:
    """The fold of a row: crc32 of its id as text; a null id counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def sample(labels: DataFrame, label: str, fold: int, folds: int, bound: int, key: str = "doc_id") -> DataFrame:
    """(key, label): labelled ids outside the held-out fold, about ``bound`` of them at most (all, where there are fewer).

    Of repeated ids the largest label counts; null ids and labels are left out. The number of rows is bounded whatever the
    input, so up to SENT of them are broadcast.
    """
    rows = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (remainder(F.col(key), folds) != fold))
    rows = rows.groupBy(F.col(key).alias("label_key")).agg(F.max(label).cast("int").alias("label"))
    n = rows.count()
    if n > bound:
        rows = rows.filter(F.pmod(F.xxhash64("label_key", F.lit(11)), F.lit(n)) < bound)
    return F.broadcast(rows) if bound <= SENT else rows


def labelled(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """(text, label) of the chosen rows; the texts are not shuffled."""
    t, k = fresh(chosen, "text", "k")
    rows = docs.select(F.col(key).alias(k), F.col(text).alias(t)).join(chosen, F.col(k) == F.col("label_key"))
    return rows.select(F.col(t).alias("text"), "label")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the bias) of a logistic regression by Newton's method, and the mean and scale of the features."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, scale
