"""Labelled rows for the learned operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from factloom.llm.store import narrow, stored

# A model learns from about this many labelled rows at most, picked by a hash of the id; so many ids fit a broadcast.
MAX_LABELLED = 200_000


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo modulus."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, train, id_col: str = "doc_id", text_col: str = "text",
             max_rows: int = MAX_LABELLED) -> DataFrame:
    """doc_id, t, y (0 or 1) of the documents whose label may be learned. train: a condition on the column doc_id.

    Rows without id or label teach nothing; of several labels for one id, or for copies of one text, the largest counts.
    """
    known = narrow(labels, doc_id=id_col if id_col in labels.columns else "doc_id", y=label_col).filter(
        F.col("doc_id").isNotNull() & F.col("y").isNotNull() & train).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    total = known.count()
    if total > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_rows / total * (1 << 30)))
    texts = narrow(docs, doc_id=id_col, t=text_col).join(F.broadcast(known), "doc_id")
    # Copies would teach as often as they occur: each text teaches once, by its first id.
    first = texts.groupBy(F.xxhash64("t").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y")).select("doc_id", "y")
    return narrow(docs, doc_id=id_col, t=text_col).join(F.broadcast(stored(first, "labelled")), "doc_id")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float]:
    """Intercept and slope of a one-dimensional logistic curve by Newton steps; a missing class gives the smoothed share."""
    if weight.sum() == 0:
        return 0.0, 0.0
    share = ((weight * y).sum() + 0.5) / (weight.sum() + 1.0)
    a, b = float(np.log(share / (1 - share))), 0.0
    if len(np.unique(y[weight > 0])) < 2:
        return a, b
    design = np.stack([np.ones_like(x), x], 1)

    def loss(c):
        z = design @ c
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge * c[1] ** 2 / 2)

    c = np.array([a, b])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ c, -60, 60)))
        gradient = design.T @ (weight * (p - y)) + np.array([0, ridge * c[1]])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-9, ridge])
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(c - size * step) > loss(c):
            size /= 2
        c = c - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(c[0]), float(c[1])
