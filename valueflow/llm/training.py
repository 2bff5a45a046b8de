"""Labelled samples and small fits shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import holdout, written

#: Labelled rows that a classifier is fitted on, at most (about; rows are drawn by a hash of the id).
SAMPLE_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of about ``rows`` labelled documents that are not held out, one per distinct text, written.

    Labels are drawn before the join, so what is broadcast has ``rows`` rows and a slight excess at most.  Ids that
    repeat count once (label: the more frequent, then 1; text: the first in order); null ids, labels and texts are left out.
    """
    wanted = labels.select(F.col("doc_id"), F.col(label).cast("double").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~holdout(F.col("doc_id")))
    wanted = wanted.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    share = min(1.0, rows / max(1, wanted.count()))
    drawn = wanted.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    one = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return written(one.groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label"), "sample")


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (last: constant) of a logistic model, drawn towards ``prior``; Newton steps with step halving."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = prior.astype(float)

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + strength / 2 * ((w - prior) ** 2).sum()

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + strength * np.eye(x.shape[1]), x.T @ (p - y) + strength * (w - prior))
        t = 1.0
        while t > 1e-6 and loss(w - t * step) > loss(w):
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-8:
            break
    return w
