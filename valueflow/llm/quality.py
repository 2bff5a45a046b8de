"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams, hashed to ``DIMS`` places: words, and one to
three neighbouring word shapes.  A shape is a word's case (small, title, capital,
digits, none), the marks it ends with, and whether it repeats the word before.
Shape n-grams also have an indicator for each share of the text (1/16, 1/8, 1/4,
1/2) that they reach, so that a single odd line differs from an odd text.

Fitting, on a bounded sample of labelled rows in one task: class log-count ratios
r of every indicator (add one) scale the indicators; rows get unit length; a
linear hinge-loss model is fitted by dual coordinate descent with the classes
weighted evenly; its weights are mixed with the mean weight as in the method's
publication; a logistic curve over the margins of two halves, each scored by the
other's model, gives scores in [0, 1].  The model is two arrays of ``DIMS`` floats.

Defined cases: null and empty texts have no indicator and get the score of the
constant; without labelled rows every score is 0.5, with labels of one class only
nearly that class; repeated rows get equal scores; texts of any length are read
whole; an empty table gives no row; a column named like the result is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard
from .training import SAMPLE_ROWS, fit_logistic, labelled_sample

DIMS = 1 << 18
EPOCHS = 12
COST = 1.0
MIX = 0.75  # share of the fitted weights; the rest is the mean weight
SHARES = np.array([1 / 16, 1 / 8, 1 / 4, 1 / 2])
THRESHOLD = 0.3
_EDGE = re.compile(r"[^\w\s]+$")
_CACHE = 150_000


def shape(word: str) -> str:
    tail = None if word[-1].isalnum() else _EDGE.search(word)
    marks = tail[0][:3] if tail else ""
    core = word[: tail.start()] if tail else word
    case = ("-" if not core else "9" if not core.isalpha() and any(c.isdigit() for c in core) else "a" if core.islower() else
            "A" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "x")
    return case + marks


class _Codes(dict):
    """word -> (hash of the word, hash of its shape); forgets all at ``_CACHE`` words."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= _CACHE:
            self.clear()
        code = zlib.crc32(word.lower().strip(".,;:!?").encode("utf-8", "surrogatepass")), zlib.crc32(shape(word).encode("utf-8", "surrogatepass"))
        self[word] = code
        return code


def features(text: str | None, codes: _Codes) -> np.ndarray:
    """Sorted places of the indicators that are set."""
    found = (text or "").split()
    if not found:
        return np.empty(0, dtype=np.int64)
    pairs = np.array([codes[w] for w in found], dtype=np.uint32).astype(np.uint64)
    shapes = pairs[:, 1].copy()
    same = np.zeros(len(found), dtype=bool)
    same[1:] = pairs[1:, 0] == pairs[:-1, 0]
    shapes[same] ^= np.uint64(0x5BD1E995)
    out = [np.unique(pairs[:, 0]) * np.uint64(2)]
    gram = np.zeros(len(found), dtype=np.uint64)
    for n in range(1, min(3, len(found)) + 1):
        gram = gram[: len(found) - n + 1] * np.uint64(0x9E3779B1) + shapes[n - 1 :] + np.uint64(n)
        values, counts = np.unique(gram, return_counts=True)
        reached = (counts[:, None] >= SHARES * len(gram)).sum(axis=1)
        for level in range(len(SHARES) + 1):
            out.append(_mixed(values[reached >= level] + np.uint64(level * 0x3C6EF372)) * np.uint64(2) + np.uint64(1))
    return np.unique(_mixed(np.concatenate(out)) % np.uint64(DIMS)).astype(np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    up, down = np.ones(DIMS), np.ones(DIMS)
    for idx, label in zip(rows, y):
        (up if label else down)[idx] += 1
    return np.log(up / up.sum()) - np.log(down / down.sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, epochs: int = EPOCHS, cost: float = COST, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights over scaled indicators, and a constant, of the hinge-loss model (L1 loss)."""
    w, bias = np.zeros(DIMS), 0.0
    values = []
    for idx in rows:
        v = r[idx]
        values.append(v / max(np.sqrt(v @ v), 1e-12))
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.array([(sign < 0).mean(), (sign > 0).mean()])
    most = cost * 0.5 / np.maximum(np.where(sign > 0, share[1], share[0]), 1e-9)
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            idx, v = rows[i], values[i]
            slope = sign[i] * (w[idx] @ v + bias) - 1
            new = min(max(alpha[i] - slope / 2, 0.0), most[i])  # the row's square length is 1, plus 1 for the constant
            step = (new - alpha[i]) * sign[i]
            if step:
                w[idx] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def margins(rows: list[np.ndarray], w: np.ndarray, r: np.ndarray, bias: float) -> np.ndarray:
    return np.array([float(w[i] @ r[i]) / max(float(np.sqrt(r[i] @ r[i])), 1e-12) + bias if len(i) else bias for i in rows])


def _fit_half(rows, y):
    r = log_count_ratios(rows, y)
    w, bias = dual_coordinate_descent(rows, y, r)
    used = w != 0
    mean = np.abs(w[used]).mean() if used.any() else 0.0
    return (1 - MIX) * mean * (r != 0) + MIX * w, bias, r


def fit(texts: list[str], y: np.ndarray) -> dict[str, np.ndarray]:
    """weights (over plain indicators), squares (of the ratios), and curve: slope, shift, constant."""
    codes = _Codes()
    rows = [features(t, codes) for t in texts]
    if len(set(y.tolist())) < 2:
        const = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return {"weights": np.zeros(DIMS, np.float32), "squares": np.zeros(DIMS, np.float32), "curve": np.array([0.0, const, 0.0])}
    half = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % 2 for t in texts], dtype=bool)
    scored = np.zeros(len(y))
    for side in (half, ~half):
        other = [rows[i] for i in np.flatnonzero(~side)]
        if side.any() and len(set(y[~side].tolist())) == 2:
            w, bias, r = _fit_half(other, y[~side])
            scored[side] = margins([rows[i] for i in np.flatnonzero(side)], w, r, bias)
    w, bias, r = _fit_half(rows, y)
    if not scored.any():
        scored = margins(rows, w, r, bias)
    slope, shift = fit_logistic(scored[:, None], y.astype(float), np.array([4.0, 0.0]), strength=0.1)
    return {"weights": (w * r).astype(np.float32), "squares": (r * r).astype(np.float32), "curve": np.array([max(slope, 0.1), shift, bias])}


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Fit on a sample of about ``rows`` labelled rows, in one task on an executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            y += b.column("label").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (texts[i], y[i]))
        model = fit([texts[i] for i in order], np.array([y[i] for i in order], dtype=int))
        yield pa.RecordBatch.from_arrays([pa.array(list(model)), pa.array([v.tobytes() for v in model.values()], pa.binary())], ["name", "bytes"])

    sample = labelled_sample(docs, labels, "quality", rows)
    parts = sample.select("text", F.col("label").cast("long").alias("label")).coalesce(1).mapInArrow(run, "name string, bytes binary").collect()
    discard(sample)
    got = {p["name"]: bytes(p["bytes"]) for p in parts}
    return {k: np.frombuffer(v, np.float64 if k == "curve" else np.float32) for k, v in got.items()} if got else fit([], np.array([], dtype=int))


def score(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> Column:
    """Chance of label 1, as a column over ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, codes = sent.value, _Codes()
        weights, squares, (slope, shift, bias) = model["weights"], model["squares"], model["curve"]
        for batch in batches:
            out = []
            for t in batch:
                idx = features(t.as_py(), codes)
                m = bias + (float(weights[idx].sum(dtype=np.float64)) / max(float(squares[idx].sum(dtype=np.float64)) ** 0.5, 1e-12) if len(idx) else 0.0)
                out.append(1 / (1 + np.exp(-np.clip(slope * m + shift, -40, 40))))
            yield pa.array(out, pa.float64())

    return run(F.col(text).cast("string"))


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD, out: str = "_quality") -> DataFrame:
    """Adds the struct ``out``: score, predicted."""
    model = train(docs, labels, rows)
    scored = docs.withColumn("__score", score(docs, model))
    return scored.withColumn(out, F.struct(F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))).drop("__score")
