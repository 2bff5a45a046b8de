"""Embedding whitening from a polarisation covariance.

Entries become integers, floor(scale * c).  The fit list is each distinct vector
once.  With S the sums and n the length of the list, a centred value is the
integer n * x - S.  The squares of the centred values are summed exactly for
every dimension and for the sum of every two dimensions; with Q the sums,

    n^3 * cov(i, j) = (Q(i + j) - Q(i) - Q(j)) / 2,

so differences of variances give all cross-covariances.  They are assembled as
correctly rounded doubles for ``eigh`` on the driver (a dims x dims matrix).

What moves: the distinct vectors once, then per task one row of sums for each
dimension pair; nothing is collected but sums, whose number is set by the
dimensions.  Sums are exact at every size: squares are taken in parts of 24 bits
where 64 would overflow, and with Python integers beyond 2^48.

Defined cases: rows whose vector is null or holds a null or non-finite entry are
dropped; shorter vectors are filled with zeros up to the longest; entries beyond
64 bits are clipped; equal rows count once in the fit and are whitened each; a
component without variance has a null projection and no part in the identity
error; vectors without any entry have no component; empty tables give empty
tables; columns of the caller stay, one named like the result column is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Context
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, written

BLOCK_ROWS = 4096  # rows whose squares are summed at once
PAIR_COLUMNS = 64  # dimension pairs that are squared at once
_LIMB = 24
_WIDE = Context(prec=60)

RESULT = T.StructType([T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])


@dataclass
class Model:
    """What was fitted: n vectors with sums S, unit components (rows), eigenvalues, their shares and the identity error."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    identity_error: float | None


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * c) of every entry; null for vectors that take no part."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")))


def filled(x: Column, dims: int) -> Column:
    """The vector with zeros up to ``dims`` entries."""
    return F.when(F.size(x) == dims, x).otherwise(F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(x))))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as 64-bit integers where they and their pair sums fit, else as Python integers."""
    top = max((max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0) * n, max(map(abs, sums), default=0))
    if top < 2**60:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def squares(y: np.ndarray) -> list[int]:
    """Exact sum of the squares of every column."""
    if y.dtype == object:
        return (y * y).sum(axis=0).tolist() if len(y) else [0] * y.shape[1]
    top = max(abs(int(y.min())), abs(int(y.max()))) if y.size else 0
    if top * top * max(1, len(y)) < 2**63:
        return (y * y).sum(axis=0).tolist()
    if top < 2**48 and len(y) <= 2**14:
        high, low = y >> _LIMB, y & (2**_LIMB - 1)
        sums = ((high * high).sum(axis=0), (high * low).sum(axis=0), (low * low).sum(axis=0))
        return [(a << 2 * _LIMB) + (b << _LIMB + 1) + c for a, b, c in zip(*(s.tolist() for s in sums))]
    y = y.astype(object)
    return (y * y).sum(axis=0).tolist()


def pair_places(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with i < j of all dimension pairs."""
    return np.triu_indices(dims, 1)


def variance_sums(d: np.ndarray) -> list[int]:
    """Exact sums of squares of a block of centred vectors: every dimension, then the sum of every dimension pair."""
    i, j = pair_places(d.shape[1])
    out = squares(d)
    for lo in range(0, len(i), PAIR_COLUMNS):
        out += squares(d[:, i[lo : lo + PAIR_COLUMNS]] + d[:, j[lo : lo + PAIR_COLUMNS]])
    return out


def covariance(q: list[int], n: int, dims: int) -> np.ndarray:
    """Covariances from the sums of ``variance_sums``, each rounded once."""
    v = np.zeros((dims, dims))
    for i in range(dims):
        v[i, i] = float(Fraction(q[i], n**3))
    for (i, j), both in zip(zip(*(p.tolist() for p in pair_places(dims))), q[dims:]):
        v[i, j] = v[j, i] = float(Fraction(both - q[i] - q[j], 2 * n**3))
    return v


def _totals(fit: DataFrame, row_sums: Callable[[pa.Array], list[int]]) -> dict[int, int]:
    """Exact sums over all rows of what ``row_sums`` gives for a block, by place; they travel in parts of 60 bits."""
    names = ["place", "low", "mid", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                one = row_sums(batch.column(0).slice(lo, BLOCK_ROWS))
                total = one if total is None else [a + b for a, b in zip(total, one)]
        if total is not None:
            parts = [[t & (2**60 - 1) for t in total], [(t >> 60) & (2**60 - 1) for t in total], [t >> 120 for t in total]]
            if any(abs(p) >= 2**62 for p in parts[2]):
                raise OverflowError("sums beyond 180 bits")
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), *(pa.array(p, pa.int64()) for p in parts)], names=names)

    parts = fit.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    exact = parts.groupBy("place").agg(*(F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in names[1:])).collect()
    return {r["place"]: int(r["low"]) + (int(r["mid"]) << 60) + (int(r["high"]) << 120) for r in exact}


def fit(vectors: DataFrame, x_col: str, k: int) -> Model:
    """Fits on the distinct vectors of a column of equally long arrays of long."""
    distinct = written(vectors.select(F.col(x_col).alias("x")).distinct(), "whiten-fit")
    sums = _totals(distinct, lambda x: [len(x), *_exact_sums(_matrix(x, len(x[0])))])
    if len(sums) < 2:
        discard(distinct)
        return Model(sums.get(0, 0), [], np.zeros((0, 0)), np.zeros(0), [], None)
    n, s = sums[0], [sums[i] for i in range(1, len(sums))]
    dims = len(s)
    q = _totals(distinct, lambda x: variance_sums(centred(_matrix(x, dims), n, s)))
    v = covariance([q[i] for i in range(len(q))], n, dims)
    values, columns = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:k]
    components = columns[:, order].T
    components = components * np.where(components[np.arange(len(order)), np.abs(components).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    values = np.where(values[order] > dims * np.finfo(float).eps * max(values.max(), 0.0), values[order], 0.0)
    trace = float(np.trace(v))
    model = Model(n, s, components, values, [float(e) / trace if trace > 0 else None for e in values], None)
    model.identity_error = _identity_error(distinct, model)
    discard(distinct)
    return model


def _exact_sums(x: np.ndarray) -> list[int]:
    top = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    return (x if top * max(1, len(x)) < 2**63 else x.astype(object)).sum(axis=0).tolist()


def project(d: np.ndarray, model: Model) -> np.ndarray:
    """Centred integers on the components, over the root of the eigenvalue; NaN without variance."""
    scale = np.sqrt(model.values)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (d.astype(np.float64) / model.n) @ model.components.T / scale
    out[:, scale == 0] = np.nan
    return out


def _identity_error(distinct: DataFrame, model: Model) -> float | None:
    """Largest entry of the whitened fit list's covariance minus the identity; its mean is taken off first."""
    live = int((model.values > 0).sum())
    if not live:
        return None
    width = live + live * live

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            w = project(centred(_matrix(batch.column(0), len(model.sums)), model.n, model.sums), model)[:, :live]
            total += np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int64()), pa.array(total)], names=["place", "total"])

    sums = np.zeros(width)
    for place, total in distinct.mapInArrow(run, "place long, total double").groupBy("place").agg(F.sum("total")).collect():
        sums[place] = total
    mean = sums[:live] / model.n
    cov = sums[live:].reshape(live, live) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(live)).max())


def whiten(vectors: DataFrame, k: int = 4, vector_col: str = "embedding", scale: float = 256.0, out: str = "_white") -> tuple[DataFrame, Model]:
    """The rows that take part with the struct ``out``: deviation (exact sum over dimensions of (n * x - S)^2; null beyond
    38 digits) and whitened (projections on the first ``k`` components); and the model."""
    names = [c for c in vectors.columns if c != out]
    used = vectors.select(quantised(F.col(f"`{vector_col}`"), scale).alias("x"))
    dims = used.agg(F.max(F.size("x"))).first()[0]
    if dims is None or dims < 0:
        dims = 0
    x = filled(quantised(F.col(f"`{vector_col}`"), scale), dims)
    model = fit(vectors.select(x.alias("x")).filter(F.col("x").isNotNull()), "x", k)
    rows = vectors.select(*(vectors[f"`{c}`"] for c in names), x.alias(out)).filter(F.col(out).isNotNull())
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, RESULT)])
    kind = pa.struct([("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model.sums:
                d = centred(_matrix(batch.column(len(names)), len(model.sums)), model.n, model.sums)
                sums = squares(np.ascontiguousarray(d.T)) if d.size else []
                flat = project(d, model)
            else:
                sums, flat = [0] * batch.num_rows, np.zeros((batch.num_rows, 0))
            offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat.ravel(), pa.float64(), from_pandas=True))
            exact = pa.array([_WIDE.create_decimal(s) if s < 10**38 else None for s in sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.StructArray.from_arrays([exact, lists], fields=list(kind))], names=[*names, out])

    return rows.mapInArrow(run, schema), model
