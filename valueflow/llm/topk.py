"""Exact top-k search by inner product: columnar branch and bound.

Vectors are integers.  Queries and candidates are dealt into blocks (queries by
thousands, candidates by thousands); every pair of a query block and a candidate
block meets in one task of bounded size.  There the candidates lie in vertical
layout (one row per dimension, dimensions with the most mass first).  Scores are
accumulated dimension block by dimension block; after each, the Cauchy-Schwarz
product of what is left of query and candidate bounds what a candidate can still
gain, and candidates that cannot reach the query's k-th best score are compacted
away.  The k best of every pair of blocks are merged per query.

Arithmetic is exact: floating point below 2^53, 64-bit integers below 2^63,
Python integers beyond (scores are then clipped to the long range).

Defined cases: null vectors, null ids and vectors holding a null or non-finite
component take no part; equal rows count once; rows that share an id but not the
vector are searched and found each; missing dimensions of shorter vectors are 0;
ties go to the smaller id; fewer than k candidates give all of them; an empty
table gives no row.  Only the id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_ROWS = 8192      # candidates in a block
QUERY_ROWS = 8192      # queries in a block
INNER_ROWS = 4096      # candidates that a task holds in vertical layout at once
DIMS = 16              # dimensions in a block
LONG = 2**63 - 1


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component; null for vectors that take no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    lengths = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    dims = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), dims), dtype=np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _widen(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many dimensions, as a type in which inner products are exact."""
    dims = max(q.shape[1], x.shape[1], 1)
    q, x = (np.pad(a, ((0, 0), (0, dims - a.shape[1]))) for a in (q, x))
    top = [max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) for a in (q, x)]
    kind = np.float64 if top[0] * top[1] * dims < 2**53 else np.int64 if top[0] * top[1] * dims < 2**63 else object
    return q.astype(kind), x.astype(kind)


def _rest(a: np.ndarray, starts: list[int]) -> np.ndarray:
    """For each start: length of every vector's part from there on, a little enlarged."""
    squares = a.astype(np.float64) ** 2
    return np.array([np.sqrt(squares[:, s:].sum(axis=1)) * (1 + 1e-9) for s in starts] + [np.zeros(len(a))])


class _Best:
    """The k best (score, id) of one query so far."""

    def __init__(self, k: int):
        self.k, self.rows, self.floor = k, [], -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k and scores.dtype != object:
            near = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[near], ids[near]
        self.rows = sorted([*self.rows, *((-int(s), i) for s, i in zip(scores.tolist(), ids.tolist()))])[: self.k]
        if len(self.rows) == self.k:
            self.floor = float(-self.rows[-1][0])


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query its best [(score, id)], its own id left out."""
    q, x = _widen(q, x)
    order = np.argsort(-(x.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    q, x = q[:, order], x[:, order]
    starts = list(range(0, x.shape[1], DIMS))
    q_rest = _rest(q, starts)
    best = [_Best(k) for _ in q_ids]
    for lo in range(0, len(x), INNER_ROWS):
        ids = x_ids[lo : lo + INNER_ROWS]
        columns = np.ascontiguousarray(x[lo : lo + INNER_ROWS].T)
        x_rest = _rest(x[lo : lo + INNER_ROWS], starts)
        for top in range(0, len(q), 256):
            first = q[top : top + 256, :DIMS] @ columns[:DIMS]
            for i, b in enumerate(best[top : top + 256], top):
                alive = np.flatnonzero(ids != q_ids[i])
                partial = first[i - top][alive]
                for at, start in enumerate(starts):
                    if at:
                        partial = partial + q[i, start : start + DIMS] @ columns[start : start + DIMS, alive]
                    reach = partial.astype(np.float64) + q_rest[at + 1, i] * x_rest[at + 1, alive]
                    keep = reach >= b.floor - 1e-9 * abs(b.floor) if np.isfinite(b.floor) else None
                    if keep is not None and not keep.all():
                        alive, partial = alive[keep], partial[keep]
                    if not len(alive):
                        break
                if len(alive):
                    b.add(partial, ids[alive])
    return [[(-s, i) for s, i in b.rows] for b in best]


def _pair_of_blocks(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"query_id": [], "query_row": [], "vec_id": [], "score": []}
        if len(candidates) and len(queries):
            q_ids, q_rows = queries["id"].to_numpy(), queries["row"].to_pylist()
            found = search(_matrix(queries["vec"]), q_ids, _matrix(candidates["vec"]), candidates["id"].to_numpy(), k)
            for i, (q, hits) in enumerate(zip(q_ids.tolist(), found)):
                for score, v in hits:
                    rows["query_id"].append(q), rows["query_row"].append(q_rows[i])
                    rows["vec_id"].append(v), rows["score"].append(min(max(score, -LONG - 1), LONG))
        return pa.table({n: pa.array(v, pa.int64()) for n, v in rows.items()})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 256.0, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` candidates with the highest inner product for every row that ``is_query`` holds for.

    Returns query_id, rank (from 1), vec_id, score.  Each of the N / ``block_rows`` candidate blocks meets each
    query block once, so rows move N * queries / ``query_rows`` + queries * N / ``block_rows`` times in all.
    """
    base = written(
        vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("vec"),
                       F.coalesce(is_query, F.lit(False)).alias("asks"))
        .filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
        .dropDuplicates(["id", "vec"]).withColumn("row", F.xxhash64("id", "vec")), "vectors")
    n, m = base.agg(F.count("*"), F.count_if("asks")).first()
    n_blocks, q_blocks = max(1, -(-n // block_rows)), max(1, -(-m // query_rows))
    deal = lambda blocks: F.pmod(F.col("row"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    candidates = base.select("id", "vec", "row", deal(n_blocks).alias("block"), every(q_blocks).alias("q_block"))
    queries = base.filter("asks").select("id", "vec", "row", deal(q_blocks).alias("q_block"), every(n_blocks).alias("block"))
    found = candidates.groupBy("q_block", "block").cogroup(queries.groupBy("q_block", "block")).applyInArrow(
        _pair_of_blocks(k), "query_id long, query_row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
