"""Exact top-k against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from valueflow.llm import topk


def brute(q, q_id, x, ids, k):
    found = sorted((-sum(int(a) * int(b) for a, b in zip(q, v)), i) for v, i in zip(x, ids) if i != q_id)
    return [(-s, i) for s, i in found[:k]]


@pytest.mark.parametrize("top", [40, 2**30, 2**60])
def test_search_equals_brute_force(top):
    rng = np.random.default_rng(3)
    x = rng.integers(-top, top, (300, 37), dtype=np.int64)
    x[50:90] = x[50]  # ties
    ids = np.arange(300)
    got = topk.search(x[:60], ids[:60], x, ids, 5)
    for i in range(60):
        assert got[i] == brute(x[i], i, x, ids, 5)


def test_blocks_and_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(v)) for v in rng.normal(size=8)], "r") for i in range(200)]
    rows += [(200, None, "r"), (250, [float("nan")] * 8, "r"), (300, [None, 1.0], "r"), (350, [float("inf")] * 8, "r"), (None, [1.0] * 8, "r")]
    rows += [rows[3], rows[50], (400, [1.0, 2.0], "r"), (450, [], "r")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, block_rows=64, query_rows=2).collect()
    ints = {r[0]: [int(np.floor(256 * float(np.float32(c)))) for c in r[1]] for r in rows if r[0] is not None and r[0] not in (200, 250, 300, 350)}
    for q in (0, 50, 100, 150, 400, 450):
        mine = [(r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert mine == brute(ints[q], q, list(ints.values()), list(ints), 5), q
    assert {r["query_id"] for r in got} == {0, 50, 100, 150, 400, 450}
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    two = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in two] == [(0, 1, 1, 256 * 512)]
