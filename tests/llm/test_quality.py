"""Quality: shapes, dual coordinate descent, held-out accuracy, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from valueflow.llm import quality as Q
from valueflow.llm.common import holdout, table

SF = "/root/testdata/sf0.1"


def test_shapes():
    assert [Q.shape(w) for w in ("word", "Word", "WORD!!", "a***", "|", "x9", "A", "mIx", "été.")] == ["a", "T", "A!!", "a***", "-|", "9", "T", "x", "a."]


def test_features_are_sorted_indicators():
    codes = Q._Codes()
    f = Q.features("the the cat sat", codes)
    assert (np.diff(f) > 0).all() and f.max() < Q.DIMS
    assert len(Q.features("", codes)) == len(Q.features(None, codes)) == len(Q.features(" \n", codes)) == 0
    assert not np.array_equal(Q.features("a a a a", codes), Q.features("a b a b", codes))


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(120)]
    y = np.array([int(r.sum() > 160) for r in rows])
    r = Q.log_count_ratios(rows, y)
    w, b = Q.dual_coordinate_descent(rows, y, r, epochs=400)
    x = np.zeros((len(rows), Q.DIMS))
    for i, idx in enumerate(rows):
        x[i, idx] = r[idx] / np.linalg.norm(r[idx])
    sign, share = np.where(y > 0, 1, -1), y.mean()
    cost = 0.5 / np.where(y > 0, share, 1 - share)
    loss = lambda w, b: (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - sign * (x @ w + b))).sum()
    best = loss(w, b)
    for _ in range(200):
        step = np.zeros(Q.DIMS)
        step[:40] = rng.normal(size=40) * 0.02
        assert loss(w + step, b + rng.normal() * 0.02) >= best - 1e-3 * best


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    held = Q.classify(docs, labels).filter(holdout(F.col("doc_id"))).join(labels, "doc_id").select("_quality.predicted", "quality", "_quality.score").collect()
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in held)


def test_cases(spark):
    rows = [(i, f"good plain words number {i} here.", "a") for i in range(40)] + [(100 + i, "BAD!! BAD!! BAD!!" + " x" * i, "a") for i in range(40)]
    rows += [(500, None, "a"), (501, "", "a"), (502, "word " * 50_000, "a"), (1, rows[1][1], "a"), (None, "no id", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(None, 1), (500, 0), (501, None)], "doc_id long, quality int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r["_quality"]["predicted"] == (r["doc_id"] < 100) for r in got if r["doc_id"] is not None and r["doc_id"] < 500)
    score = {r["doc_id"]: r["_quality"]["score"] for r in got}
    assert score[500] == score[501] and 0 <= score[502] <= 1
    none = Q.classify(docs, labels.limit(0)).select("_quality.score").distinct().collect()
    assert [r[0] for r in none] == [0.5]
    ones = Q.classify(docs, labels.filter("quality = 1")).select("_quality.predicted").distinct().collect()
    assert [r[0] for r in ones] == [1]
    assert Q.classify(docs.limit(0), labels).count() == 0
