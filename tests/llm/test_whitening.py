"""Whitening against exact sums and a plain covariance."""

from fractions import Fraction

import numpy as np
import pytest

from valueflow.llm import whitening as W


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string")


def test_equals_plain_whitening(spark):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7))).astype(np.float32)
    rows = [(i, [float(c) for c in v], "k") for i, v in enumerate(base)]
    rows += [(300 + i, rows[0][1], "copy") for i in range(150)]  # a third of all rows
    rows += [(500, None, "n"), (501, [1.0, None], "n"), (502, [float("nan")] * 7, "n"), (503, [float("inf")] * 7, "n"), (None, rows[5][1], "k")]
    rows += [(504, [0.5, 0.25], "short")]
    found, model = W.whiten(table(spark, rows).repartition(5), 4)
    got = found.collect()
    ints = lambda v: tuple([int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (7 - len(v)))
    fit = sorted({ints(r[1]) for r in rows if r[2] in ("k", "copy", "short")})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    assert (model.n, model.sums) == (n, sums)
    d = [[n * c - s for c, s in zip(x, sums)] for x in fit]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in d), n**3)) for j in range(7)] for i in range(7)])
    values, columns = np.linalg.eigh(v)
    values, columns = values[::-1][:4], columns[:, ::-1][:, :4]
    assert np.allclose(model.explained, values / np.trace(v), rtol=1e-12) and model.identity_error < 1e-9
    signs = np.sign((model.components * columns.T).sum(axis=1))
    assert len(got) == 300 + 150 + 2 and {r["x"] for r in got} == {"k", "copy", "short"}
    source = {r[0]: r[1] for r in rows}
    for r in got:
        dev = [n * c - s for c, s in zip(ints(source[r["vec_id"]]), sums)]
        assert int(r["_white"]["deviation"]) == sum(c * c for c in dev)
        want = np.array(dev, dtype=float) / n @ columns / np.sqrt(values) * signs
        assert np.allclose(r["_white"]["whitened"], want, rtol=1e-10, atol=1e-10)


@pytest.mark.parametrize("top", [100, 2**27, 2**45, 2**58])
def test_sums_are_exact(top):
    x = np.random.default_rng(1).integers(-top, top, (4096, 3))
    x[:, 0] = top
    d = W.centred(x, 3, [5, -7, 11])
    plain = [[3 * int(c) - s for c, s in zip(r, (5, -7, 11))] for r in x]
    want = [sum(r[i] ** 2 for r in plain) for i in range(3)] + [sum((r[i] + r[j]) ** 2 for r in plain) for i, j in ((0, 1), (0, 2), (1, 2))]
    assert W.variance_sums(d) == want


def test_degenerate_tables(spark):
    one = [(i, [1.0, 2.0], "c") for i in range(4)]
    found, model = W.whiten(table(spark, one))
    assert model.n == 1 and model.identity_error is None
    assert all(r["_white"]["whitened"] == [None, None] and r["_white"]["deviation"] == 0 for r in found.collect())
    line = [(i, [float(i), 2.0 * i, 0.0], "c") for i in range(5)]  # one component only
    found, model = W.whiten(table(spark, line))
    assert model.explained == pytest.approx([1, 0, 0]) and model.identity_error < 1e-9
    assert found.first()["_white"]["whitened"][1:] == [None, None]
    for rows in ([], [(1, None, "c")], [(1, [], "c")]):
        found, model = W.whiten(table(spark, rows))
        assert found.count() == len([r for r in rows if r[1] is not None]) and model.explained == []
    huge, model = W.whiten(table(spark, [(1, [3e38, 1.0], "c"), (2, [-3e38, 2.0], "c")]))
    assert huge.count() == 2 and model.identity_error < 1e-9
    twice = W.whiten(table(spark, line).withColumnRenamed("x", "_white"))[0]
    assert twice.columns == ["vec_id", "embedding", "_white"]
