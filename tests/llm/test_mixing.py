"""Mixing: targets against an iterative fill, copies, reruns, edge cases."""

import re

from pyspark.sql import functions as F

from valueflow.llm import mixing


def filled(sizes, cap=3):
    """Iterative twin: share by weight, stop what is above, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, free = {}, sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * sizes[s] + 1e-9}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rate string")
    return df, mixing.mix(df)


def test_targets_copies_and_cases(spark):
    rows = [(i, "word " * (i % 11), f"s{i % 5}", "x") for i in range(400)]
    rows += [(i, "a b c", "tiny", "x") for i in range(500, 503)] + [(i, "é x\ty", None, "x") for i in range(600, 640)]
    rows += [(700, None, "void", "x"), (701, "", "void", "x"), (702, " \t\n", "void", "x"), (None, "one two", "s1", "x"), (5, "word " * 5, "s0", "x"), (800, "w " * 50_000, "s2", "x")]
    df, mixed = run(spark, rows)
    got = mixed.collect()
    assert len(got) == len(rows) and set(mixed.columns) == {*df.columns, "_mix"}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = filled(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        m = r["_mix"]
        assert m["size"] == size(r["text"]) and m["source_size"] == sizes[r["source"]]
        assert abs(m["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert int(m["rate"]) <= m["copies"] <= min(3, int(m["rate"]) + 1)
        taken[r["source"]] += m["size"] * m["copies"]
    for s in ("s0", "s1", "s3", "s4", "tiny", None):
        assert abs(taken[s] - want[s]) <= 0.05 * want[s] + 12, (s, taken[s], want[s])
    again = mixing.mix(df.repartition(5, "text"))
    key = lambda r: (str(r["doc_id"]), str(r["text"])[:30], r["_mix"]["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))
    out = mixing.emit(mixed)
    assert out.columns == df.columns and out.count() == sum(r["_mix"]["copies"] for r in got)


def test_empty_and_given_weights(spark):
    _, mixed = run(spark, [])
    assert mixed.count() == 0
    df, _ = run(spark, [(1, "a b", "p", "x"), (2, "c d e f", "q", "x"), (3, "z", None, "x")])
    weights = spark.createDataFrame([("p", 1.0), ("q", 1.0)], "source string, weight double")
    got = {r["source"]: r["_mix"]["target"] for r in mixing.mix(df, weights).collect()}
    assert got == {"p": 3.0, "q": 3.0}


def test_draws_are_uniform(spark):
    u = spark.range(4000).select(*[mixing.uniform(mixing.draws(F.col("id"), F.lit("t")), j).alias(f"u{j}") for j in range(8)])
    for v in u.agg(*[F.avg(c) for c in u.columns]).first():
        assert abs(v - 0.5) < 0.03


def test_equal_rows_share_their_copies_out(spark):
    rows = [(1, "ten words " * 5, "hot", str(i)) for i in range(1000)] + [(i, "word " * 20, f"s{i % 2}", "x") for i in range(2, 1002)] + [(None, None, None, "n")] * 50
    rows += [(7, "same in two sources", s, "x") for s in ("hot", "s0", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __size string").repartition(7)
    sums = []
    for part in (df, df.repartition(3)):
        got = mixing.mix(part).collect()
        assert len(got) == len(rows) and sorted(r["__size"] for r in got) == sorted(r[3] for r in rows)
        taken, target = {}, {}
        for r in got:
            m = r["_mix"]
            assert int(m["rate"]) <= m["copies"] <= min(3, int(m["rate"]) + 1)
            taken[r["source"]] = taken.get(r["source"], 0) + m["size"] * m["copies"]
            target[r["source"]] = m["target"]
        assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 20 for s in taken), (taken, target)
        sums.append(sorted((str(r["doc_id"]), str(r["source"]), r["_mix"]["copies"]) for r in got))
    assert sums[0] == sums[1]


def test_columns_named_like_helpers_stay(spark):
    df = spark.createDataFrame([(1, "a b", "s", 4, 5, 6)], "doc_id long, text string, source string, __hex long, __plan long, __copy long")
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "_mix"] and tuple(mixed.first())[:6] == (1, "a b", "s", 4, 5, 6)
    assert [tuple(r) for r in mixing.emit(mixed).collect()] == [(1, "a b", "s", 4, 5, 6)]
