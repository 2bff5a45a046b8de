"""Jaccard join against all pairs; components; posterior bounds."""

import math
import random
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from valueflow.llm import common
from valueflow.llm import jaccard_join as J
from valueflow.llm.common import among, bits_of, words
from valueflow.llm.components import components


def all_pairs(texts):
    sets = []
    for t in texts:
        w = words(t)
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else None)
    links = set()
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                linked = 9 * both >= 4 * (len(sets[a]) + len(sets[b]))
            else:
                linked = texts[a] is not None and texts[a] == texts[b]
            if linked:
                links.add((b, a))
    return links


def roots(n, links):
    at = list(range(n))
    for a, b in links:
        x, y = at[a], at[b]
        at = [min(x, y) if v in (x, y) else v for v in at]
    return at


def test_equals_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrst")
    shared = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 20, 80, 150]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            other = list(base)
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = word()
            texts.append(rng.choice([" ", ", ", "\n"]).join(other).upper())
    texts += [shared + " " + " ".join(word() for _ in range(40)) for _ in range(30)]
    texts += [texts[0]] * 20 + [None, None, "", "", "...", "...", "!", "one", "ONE", "two words", "very " * 5000, "very " * 6000]
    ids = [i * 3 + 7 for i in range(len(texts))]
    ids[5] = None
    df = spark.createDataFrame([(i, t, "z") for i, t in zip(ids, texts)], "doc_id long, text string, rid string").repartition(5)
    links = all_pairs(texts)
    root = roots(len(texts), links)
    degree = [sum(i in p for p in links) for i in range(len(texts))]
    for hot, block in ((J.HOT, J.BLOCK), (3, 4), (2, 512)):  # pairs mostly, clusters of several blocks, clusters only
        check(J.join(df, hot=hot, block=block).collect(), ids, texts, root, degree)
    assert J.join(df.limit(0)).count() == 0


def check(got, ids, texts, root, degree):
    assert len(got) == len(texts)
    for r in got:
        if r["doc_id"] is not None:
            i = ids.index(r["doc_id"])
            least = min(ids[k] for k in range(len(texts)) if root[k] == root[i] and ids[k] is not None)
            assert (r["_near"]["class_id"], r["_near"]["n_links"]) == (least, degree[i]), texts[i]
    assert sum(r["_near"]["first"] for r in got) == len(set(root))


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "x y")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["_near"]["class_id"], r["_near"]["n_links"]) for r in J.join(df).collect())
    assert got == [(1, 1, 2)] * 3 + [(2, 2, 0)]
    assert sum(r["_near"]["first"] for r in J.join(df).collect()) == 2


def test_posterior_bounds():
    """The fewest matches kept, against the posterior integrated over a grid."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    for n, least in J.fewest_matches(0.8, 1e-6).items():
        for m in (least - 1, least):
            log = m * np.log(grid) + (n - m) * np.log(1 - grid)
            p = np.exp(log - log.max())
            tail = p[grid >= 0.8].sum() / p.sum()
            assert (tail >= 1e-6) == (m >= least), (n, m, tail)
    lost = sum(math.comb(32, m) * 0.8**m * 0.2 ** (32 - m) for m in range(J.fewest_matches()[32]))
    assert lost < 1e-4


def test_prefix_filter_keeps_every_pair(spark):
    """Whatever the rarity table, pairs that reach the threshold share a prefix token."""
    rng = random.Random(2)
    texts = []
    for _ in range(40):
        base = [rng.choice("abcdefgh") for _ in range(rng.randint(5, 60))]
        other = list(base)
        other[rng.randrange(len(other))] = "zz"
        texts += [" ".join(base), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    cache = J._WordHashes()
    sets = [set(J.shingles(t, cache).tolist()) for t in texts]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    for table in (np.zeros(J.COUNTERS, np.int32), np.random.default_rng(1).integers(0, 50, J.COUNTERS).astype(np.int32)):
        found = {tuple(r)[:2] for r in J.candidates(J.prefix_tokens(df, table, 0.8), 0.8, 10_000).collect()}
        assert want <= found


def test_tokens_of_many_documents_give_stars(spark):
    """Over one partition with small batches: a star per hot token, whatever batches cut it."""
    rows = [(1, i, 10, 0) for i in range(50)] + [(2, i, 10, 0) for i in range(3)] + [(3, i, 10, 0) for i in range(10, 40)] + [(4, 7, 10, 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = sorted(tuple(r) for r in J.candidates(spark.createDataFrame(rows, "token long, rid long, n int, pos int"), 0.8, 10).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted([(0, i, True) for i in range(1, 50)] + [(0, 1, False), (0, 2, False), (1, 2, False)] + [(10, i, True) for i in range(11, 40)])


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    y = np.unique(np.concatenate([x[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    real = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((J.signature(x) == J.signature(y)).mean() - real) < 0.15


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    at = {n: n for p in links for n in p}
    for a, b in links:
        x, y = at[a], at[b]
        at = {n: min(x, y) if v in (x, y) else v for n, v in at.items()}
    alone = {a for a, b in links if a == b} - {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: v for n, v in at.items() if n not in alone}


def test_columns_named_like_helpers_stay(spark):
    df = spark.createDataFrame([(1, "one two three four five six", "a", "b"), (2, "one two three four five six", "c", "d")], "doc_id long, text string, __rid string, __print string")
    got = J.join(df)
    assert got.columns == ["doc_id", "text", "__rid", "__print", "_near"]
    assert sorted((r["doc_id"], r["__rid"], r["__print"], r["_near"]["class_id"], r["_near"]["n_links"]) for r in got.collect()) == [(1, "a", "b", 1, 1), (2, "c", "d", 1, 1)]


def test_phrases_do_not_tie_documents(spark, monkeypatch):
    """Documents of two out of six passages share tokens with all others, but only A B and B A are near copies."""
    passages = [[f"w{i}x{k}" for k in range(30)] for i in range(6)]
    texts = {10 * i + j: " ".join(passages[i] + passages[j]) for i in range(6) for j in range(6) if i != j}
    sizes, within = [], J.within_clusters

    def watched(members, *args):
        sizes.extend(r["count"] for r in members.groupBy("cluster").count().collect())
        return within(members, *args)

    monkeypatch.setattr(J, "within_clusters", watched)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for block in (J.BLOCK, 4):
        sizes.clear()
        got = {r["doc_id"]: (r["_near"]["class_id"], r["_near"]["n_links"]) for r in J.join(df, hot=3, block=block).collect()}
        assert got == {d: (min(d, 10 * (d % 10) + d // 10), 1) for d in texts}
        assert max(sizes, default=0) <= 2


def test_among(spark, monkeypatch):
    """Numbers at the edges of a row of bits and in several partitions; by broadcast and by join, wide rows unmoved by the first."""
    numbers = [0, 1, 2, 8, 9, 32_767, 32_768, 32_769, 1 << 33, (1 << 33) + 1, (1 << 33) + 40_000, (5 << 33) + 7]
    for asked in (numbers[::2], numbers[1::2], numbers, []):
        df = spark.createDataFrame([(n, "x" * 50) for n in numbers] + [(numbers[3], "again")], "n long, text string")
        ids = spark.createDataFrame([(n,) for n in asked] * 2, "i long")
        want = sorted(r["n"] for r in df.collect() if r["n"] in asked)
        found = among(df, "n", bits_of(ids))
        assert found.columns == df.columns and sorted(r["n"] for r in found.collect()) == want
        assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(common, "BROADCAST_BITS", 0)
            assert sorted(r["n"] for r in among(df, "n", bits_of(ids)).collect()) == want


def test_written_leaves_no_shuffle_files(spark):
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    files = lambda: {str(p) for d in dirs for p in Path(d.getPath()).rglob("shuffle_*")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(key)
    back = common.written(spark.range(5000).groupBy((F.col("id") % 50).alias("k")).agg(F.collect_list("id").alias("l")), "grouped")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(key) == setting
    assert back.count() == 50
