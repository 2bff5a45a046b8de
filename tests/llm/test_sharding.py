"""Sharding: law, gapless slots, order that follows seed and records only."""

import numpy as np
from pyspark.sql import functions as F

from valueflow.llm import sharding


def test_fisher_yates():
    assert sharding.fisher_yates(0, 1, 1).tolist() == [] and sharding.fisher_yates(1, 1, 1).tolist() == [0]
    seen = np.zeros((4, 4))
    for b in range(4000):
        seen[np.arange(4), sharding.fisher_yates(4, 9, b)] += 1
    assert (abs(seen - 1000) < 150).all()


def check(rows, n, shards):
    by = {}
    for r in rows:
        by.setdefault(r["_shard"]["shard"], []).append(r["_shard"]["slot"])
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_rows_law_and_cases(spark):
    rows = [(i, f"text {i % 7}", "s") for i in range(500)] + [(None, f"n{i}", "s") for i in range(200)] + [(1, "text 1", "s")] * 3 + [(2, None, "s"), (3, "", "s"), (4, "x" * 200_000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string")
    a = sharding.shard(df, 8, bucket_bytes=2000).collect()
    check(a, len(rows), 8)
    b = sharding.shard(df.repartition(7, F.rand(1)), 8, bucket_bytes=2000).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"])[:20], r["_shard"]["shard"], r["_shard"]["slot"])
    assert sorted(map(key, a)) == sorted(map(key, b))
    assert a[0].asDict().keys() == {"doc_id", "text", "size", "_shard"}
    other = sharding.shard(df, 8, seed=2, bucket_bytes=2000).collect()
    assert sorted(map(key, a)) != sorted(map(key, other))
    assert sharding.shard(df.limit(0), 8).count() == 0


def test_hot_equal_rows_are_salted(spark):
    df = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same text again and again").alias("text"))
    check(sharding.shard(df, 3, bucket_bytes=4000).collect(), 3000, 3)
    sizes = sharding.shuffled_buckets(df, bucket_bytes=4000).groupBy("__bucket").count().agg(F.max("count")).first()[0]
    assert sizes < 600


def test_write(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i)) for i in range(20)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().agg(F.min("count"), F.max("count"), F.count("*")).first()[:] == (5, 5, 4)


def test_columns_named_like_helpers_stay_and_equal_rows_are_split(spark):
    rows = [(1, "same text " * 20, i, i) for i in range(400)] + [(i, f"text {i}", i, i) for i in range(500, 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key long, __bucket long").repartition(4)
    placed = sharding.shard(df, 4, bucket_bytes=4000)
    assert placed.columns == ["doc_id", "text", "__key", "__bucket", "_shard"]
    got = placed.collect()
    assert sorted((r["__key"], r["__bucket"]) for r in got) == sorted((r[2], r[3]) for r in rows)
    for s in range(4):
        slots = sorted(r["_shard"]["slot"] for r in got if r["_shard"]["shard"] == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / 4) <= 1
