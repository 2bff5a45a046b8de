"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records by a seeded hash of id and text into buckets that
fit in memory (their number follows the bytes).  Pass 2 brings each bucket's
records into a fixed order and shuffles them with Fisher-Yates.  Buckets in a
row form one random order of all records; dealing it out in turn gives shards
whose row counts differ by one at most (law ``rows``) and gapless slots.

Equal records (same id and text) have the same hash; where such copies would
fill more than a quarter of a bucket they are salted by row, which changes
nothing in the result as they cannot be told apart.

The order depends on seed, records and number of buckets only, not on files,
partitions or tasks.  Defined cases: null text has no bytes; null ids are
scattered by their text; an empty table gives no row; repeated rows each get a
slot; a column named like the result column is replaced, others stay whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, join_small, scratch, set_aside, written

BUCKET_BYTES = 8 << 20
SEED = 20_240


def record_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """Random order of 0..n-1: swap each place, from the last, with one up to it."""
    rng = np.random.Generator(np.random.PCG64([seed, bucket]))
    order = np.arange(n)
    if n > 1:
        at = rng.integers(0, np.arange(n, 1, -1))  # for i = n-1 .. 1 a place in 0..i
        for i, j in zip(range(n - 1, 0, -1), at.tolist()):
            order[i], order[j] = order[j], order[i]
    return order


def _shuffled(seed: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        by_key = np.argsort(rows["__key"].to_numpy(), kind="stable")
        pos = np.empty(len(by_key), dtype=np.int64)
        pos[by_key[fisher_yates(len(by_key), seed, key[0].as_py())]] = np.arange(len(by_key))
        return rows.append_column("__pos", pa.array(pos))

    return run


def shuffled_buckets(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Adds ``__bucket`` and ``__pos``, the place in the bucket's random order."""
    keyed = docs.withColumn("__key", _key(seed))
    per_key = keyed.select("__key", record_bytes(F.col("text")).alias("b")).groupBy("__key").agg(F.sum("b").alias("b"), F.count("*").alias("n"))
    total, hot = per_key.agg(F.sum("b"), F.count_if((F.col("n") > 1) & (F.col("b") > bucket_bytes // 4))).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    if hot:
        heavy = per_key.filter((F.col("n") > 1) & (F.col("b") > bucket_bytes // 4)).select(F.col("__key").alias("__heavy"))
        # numbers of written rows: a task that runs again finds the same salts
        keyed = join_small(written(keyed.withColumn("__row", F.monotonically_increasing_id()), "numbered"), heavy,
                           F.col("__key") == F.col("__heavy"), "left", BROADCAST_ROWS)
        salt = F.when(F.col("__heavy").isNotNull(), F.col("__row")).otherwise(0)
        keyed = keyed.withColumn("__bucket", F.pmod(F.xxhash64("__key", salt), F.lit(buckets))).drop("__heavy", "__row")
    else:
        keyed = keyed.withColumn("__bucket", F.pmod(F.xxhash64("__key", F.lit(0).cast("long")), F.lit(buckets)))
    schema = T.StructType([*keyed.schema.fields, T.StructField("__pos", T.LongType())])
    return keyed.groupBy("__bucket").applyInArrow(_shuffled(seed), schema)


def shard(docs: DataFrame, shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, out: str = "_shard") -> DataFrame:
    """Adds the struct ``out``: shard (0 to ``shards`` - 1) and slot (0, 1, ... in the shard).

    The shuffled buckets are written to the shared folder once; counts per bucket (one row per
    ``bucket_bytes`` of input) give each bucket its offset in the whole order.
    """
    spark = docs.sparkSession
    base, back = set_aside(docs.drop(out), ["__key", "__bucket", "__pos", "__heavy", "__row", "__b", "__n", "__offset"])
    path = scratch(spark, "buckets")
    done = shuffled_buckets(base, seed, bucket_bytes)
    done.write.parquet(path)
    stored = spark.read.schema(done.schema).parquet(path)
    offsets = stored.groupBy(F.col("__bucket").alias("__b")).agg(F.count("*").alias("__n")).withColumn(
        "__offset", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.col("__offset") + F.col("__pos")
    return back(join_small(stored, offsets, F.col("__bucket") == F.col("__b")).withColumn(
        out, F.struct((place % shards).cast("int").alias("shard"), F.floor(place / F.lit(shards)).cast("long").alias("slot"))
    ).drop("__b", "__offset", "__bucket", "__pos", "__key"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the shards as folders ``shard=N`` below ``path``; ``slot`` is the order inside a shard."""
    placed = shard(docs, shards, seed, bucket_bytes)
    placed.select(*[c for c in placed.columns if c != "_shard"], F.col("_shard.slot").alias("slot"), F.col("_shard.shard").alias("shard")).write.partitionBy("shard").parquet(path)
