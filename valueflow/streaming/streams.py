"""Structured Streaming variants of the running snapshots (T-01 … T-03).

* T-01 ``stream_balances``: streaming ``groupBy(wallet, expiry, restriction)``
  in update mode; each micro-batch's updated groups are appended by
  ``foreachBatch`` to an epoch-keyed folder (a replayed epoch overwrites its
  own folder, so the sink is idempotent); the snapshot is latest-wins per
  group over the epochs (S-07).
* T-02 ``stream_consumption``: state (remaining quantity of each lot, packed
  by bucket of lots) with ``applyInPandasWithState``; rows of a lot inside
  one micro-batch are folded in sequence order.
* T-03 ``stream_daily_nutrition``: stream-static join to the food
  dimension, watermark on the event time, 1-day tumbling windows.  Rows
  later than the watermark are dropped by the stream and re-done by the
  batch job (A-01), which stays the reference.

Sink and checkpoint paths are arguments: a stream that is called again with
them goes on where it stopped.  By default they are fresh folders under the
session's ``spark.checkpoint.dir`` (shared storage on a cluster).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalars as S
from ..operators.money import GROUP, is_limited
from ..operators.nutrition import with_food
from ..operators.stock import DECISION_SCHEMA, _accepted
from ..sources.ingest import scratch_path
from ..sources.schema import MEASURES

c = F.col


def write_waves(df: DataFrame, path: str, waves: list, by: str | None = None) -> None:
    """Write ``df`` as a replay source in a fixed number of waves, each by all tasks in one job.

    The file source replays older files first, so a wave arrives before the
    next.  ``waves`` are conditions that split the rows; with ``by`` rows of a
    key share a file within a wave.
    """
    for rows in waves:
        part = df.filter(rows)
        (part.repartition(by) if by else part).write.mode("append").parquet(path)


def _run(query_builder, checkpoint: str):
    q = query_builder.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _paths(spark: SparkSession, name: str, sink: str | None, checkpoint: str | None) -> tuple[str, str]:
    """Given paths make a stream resumable; missing ones are fresh scratch folders."""
    return sink or scratch_path(spark, f"{name}-sink"), checkpoint or scratch_path(spark, f"{name}-ckpt")


#: Epochs after which a sink is merged.
COMPACT = 16


def _folders(spark: SparkSession, sink: str) -> tuple[list[int], list[int]]:
    """Epochs of the whole snapshots and of the epoch folders of a sink."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = folder(sink).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder(sink))] if fs.exists(folder(sink)) else []
    number = lambda kind: sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))
    return [n for n in number("snapshot") if fs.exists(folder(f"{sink}/snapshot={n}/_SUCCESS"))], number("epoch")


def _latest(spark: SparkSession, sink: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """The newest row per ``keys``: the last whole snapshot and the epochs after it."""
    snapshots, epochs = _folders(spark, sink)
    last = snapshots[-1] if snapshots else -1
    paths = [f"{sink}/snapshot={last}"] * bool(snapshots) + [f"{sink}/epoch={e}" for e in epochs if e > last]
    stored = T.StructType([*schema.fields, T.StructField("at_epoch", T.LongType())])
    rows = spark.read.schema(stored).parquet(*paths) if paths else spark.createDataFrame([], stored)
    rest = [f.name for f in stored.fields if f.name not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "at_epoch").alias("newest")).select(*keys, *[f"newest.{r}" for r in rest])


def _epoch_sink(sink: str, keys: list[str], shape=lambda batch: batch):
    """What ``foreachBatch`` calls: stores an epoch's rows; every ``COMPACT`` epochs merges the sink and deletes what is covered."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark, rows = batch.sparkSession, shape(batch)
        rows.withColumn("at_epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
        if (epoch + 1) % COMPACT:
            return
        snapshots, _ = _folders(spark, sink)
        if epoch not in snapshots:
            _latest(spark, sink, keys, rows.schema).write.mode("overwrite").parquet(f"{sink}/snapshot={epoch}")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = folder(sink).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        snapshots, epochs = _folders(spark, sink)
        for old in [f"snapshot={n}" for n in snapshots if n < epoch] + [f"epoch={n}" for n in epochs if n <= epoch]:
            fs.delete(folder(f"{sink}/{old}"), True)

    return merge


# T-01 -----------------------------------------------------------------------
def stream_balances(spark: SparkSession, source: str, schema: T.StructType, sink: str | None = None,
                    checkpoint: str | None = None, files_per_trigger: int = 64) -> DataFrame:
    """Balance snapshot maintained by a streaming aggregate over timed payment files."""
    sink, checkpoint = _paths(spark, "balances", sink, checkpoint)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    agg = (stream.filter(c("wallet_id").isNotNull()).groupBy(*GROUP)
           .agg(F.sum("amount").cast("long").alias("current_amount"), F.max("id").alias("last_id"),
                F.max("transaction_at").alias("updated_at")))
    _run(agg.writeStream.outputMode("update").foreachBatch(_epoch_sink(sink, GROUP)), checkpoint)
    latest = _latest(spark, sink, GROUP, agg.schema)
    return latest.select(*GROUP, F.when(is_limited(), c("last_id")).alias("origin_payment_id"),
                         "current_amount", "updated_at")


# T-02 -----------------------------------------------------------------------
# Buckets of lots: a call and a state cover the lots of a bucket, as both cost more than a lot's few requests.
LOT_BUCKETS = 8192
#: What is left of a bucket's lots: ids (64-bit integers, ascending) and quantities (doubles), packed.
STATE_SCHEMA = T.StructType([T.StructField("lots", T.BinaryType()), T.StructField("remaining", T.BinaryType())])

#: Long columns travel as 0 for null, with a bit each in ``nulls``: pandas would make doubles of a column with a null.
_LONGS = [f.name for f in DECISION_SCHEMA.fields if isinstance(f.dataType, T.LongType)]
_FILLED = T.StructType([*DECISION_SCHEMA.fields, T.StructField("nulls", T.LongType())])


def _place(pdf: pd.DataFrame) -> np.ndarray:
    """Order of the rows by lot, then (seq, request_id), nulls first."""
    seen = lambda n: (pdf["nulls"].to_numpy() >> _LONGS.index(n)) & 1 == 0
    return np.lexsort((pdf["request_id"], seen("request_id"), pdf["seq"], seen("seq"), pdf["inventory_id"]))


def _consume_with_state(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold the requests of a bucket's lots, each against what is left of its lot (a bucket has null lots only or none)."""
    parts = [p for p in pdfs if len(p)]
    if not parts:
        return
    pdf = pd.concat(parts)
    pdf = pdf.iloc[_place(pdf)]
    held, remaining = ([np.frombuffer(x, t) for x, t in zip(state.get, ("<i8", "<f8"))] if state.exists else (np.zeros(0, "<i8"), np.zeros(0, "<f8")))
    lots, amounts, qty = pdf["inventory_id"].to_numpy(), *(pdf[n].to_numpy(dtype="float64", na_value=np.nan) for n in ("amount", "lot_quantity"))
    starts = np.flatnonzero(np.concatenate(([True], lots[1:] != lots[:-1])))
    ids, ends = lots[starts], [*starts[1:].tolist(), len(lots)]
    # a lot starts from its state, else from the first quantity that its requests carry
    known = np.flatnonzero(qty == qty)
    first = np.concatenate((known, [len(qty)]))[np.searchsorted(known, starts)]
    left = np.where(first < ends, np.concatenate((qty, [np.nan]))[first], np.nan)
    at = np.searchsorted(held, ids)
    old = np.zeros(len(ids), dtype=bool)
    old[at < len(held)] = held[at[at < len(held)]] == ids[at < len(held)]
    left[old] = remaining[at[old]]
    accepted, after = np.zeros(len(lots), dtype=bool), np.full(len(lots), np.nan)
    for lo, hi, begin in zip(starts.tolist(), ends, left.tolist()):
        if begin == begin:
            accepted[lo:hi], after[lo:hi] = _accepted(amounts[lo:hi], begin)
    none = after != after  # unknown lots: nothing to take from, and no state until they are known
    reason = np.where(accepted, "", np.where(none, "NO_LOT", np.where(~(amounts >= 0), "INVALID_AMOUNT", "OVERDRAW")))
    now = after[np.asarray(ends) - 1]
    if (now == now).any():
        remaining = remaining.copy()
        remaining[at[old]] = now[old]
        fresh = ~old & (now == now)
        held, remaining = np.concatenate((held, ids[fresh])), np.concatenate((remaining, now[fresh]))
        order = np.argsort(held, kind="stable")
        state.update((held[order].astype("<i8").tobytes(), remaining[order].astype("<f8").tobytes()))
    yield pdf.assign(accepted=accepted, reason=reason, remaining_after=np.where(none, 0.0, after))[_FILLED.names]


def stream_consumption(spark: SparkSession, source: str, schema: T.StructType, sink: str | None = None,
                       checkpoint: str | None = None, files_per_trigger: int = 64) -> DataFrame:
    """Accept / reject consumption requests as they arrive; state = what is left of each lot, kept by bucket of lots.

    Rows carry their lot's quantity; without one (the lot is unknown when they arrive) they are rejected as ``NO_LOT``.
    """
    sink, checkpoint = _paths(spark, "consumption", sink, checkpoint)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    # requests of unknown lots need no state: they are dealt by themselves, below zero
    dealt = lambda n: F.pmod(F.xxhash64(n), F.lit(LOT_BUCKETS))
    bucket = (F.when(c("lot_quantity").isNull() & c("request_id").isNotNull(), -1 - dealt("request_id"))
              .when(c("inventory_id").isNull(), F.lit(LOT_BUCKETS)).otherwise(dealt("inventory_id")))
    nulls = sum((F.when(c(n).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, n in enumerate(_LONGS)), F.lit(0).cast("long"))
    filled = stream.select(bucket.cast("long").alias("bucket"), nulls.alias("nulls"),
                           *[F.coalesce(c(n), F.lit(0)).cast("long").alias(n) if n in _LONGS else c(n) for n in stream.columns])
    decided = filled.groupBy("bucket").applyInPandasWithState(_consume_with_state, _FILLED, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    # the fold answers without nulls: no reason is '', and an unknown lot has nothing left
    decided = decided.withColumns({"reason": F.when(c("reason") != "", c("reason")), "remaining_after": F.when(c("reason") != "NO_LOT", c("remaining_after"))})
    there = lambda n: F.when(c("nulls").bitwiseAND(F.lit(1 << _LONGS.index(n))) == 0, c(n)).alias(n)
    decided = decided.select(*[there(f.name) if f.name in _LONGS else c(f.name).cast(f.dataType) for f in DECISION_SCHEMA.fields])
    _run(decided.writeStream.outputMode("append").format("parquet").option("path", sink), checkpoint)
    return spark.read.schema(DECISION_SCHEMA).parquet(sink)


# T-03 -----------------------------------------------------------------------
def stream_daily_nutrition(spark: SparkSession, source: str, schema: T.StructType, led, lateness: str = "7 days",
                           sink: str | None = None, checkpoint: str | None = None, files_per_trigger: int = 64) -> DataFrame:
    """Per-day measure sums from a stream of consumption events (update mode, latest wins).

    The day is taken from the naive time and carried as that day's first
    instant since the epoch, so windows and results do not depend on the
    session's time zone.
    """
    sink, checkpoint = _paths(spark, "nutrition", sink, checkpoint)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    ev = with_food(stream, led)  # stream-static join to the food dimension
    day = F.timestamp_seconds(F.unix_date(F.to_date("eaten_at")).cast("long") * 86400)
    ev = ev.withColumn("day_at", day).withWatermark("day_at", lateness)
    agg = ev.groupBy(F.window("day_at", "1 day").alias("w")).agg(
        *[S.decimal_sum(S.nutrient_amount("food_type", "qty", m)).alias(m) for m in MEASURES])
    dated = lambda batch: batch.select(F.date_from_unix_date((F.unix_seconds("w.start") / 86400).cast("int")).alias("day"), *MEASURES)
    _run(agg.writeStream.outputMode("update").foreachBatch(_epoch_sink(sink, ["day"], dated)), checkpoint)
    latest = _latest(spark, sink, ["day"], T.StructType([T.StructField("day", T.DateType()), *(agg.schema[m] for m in MEASURES)]))
    return latest.select("day", *[c(m).cast("double").alias(m) for m in MEASURES])
