"""Registered streaming queries (T-01 … T-03), each checked against its batch twin's SQL.

Each query writes a replay source derived from the ledger (a fixed number of
waves, each written by all tasks, under the checkpoint folder), runs the
stream to completion with ``availableNow`` and returns the sink's table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.nutrition import consumption_events
from ..operators.stock import ensure_consumption
from ..plans.catalog import register
from ..plans.queries_money import SNAPSHOT_SQL
from ..plans.queries_nutrition import _daily_sql
from ..sources.ingest import scratch_path
from ..sources.schema import MEASURES
from . import streams as ST

c = F.col


@register("t01_stream_balances", SNAPSHOT_SQL.format(payments="t_payments"))
def t01(led):
    spark = led.spark
    tx = led["t_transactions"].select(c("id").alias("transaction_id"), "transaction_at")
    timed = led["t_payments"].join(tx, "transaction_id", "left")
    src = scratch_path(spark, "payments-src")
    ST.write_waves(timed, src, [c("id") % 2 == 0, c("id") % 2 != 0])
    return ST.stream_balances(spark, src, timed.schema)


@register("t02_stream_consumption", "select * from decisions")
def t02(led):
    spark = led.spark
    lots = led["t_inventory"].select(c("id").alias("inventory_id"), "detail_id",
                                     c("current_quantity").alias("lot_quantity"))
    req = led["consume_requests"].join(lots, "inventory_id", "left")
    req = req.select(*[f.name for f in ST.DECISION_SCHEMA.fields if f.name not in ("accepted", "reason", "remaining_after")])
    src = scratch_path(spark, "requests-src")
    ST.write_waves(req, src, [c("seq") <= 1, c("seq") > 1], "inventory_id")
    return ST.stream_consumption(spark, src, req.schema)


@register("t03_stream_daily_nutrition", _daily_sql(MEASURES))
def t03(led):
    spark = led.spark
    ensure_consumption(led)
    ev = consumption_events(led)
    src = scratch_path(spark, "events-src")
    ST.write_waves(ev, src, [F.lit(True)])
    # history is replayed in any order, so nothing may count as late
    return ST.stream_daily_nutrition(spark, src, ev.schema, led, lateness="36525 days")
