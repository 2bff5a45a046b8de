"""Micro-fixture tests, one per operator rule (values are ours)."""

import datetime as dt
import difflib

from pyspark.sql import Window
from pyspark.sql import functions as F

from valueflow.functions import scalars as S
from valueflow.operators import goods as G
from valueflow.operators import matching as Z
from valueflow.operators import money as M
from valueflow.operators import quality as Q
from valueflow.operators import stock as K
from valueflow.operators.windows import bucketed_running_sum
from valueflow.sources import ingest as I

TS = "timestamp_ntz"


def test_serial_round_trip(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (46023.0,), (45000.999988426,)], "x double")
    out = df.select("x", S.ts_to_serial(S.serial_to_ts("x")).alias("back"), S.serial_to_ts("x").alias("ts")).collect()
    for r in out:
        assert abs(r.back - r.x) < 1.0 / 86400 + 1e-9
    assert out[1].ts == dt.datetime(1899, 12, 31, 12, 0)


def test_parse_dates(spark):
    vals = ["20260228", "20260230", "2026022", "２０２６０２２８", "", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.d for r in df.select(S.parse_yyyymmdd("s").alias("d")).collect()]
    assert got == [dt.datetime(2026, 2, 28), None, None, dt.datetime(2026, 2, 28), None, None]
    df2 = spark.createDataFrame([("202602281330",), ("20260228",), ("x",)], "s string")
    got2 = [r.d for r in df2.select(S.parse_yyyymmddhhmm("s", S.ts_lit("2000-01-01 00:00:00")).alias("d")).collect()]
    assert got2 == [dt.datetime(2026, 2, 28, 13, 30), dt.datetime(2026, 2, 28), dt.datetime(2000, 1, 1)]


def test_month_range(spark):
    df = spark.createDataFrame([("202602",), ("202612",), ("202613",), ("20261",)], "ym string")
    r = df.select(S.month_start("ym").alias("s"), S.month_last_second("ym").alias("e")).collect()
    assert r[0].s == dt.datetime(2026, 2, 1) and r[0].e == dt.datetime(2026, 2, 28, 23, 59, 59)
    assert r[1].e == dt.datetime(2026, 12, 31, 23, 59, 59)
    assert r[2].s is None and r[3].s is None


def test_default_tax(spark):
    df = spark.createDataFrame([(True, "UNIVERSAL", None), (True, "OUT_EAT", None), (False, "UNIVERSAL", None),
                                (True, "UNIVERSAL", 0.0)], "pub boolean, ft string, given double")
    got = [r.t for r in df.select(S.default_tax_rate("pub", "ft", "given").alias("t")).collect()]
    assert got == [0.08, 0.10, 0.0, 0.0]


def _receipt_ledger(ledger, spark, lines, adj=1):
    ledger["t_transaction_details"] = spark.createDataFrame(
        [(i, 1, p, q, t, d) for i, (p, q, t, d) in enumerate(lines)],
        "id long, transaction_id long, unit_price_ex_tax double, quantity double, tax_rate double, discount_amount double")
    ledger["t_transactions"] = spark.createDataFrame([(1, adj)], "id long, tax_adjustment_jpy long")
    return ledger


def test_receipt_totals(ledger, spark):
    led = _receipt_ledger(ledger, spark, [(99.0, 1.0, 0.08, None)] * 3)
    assert G.receipt_checkout_total(led).first().checkout_total == 318
    assert G.receipt_display_total(led).first().display_total == 318
    r = G.receipt_rounded_once(led).first()
    assert (r.rounded_total, r.receipt_total) == (320, 321)


def test_discount_floor(ledger, spark):
    led = _receipt_ledger(ledger, spark, [(100.0, 1.0, 0.1, 150.0)])
    assert G.receipt_checkout_total(led).first().checkout_total == 0


def _pay(spark, rows):
    return spark.createDataFrame(rows, "id long, transaction_id long, wallet_id long, amount long, "
                                       "expiry_at timestamp_ntz, usage_restriction string")


def test_offset_limited_funds(spark):
    e1, e2 = dt.datetime(2030, 1, 1), dt.datetime(2030, 2, 1)
    pay = _pay(spark, [(1, 1, 7, 300, e1, None), (2, 2, 7, 500, e2, None)])
    mv = lambda amt: spark.createDataFrame([(10, 10, 7, amt, None, None, None)],
                                           "movement_id long, transaction_id long, wallet_id long, amount long, "
                                           "requested_offset long, new_expiry_text string, new_restriction string")

    def run(amt, cap):
        rows = M.offset_limited_funds(pay, mv(amt), cap=cap).orderBy(F.col("lot_no").asc_nulls_last()).collect()
        return [(r.kind, r.amount) for r in rows]

    assert run(400, True) == [("OFFSET", -300), ("OFFSET", -100)]
    assert run(1000, True) == [("OFFSET", -300), ("OFFSET", -500), ("RESIDUAL", -200)]
    assert run(400, False) == [("OFFSET", -300), ("OFFSET", -500), ("RESIDUAL", 400)]


def test_balance_snapshot_groups(spark):
    e = dt.datetime(2030, 1, 1)
    rows = []
    for k, (exp, res) in enumerate([(None, None), (e, None), (None, "R"), (e, "R")]):
        rows += [(10 * k + 1, 1, 7, 5, exp, res), (10 * k + 2, 1, 7, 6, exp, res)]
    p = _pay(spark, rows).withColumn("transaction_at", F.lit(None).cast(TS))
    snap = {(r.expiry_at, r.usage_restriction): r for r in M.balance_snapshot(p).collect()}
    assert len(snap) == 4
    assert snap[(None, None)].origin_payment_id is None and snap[(None, None)].current_amount == 11
    assert snap[(e, "R")].origin_payment_id == 32


def test_greedy_consumption(spark):
    lots = spark.createDataFrame([(1, 100, 10.0, dt.datetime(2020, 1, 1))],
                                 "id long, detail_id long, current_quantity double, updated_at timestamp_ntz")
    req = spark.createDataFrame([(i, 1, 5, a, "SELF", dt.datetime(2020, 1, 2), i) for i, a in
                                 enumerate([5.0, 7.0, 3.0, -1.0], start=1)] + [(9, 2, 5, 1.0, "SELF", None, 1)],
                                "request_id long, inventory_id long, meal_id long, amount double, consume_type string, "
                                "requested_at timestamp_ntz, seq long")
    out = K.record_consumption(req, lots)
    dec = {r.request_id: (r.accepted, r.reason) for r in out["decisions"].collect()}
    assert dec == {1: (True, None), 2: (False, "OVERDRAW"), 3: (True, None), 4: (False, "INVALID_AMOUNT"),
                   9: (False, "NO_LOT")}
    assert out["t_inventory"].first().current_quantity == 2.0


def test_empty_meal_dropped(spark):
    lots = spark.createDataFrame([(1, 100, 1.0, dt.datetime(2020, 1, 1))],
                                 "id long, detail_id long, current_quantity double, updated_at timestamp_ntz")
    req = spark.createDataFrame([(1, 1, 5, 2.0, "SELF", dt.datetime(2020, 1, 2), 1),
                                 (2, 1, 6, 0.5, "SELF", dt.datetime(2020, 1, 3), 2)],
                                "request_id long, inventory_id long, meal_id long, amount double, consume_type string, "
                                "requested_at timestamp_ntz, seq long")
    meals = [r.id for r in K.record_consumption(req, lots)["t_meal_logs"].collect()]
    assert meals == [6]


def test_bucketed_running_sum_matches_window(spark):
    rows = [(i, (i % 3) if i % 5 else None, (i * 7) % 11 - 5) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "id long, k long, v long")
    got = {r.id: r.rs for r in bucketed_running_sum(df, ["k"], "id", "v", "rs", bucket_width=16).collect()}
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r.rs for r in df.withColumn("rs", F.sum("v").over(w)).collect()}
    assert got == want


def test_rate_as_of(spark):
    rates = spark.createDataFrame([(1, 1, 2.0, dt.datetime(2020, 1, 1)), (2, 1, 3.0, dt.datetime(2020, 1, 10)),
                                   (3, 1, 4.0, dt.datetime(2020, 3, 1))],
                                  "id long, currency_id long, rate_to_jpy double, effective_at timestamp_ntz")
    facts = spark.createDataFrame([(1, 1, dt.datetime(2019, 12, 31)), (2, 1, dt.datetime(2020, 1, 10)),
                                   (3, 1, dt.datetime(2020, 2, 5)), (4, 1, dt.datetime(2021, 1, 1))],
                                  "fid long, currency_id long, t timestamp_ntz")
    got = {r.fid: r.rate_to_jpy for r in M.rate_as_of(facts, rates, "t").collect()}
    assert got == {1: None, 2: 3.0, 3: 3.0, 4: 4.0}


def test_due_status(spark):
    now = "2026-01-10 12:00:00"
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1), True), (dt.datetime(2026, 1, 1), False),
                                (dt.datetime(2026, 1, 11), True), (dt.datetime(2026, 1, 15), True), (None, False)],
                               "due timestamp_ntz, real boolean")
    got = [r.s for r in df.select(S.due_status("due", "real", now).alias("s")).collect()]
    assert got == ["EXPIRED", "GUIDELINE_EXCEEDED", "SOON", "", ""]


def test_similarity_top3_matches_stdlib(spark):
    names = ["small ring Brand#2", "small ring Brand#3", "red widget Brand#17", "blue bolt Brand#4",
             "small bolt Brand#12", "hot gear Brand#3", "old bolt Brand#17", "small gizmo Brand#25"]
    queries = ["small ring", "SMALL BOLT Brand#12", "bolt", "zzzz"]
    masters = spark.createDataFrame([(i, n, "UNIVERSAL") for i, n in enumerate(names)], "id long, name string, kind string")
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    got = {}
    for r in Z.top_candidates(q, masters).collect():
        got.setdefault(r.query, []).append((r.rank, r.name))
    for x in queries:
        want = difflib.get_close_matches(x, names, n=3, cutoff=0.4)
        assert [n for _, n in sorted(got.get(x, []))] == want


def test_apply_updates_latest_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    upd = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "id long, name string, seq long")
    assert {r.id: r.name for r in I.apply_updates(base, upd, "id").collect()} == {1: "y", 2: "z"}


def test_quality_checks_find_violations(ledger, spark):
    ledger["t_payments"] = _pay(spark, [(1, 99, 7, 5, None, None)])
    from valueflow.sources.schema import SCHEMAS
    ledger["t_transactions"] = spark.createDataFrame([(1, None, None, dt.datetime(2020, 1, 1), True, 0, 0)],
                                                     SCHEMAS["t_transactions"])
    ledger["m_wallets"] = spark.createDataFrame([(7, "w", None, "CASHX", True)],
                                                "id long, name string, currency_id long, wallet_group string, "
                                                "is_active boolean")
    for t in ["m_currencies", "m_brands", "m_store_branches", "m_categories", "t_transaction_details",
              "t_currency_rates", "t_inventory"]:
        ledger[t] = spark.createDataFrame([], SCHEMAS[t])
    enums = Q.check_enums(ledger).collect()
    assert [(r.table_name, r.value) for r in enums] == [("m_wallets", "CASHX")]
    fk = Q.check_foreign_keys(ledger).collect()
    assert [(r.table_name, r.column_name, r.value) for r in fk] == [("t_payments", "transaction_id", "99")]
