"""Plans that must not grow: task sizes, stream state, casts of empty texts, one pass over a table, one fold for several tables."""

import datetime as dt

from pyspark.sql import functions as F

from valueflow.functions import scalars as S
from valueflow.operators import quality as Q
from valueflow.operators import stock as K
from valueflow.session import size_tasks
from valueflow.sources import ingest as I
from valueflow.streaming import streams as ST

NOON = dt.datetime(2024, 1, 1, 12)
REQUESTS = "request_id long, inventory_id long, meal_id long, amount double, consume_type string, requested_at timestamp_ntz, seq long"
LOTS = "id long, detail_id long, current_quantity double, updated_at timestamp_ntz"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def folds(df):
    return plan(df).count("MapInArrow")


def test_shuffle_partitions_grow_with_the_tables(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    old = {k: spark.conf.get(k, None) for k in [*keys, *(f"spark.valueflow.set.{k}" for k in keys)]}
    for k in old:
        spark.conf.unset(k)
    try:
        found = []
        for size in (10**6, 6 * 10**9, 12 * 10**9):
            size_tasks(spark, size)
            found.append(int(spark.conf.get(keys[2])))
        assert found[0] == int(spark.conf.get("spark.sql.shuffle.partitions")) and 1.9 < found[2] / found[1] < 2.1
        assert 6 * 10**9 / found[1] < 8 << 20
        spark.conf.set(keys[1], "3m")  # named by the session: stays
        size_tasks(spark, 10**6)
        assert spark.conf.get(keys[1]) == "3m"
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stream_state_is_kept_by_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "LOT_BUCKETS", 4)
    big = 9007199254740993  # ids beyond the integers of a double
    lots = [(big + i, i, 10.0, NOON) for i in range(40)]
    asked = [(i * 10 + k, None if i == 41 else big + i, i, None if i % 7 == 0 and k == 2 else 4.0 + (i + k) % 3, "SELF", NOON, None if i == 3 and k == 1 else k)
             for i in range(42) for k in (1, 2, 3)]
    requests, stock = spark.createDataFrame(asked, REQUESTS), spark.createDataFrame(lots, LOTS)
    want = K.greedy_consumption(requests, stock)
    rows = requests.join(stock.select(F.col("id").alias("inventory_id"), "detail_id", F.col("current_quantity").alias("lot_quantity")), "inventory_id", "left")
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    ST.write_waves(rows, source, [F.coalesce(F.col("seq"), F.lit(0)) <= 1, F.col("seq") == 2, F.col("seq") == 3], "inventory_id")
    got = ST.stream_consumption(spark, source, rows.schema, str(tmp_path / "out"), check, files_per_trigger=4)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))
    assert spark.read.format("statestore").load(check).count() <= 4


def test_empty_numbers_are_not_cast(spark):
    """A failed cast raises inside and is caught, once a line; an empty text must not reach it."""
    names = "receipt_id line_no at_text public_text brand_text branch_text item_text kind_text price_text qty_text tax_text discount_text dest_text limit_text limit_kind_text"
    row = {n: "1" for n in names.split()} | {"at_text": "20240101", "kind_text": "u"}
    texts = ["", "  ", None, "0.5", "abc", "\u3000", "\uff11"]
    raw = spark.createDataFrame([tuple((row | {"receipt_id": str(i), "discount_text": t}).values()) for i, t in enumerate(texts)],
                                ", ".join(f"{n} string" for n in names.split()))
    casts = []
    kept, I.stored = I.stored, lambda df, name: casts.append(plan(df)) or kept(df, name)
    try:
        out = I.ingest_receipts(raw, "2024-01-01 00:00:00")
    finally:
        I.stored = kept
    lines = [x for x in casts[0].splitlines() if "discount_text" in x and "try_cast" in x.lower()]
    assert lines and all("CASE WHEN coalesce(NOT (trim(discount_text" in x for x in lines)
    assert {r["receipt_id"]: r["discount_amount"] for r in out["lines"].collect()} == {"0": 0.0, "1": 0.0, "2": 0.0, "3": 0.5, "6": 1.0}
    assert {r["receipt_id"]: r["reject_reason"] for r in out["rejects"].collect()} == {"4": "BAD_DISCOUNT", "5": "BAD_DISCOUNT"}


def test_required_columns_take_one_pass(spark, ledger):
    ledger["t_payments"] = spark.range(4).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.when(F.col("id") > 1, F.col("id")).alias("amount"))
    out = Q.check_required(ledger)
    assert plan(out).count("Range (") == 1
    assert sorted((r["column_name"], r["row_key"] or "") for r in out.collect()) == [("amount", ""), ("amount", "1"), ("id", "")]


def test_zero_measures_make_no_decimal(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (0.123456785,), (1e-9,), (None,)], "x double")
    assert df.agg(S.decimal_sum("x").alias("s")).first()["s"] == df.agg(F.sum(F.col("x").cast("decimal(28,8)")).alias("s")).first()["s"]


def test_a_kept_fold_is_run_once(spark, ledger):
    ledger["t_inventory"] = spark.createDataFrame([(1, 1, 5.0, NOON)], LOTS)
    ledger["consume_requests"] = spark.createDataFrame([(1, 1, 1, 2.0, "SELF", NOON, 1), (2, 1, 2, 9.0, "SELF", NOON, 2)], REQUESTS)
    K.ensure_consumption(ledger, keep=True)
    tables = ["t_meal_details", "t_meal_logs", "t_inventory_snapshot", "consumption_rejects"]
    assert [folds(ledger[t]) for t in tables] == [0, 0, 0, 0]
    assert [ledger[t].count() for t in tables] == [1, 1, 1, 1]


def test_planted_checks_share_one_fold(spark, ledger):
    from valueflow.plans import planted

    ledger["t_inventory"] = spark.createDataFrame([(1, 1, 5.0, NOON)], LOTS)
    ledger["consume_requests"] = spark.createDataFrame([(1, 1, 1, 2.0, "SELF", NOON, 1)], REQUESTS)
    bad = planted.ledger(ledger)
    assert "t_meal_details" in bad and folds(bad["t_meal_details"]) + folds(bad["t_meal_logs"]) == 0
    assert bad["t_meal_details"].count() == 1
