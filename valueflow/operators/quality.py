"""Data-quality jobs from the schema constraints (V-01 … V-10).

Each check returns the violating rows tagged with the rule, so all checks
of a ledger can be unioned into one report.  Every check is one filter, one
aggregate or one anti-join — no driver loops over data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import ENUMS, SCHEMAS

c = F.col

# --- fixed values: foreign-key edges of the ledger model (child, column, parent, column) ---
FOREIGN_KEYS = [
    ("m_currencies", "successor_id", "m_currencies", "id"),
    ("t_currency_rates", "currency_id", "m_currencies", "id"),
    ("m_wallets", "currency_id", "m_currencies", "id"),
    ("m_store_branches", "brand_id", "m_brands", "id"),
    ("t_transactions", "branch_id", "m_store_branches", "id"),
    ("t_transaction_details", "transaction_id", "t_transactions", "id"),
    ("t_transaction_details", "category_id", "m_categories", "id"),
    ("t_payments", "transaction_id", "t_transactions", "id"),
    ("t_payments", "wallet_id", "m_wallets", "id"),
    ("t_inventory", "detail_id", "t_transaction_details", "id"),
    ("t_meal_details", "meal_id", "t_meal_logs", "id"),
    ("t_meal_details", "inventory_id", "t_inventory", "id"),
    ("t_meal_details", "detail_id", "t_transaction_details", "id"),
    ("t_wallet_balances", "wallet_id", "m_wallets", "id"),
    ("t_wallet_balances", "origin_payment_id", "t_payments", "id"),
]
# --- fixed values: unique keys besides the id of every table ---
UNIQUE_KEYS = [("m_currencies", "code")]
# --- fixed values: value ranges (table, column, low, high) ---
RANGES = [("t_transaction_details", "reliability_level", 1, 3)]

VIOLATION_COLS = ["rule", "table_name", "column_name", "row_key", "value"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _rows(df: DataFrame, rule: str, table: str, column: str | Column, key: str | None, value) -> DataFrame:
    named = F.lit(column) if isinstance(column, str) else column
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), named.alias("column_name"),
                     (c(key).cast("string") if key else F.lit(None).cast("string")).alias("row_key"),
                     value.cast("string").alias("value"))


def _key(df: DataFrame) -> str | None:
    return "id" if "id" in df.columns else None


# V-01
def check_enums(led) -> DataFrame:
    """Values outside their domain; a column that a table lacks is a violation of its own."""
    out = []
    for (table, col), allowed in ENUMS.items():
        if table in led:
            df = led[table]
            if col in df.columns:
                out.append(_rows(df.filter(c(col).isNotNull() & ~c(col).isin(*allowed)), "ENUM", table, col, _key(df), c(col)))
            else:
                out.append(_rows(led.spark.range(1), "MISSING_COLUMN", table, col, None, F.lit(None)))
    return _union(out)


# V-02
def check_required(led) -> DataFrame:
    """NULLs in columns that may hold none: one pass over each table, whatever the number of such columns."""
    out = []
    for table, schema in SCHEMAS.items():
        if table not in led:
            continue
        df = led[table]
        needed = [f.name for f in schema.fields if not f.nullable and f.name in df.columns]
        if needed:
            empty = df.filter(reduce(Column.__or__, [c(n).isNull() for n in needed]))
            rows = _rows(empty, "NOT_NULL", table, F.explode(F.array(*[F.when(c(n).isNull(), F.lit(n)) for n in needed])), _key(df), F.lit(None))
            out.append(rows.filter(c("column_name").isNotNull()))
    return _union(out)


# V-03
def check_unique(led) -> DataFrame:
    out = []
    keys = [(t, "id") for t in SCHEMAS if t in led and "id" in led[t].columns] + [k for k in UNIQUE_KEYS if k[0] in led]
    for table, col in keys:
        dup = led[table].groupBy(col).agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1)
        out.append(_rows(dup, "UNIQUE", table, col, col, c("n")))
    return _union(out)


# V-04
def check_foreign_keys(led) -> DataFrame:
    """Child rows whose (non-NULL) reference has no parent: one anti-join per edge."""
    out = []
    for child, ccol, parent, pcol in FOREIGN_KEYS:
        if child not in led or parent not in led:
            continue
        ch = led[child].filter(c(ccol).isNotNull())
        pa = led[parent].select(c(pcol).alias("__pk")).distinct()
        orphans = ch.join(pa, ch[ccol] == pa["__pk"], "left_anti")
        out.append(_rows(orphans, "FOREIGN_KEY", child, ccol, _key(led[child]), c(ccol)))
    return _union(out)


# V-05
def check_food_reference(led) -> DataFrame:
    """Lines whose food id is missing from the master its food type points to."""
    d = led["t_transaction_details"].filter(c("food_id").isNotNull())
    kind = F.when(c("food_type") == "OUT_EAT", F.lit("PROCESSED")).otherwise(c("food_type"))
    foods = led["m_foods"].select(c("food_kind").alias("__k"), c("id").alias("__id"))
    bad = d.join(foods, (kind == foods["__k"]) & (d["food_id"] == foods["__id"]), "left_anti")
    return _rows(bad, "FOOD_REFERENCE", "t_transaction_details", "food_id", "id", c("food_id"))


# V-06
def check_category_rule(led) -> DataFrame:
    d = led["t_transaction_details"]
    bad = d.filter(c("category_id").isNotNull() & (F.coalesce(c("food_type"), F.lit("NONE")) != "NONE"))
    return _rows(bad, "CATEGORY_NEEDS_NONE", "t_transaction_details", "food_type", "id", c("food_type"))


# V-07
def check_ranges(led) -> DataFrame:
    out = []
    for table, col, lo, hi in RANGES:
        df = led[table]
        if col in df.columns:
            bad = df.filter(c(col).isNotNull() & ~c(col).between(lo, hi))
            out.append(_rows(bad, "RANGE", table, col, _key(df), c(col)))
    return _union(out)


# V-09
def reconcile_flows(led) -> DataFrame:
    """Goods total (checkout rule) vs money total per transaction, full outer join.

    Spending is negative money, so a settled purchase has goods + money = 0.
    """
    from .goods import receipt_checkout_total
    goods = receipt_checkout_total(led).select("transaction_id", c("checkout_total").alias("goods_total"))
    money = led["t_payments"].groupBy("transaction_id").agg(F.sum("amount").cast("long").alias("money_total"))
    j = goods.join(money, "transaction_id", "full")
    return j.select("transaction_id", F.coalesce("goods_total", F.lit(0)).cast("long").alias("goods_total"),
                    F.coalesce("money_total", F.lit(0)).cast("long").alias("money_total"),
                    (F.coalesce("goods_total", F.lit(0)) + F.coalesce("money_total", F.lit(0))).cast("long")
                    .alias("difference"))


# V-10
def reconcile_stock(led, stored: DataFrame | None = None) -> DataFrame:
    """Stored stock (by default the sequential fold) vs recomputed bought − Σ accepted (exact decimal)."""
    from .stock import ensure_consumption
    ensure_consumption(led)
    snap = (led["t_inventory_snapshot"] if stored is None else stored).select("id", c("current_quantity").alias("stored"))
    used = (led["t_meal_details"].groupBy("inventory_id")
            .agg(F.sum(c("amount_consumed").cast("decimal(28,8)")).alias("used")))
    inv = led["t_inventory"].select("id", "current_quantity")
    re = (inv.join(used, inv["id"] == used["inventory_id"], "left")
          .select("id", (c("current_quantity").cast("decimal(28,8)") - F.coalesce(c("used"), F.lit(0)))
                  .cast("double").alias("recomputed")))
    j = snap.join(re, "id", "full")
    return j.select("id", "stored", "recomputed", (c("stored") - c("recomputed")).alias("difference")) \
            .filter(F.abs(c("difference")) > 1e-6)


def reconcile_balances(led, stored: DataFrame | None = None) -> DataFrame:
    """Stored balance rows vs the per-movement running balance at each group's last movement."""
    from .money import ledger_balances, remaining_after_movement, is_limited
    stored = ledger_balances(led) if stored is None else stored
    run = remaining_after_movement(led["t_payments"]).filter(is_limited())
    last = run.groupBy("wallet_id", "expiry_at", "usage_restriction").agg(
        F.max_by("remaining_amount", "id").alias("recomputed"))
    s = stored.filter(is_limited()).alias("s")
    r = last.alias("r")
    cond = ((c("s.wallet_id") == c("r.wallet_id")) & c("s.expiry_at").eqNullSafe(c("r.expiry_at"))
            & c("s.usage_restriction").eqNullSafe(c("r.usage_restriction")))
    return (s.join(r, cond, "full").select(
        F.coalesce("s.wallet_id", "r.wallet_id").alias("wallet_id"),
        F.coalesce("s.expiry_at", "r.expiry_at").alias("expiry_at"),
        F.coalesce("s.usage_restriction", "r.usage_restriction").alias("usage_restriction"),
        c("s.current_amount").alias("stored"), c("r.recomputed"))
        .filter(~c("stored").eqNullSafe(c("recomputed"))))
