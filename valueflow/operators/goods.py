"""Goods flow: receipts, totals under three rounding rules, transaction list and detail.

Inventory rows: J-03, A-02, A-06, A-07, A-08, A-14, W-03, R-01, R-02, R-03.

Per-receipt aggregates are ``groupBy(transaction_id)`` with map-side partial
aggregation, so a receipt with a huge number of lines is combined before the
shuffle.  Joins between lines / payments and transactions are on the
transaction key; dimension joins (branches, brands, categories) are left to
Spark's size-checked broadcast (static stats + AQE runtime sizes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .windows import range_numbered, ranged_sums

c = F.col


# J-03
def transaction_store(led) -> DataFrame:
    """Transactions ⟕ branch ⟕ brand (two-hop left outer)."""
    tx = led["t_transactions"]
    br = led["m_store_branches"].select(c("id").alias("branch_id"), "brand_id", "branch_name")
    bd = led["m_brands"].select(c("id").alias("brand_id"), c("name").alias("brand_name"))
    return tx.join(br, "branch_id", "left").join(bd, "brand_id", "left")


def _between(df, col, start, end, before=None):
    if start is not None:
        df = df.filter(c(col) >= start)
    if end is not None:
        df = df.filter(c(col) <= end)
    if before is not None:
        df = df.filter(c(col) < before)
    return df


# A-02
def transaction_list(led, start=None, end=None, before=None) -> DataFrame:
    """Per transaction: name, brand, sum of its money movements (0 if none).

    Payments are pre-aggregated per transaction, then left-joined; the time
    range (``start`` and ``end`` inclusive, ``before`` not) is a plain column
    predicate so it reaches the scan.  With a range only the payments of the
    listed transactions are aggregated.
    """
    tx, pay = transaction_store(led), led["t_payments"]
    if start is not None or end is not None or before is not None:
        in_range = lambda df: _between(df, "transaction_at", start, end, before)
        tx = in_range(tx)
        listed = in_range(led["t_transactions"]).select(c("id").alias("transaction_id"))
        pay = pay.join(listed, "transaction_id", "left_semi")
    pay = pay.groupBy("transaction_id").agg(F.sum("amount").alias("total"))
    return (tx.join(pay, tx["id"] == pay["transaction_id"], "left")
            .select(tx["id"], "transaction_at", "transaction_name", c("brand_name").alias("brand"),
                    F.coalesce(c("total"), F.lit(0).cast("long")).alias("total")))


# W-03
def list_numbering(listing: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """1-based position in a newest-first listing, per ``keys`` (e.g. month).

    Positions are counted by ranges of the listing's order, so neither a whole
    period nor a busy day is numbered by one task.
    """
    order = [c("transaction_at").desc(), c("id").desc()]
    if not keys:
        return range_numbered(listing, order, "position")
    return ranged_sums(listing, keys, order, {"position": F.lit(1)})


# R-01
def recent_transactions(led, as_of, days: int = 30) -> DataFrame:
    start, end = S.recent_range(as_of, days)
    return list_numbering(transaction_list(led, start, end))


# R-02
def monthly_transactions(led, ym: str) -> DataFrame:
    start, following = S.month_range(ym)
    return list_numbering(transaction_list(led, start, before=following))


def _lines(led):
    return led["t_transaction_details"]


# A-06
def receipt_checkout_total(led) -> DataFrame:
    """Σ per line trunc(max(0, price·qty − discount)·(1+tax)) — the entry-time total."""
    d = _lines(led)
    g = S.line_gross("unit_price_ex_tax", "quantity", "tax_rate", F.coalesce(c("discount_amount"), F.lit(0.0)))
    return d.groupBy("transaction_id").agg(F.sum(g).cast("long").alias("checkout_total"),
                                           F.count(F.lit(1)).alias("n_lines"))


# A-07
def receipt_display_total(led) -> DataFrame:
    """Σ per line trunc(price·qty·(1+tax)) — the detail-view total (discount ignored)."""
    d = _lines(led)
    g = S.line_gross("unit_price_ex_tax", "quantity", "tax_rate")
    return d.groupBy("transaction_id").agg(F.sum(g).cast("long").alias("display_total"),
                                           F.count(F.lit(1)).alias("n_lines"))


# A-08
def receipt_rounded_once(led) -> DataFrame:
    """Sum the whole receipt exactly, truncate once, add the header's ±1 adjustment."""
    d = _lines(led)
    net = S.line_net_taxed("unit_price_ex_tax", "quantity", "tax_rate", "discount_amount")
    sums = d.groupBy("transaction_id").agg(S.decimal_sum(net).alias("exact_total"))
    tx = led["t_transactions"].select(c("id").alias("transaction_id"), "tax_adjustment_jpy")
    return (sums.join(tx, "transaction_id", "left")
            .select("transaction_id", F.floor("exact_total").cast("long").alias("rounded_total"),
                    (F.floor("exact_total").cast("long") + F.coalesce(c("tax_adjustment_jpy"), F.lit(0)))
                    .cast("long").alias("receipt_total")))


# A-14
def surplus_deficit(led) -> DataFrame:
    """Income, expense and unclassified amounts per month; ADJUSTMENT lines excluded.

    Food lines are expense; other lines take their category's type; lines
    without a typed category are reported apart.  Amount = checkout line rule.
    """
    d = _lines(led).filter(F.coalesce(c("food_type"), F.lit("NONE")) != "ADJUSTMENT")
    cats = led["m_categories"].select(c("id").alias("category_id"), c("type").alias("cat_type"))
    tx = led["t_transactions"].select(c("id").alias("transaction_id"), "transaction_at")
    j = d.join(cats, "category_id", "left").join(tx, "transaction_id")
    side = (F.when(c("food_type").isin("UNIVERSAL", "MEASURED", "PROCESSED", "OUT_EAT"), F.lit("EXPENSE"))
            .when(c("cat_type").isNotNull(), c("cat_type")).otherwise(F.lit("UNCLASSIFIED")))
    amt = S.line_gross("unit_price_ex_tax", "quantity", "tax_rate", F.coalesce(c("discount_amount"), F.lit(0.0)))
    j = j.select(F.trunc(F.to_date("transaction_at"), "month").alias("month"), side.alias("side"), amt.alias("amt"))
    out = j.groupBy("month").agg(
        F.sum(F.when(c("side") == "INCOME", c("amt")).otherwise(0)).cast("long").alias("income"),
        F.sum(F.when(c("side") == "EXPENSE", c("amt")).otherwise(0)).cast("long").alias("expense"),
        F.sum(F.when(c("side") == "UNCLASSIFIED", c("amt")).otherwise(0)).cast("long").alias("unclassified"))
    return out.withColumn("surplus", (c("income") - c("expense")).cast("long"))


# R-03
def transaction_detail(led) -> dict[str, DataFrame]:
    """Header, lines and payments of every transaction (batch form of the detail view)."""
    store = transaction_store(led)
    disp = receipt_display_total(led)
    header = (store.join(disp, store["id"] == disp["transaction_id"], "left")
              .select(store["id"], "transaction_at", S.format_ts("transaction_at").alias("at_text"),
                      S.title_fallback("transaction_name", "brand_name").alias("title"),
                      "brand_name", "branch_name",
                      F.coalesce(c("display_total"), F.lit(0).cast("long")).alias("display_total"),
                      F.abs(c("total_amount_jpy")).alias("confirmed_total"),
                      S.direction("total_amount_jpy").alias("direction")))
    lines = _lines(led).select(
        "transaction_id", c("id").alias("detail_id"), "item_name_receipt",
        S.trunc_long("unit_price_ex_tax").alias("unit_price"), "quantity",
        S.line_gross("unit_price_ex_tax", "quantity", "tax_rate").alias("gross"),
        S.label("destination", S.DEST_LABELS, "other").alias("destination_label"))
    payments = payments_with_wallet(led).select(
        "transaction_id", c("id").alias("payment_id"), "wallet_name", F.abs(c("amount")).alias("amount_abs"),
        S.direction("amount").alias("direction"), S.note_text("expiry_at", "usage_restriction").alias("note"))
    return {"header": header, "lines": lines, "payments": payments}


# J-07
def payments_with_wallet(led) -> DataFrame:
    """Payments ⋈ wallets; a NULL wallet (paid by someone else) drops out."""
    w = led["m_wallets"].select(c("id").alias("wallet_id"), c("name").alias("wallet_name"))
    return led["t_payments"].join(w, "wallet_id")
