"""Ledger data model: explicit schemas, enum domains and the measure list.

Every table has a fixed ``StructType``; nothing is inferred at read time.
Times are ``timestamp_ntz`` (naive local time), amounts in wallet units are
``long``, quantities / prices / nutrients are ``double``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: nutrient and taste measure names of the food masters ---
NUTRIENTS = ["energy_kcal", "protein_g", "fat_g", "carb_g", "salt_equiv_g"]
TASTES = [
    "taste_sweet", "taste_salty", "taste_sour", "taste_bitter", "taste_umami",
    "taste_pungent", "taste_cooling", "taste_astringency", "taste_richness", "taste_sharpness",
]
MEASURES = NUTRIENTS + TASTES

# --- fixed values: enum domains of the ledger columns ---
ENUMS = {
    ("t_currency_rates", "change_type"): ["VALUE_ADJUST", "QUANTITY_ADJUST"],
    ("m_wallets", "wallet_group"): ["CASH", "BANK", "CREDIT", "PREPAID", "POINT"],
    ("m_categories", "type"): ["EXPENSE", "INCOME"],
    ("t_transaction_details", "food_type"): ["NONE", "ADJUSTMENT", "UNIVERSAL", "MEASURED", "PROCESSED", "OUT_EAT"],
    ("t_transaction_details", "condition_rank"): ["A", "B", "C", "D", "J"],
    ("t_transaction_details", "destination"): ["EAT_NOW", "FRIDGE", "FREEZER", "PANTRY", "GIFT"],
    ("t_transaction_details", "limit_type"): ["CONSUMPTION", "BEST_BEFORE"],
    ("t_meal_details", "consume_type"): ["SELF", "GIFT", "LOSS"],
}

FOOD_KINDS = ["UNIVERSAL", "MEASURED", "PROCESSED"]
STOCK_PLACES = ["FRIDGE", "FREEZER", "PANTRY"]

TS = T.TimestampNTZType()
L = T.LongType()
D = T.DoubleType()
S = T.StringType()
B = T.BooleanType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


def _measures():
    return [(m, D, True) for m in MEASURES]


SCHEMAS: dict[str, T.StructType] = {
    "m_currencies": _st(("id", L, False), ("code", S, False), ("name", S, False), ("display_unit", S, True),
                        ("start_at", TS, True), ("end_at", TS, True), ("successor_id", L, True)),
    "t_currency_rates": _st(("id", L, False), ("currency_id", L, True), ("rate_to_jpy", D, False),
                            ("change_type", S, True), ("effective_at", TS, False)),
    "m_wallets": _st(("id", L, False), ("name", S, False), ("currency_id", L, True), ("wallet_group", S, True),
                     ("is_active", B, True)),
    "m_foods": _st(("id", L, False), ("name", S, False), ("food_kind", S, False),
                   ("shelf_life_days_guideline", D, True), *_measures()),
    "m_brands": _st(("id", L, False), ("name", S, False)),
    "m_store_branches": _st(("id", L, False), ("brand_id", L, True), ("branch_name", S, False)),
    "m_categories": _st(("id", L, False), ("name", S, False), ("type", S, True)),
    "t_transactions": _st(("id", L, False), ("transaction_name", S, True), ("branch_id", L, True),
                          ("transaction_at", TS, False), ("is_public", B, True), ("tax_adjustment_jpy", L, True),
                          ("total_amount_jpy", L, True)),
    "t_transaction_details": _st(("id", L, False), ("transaction_id", L, True), ("category_id", L, True),
                                 ("food_type", S, True), ("food_id", L, True), ("item_name_receipt", S, True),
                                 ("unit_price_ex_tax", D, True), ("quantity", D, False), ("tax_rate", D, False),
                                 ("discount_amount", D, True), ("destination", S, True), ("limit_date", TS, True),
                                 ("limit_type", S, True), ("reliability_level", T.IntegerType(), True),
                                 ("condition_rank", S, True)),
    "t_payments": _st(("id", L, False), ("transaction_id", L, True), ("wallet_id", L, True), ("amount", L, False),
                      ("expiry_at", TS, True), ("usage_restriction", S, True)),
    "t_inventory": _st(("id", L, False), ("detail_id", L, False), ("current_quantity", D, False),
                       ("updated_at", TS, False)),
    "consume_requests": _st(("request_id", L, False), ("inventory_id", L, False), ("meal_id", L, False),
                            ("amount", D, True), ("consume_type", S, True), ("requested_at", TS, True),
                            ("seq", L, False)),
    "raw_movements": _st(("movement_id", L, False), ("transaction_id", L, True), ("wallet_id", L, False),
                         ("amount", L, False), ("requested_offset", L, True), ("new_expiry_text", S, True),
                         ("new_restriction", S, True), ("moved_at", TS, True)),
}

# Output schemas of the operators that write ledger tables.
MEAL_DETAILS = _st(("id", L, False), ("meal_name", S, True), ("meal_id", L, False), ("inventory_id", L, False),
                   ("detail_id", L, False), ("amount_consumed", D, False), ("consume_type", S, True))
MEAL_LOGS = _st(("id", L, False), ("eaten_at", TS, False), ("note", S, True))
WALLET_BALANCES = _st(("wallet_id", L, True), ("expiry_at", TS, True), ("usage_restriction", S, True),
                      ("origin_payment_id", L, True), ("current_amount", L, False), ("updated_at", TS, True))
SCHEMAS |= {"t_meal_logs": MEAL_LOGS, "t_meal_details": MEAL_DETAILS, "t_wallet_balances": WALLET_BALANCES}
