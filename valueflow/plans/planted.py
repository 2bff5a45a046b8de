"""A ledger with planted violations, for the checks V-01 … V-06 and V-10.

Every table of the derived ledger with some columns replaced by an expression
that Spark and DuckDB both read: ``ledger`` builds the Spark side, ``VIEWS``
the oracle side (names start with ``bad_``).  Which rows go wrong follows from
their ids, over all rows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.money import ledger_balances
from ..operators.stock import ensure_consumption
from ..sources.ledger import Ledger
from ..sources.schema import SCHEMAS

# --- fixed values: planted violations ---
PLANTED = {
    "m_currencies": {"code": "case when id >= 3 then 'DUP' else code end", "successor_id": "case when id = 1 then 42 else successor_id end"},
    "t_currency_rates": {"change_type": "case when id % 97 = 0 then 'WHATEVER' else change_type end"},
    "m_wallets": {"currency_id": "case when id % 53 = 0 then 99 else currency_id end",
                  "wallet_group": "case when id % 59 = 0 then 'SHOEBOX' else wallet_group end"},
    "m_foods": {"name": "case when id % 101 = 0 then null else name end"},
    "m_brands": {},
    "m_store_branches": {"brand_id": "case when id % 13 = 0 then 900 else brand_id end"},
    "m_categories": {"type": "case when id = 2 then 'OTHER' else type end"},
    "t_transactions": {"branch_id": "case when id % 503 = 0 then 77777 else branch_id end",
                       "transaction_at": "case when id % 509 = 0 then null else transaction_at end"},
    "t_transaction_details": {
        "food_type": "case when id % 1009 = 0 then 'BOGUS' else food_type end",
        "destination": "case when id % 1013 = 0 then 'NOWHERE' else destination end",
        "limit_type": "case when id % 1019 = 0 then 'SOMETIME' else limit_type end",
        "quantity": "case when id % 1021 = 0 then null else quantity end",
        "food_id": "case when id % 1031 = 0 then food_id + 1000000 else food_id end",
        "transaction_id": "case when id % 1033 = 0 then -1 else transaction_id end",
        "category_id": "case when id % 1039 = 0 then 3 when id % 1049 = 0 then 999 else category_id end",
        "condition_rank": "case when id % 1051 = 0 then 'Z' else condition_rank end"},
    "t_payments": {"amount": "case when id % 223 = 0 then null else amount end",
                   "wallet_id": "case when id % 211 = 0 then -5 else wallet_id end",
                   "transaction_id": "case when id % 227 = 0 then -7 else transaction_id end"},
    "t_inventory": {"detail_id": "case when id % 1063 = 0 then -detail_id else detail_id end"},
    "t_meal_logs": {"eaten_at": "case when id % 1093 = 0 then null else eaten_at end"},
    "t_meal_details": {"consume_type": "case when id % 1069 = 0 then 'FEAST' else consume_type end",
                       "meal_id": "case when id % 1087 = 0 then -1 else meal_id end",
                       "inventory_id": "case when id % 1091 = 0 then -1 else inventory_id end"},
    "t_wallet_balances": {"wallet_id": "case when wallet_id % 61 = 0 then -3 else wallet_id end",
                          "current_amount": "case when wallet_id % 67 = 0 then current_amount + 1 else current_amount end"},
}
# rows that come twice
TWICE = {"t_transaction_details": "id % 1061 = 0", "m_brands": "id = 7"}

BALANCES = """select p.wallet_id, p.expiry_at, p.usage_restriction,
  case when p.expiry_at is not null or p.usage_restriction is not null then max(p.id) end as origin_payment_id,
  cast(sum(p.amount) as bigint) as current_amount, max(t.transaction_at) as updated_at
from t_payments p left join t_transactions t on p.transaction_id = t.id
where p.wallet_id is not null group by p.wallet_id, p.expiry_at, p.usage_restriction"""


def _columns(table: str) -> dict[str, str]:
    cols = {f.name: f.name for f in SCHEMAS[table].fields}
    return cols | PLANTED[table]


def ledger(led: Ledger) -> Ledger:
    """Each table is built on first use; the consumption fold, which checks read several times, is run once and stored."""
    out = Ledger()
    out.spark = led.spark

    def build(table: str) -> DataFrame:
        if table.startswith("t_meal"):
            ensure_consumption(led, keep=True)
        df = ledger_balances(led) if table == "t_wallet_balances" else led[table]
        bad = df.select(*[F.expr(e).alias(n) for n, e in _columns(table).items()])
        return bad.unionByName(bad.filter(TWICE[table])) if table in TWICE else bad

    out._builders = {table: partial(build, table) for table in PLANTED}
    return out


def _view(table: str) -> str:
    source = f"({BALANCES}) b" if table == "t_wallet_balances" else table
    sql = "select " + ", ".join(f"{e} as {n}" for n, e in _columns(table).items()) + f" from {source}"
    if table in TWICE:
        sql = f"select * from ({sql}) x union all select * from ({sql}) y where {TWICE[table]}"
    return sql


VIEWS = [(f"bad_{t}", _view(t)) for t in PLANTED]
