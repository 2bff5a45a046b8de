"""Registered data-quality and report-level queries (V-01 … V-10, A-15, R-05).

V-01 … V-06 and V-10 run over a ledger with planted violations; their oracles
write the rules out, apart from the lists the checks iterate over.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import money as M
from ..operators import stock as K
from . import planted
from .catalog import AS_OF, register
from .queries_goods import CHECKOUT_LINE, TRUNC

c = F.col

def _row(rule, table, column, key, value):
    k = f"cast({key} as varchar)" if key else "cast(null as varchar)"
    return (f"select '{rule}' as rule, '{table}' as table_name, '{column}' as column_name, {k} as row_key, "
            f"cast({value} as varchar) as value")


def _outside(table, column, *allowed):
    return f"{_row('ENUM', table, column, 'id', column)} from bad_{table} where {column} not in {allowed}"


def _null(table, key, *columns):
    return "\nunion all ".join(f"{_row('NOT_NULL', table, col, key, 'null')} from bad_{table} where {col} is null" for col in columns)


def _twice(table, column="id"):
    return f"{_row('UNIQUE', table, column, column, 'count(*)')} from bad_{table} group by {column} having count(*) > 1"


def _orphan(child, column, parent, key="ch.id"):
    return (f"{_row('FOREIGN_KEY', child, column, key, 'ch.' + column)} from bad_{child} ch where ch.{column} is not null "
            f"and not exists (select 1 from bad_{parent} pa where pa.id = ch.{column})")


@register("v01_check_enums", "\nunion all ".join([
    _outside("t_currency_rates", "change_type", "VALUE_ADJUST", "QUANTITY_ADJUST"),
    _outside("m_wallets", "wallet_group", "CASH", "BANK", "CREDIT", "PREPAID", "POINT"),
    _outside("m_categories", "type", "EXPENSE", "INCOME"),
    _outside("t_transaction_details", "food_type", "NONE", "ADJUSTMENT", "UNIVERSAL", "MEASURED", "PROCESSED", "OUT_EAT"),
    _outside("t_transaction_details", "condition_rank", "A", "B", "C", "D", "J"),
    _outside("t_transaction_details", "destination", "EAT_NOW", "FRIDGE", "FREEZER", "PANTRY", "GIFT"),
    _outside("t_transaction_details", "limit_type", "CONSUMPTION", "BEST_BEFORE"),
    _outside("t_meal_details", "consume_type", "SELF", "GIFT", "LOSS")]), planted.VIEWS)
def v01(led):
    return Q.check_enums(planted.ledger(led))


@register("v02_check_required", "\nunion all ".join([
    _null("m_currencies", "id", "id", "code", "name"), _null("t_currency_rates", "id", "id", "rate_to_jpy", "effective_at"),
    _null("m_wallets", "id", "id", "name"), _null("m_foods", "id", "id", "name", "food_kind"), _null("m_brands", "id", "id", "name"),
    _null("m_store_branches", "id", "id", "branch_name"), _null("m_categories", "id", "id", "name"),
    _null("t_transactions", "id", "id", "transaction_at"), _null("t_transaction_details", "id", "id", "quantity", "tax_rate"),
    _null("t_payments", "id", "id", "amount"), _null("t_inventory", "id", "id", "detail_id", "current_quantity", "updated_at"),
    _null("t_meal_logs", "id", "id", "eaten_at"),
    _null("t_meal_details", "id", "id", "meal_id", "inventory_id", "detail_id", "amount_consumed"),
    _null("t_wallet_balances", None, "current_amount")]), planted.VIEWS)
def v02(led):
    return Q.check_required(planted.ledger(led))


@register("v03_check_unique", "\nunion all ".join([*map(_twice, [
    "m_currencies", "t_currency_rates", "m_wallets", "m_foods", "m_brands", "m_store_branches", "m_categories", "t_transactions",
    "t_transaction_details", "t_payments", "t_inventory", "t_meal_logs", "t_meal_details"]), _twice("m_currencies", "code")]), planted.VIEWS)
def v03(led):
    return Q.check_unique(planted.ledger(led))


@register("v04_check_foreign_keys", "\nunion all ".join([
    _orphan("m_currencies", "successor_id", "m_currencies"), _orphan("t_currency_rates", "currency_id", "m_currencies"),
    _orphan("m_wallets", "currency_id", "m_currencies"), _orphan("m_store_branches", "brand_id", "m_brands"),
    _orphan("t_transactions", "branch_id", "m_store_branches"), _orphan("t_transaction_details", "transaction_id", "t_transactions"),
    _orphan("t_transaction_details", "category_id", "m_categories"), _orphan("t_payments", "transaction_id", "t_transactions"),
    _orphan("t_payments", "wallet_id", "m_wallets"), _orphan("t_inventory", "detail_id", "t_transaction_details"),
    _orphan("t_meal_details", "meal_id", "t_meal_logs"), _orphan("t_meal_details", "inventory_id", "t_inventory"),
    _orphan("t_meal_details", "detail_id", "t_transaction_details"),
    _orphan("t_wallet_balances", "wallet_id", "m_wallets", None), _orphan("t_wallet_balances", "origin_payment_id", "t_payments", None)]),
    planted.VIEWS)
def v04(led):
    return Q.check_foreign_keys(planted.ledger(led))


@register("v05_check_food_reference", f"""{_row('FOOD_REFERENCE', 't_transaction_details', 'food_id', 'd.id', 'd.food_id')}
from bad_t_transaction_details d where d.food_id is not null and not exists (
  select 1 from bad_m_foods f where f.id = d.food_id
    and f.food_kind = case when d.food_type = 'OUT_EAT' then 'PROCESSED' else d.food_type end)""", planted.VIEWS)
def v05(led):
    return Q.check_food_reference(planted.ledger(led))


@register("v06_check_category_rule", f"""{_row('CATEGORY_NEEDS_NONE', 't_transaction_details', 'food_type', 'id', 'food_type')}
from bad_t_transaction_details where category_id is not null and coalesce(food_type, 'NONE') <> 'NONE'""", planted.VIEWS)
def v06(led):
    return Q.check_category_rule(planted.ledger(led))


@register("v07_check_ranges", f"""{_row('RANGE', 't_transaction_details', 'reliability_level', 'id', 'reliability_level')}
from t_transaction_details where reliability_level is not null and reliability_level not between 1 and 3""")
def v07(led):
    return Q.check_ranges(led)


@register("v09_reconcile_flows", f"""select coalesce(g.transaction_id, m.transaction_id) as transaction_id,
  coalesce(g.goods_total, 0) as goods_total, coalesce(m.money_total, 0) as money_total,
  coalesce(g.goods_total, 0) + coalesce(m.money_total, 0) as difference
from (select transaction_id, cast(sum({TRUNC.format(x=CHECKOUT_LINE)}) as bigint) as goods_total
      from t_transaction_details group by transaction_id) g
full join (select transaction_id, cast(sum(amount) as bigint) as money_total from t_payments group by transaction_id) m
  on g.transaction_id = m.transaction_id""")
def v09(led):
    return Q.reconcile_flows(led)


OFF = "case when id % 1097 = 0 then current_quantity + 1 else current_quantity end as current_quantity"


@register("v10_reconcile_stock", f"""select * from (select s.id, s.current_quantity as stored,
  cast(cast(i.current_quantity as decimal(28,8)) - coalesce(u.used, 0) as double) as recomputed,
  s.current_quantity - cast(cast(i.current_quantity as decimal(28,8)) - coalesce(u.used, 0) as double) as difference
from (select id, {OFF} from t_inventory_snapshot) s join t_inventory i on s.id = i.id
left join (select inventory_id, sum(cast(amount_consumed as decimal(28,8))) as used from t_meal_details
           group by inventory_id) u on i.id = u.inventory_id) x where abs(difference) > 1e-6""")
def v10(led):
    """Against a stored snapshot in which some lots are off by one."""
    stored = K.ensure_consumption(led)["t_inventory_snapshot"].selectExpr("id", OFF)
    return Q.reconcile_stock(led, stored)


@register("v10_reconcile_balances", """select * from (
  select coalesce(s.wallet_id, r.wallet_id) as wallet_id, coalesce(s.expiry_at, r.expiry_at) as expiry_at,
    coalesce(s.usage_restriction, r.usage_restriction) as usage_restriction, s.current_amount as stored, r.recomputed
  from (select * from bad_t_wallet_balances where expiry_at is not null or usage_restriction is not null) s
  full join (select wallet_id, expiry_at, usage_restriction,
               arg_max(cast(run as bigint), id) as recomputed
             from (select p.*, sum(p.amount) over (partition by p.wallet_id, p.expiry_at, p.usage_restriction order by p.id
                     rows between unbounded preceding and current row) as run
                   from t_payments p where p.wallet_id is not null
                     and (p.expiry_at is not null or p.usage_restriction is not null)) x
             group by 1, 2, 3) r
  on s.wallet_id = r.wallet_id and s.expiry_at is not distinct from r.expiry_at
     and s.usage_restriction is not distinct from r.usage_restriction) y
where stored is distinct from recomputed""", planted.VIEWS)
def v10b(led):
    """Against stored balances, some of them under another wallet or off by one."""
    return Q.reconcile_balances(led, planted.ledger(led)["t_wallet_balances"])


@register("a15_report_counts", """select 'transactions' as report, count(*) as n from t_transactions
union all select 'consumed_items' as report, count(*) as n from t_meal_details
union all select 'rejected_requests' as report, count(*) as n from decisions where not accepted""")
def a15(led):
    """Row counts shown under the listings, as aggregates (no driver-side count); both decisions come from one fold."""
    K.ensure_consumption(led)
    decided = led["consumption_decisions"].agg(F.count_if("accepted").alias("consumed_items"), F.count_if(~c("accepted")).alias("rejected_requests"))
    both = decided.select(F.explode(F.create_map(*[x for n in decided.columns for x in (F.lit(n), c(n))])).alias("report", "n"))
    return led["t_transactions"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("transactions").alias("report"), "n").unionByName(both)


@register("r05_asset_report", f"""select 'WALLET' as section, w.name as item, cast(coalesce(s.current_amount, 0) as double) as amount,
  c.display_unit as unit
from m_wallets w join m_currencies c on w.currency_id = c.id
left join (select p.wallet_id, cast(sum(p.amount) as bigint) as current_amount from t_payments p
           where p.wallet_id is not null group by p.wallet_id, p.expiry_at, p.usage_restriction) s on w.id = s.wallet_id
where w.is_active
union all
select 'STOCK' as section, d.item_name_receipt as item, inv.current_quantity as amount,
  case d.destination when 'FRIDGE' then 'fridge' when 'FREEZER' then 'freezer' when 'PANTRY' then 'pantry' else '' end
    as unit
from t_inventory_snapshot inv join t_transaction_details d on inv.detail_id = d.id
join t_transactions t on d.transaction_id = t.id
where inv.current_quantity > 0""")
def r05(led):
    """Wallet balances and stock in one listing."""
    w = M.wallet_balances(led).select(F.lit("WALLET").alias("section"), c("name").alias("item"),
                                      c("total").cast("double").alias("amount"), c("display_unit").alias("unit"))
    s = K.stock_report(led, AS_OF).select(F.lit("STOCK").alias("section"), c("item_name_receipt").alias("item"),
                                          c("current_quantity").alias("amount"), c("place").alias("unit"))
    return w.unionByName(s)
