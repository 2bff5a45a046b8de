"""Registered stock queries (S-03, J-04, J-05, J-13, W-06, A-11, A-13, V-08, R-04, R-11)."""

from __future__ import annotations

from ..operators import stock as K
from .catalog import AS_OF, register


@register("s03_create_lots", "select * from t_inventory")
def s03(led):
    return K.create_lots(led["t_transaction_details"], led["t_transactions"])


@register("w06_greedy_consumption", "select * from decisions")
def w06(led):
    """Accept / reject each request against what is left in its lot (order-dependent fold)."""
    return K.greedy_consumption(led["consume_requests"], led["t_inventory"])


@register("r11_record_consumption", "select * from t_meal_details")
def r11(led):
    """Accepted consumption items of the batch (rejects are V-08)."""
    return K.record_consumption(led["consume_requests"], led["t_inventory"])["t_meal_details"]


@register("j13_drop_empty_meals", "select * from t_meal_logs")
def j13(led):
    return K.ensure_consumption(led)["t_meal_logs"]


@register("a11_stock_snapshot", "select * from t_inventory_snapshot")
def a11(led):
    return K.ensure_consumption(led)["t_inventory_snapshot"]


@register("v08_check_overdraw", """select request_id, inventory_id, meal_id, amount, reason, remaining_after as available
from decisions where not accepted""")
def v08(led):
    return K.check_overdraw(led)


@register("j05_consumption_lineage", """select md.id as item_id, md.meal_id, ml.eaten_at, md.inventory_id, md.detail_id,
  d.transaction_id, d.item_name_receipt, d.food_type, d.food_id, md.amount_consumed, md.consume_type
from t_meal_details md join t_meal_logs ml on md.meal_id = ml.id
join t_transaction_details d on md.detail_id = d.id""")
def j05(led):
    return K.consumption_lineage(led)


LOTS_SQL = """select inv.id as inv_id, d.item_name_receipt, inv.current_quantity, t.transaction_at,
  d.destination as location, d.limit_date, d.limit_type, u.shelf_life_days_guideline
from t_inventory_snapshot inv join t_transaction_details d on inv.detail_id = d.id
join t_transactions t on d.transaction_id = t.id
left join m_foods u on d.food_id = u.id and d.food_type = 'UNIVERSAL' and u.food_kind = 'UNIVERSAL'"""


@register("j04_stock_lots", LOTS_SQL)
def j04(led):
    return K.stock_lots(led)


_DUE = ("coalesce(limit_date, transaction_at + to_microseconds(cast(round(shelf_life_days_guideline * 86400e6) "
        "as bigint)))")


@register("r04_stock_report", f"""select inv_id, item_name_receipt,
  case location when 'FRIDGE' then 'fridge' when 'FREEZER' then 'freezer' when 'PANTRY' then 'pantry' else '' end as place,
  current_quantity, {_DUE} as due_at,
  case when limit_date is not null then case when limit_type = 'CONSUMPTION' then 'CONSUMPTION' else 'BEST_BEFORE' end
       when shelf_life_days_guideline is not null then 'GUIDELINE' end as due_kind,
  case when {_DUE} is null then ''
       when {_DUE} < timestamp '{AS_OF}' then case when limit_date is not null then 'EXPIRED' else 'GUIDELINE_EXCEEDED' end
       when {_DUE} < timestamp '{AS_OF}' + interval 2 day then 'SOON' else '' end as status,
  coalesce(limit_date, transaction_at + to_microseconds(cast(round(coalesce(shelf_life_days_guideline, 9999.0e0) * 86400e6)
    as bigint))) as sort_key
from ({LOTS_SQL}) l where current_quantity > 0""")
def r04(led):
    return K.stock_report(led, AS_OF)


@register("a13_consumption_cost", """select cast(ml.eaten_at as date) as day, md.consume_type,
  cast(sum(cast(md.amount_consumed * d.unit_price_ex_tax * (1.0e0 + d.tax_rate) as decimal(28,8))) as double) as cost,
  count(*) as items
from t_meal_details md join t_meal_logs ml on md.meal_id = ml.id
join t_transaction_details d on md.detail_id = d.id
group by cast(ml.eaten_at as date), md.consume_type""")
def a13(led):
    return K.consumption_cost(led)
