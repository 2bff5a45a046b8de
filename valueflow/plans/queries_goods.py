"""Registered goods-side queries (J-03, J-07, A-02, A-06…A-08, A-14, W-03, R-01…R-03)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import goods as G
from .catalog import AS_OF, MONTH, register

STORE_SQL = """t_transactions t left join m_store_branches sb on t.branch_id = sb.id
left join m_brands b on sb.brand_id = b.id"""

LIST_SQL = f"""select t.id, t.transaction_at, t.transaction_name, b.name as brand,
  coalesce(cast(p.total as bigint), 0) as total
from {STORE_SQL}
left join (select transaction_id, sum(amount) as total from t_payments group by transaction_id) p
  on t.id = p.transaction_id"""

TRUNC = "case when {x} >= 0 then floor({x}) else ceil({x}) end"
CHECKOUT_LINE = "greatest(unit_price_ex_tax * quantity - coalesce(discount_amount, 0.0e0), 0.0e0) * (1.0e0 + tax_rate)"
DISPLAY_LINE = "unit_price_ex_tax * quantity * (1.0e0 + tax_rate)"


@register("j03_transaction_store", f"""select t.*, sb.brand_id, sb.branch_name, b.name as brand_name
from {STORE_SQL}""")
def j03(led):
    return G.transaction_store(led)


@register("j07_payments_with_wallet", """select p.*, w.name as wallet_name
from t_payments p join m_wallets w on p.wallet_id = w.id""")
def j07(led):
    return G.payments_with_wallet(led)


@register("a02_transaction_list", LIST_SQL)
def a02(led):
    """Whole-ledger transaction list with brand and movement total."""
    return G.transaction_list(led)


def _recent_bounds():
    end = dt.datetime.fromisoformat(AS_OF)
    return end - dt.timedelta(days=30), end


_RS, _RE = _recent_bounds()


@register("r01_recent_transactions", f"""select l.*, row_number() over (order by transaction_at desc, id desc) as position
from ({LIST_SQL}) l where transaction_at between timestamp '{_RS}' and timestamp '{_RE}'""")
def r01(led):
    return G.recent_transactions(led, AS_OF)


_M0 = dt.datetime(int(MONTH[:4]), int(MONTH[4:]), 1)
_M1 = dt.datetime(_M0.year + (_M0.month == 12), _M0.month % 12 + 1, 1)


@register("r02_monthly_transactions", f"""select l.*, row_number() over (order by transaction_at desc, id desc) as position
from ({LIST_SQL}) l where transaction_at >= timestamp '{_M0}' and transaction_at < timestamp '{_M1}'""")
def r02(led):
    return G.monthly_transactions(led, MONTH)


@register("w03_list_numbering", f"""select l.*, cast(date_trunc('month', transaction_at) as date) as month,
  row_number() over (partition by date_trunc('month', transaction_at) order by transaction_at desc, id desc) as position
from ({LIST_SQL}) l""")
def w03(led):
    """Position of each transaction in its month's newest-first listing."""
    lst = G.transaction_list(led).withColumn("month", F.trunc(F.to_date("transaction_at"), "month"))
    return G.list_numbering(lst, ["month"])


@register("a06_receipt_checkout_total", f"""select transaction_id,
  cast(sum({TRUNC.format(x=CHECKOUT_LINE)}) as bigint) as checkout_total, count(*) as n_lines
from t_transaction_details group by transaction_id""")
def a06(led):
    return G.receipt_checkout_total(led)


@register("a07_receipt_display_total", f"""select transaction_id,
  cast(sum({TRUNC.format(x=DISPLAY_LINE)}) as bigint) as display_total, count(*) as n_lines
from t_transaction_details group by transaction_id""")
def a07(led):
    return G.receipt_display_total(led)


@register("a08_receipt_rounded_once", f"""select s.transaction_id, cast(floor(s.exact_total) as bigint) as rounded_total,
  cast(floor(s.exact_total) as bigint) + coalesce(t.tax_adjustment_jpy, 0) as receipt_total
from (select transaction_id, sum(cast({CHECKOUT_LINE} as decimal(28,8))) as exact_total
      from t_transaction_details group by transaction_id) s
left join t_transactions t on s.transaction_id = t.id""")
def a08(led):
    return G.receipt_rounded_once(led)


@register("a14_surplus_deficit", f"""select month,
  cast(sum(case when side = 'INCOME' then amt else 0 end) as bigint) as income,
  cast(sum(case when side = 'EXPENSE' then amt else 0 end) as bigint) as expense,
  cast(sum(case when side = 'UNCLASSIFIED' then amt else 0 end) as bigint) as unclassified,
  cast(sum(case when side = 'INCOME' then amt else 0 end) - sum(case when side = 'EXPENSE' then amt else 0 end) as bigint)
    as surplus
from (select cast(date_trunc('month', t.transaction_at) as date) as month,
        case when d.food_type in ('UNIVERSAL','MEASURED','PROCESSED','OUT_EAT') then 'EXPENSE'
             when c.type is not null then c.type else 'UNCLASSIFIED' end as side,
        cast({TRUNC.format(x=CHECKOUT_LINE)} as bigint) as amt
      from t_transaction_details d left join m_categories c on d.category_id = c.id
      join t_transactions t on d.transaction_id = t.id
      where coalesce(d.food_type, 'NONE') <> 'ADJUSTMENT') x
group by month""")
def a14(led):
    return G.surplus_deficit(led)


@register("r03_transaction_detail_header", f"""select t.id, t.transaction_at,
  coalesce(strftime(t.transaction_at, '%Y/%m/%d %H:%M'), '---') as at_text,
  coalesce(nullif(t.transaction_name, ''), nullif(b.name, ''), '(untitled)') as title,
  b.name as brand_name, sb.branch_name, coalesce(dt.display_total, 0) as display_total,
  abs(t.total_amount_jpy) as confirmed_total,
  case when t.total_amount_jpy > 0 then 'INCOME' else 'EXPENSE' end as direction
from {STORE_SQL}
left join (select transaction_id, cast(sum({TRUNC.format(x=DISPLAY_LINE)}) as bigint) as display_total
           from t_transaction_details group by transaction_id) dt on t.id = dt.transaction_id""")
def r03h(led):
    return G.transaction_detail(led)["header"]


@register("r03_transaction_detail_lines", f"""select transaction_id, id as detail_id, item_name_receipt,
  cast({TRUNC.format(x='unit_price_ex_tax')} as bigint) as unit_price, quantity,
  cast({TRUNC.format(x=DISPLAY_LINE)} as bigint) as gross,
  case destination when 'EAT_NOW' then 'eat now' when 'FRIDGE' then 'fridge' when 'FREEZER' then 'freezer'
    when 'PANTRY' then 'pantry' else 'other' end as destination_label
from t_transaction_details""")
def r03l(led):
    return G.transaction_detail(led)["lines"]


@register("r03_transaction_detail_payments", """select p.transaction_id, p.id as payment_id, w.name as wallet_name,
  abs(p.amount) as amount_abs, case when p.amount > 0 then 'INCOME' else 'EXPENSE' end as direction,
  concat_ws(' ', case when p.expiry_at is not null then 'until ' || strftime(p.expiry_at, '%y/%m/%d') end,
            p.usage_restriction) as note
from t_payments p join m_wallets w on p.wallet_id = w.id""")
def r03p(led):
    return G.transaction_detail(led)["payments"]
