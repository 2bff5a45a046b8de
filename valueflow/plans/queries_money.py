"""Registered money-side queries (J-01, J-02, J-08, J-11, J-12, A-03, A-09, A-10, A-12, W-01, W-02, W-05, R-10, R-12)."""

from __future__ import annotations

import datetime as dt

from ..operators import money as M
from .catalog import AS_OF, FUNDS_AS_OF, FUNDS_DAYS, register

LIMITED = "(p.expiry_at is not null or p.usage_restriction is not null)"

SNAPSHOT_SQL = f"""select p.wallet_id, p.expiry_at, p.usage_restriction,
  case when {LIMITED} then max(p.id) end as origin_payment_id,
  cast(sum(p.amount) as bigint) as current_amount, max(t.transaction_at) as updated_at
from {{payments}} p left join t_transactions t on p.transaction_id = t.id
where p.wallet_id is not null group by p.wallet_id, p.expiry_at, p.usage_restriction"""

GROUPS_SQL = f"""select p.wallet_id, p.expiry_at, p.usage_restriction, cast(sum(p.amount) as bigint) as total,
  count(*) as members, min(p.transaction_id) as first_transaction_id, min(p.id) as first_payment_id,
  max(p.id) as last_payment_id
from t_payments p where p.wallet_id is not null and {LIMITED}
group by p.wallet_id, p.expiry_at, p.usage_restriction"""

LOT_ORDER = "l.first_transaction_id, l.expiry_at asc nulls last, l.usage_restriction asc nulls first"

def offsets_sql(cap: bool = True, order: str = LOT_ORDER, alive: str = "true") -> str:
    """Sequential settlement as overlaps of two stretches: movements and lots of a wallet, laid end to end."""
    default = "abs(m.move)" if cap else "h.held"
    return f"""(with mv as (
  select movement_id, transaction_id, wallet_id, -amount as move, requested_offset,
    case when regexp_matches(trim(new_expiry_text), '^[0-9]{{8}}$')
      then try_strptime(trim(new_expiry_text), '%Y%m%d') end as new_expiry, new_restriction
  from raw_movements),
lots as (
  select l.*, sum(abs(l.total)) over (partition by l.wallet_id, l.total > 0 order by {order} rows unbounded preceding) as lot_end,
    row_number() over (partition by l.wallet_id, l.total > 0 order by {order}) as lot_no
  from ({GROUPS_SQL}) l where l.total <> 0 and {alive}),
held as (select wallet_id, total > 0 as spends, max(lot_end) as held from lots group by all),
wants as (
  select *, sum(need) over (partition by wallet_id, move < 0 order by movement_id rows unbounded preceding) as mv_end
  from (select m.*, least(greatest(coalesce(m.requested_offset, {default}), 0), h.held) as need
        from mv m join held h on m.wallet_id = h.wallet_id and (m.move < 0) = h.spends where m.move <> 0) n where need > 0),
cut as (
  select w.movement_id, w.transaction_id, w.wallet_id, l.lot_no, l.expiry_at, l.usage_restriction, l.total, l.lot_end,
    least(l.lot_end, w.mv_end) as upper, greatest(l.lot_end - abs(l.total), w.mv_end - w.need) as lower
  from wants w join lots l on w.wallet_id = l.wallet_id and (w.move < 0) = (l.total > 0)),
offs as (
  select movement_id, transaction_id, wallet_id, 'OFFSET' as kind, cast(lot_no as integer) as lot_no, expiry_at,
    usage_restriction, cast(case when total < 0 then upper - lower else lower - upper end as bigint) as amount,
    cast(case when total < 0 then upper - lot_end else lot_end - upper end as bigint) as remaining_amount
  from cut where upper > lower)
select * from offs
union all
select mv.movement_id, mv.transaction_id, mv.wallet_id, 'RESIDUAL' as kind, cast(null as integer) as lot_no,
  mv.new_expiry as expiry_at, mv.new_restriction as usage_restriction,
  cast(mv.move - coalesce(u.used, 0) as bigint) as amount,
  cast(case when mv.new_expiry is not null or mv.new_restriction is not null
    then mv.move - coalesce(u.used, 0) else 0 end as bigint) as remaining_amount
from mv left join (select movement_id, sum(amount) as used from offs group by movement_id) u
  on mv.movement_id = u.movement_id
where mv.move - coalesce(u.used, 0) <> 0)"""


OFFSETS_SQL = offsets_sql()


@register("j01_wallets_with_currency", """select w.id, w.name, c.name as currency_name, c.display_unit
from m_wallets w join m_currencies c on w.currency_id = c.id""")
def j01(led):
    return M.wallets_with_currency(led)


@register("a09_balance_snapshot", SNAPSHOT_SQL.format(payments="t_payments"))
def a09(led):
    return M.ledger_balances(led)


@register("a10_wallet_total", f"""select wallet_id, cast(sum(current_amount) as bigint) as total, count(*) as groups
from ({SNAPSHOT_SQL.format(payments="t_payments")}) s group by wallet_id""")
def a10(led):
    return M.wallet_total(M.ledger_balances(led))


@register("j02_wallet_balances", f"""select w.id as wallet_id, w.name, c.display_unit, s.expiry_at, s.usage_restriction,
  coalesce(s.current_amount, 0) as total, format('{{:,}}', coalesce(s.current_amount, 0)) || c.display_unit as amount_text
from m_wallets w join m_currencies c on w.currency_id = c.id
left join ({SNAPSHOT_SQL.format(payments="t_payments")}) s on w.id = s.wallet_id
where w.is_active""")
def j02(led):
    return M.wallet_balances(led)


@register("a03_limited_groups", GROUPS_SQL)
def a03(led):
    return M.limited_groups(led["t_payments"])


@register("a03_limited_members", f"""select p.id as payment_id, p.transaction_id, p.wallet_id, p.expiry_at, p.usage_restriction, p.amount,
  cast(sum(p.amount) over (partition by p.wallet_id, p.expiry_at, p.usage_restriction) as bigint) as total
from t_payments p where p.wallet_id is not null and {LIMITED}""")
def a03_members(led):
    return M.limited_members(led["t_payments"])


@register("w05_latest_origin", f"""select p.wallet_id, p.expiry_at, p.usage_restriction, max(p.id) as latest_origin_id
from t_payments p where p.wallet_id is not null and {LIMITED}
group by p.wallet_id, p.expiry_at, p.usage_restriction""")
def w05(led):
    return M.latest_origin(led["t_payments"])


@register("w01_remaining_after_movement", f"""select p.*, cast(case when {LIMITED} then
  sum(p.amount) over (partition by p.wallet_id, p.expiry_at, p.usage_restriction order by p.id
    rows between unbounded preceding and current row) else 0 end as bigint) as remaining_amount
from t_payments p where p.wallet_id is not null""")
def w01(led):
    return M.remaining_after_movement(led["t_payments"])


@register("j08_balance_attribute_match", f"""select p.id as payment_id, p.wallet_id, p.expiry_at, p.usage_restriction,
  s.current_amount, s.origin_payment_id
from t_payments p join ({SNAPSHOT_SQL.format(payments="t_payments")}) s
  on p.wallet_id = s.wallet_id and p.expiry_at is not distinct from s.expiry_at
  and p.usage_restriction is not distinct from s.usage_restriction
where p.wallet_id is not null""")
def j08(led):
    return M.balance_attribute_match(led["t_payments"], M.ledger_balances(led))


@register("w02_offset_limited_funds", f"select * from {OFFSETS_SQL} x")
def w02(led):
    return M.offset_limited_funds(led["t_payments"], led["raw_movements"], cap=True)


@register("w02_whole_lots", f"select * from {offsets_sql(cap=False)} x")
def w02_whole(led):
    return M.offset_limited_funds(led["t_payments"], led["raw_movements"], cap=False)


@register("w02_by_expiry", f"""select * from {offsets_sql(
    order="l.expiry_at asc nulls last, l.first_transaction_id, l.usage_restriction asc nulls first",
    alive=f"(l.expiry_at is null or l.expiry_at >= timestamp '{FUNDS_AS_OF}')")} x""")
def w02_expiry(led):
    return M.offset_limited_funds(led["t_payments"], led["raw_movements"], order="expiry", as_of=FUNDS_AS_OF)


NEW_PAYMENTS_SQL = f"""(select cast((select coalesce(max(id), 0) from t_payments)
    + row_number() over (order by movement_id, lot_no asc nulls last) as bigint) as id, transaction_id, wallet_id,
  amount, remaining_amount, expiry_at, usage_restriction from {OFFSETS_SQL} x)"""


@register("r10_new_payments", f"select * from {NEW_PAYMENTS_SQL} np")
def r10_payments(led):
    return M.settle_payments(led)["payments"]


@register("r10_settle_payments", SNAPSHOT_SQL.format(
    payments=f"(select id, transaction_id, wallet_id, amount, expiry_at, usage_restriction from t_payments "
             f"union all select * exclude (remaining_amount) from {NEW_PAYMENTS_SQL} np)"))
def r10(led):
    return M.settle_payments(led)["snapshot"]


_H = dt.datetime.fromisoformat(FUNDS_AS_OF) + dt.timedelta(days=FUNDS_DAYS)


@register("r12_expiring_funds", f"""select s.*, case when s.expiry_at <= timestamp '{FUNDS_AS_OF}' then 'LAPSED'
  else 'EXPIRING' end as status
from ({SNAPSHOT_SQL.format(payments="t_payments")}) s
where s.expiry_at is not null and s.expiry_at < timestamp '{_H}' and s.current_amount <> 0""")
def r12(led):
    return M.expiring_funds(M.ledger_balances(led), FUNDS_AS_OF, FUNDS_DAYS)


@register("j11_rate_as_of", """select x.id, x.wallet_id, x.currency_id, x.amount, x.transaction_at,
  r.id as rate_id, r.rate_to_jpy, x.amount * r.rate_to_jpy as value_jpy
from (select p.id, p.wallet_id, w.currency_id, p.amount, t.transaction_at
      from t_payments p left join t_transactions t on p.transaction_id = t.id
      join m_wallets w on p.wallet_id = w.id) x
asof left join t_currency_rates r on x.currency_id = r.currency_id and x.transaction_at >= r.effective_at""")
def j11(led):
    return M.payment_rates(led)


@register("a12_wallet_value_jpy", f"""select t.wallet_id, w.currency_id, t.total, r.rate_to_jpy,
  t.total * r.rate_to_jpy as value_jpy
from (select wallet_id, cast(sum(current_amount) as bigint) as total
      from ({SNAPSHOT_SQL.format(payments="t_payments")}) s group by wallet_id) t
join m_wallets w on t.wallet_id = w.id
left join (select currency_id, arg_max(rate_to_jpy, effective_at) as rate_to_jpy from t_currency_rates
           where effective_at <= timestamp '{FUNDS_AS_OF}' group by currency_id) r on w.currency_id = r.currency_id""")
def a12(led):
    return M.wallet_value_jpy(led, FUNDS_AS_OF)


@register("j12_currency_successor", f"""with recursive chain(currency_id, valid_currency_id, hops) as (
  select id, id, cast(0 as bigint) from m_currencies
  union all
  select ch.currency_id, m.successor_id, ch.hops + 1 from chain ch join m_currencies m on ch.valid_currency_id = m.id
  where m.end_at is not null and m.end_at <= timestamp '{AS_OF}' and m.successor_id is not null)
select currency_id, arg_max(valid_currency_id, hops) as valid_currency_id, max(hops) as hops
from chain group by currency_id""")
def j12(led):
    return M.currency_successor(led["m_currencies"], AS_OF)
