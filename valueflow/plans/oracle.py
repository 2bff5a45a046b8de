"""DuckDB oracle text: the ledger views over the star tables, as CTEs.

``with_ledger(body)`` prefixes a query body with ``WITH RECURSIVE`` and the
view definitions it needs, so each oracle query is one self-contained SQL
string that DuckDB runs over the pre-registered star tables.  The mapping
mirrors ``sources.ledger.Ledger.from_star`` line by line.
"""

from __future__ import annotations

import re

VIEWS: list[tuple[str, str]] = [
    ("m_currencies", """
select cast(r_regionkey as bigint) as id, r_name as code, r_name as name, 'u' as display_unit,
  case when r_regionkey > 0 then timestamp '1995-01-01 00:00:00' end as start_at,
  case when r_regionkey in (2,3) then timestamp '1998-01-01 00:00:00' end as end_at,
  case r_regionkey when 2 then cast(3 as bigint) when 3 then cast(4 as bigint) end as successor_id
from region"""),
    ("t_currency_rates", """
select min(o_orderkey) as id, o_custkey % 5 as currency_id,
  max(case when o_custkey % 5 = 0 then 1.0e0 else o_totalprice / 1.0e5 end) as rate_to_jpy,
  case when min(o_orderkey) % 4 = 0 then 'QUANTITY_ADJUST' else 'VALUE_ADJUST' end as change_type,
  o_orderdate as effective_at
from orders group by o_custkey % 5, o_orderdate"""),
    ("m_wallets", """
select c_custkey as id, c_name as name,
  case when c_custkey % 13 = 0 then null else cast(n_regionkey as bigint) end as currency_id,
  case c_mktsegment when 'HOUSEHOLD' then 'CASH' when 'MACHINERY' then 'BANK' when 'FURNITURE' then 'CREDIT'
    when 'BUILDING' then 'PREPAID' else 'POINT' end as wallet_group,
  c_acctbal >= 0 as is_active
from customer join nation on c_nationkey = n_nationkey"""),
    ("m_foods", """
select p_partkey as id, p_name || ' ' || p_brand as name,
  case p_partkey % 6 when 2 then 'UNIVERSAL' when 3 then 'MEASURED' else 'PROCESSED' end as food_kind,
  case when p_partkey % 6 = 2 and p_size % 5 <> 0 then cast(p_size as double) end as shelf_life_days_guideline,
  case when p_partkey % 11 <> 0 then p_retailprice / 10 end as energy_kcal,
  case when p_partkey % 7 <> 0 then p_size * 0.3e0 end as protein_g,
  p_size * 0.2e0 as fat_g, p_size * 0.9e0 as carb_g, (p_partkey % 9) * 0.1e0 as salt_equiv_g,
  (p_partkey % 10) * 1.0e0 as taste_sweet, (p_partkey % 8) * 1.0e0 as taste_salty, (p_partkey % 7) * 1.0e0 as taste_sour,
  (p_partkey % 5) * 1.0e0 as taste_bitter, (p_partkey % 4) * 1.0e0 as taste_umami, (p_partkey % 3) * 1.0e0 as taste_pungent,
  (p_partkey % 2) * 1.0e0 as taste_cooling, (p_size % 4) * 1.0e0 as taste_astringency, (p_size % 6) * 1.0e0 as taste_richness,
  (p_size % 9) * 1.0e0 as taste_sharpness
from part where p_partkey % 6 >= 2"""),
    ("m_brands", "select cast(n_nationkey as bigint) as id, n_name as name from nation"),
    ("m_store_branches", """
select s_suppkey as id, cast(s_nationkey as bigint) as brand_id, s_name as branch_name from supplier"""),
    ("m_categories", """
select cast(n_nationkey as bigint) as id, 'CAT_' || n_name as name,
  case when n_nationkey < 11 then 'EXPENSE' when n_nationkey < 14 then 'INCOME' end as type
from nation where n_nationkey < 15"""),
    ("t_transactions", """
select o_orderkey as id, case when o_orderkey % 7 = 0 then null else o_orderpriority end as transaction_name,
  case when o_orderstatus = 'P' then null else o_custkey % 10 end as branch_id,
  o_orderdate as transaction_at, o_orderpriority <> '5-LOW' as is_public,
  cast(case when o_orderkey % 20 = 0 then 1 else 0 end as bigint) as tax_adjustment_jpy,
  cast(floor(o_totalprice) as bigint) as total_amount_jpy
from orders"""),
    ("t_transaction_details", """
select ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as id,
  l_orderkey as transaction_id,
  case when l_partkey % 6 = 0 then l_suppkey % 15 end as category_id,
  case l_partkey % 6 when 0 then 'NONE' when 1 then 'ADJUSTMENT' when 2 then 'UNIVERSAL' when 3 then 'MEASURED'
    when 4 then 'PROCESSED' else 'OUT_EAT' end as food_type,
  case when l_partkey % 6 >= 2 then l_partkey end as food_id,
  'item ' || cast(l_partkey as varchar) as item_name_receipt,
  l_extendedprice / l_quantity as unit_price_ex_tax, l_quantity as quantity, l_tax as tax_rate,
  case when l_linenumber = 7 then l_extendedprice * 2 else l_extendedprice * l_discount end as discount_amount,
  case when l_partkey % 6 = 5 then 'EAT_NOW' when l_partkey % 6 < 2 then 'EAT_NOW'
    when l_returnflag = 'A' and l_linestatus = 'F' then 'FRIDGE' when l_returnflag = 'A' then 'FREEZER'
    when l_returnflag = 'N' then 'PANTRY' when l_linestatus = 'F' then 'EAT_NOW' else 'GIFT' end as destination,
  case when l_linenumber % 3 <> 0 then l_shipdate end as limit_date,
  case l_linenumber % 3 when 1 then 'CONSUMPTION' when 2 then 'BEST_BEFORE' end as limit_type,
  cast(case when l_linenumber % 5 <> 0 then l_linenumber % 5 end as integer) as reliability_level,
  case l_linenumber when 1 then 'A' when 2 then 'B' when 3 then 'C' when 4 then 'D' when 5 then 'J' end as condition_rank
from lineitem"""),
    ("t_payments", """
select event_id as id, event_id as transaction_id,
  case when event_type = 'error' then null else user_id end as wallet_id,
  cast(case when event_type in ('purchase','click') then -1 else 1 end * floor(value * 10) as bigint) as amount,
  case when event_id % 4 = 0 then date_trunc('month', ts) end as expiry_at,
  case when event_id % 10 = 0 then 'R' || cast(event_id % 3 as varchar) end as usage_restriction
from events"""),
    ("t_inventory", """
select d.id as id, d.id as detail_id, d.quantity as current_quantity, t.transaction_at as updated_at
from t_transaction_details d join t_transactions t on d.transaction_id = t.id
where d.destination in ('FRIDGE','FREEZER','PANTRY')"""),
    ("consume_requests", """
select d.id * 4 + k.k as request_id, d.id as inventory_id, d.transaction_id * 4 + k.k as meal_id,
  d.quantity * k.frac as amount,
  case (k.k - 1 + d.id) % 3 when 0 then 'SELF' when 1 then 'LOSS' else 'GIFT' end as consume_type,
  t.transaction_at + to_days(cast(k.k as integer)) as requested_at, cast(k.k as bigint) as seq
from t_transaction_details d join t_transactions t on d.transaction_id = t.id
cross join (values (1, 0.5e0), (2, 0.7e0), (3, 0.3e0)) as k(k, frac)
where d.destination in ('FRIDGE','FREEZER','PANTRY')"""),
    ("raw_movements", """
select max(o_orderkey) as movement_id, max(o_orderkey) as transaction_id, o_custkey as wallet_id,
  cast(floor(arg_max(o_totalprice, o_orderkey) / 1000) as bigint) as amount,
  case when max(o_orderkey) % 3 = 0 then cast(floor(arg_max(o_totalprice, o_orderkey) / 4000) as bigint) end
    as requested_offset,
  case when max(o_orderkey) % 5 = 0 then '20240331' end as new_expiry_text,
  case when max(o_orderkey) % 7 = 0 then 'R9' end as new_restriction,
  arg_max(o_orderdate, o_orderkey) as moved_at
from orders group by o_custkey, o_orderkey % 4"""),
    ("raw_receipts", """
select l_orderkey as receipt_id,
  case when o_orderkey % 97 = 0 then '202613011200' when o_orderkey % 4 = 0 then strftime(o_orderdate, '%Y%m%d') else strftime(o_orderdate, '%Y%m%d%H%M') end as at_text,
  case when o_orderpriority = '5-LOW' then 'n' else 'y' end as public_text,
  case when o_orderkey % 9 = 0 then lower(n_name) when o_orderkey % 13 = 0 then substr(n_name, 1, 2) || substr(n_name, 4) else n_name end as brand_text,
  case when o_orderkey % 11 = 0 then replace(s_name, 'Supplier#', 'Sup ') else s_name end as branch_text,
  cast(l_linenumber as bigint) as line_no,
  case when l_partkey % 6 >= 2 then case l_linenumber when 3 then upper(p_name || ' ' || p_brand)
    when 5 then substr(p_name || ' ' || p_brand, 1, 2) || substr(p_name || ' ' || p_brand, 4)
    when 7 then substr(p_name || ' ' || p_brand, 1, 2) || substr(p_name || ' ' || p_brand, 4, 1) || substr(p_name || ' ' || p_brand, 3, 1)
      || substr(p_name || ' ' || p_brand, 5)
    else p_name || ' ' || p_brand end else 'item ' || cast(l_partkey as varchar) end as item_text,
  case l_partkey % 6 when 0 then cast(l_suppkey % 15 as varchar) when 1 then 'a' when 2 then 'u' when 3 then 'm'
    when 4 then 'p' else 'o' end as kind_text,
  case when l_linenumber = 6 then 'x' else '' end || cast(cast(floor(l_extendedprice / l_quantity) as bigint) as varchar)
    as price_text,
  case when l_partkey % 107 = 0 then '-1' else cast(l_quantity as varchar) end as qty_text,
  case when l_partkey % 101 = 0 then 'abc' when l_linenumber % 4 = 0 then '' else cast(l_tax as varchar) end as tax_text,
  case when l_partkey % 103 = 0 then 'zz' when l_linenumber = 2 then cast(cast(floor(l_extendedprice * l_discount) as bigint) as varchar) else '' end
    as discount_text,
  case when l_returnflag = 'A' then '2' when l_returnflag = 'N' then '4' else '1' end as dest_text,
  case when l_linenumber = 5 then '20011340' when l_linenumber % 3 <> 0 then strftime(l_shipdate, '%Y%m%d') end
    as limit_text,
  case when l_linenumber % 2 = 0 then '2' else '1' end as limit_kind_text
from lineitem join (select o.*, s.s_name, n.n_name from orders o
  left join supplier s on o.o_custkey % 10 = s.s_suppkey left join nation n on s.s_nationkey = n.n_nationkey) h
  on l_orderkey = o_orderkey
left join part on l_partkey = p_partkey"""),
    ("receipt_parsed", """
select receipt_id, line_no, coalesce(at_ts, timestamp '{as_of}') as transaction_at, pub as is_public, brand_text, branch_text,
  item_text, ft as food_type, category_id, unit_price, quantity,
  coalesce(tax, case when not pub then 0.0e0 when ft in ('UNIVERSAL','MEASURED','PROCESSED') then 0.08e0 else 0.10e0 end) as tax_rate,
  coalesce(discount, 0.0e0) as discount_amount, dest as destination, limit_date,
  case when limit_date is not null then case when trim(limit_kind_text) = '2' then 'BEST_BEFORE' else 'CONSUMPTION' end end
    as limit_type,
  case when coalesce(trim(at_text), '') <> '' and at_ts is null then 'BAD_TIME'
    when unit_price is null then 'BAD_PRICE'
    when quantity is null or quantity < 0 then 'BAD_QUANTITY'
    when coalesce(trim(tax_text), '') <> '' and (tax is null or tax < 0) then 'BAD_TAX'
    when coalesce(trim(discount_text), '') <> '' and (discount is null or discount < 0) then 'BAD_DISCOUNT' end as reject_reason
from (select *,
  case when regexp_full_match(tt, '[0-9]{12}') then try_strptime(tt, '%Y%m%d%H%M')
       when regexp_full_match(tt, '[0-9]{8}') then try_strptime(tt, '%Y%m%d') end as at_ts,
  case when regexp_full_match(k, '[0-9]+') then try_cast(k as bigint) end as category_id,
  case when regexp_full_match(pt, '-?[0-9]+') then try_cast(pt as bigint) end as unit_price,
  try_cast(translate(trim(qty_text), '０１２３４５６７８９', '0123456789') as double) as quantity,
  try_cast(translate(trim(tax_text), '０１２３４５６７８９', '0123456789') as double) as tax,
  try_cast(translate(trim(discount_text), '０１２３４５６７８９', '0123456789') as double) as discount,
  case when dest in ('FRIDGE','FREEZER','PANTRY') and coalesce(trim(limit_text) <> '', false) then
    case when regexp_full_match(lt, '[0-9]{8}') then try_strptime(lt, '%Y%m%d') end end as limit_date
from (select *,
    case when ft in ('UNIVERSAL','MEASURED','PROCESSED') then
      coalesce(case trim(dest_text) when '1' then 'EAT_NOW' when '2' then 'FRIDGE' when '3' then 'FREEZER'
                 when '4' then 'PANTRY' when '5' then 'GIFT' end, 'EAT_NOW') else 'EAT_NOW' end as dest
  from (select *, translate(trim(at_text), '０１２３４５６７８９', '0123456789') as tt,
      translate(trim(price_text), '０１２３４５６７８９', '0123456789') as pt,
      translate(trim(limit_text), '０１２３４５６７８９', '0123456789') as lt,
      lower(trim(kind_text)) as k,
      coalesce(lower(trim(public_text)) <> 'n', true) as pub,
      case when regexp_full_match(lower(trim(kind_text)), '[0-9]+') then 'NONE'
        else coalesce(case lower(trim(kind_text)) when 'u' then 'UNIVERSAL' when 'm' then 'MEASURED'
          when 'p' then 'PROCESSED' when 'o' then 'OUT_EAT' when 'a' then 'ADJUSTMENT' when 'x' then 'NONE' end,
          'NONE') end as ft
    from raw_receipts) a) b) c"""),
    ("receipt_lines", "select * exclude (reject_reason) from receipt_parsed where reject_reason is null"),
    # --- consumption fold (recursive), the oracle of the streaming fold ---
    ("req_lots", """
select r.*, i.detail_id, i.current_quantity as lot_quantity,
  row_number() over (partition by r.inventory_id order by r.seq, r.request_id) as rn
from consume_requests r join t_inventory i on r.inventory_id = i.id"""),
    ("fold", """
select q.inventory_id, q.rn, q.request_id,
  coalesce(q.amount >= 0 and q.amount <= q.lot_quantity, false) as accepted,
  case when q.amount >= 0 and q.amount <= q.lot_quantity then q.lot_quantity - q.amount else q.lot_quantity end
    as remaining_after
from req_lots q where q.rn = 1
union all
select q.inventory_id, q.rn, q.request_id,
  coalesce(q.amount >= 0 and q.amount <= f.remaining_after, false),
  case when q.amount >= 0 and q.amount <= f.remaining_after then f.remaining_after - q.amount
    else f.remaining_after end
from fold f join req_lots q on q.inventory_id = f.inventory_id and q.rn = f.rn + 1"""),
    ("decisions", """
select q.request_id, q.inventory_id, q.meal_id, q.detail_id, q.amount, q.consume_type, q.requested_at, q.seq,
  q.lot_quantity, f.accepted,
  case when f.accepted then null when q.amount is null or q.amount < 0 then 'INVALID_AMOUNT' else 'OVERDRAW' end
    as reason,
  f.remaining_after
from req_lots q join fold f on q.request_id = f.request_id"""),
    ("t_meal_details", """
select request_id as id, cast(null as varchar) as meal_name, meal_id, inventory_id, detail_id,
  amount as amount_consumed, consume_type
from decisions where accepted"""),
    ("t_meal_logs", """
select meal_id as id, min(requested_at) as eaten_at, cast(null as varchar) as note
from consume_requests where meal_id in (select meal_id from t_meal_details) group by meal_id"""),
    ("t_inventory_snapshot", """
select i.id, i.detail_id, coalesce(l.left_qty, i.current_quantity) as current_quantity,
  greatest(i.updated_at, coalesce(l.last_at, i.updated_at)) as updated_at
from t_inventory i left join (
  select inventory_id, arg_max(remaining_after, seq) as left_qty, max(requested_at) as last_at
  from decisions where accepted group by inventory_id) l on i.id = l.inventory_id"""),
]

# --- fixed values: "now" of the batch ingest of the registered queries ---
INGEST_AS_OF = "2001-06-15 12:00:00"
VIEWS = [(n, b.replace("{as_of}", INGEST_AS_OF)) for n, b in VIEWS]
_NAMES = [n for n, _ in VIEWS]
_BODY = dict(VIEWS)


def with_ledger(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the (transitively) needed ledger CTEs."""
    extra = extra or []
    if body.strip().lower().startswith("with"):
        body = f"select * from ({body.strip()}) __q"
    bodies = dict(_BODY)
    order = list(_NAMES)
    for n, s in extra:
        bodies[n] = s
        order.append(n)
    need: set[str] = set()
    todo = [n for n in order if re.search(rf"\b{n}\b", body)]
    while todo:
        n = todo.pop()
        if n in need:
            continue
        need.add(n)
        todo.extend(m for m in order if m != n and re.search(rf"\b{m}\b", bodies[n]))
    ctes = [f"{n} AS ({bodies[n].strip()})" for n in order if n in need]
    if not ctes:
        return body.strip()
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body.strip()
