"""Registered source / sink / ingest queries (S-01 … S-07, R-09)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.money import balance_snapshot
from ..operators.stock import ensure_consumption
from ..sources import ingest as I
from ..sources.ledger import Ledger
from .catalog import AS_OF, register
from .similarity import BRAND_VIEWS, places_sql, ratio_views

c = F.col


@register("s01_scan_ledger", "select * from t_transaction_details")
def s01(led):
    """Store a ledger table as Parquet and read it back with its fixed schema."""
    root = I.scratch_path(led.spark, "ledger")
    led["t_transaction_details"].write.parquet(f"{root}/t_transaction_details")
    return Ledger.load(led.spark, root, tables=["t_transaction_details"])["t_transaction_details"]


S01_SIMPLE = ["m_currencies", "t_currency_rates", "m_foods", "m_store_branches", "m_categories", "t_transactions", "t_payments", "t_inventory",
              "consume_requests", "raw_movements", "t_meal_logs", "t_meal_details"]


@register("s01_every_table", "\nunion all ".join([
    *(f"select '{t}' as table_name, count(*) as n, 0::bigint as corrupt, 0::bigint as older from {t}" for t in S01_SIMPLE),
    "select 't_wallet_balances', count(*), 0, 0 from (select distinct wallet_id, expiry_at, usage_restriction from t_payments where wallet_id is not null) b",
    "select 't_transaction_details', count(*), 0, count(*) filter (id % 2 = 0 or reliability_level is null) from t_transaction_details",
    "select 'm_brands', count(*), count(*) filter (id % 5 = 0), 0 from m_brands",
    "select 'm_wallets', count(*), count(*) filter (id % 7 = 0), 0 from m_wallets"]))
def s01_all(led):
    """Every ledger table stored and read back: lines in two schema versions, brands as CSV and wallets as JSON with
    broken lines between them."""
    root = I.scratch_path(led.spark, "ledger")
    for name in ("t_inventory", "consume_requests"):  # what the fold reads is stored first and read back, the fold is run once
        led[name].write.parquet(f"{root}/{name}")
        led[name] = Ledger.load(led.spark, root, tables=[name])[name]
    ensure_consumption(led, keep=True)
    led["t_wallet_balances"] = balance_snapshot(led["t_payments"].join(
        led["t_transactions"].select(c("id").alias("transaction_id"), "transaction_at"), "transaction_id", "left"))
    for name in [*S01_SIMPLE, "t_wallet_balances"]:
        if name in ("t_inventory", "consume_requests"):
            continue
        led[name].write.parquet(f"{root}/{name}")
    lines = led["t_transaction_details"]
    lines.filter(c("id") % 2 != 0).write.parquet(f"{root}/t_transaction_details")
    lines.filter(c("id") % 2 == 0).drop("reliability_level", "condition_rank").write.mode("append").parquet(f"{root}/t_transaction_details")
    led["m_brands"].write.option("header", "true").csv(f"{root}/m_brands")
    led["m_brands"].filter(c("id") % 5 == 0).select(F.concat(F.lit("x"), "id", F.lit(","), "name").alias("id,name")).write.option(
        "header", "true").option("quote", "\u0000").mode("append").csv(f"{root}/m_brands")
    led["m_wallets"].write.json(f"{root}/m_wallets")
    led["m_wallets"].filter(c("id") % 7 == 0).select(F.concat(F.lit('{"id": '), "id").alias("line")).write.mode("append").text(f"{root}/m_wallets")
    back = Ledger.load(led.spark, root, {"m_brands": "csv", "m_wallets": "json"})

    def counted(name):
        older = F.count_if(c("reliability_level").isNull()) if name == "t_transaction_details" else F.lit(0).cast("long")
        rows = back[name].agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), older.alias("older"))
        broken = back.corrupt[name].agg(F.count("text").alias("corrupt")) if name in back.corrupt else None
        return rows.select("table_name", "n", F.lit(0).cast("long").alias("corrupt"), "older") if broken is None else \
            rows.join(F.broadcast(broken), F.lit(True)).select("table_name", "n", "corrupt", "older")

    return reduce(DataFrame.unionByName, [counted(name) for name in back])


@register("s02_append_facts", "select *, cast(date_trunc('month', transaction_at) as date) as month from t_transactions")
def s02(led):
    """Two appends into a month-partitioned fact table, read back."""
    return I.append_round_trip(led.spark, led["t_transactions"])


@register("s04_ingest_receipts", "select * from receipt_lines")
def s04(led):
    return I.ingest_receipts(led["raw_receipts"], AS_OF)["lines"]


@register("s04_ingest_rejects", "select * from receipt_parsed where reject_reason is not null")
def s04r(led):
    return I.ingest_receipts(led["raw_receipts"], AS_OF)["rejects"]


CONSUMPTION_SQL = f"""(with raw as (
  select request_id, inventory_id, meal_id, seq,
    case when request_id % 211 = 0 then 'some' when request_id % 223 = 0 then '-1' else cast(cast(amount as decimal(18,2)) as varchar) end as amount_text,
    case when request_id % 227 = 0 then '9' when request_id % 229 = 0 then '' else case consume_type when 'SELF' then '1' when 'LOSS' then '2' else '3' end end as kind_text,
    case when request_id % 233 = 0 then '20011340' when request_id % 239 = 0 then ''
      when request_id % 2 = 0 then strftime(requested_at, '%Y%m%d') else strftime(requested_at, '%Y%m%d%H%M') end as at_text
  from consume_requests),
typed as (
  select *, try_cast(amount_text as double) as amount, case kind_text when '1' then 'SELF' when '2' then 'LOSS' when '3' then 'GIFT' end as kind,
    case length(at_text) when 12 then try_strptime(at_text, '%Y%m%d%H%M') when 8 then try_strptime(at_text, '%Y%m%d') end as at_ts
  from raw)
select request_id, inventory_id, meal_id, amount, coalesce(kind, 'SELF') as consume_type, coalesce(at_ts, timestamp '{AS_OF}') as requested_at, seq,
  case when amount is null or amount < 0 then 'BAD_AMOUNT' when kind_text <> '' and kind is null then 'BAD_KIND'
    when at_text <> '' and at_ts is null then 'BAD_TIME' end as reject_reason
from typed)"""


@register("s04_consumption_batch", f"select * exclude (reject_reason) from {CONSUMPTION_SQL} x where reject_reason is null")
def s04_consumption(led):
    """Consumption entered as text: kind digits, 8 or 12 digit times."""
    return I.ingest_consumption(I.raw_consumption(led["consume_requests"]), AS_OF)["requests"]


@register("s04_consumption_rejects", f"select * from {CONSUMPTION_SQL} x where reject_reason is not null")
def s04_consumption_rejects(led):
    return I.ingest_consumption(I.raw_consumption(led["consume_requests"]), AS_OF)["rejects"]


@register("s05_seed_rates", """select id as currency_id, 1.0e0 as rate_to_jpy, 'VALUE_ADJUST' as change_type,
  coalesce(start_at, timestamp '1899-12-30 00:00:00') as effective_at from m_currencies""")
def s05(led):
    return I.seed_rates(led["m_currencies"])


@register("s05_seed_balances", """select id as wallet_id, cast(0 as bigint) as amount, cast(0 as bigint) as current_amount,
  cast(null as bigint) as origin_payment_id from m_wallets""")
def s05b(led):
    return I.seed_balances(led["m_wallets"])


@register("s06_add_missing_column", "select *, 'ESTIMATE' as expiration_type from t_inventory")
def s06(led):
    return I.add_missing_column(led["t_inventory"], "expiration_type", "ESTIMATE")


@register("s07_apply_updates", """select id,
  coalesce(case when id % 14 = 0 then 'late ' || cast(id as varchar) end,
           case when transaction_name is null then 'order ' || cast(id as varchar) end, transaction_name)
    as transaction_name,
  branch_id, transaction_at, is_public, tax_adjustment_jpy, total_amount_jpy
from t_transactions""")
def s07(led):
    """Name updates after entry: a first naming batch and a later correction; latest wins."""
    base = led["t_transactions"]
    u1 = (base.filter(c("transaction_name").isNull())
          .withColumn("transaction_name", F.concat(F.lit("order "), c("id").cast("string")))
          .withColumn("seq", F.lit(1)))
    u2 = (base.filter(c("id") % 14 == 0)
          .withColumn("transaction_name", F.concat(F.lit("late "), c("id").cast("string")))
          .withColumn("seq", F.lit(2)))
    return I.apply_updates(base, u1.unionByName(u2), "id")


MATCH_SQL = """(select l.*, b.brand_id, sb.branch_id, f.food_id
  from receipt_lines l left join (select name, min(id) as brand_id from m_brands group by name) b on l.brand_text = b.name
  left join (select brand_id as of_brand, branch_name, min(id) as branch_id from m_store_branches group by all) sb
    on sb.of_brand = b.brand_id and sb.branch_name = l.branch_text
  left join (select food_kind, name, min(id) as food_id from m_foods group by food_kind, name) f
    on f.food_kind = case when l.food_type = 'OUT_EAT' then 'PROCESSED' else l.food_type end
    and f.name = l.item_text)"""


NEW_BRANDS = """(select (select coalesce(max(id), 0) from m_brands) + row_number() over (order by name) as id, name
  from (select distinct brand_text as name from receipt_lines where trim(brand_text) <> '' and brand_text not in (select query from brand_of)) x)"""
STORES = f"""(select l.brand_text, l.branch_text, coalesce(b.brand_id, n.id) as brand_id, s.branch_id
  from (select distinct brand_text, branch_text from receipt_lines where trim(brand_text) <> '') l
  left join brand_of b on b.query = l.brand_text left join {NEW_BRANDS} n on n.name = l.brand_text
  left join branch_of s on s.kind = cast(b.brand_id as varchar) and s.query = l.branch_text)"""
NEW_BRANCHES = f"""(select (select coalesce(max(id), 0) from m_store_branches) + row_number() over (order by brand_id, branch_name) as id, brand_id, branch_name
  from (select distinct brand_id, branch_text as branch_name from {STORES} s where branch_id is null and trim(branch_text) <> '') x)"""
BOUND_VIEWS = [*BRAND_VIEWS, ("bound_stores", f"""select s.brand_text, s.branch_text, s.brand_id, coalesce(s.branch_id, n.id) as branch_id
from {STORES} s left join {NEW_BRANCHES} n on n.brand_id = s.brand_id and n.branch_name = s.branch_text""")]


@register("r09_new_brands", f"select * from {NEW_BRANDS} n", BRAND_VIEWS)
def r09_brands(led):
    """Brands that a batch adds: no exact and no fuzzy hit."""
    return I.record_purchases(led["raw_receipts"], led, AS_OF)["m_brands"]


@register("r09_new_branches", f"select * from {NEW_BRANCHES} n", BRAND_VIEWS)
def r09_branches(led):
    """Branches that a batch adds, under old and new brands."""
    return I.record_purchases(led["raw_receipts"], led, AS_OF)["m_store_branches"]


@register("r09_record_purchases", """select receipt_id, min(transaction_at) as transaction_at, min(is_public) as is_public,
  min(brand_id) as brand_id, min(branch_id) as branch_id,
  cast(sum(case when x >= 0 then floor(x) else ceil(x) end) as bigint) as total_amount_jpy, count(*) as n_lines
from (select l.*, s.brand_id, s.branch_id, greatest(unit_price * quantity - discount_amount, 0.0e0) * (1.0e0 + tax_rate) as x
  from receipt_lines l left join bound_stores s on s.brand_text = l.brand_text and s.branch_text is not distinct from l.branch_text) y
group by receipt_id""", BOUND_VIEWS)
def r09(led):
    return I.record_purchases(led["raw_receipts"], led, AS_OF)["transactions"]


BIND_VIEWS = [
    ("bind_asked", """select distinct item_text as query, case food_type when 'OUT_EAT' then 'PROCESSED' else food_type end as kind
from receipt_lines where food_type in ('UNIVERSAL','MEASURED','PROCESSED','OUT_EAT') and trim(item_text) <> ''"""),
    ("bind_names", "select food_kind as kind, name, count(*) as copies, min(id) as id from m_foods group by food_kind, name"),
    *ratio_views("bind", "(select a.* from bind_asked a anti join bind_names n on n.kind = a.kind and n.name = a.query)", "bind_names", "n.kind = q.kind", "q.kind"),
    ("bind_places", places_sql("bind_scored join bind_names using (kind, name)")),
    ("bind_found", """select a.query, a.kind, n.id as food_id from bind_asked a join bind_names n on n.kind = a.kind and n.name = a.query
union all select query, kind, id from bind_places where rank = 1"""),
    ("bind_new", """select (select coalesce(max(id), 0) from m_foods) + row_number() over (order by food_kind, name) as id, name, food_kind
from (select query as name, kind as food_kind from bind_asked a anti join bind_found f using (query, kind)) x"""),
    ("bind_foods", "select query, kind, food_id from bind_found union all select name, food_kind, id from bind_new"),
]


@register("r09_new_foods", "select * from bind_new", BIND_VIEWS)
def r09_foods(led):
    """Foods that a batch adds, each to the master that its line names."""
    return I.record_purchases(led["raw_receipts"], led, AS_OF)["m_foods"]


NUMBERED_SQL = """(select *, (select coalesce(max(id), 0) from t_transaction_details) + row_number() over (order by receipt_id nulls first,
    line_no nulls first, item_text nulls first, food_type nulls first, category_id nulls first, unit_price nulls first,
    quantity nulls first, tax_rate nulls first, discount_amount nulls first, destination nulls first, limit_date nulls first,
    limit_type nulls first) as id from receipt_lines)"""


@register("r09_purchase_details", f"""select id, receipt_id as transaction_id, line_no, category_id, food_type, food_id, item_text as item_name_receipt,
  cast(unit_price as double) as unit_price_ex_tax, quantity, tax_rate, discount_amount, destination, limit_date, limit_type
from {NUMBERED_SQL} l left join bind_foods f on f.query = l.item_text
  and f.kind = case l.food_type when 'OUT_EAT' then 'PROCESSED' else l.food_type end""", BIND_VIEWS)
def r09_details(led):
    return I.record_purchases(led["raw_receipts"], led, AS_OF)["details"]


@register("r09_purchase_lots", f"""select id, id as detail_id, quantity as current_quantity, transaction_at as updated_at
from {NUMBERED_SQL} d where destination in ('FRIDGE','FREEZER','PANTRY')""")
def r09_lots(led):
    return I.record_purchases(led["raw_receipts"], led, AS_OF)["lots"]


__all__ = ["MATCH_SQL"]
