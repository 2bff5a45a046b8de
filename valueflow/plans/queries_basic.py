"""Registered small building blocks: projections, filters, sorts, set ops, scalar functions.

P-01…P-05, F-01…F-09, O-01…O-08, U-03, C-01…C-22.  Each runs over a whole
ledger table; the constants in filters are report inputs (an instant, a
code), not row caps.  Sorted queries keep their ``orderBy`` (a range
partitioned sort); the oracle compares them as multisets.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import goods as G
from ..operators import money as M
from ..operators import nutrition as N
from ..operators import stock as K
from ..sources.schema import MEASURES, STOCK_PLACES
from .catalog import AS_OF, register
from .queries_goods import CHECKOUT_LINE, DISPLAY_LINE, STORE_SQL, TRUNC
from .queries_nutrition import FOOD_JOIN, _amount_sql, _events_sql

c = F.col
YEAR_START, YEAR_END = "1998-01-01 00:00:00", "1998-12-31 23:59:59"
DAY_START, DAY_END = dt.date(1999, 3, 1), dt.date(1999, 3, 31)


# ---------------------------------------------------------------- P
@register("p01_projection", "select id, transaction_at as at, transaction_name as name, total_amount_jpy as total from t_transactions")
def p01(led):
    return led["t_transactions"].select("id", c("transaction_at").alias("at"), c("transaction_name").alias("name"),
                                        c("total_amount_jpy").alias("total"))


@register("p02_star_projection", "select d.*, t.transaction_at from t_transaction_details d join t_transactions t on d.transaction_id = t.id")
def p02(led):
    d, t = led["t_transaction_details"].alias("d"), led["t_transactions"].alias("t")
    return d.join(t, c("d.transaction_id") == c("t.id")).select("d.*", "t.transaction_at")


@register("p03_case_when", """select id, food_type, quantity,
  case when food_type = 'MEASURED' then quantity / 100.0e0 when food_type in ('UNIVERSAL','PROCESSED','OUT_EAT') then quantity
  else 0.0e0 end as factor from t_transaction_details""")
def p03(led):
    return led["t_transaction_details"].select("id", "food_type", "quantity",
                                               S.nutrient_factor("food_type", "quantity").alias("factor"))


@register("p04_coalesce", """select id, coalesce(food_id, category_id, -1) as ref_id, coalesce(discount_amount, 0.0e0) as discount,
  coalesce(limit_date, timestamp '2199-12-31 00:00:00') as limit_or_far from t_transaction_details""")
def p04(led):
    return led["t_transaction_details"].select(
        "id", F.coalesce("food_id", "category_id", F.lit(-1).cast("long")).alias("ref_id"),
        F.coalesce("discount_amount", F.lit(0.0)).alias("discount"),
        F.coalesce("limit_date", S.ts_lit("2199-12-31 00:00:00")).alias("limit_or_far"))


@register("p05_generated_columns", "select e.eaten_at, e.food_type, e.food_id, e.qty, " + ", ".join(
    f"{_amount_sql(m)} as {m}" for m in MEASURES) + f" from ({_events_sql()}) e {FOOD_JOIN}")
def p05(led):
    """The same expression generated for all 15 measures (one column each)."""
    ev = N.with_food(N.consumption_events(led), led)
    return ev.select("eaten_at", "food_type", "food_id", "qty",
                     *[S.nutrient_amount("food_type", "qty", m).alias(m) for m in MEASURES])


# ---------------------------------------------------------------- F
@register("f01_key_lookup", "select * from m_wallets where currency_id = 0")
def f01(led):
    return led["m_wallets"].filter(c("currency_id") == 0)


@register("f02_time_between", f"select * from t_transactions where transaction_at between timestamp '{YEAR_START}' and timestamp '{YEAR_END}'")
def f02(led):
    t = led["t_transactions"]
    return t.filter((c("transaction_at") >= S.ts_lit(YEAR_START)) & (c("transaction_at") <= S.ts_lit(YEAR_END)))


@register("f03_day_range", f"select * from ({_events_sql(DAY_START, DAY_END)}) e")
def f03(led):
    return N.consumption_events(led, DAY_START, DAY_END)


@register("f04_sign_filter", "select * from t_payments where sign(amount) = -sign(-1)")
def f04(led):
    move = F.lit(-1)
    return led["t_payments"].filter(F.signum("amount") == -F.signum(move))


@register("f05_null_tests", """select *, wallet_id is null as paid_by_other,
  (expiry_at is not null or usage_restriction is not null) as limited from t_payments
where wallet_id is null or expiry_at is not null or usage_restriction is not null""")
def f05(led):
    p = led["t_payments"]
    return (p.filter(c("wallet_id").isNull() | M.is_limited())
            .withColumn("paid_by_other", c("wallet_id").isNull()).withColumn("limited", M.is_limited()))


@register("f06_null_safe_equality", "select * from t_payments where expiry_at is not distinct from null and usage_restriction is not distinct from 'R1'")
def f06(led):
    p = led["t_payments"]
    return p.filter(c("expiry_at").eqNullSafe(F.lit(None).cast("timestamp_ntz"))
                    & c("usage_restriction").eqNullSafe(F.lit("R1")))


@register("f07_in_list", "select * from t_transaction_details where destination in ('FRIDGE','FREEZER','PANTRY')")
def f07(led):
    return led["t_transaction_details"].filter(c("destination").isin(*STOCK_PLACES))


@register("f08_active_wallets", "select * from m_wallets where is_active")
def f08(led):
    return led["m_wallets"].filter(c("is_active"))


@register("f09_expense_categories", "select id, name from m_categories where type = 'EXPENSE'")
def f09(led):
    return led["m_categories"].filter(c("type") == "EXPENSE").select("id", "name")


# ---------------------------------------------------------------- O
@register("o01_order_by_id", """select w.id, w.name, c.name as currency_name, c.display_unit
from m_wallets w join m_currencies c on w.currency_id = c.id order by w.id""")
def o01(led):
    return M.wallets_with_currency(led)


@register("o02_order_by_time_desc", f"""select t.id, t.transaction_at, t.transaction_name from t_transactions t
order by t.transaction_at desc, t.id desc""")
def o02(led):
    return led["t_transactions"].select("id", "transaction_at", "transaction_name").orderBy(
        c("transaction_at").desc(), c("id").desc())


@register("o03_order_by_due", """select inv.id as inv_id,
  coalesce(d.limit_date, t.transaction_at + to_microseconds(cast(round(coalesce(u.shelf_life_days_guideline, 9999.0e0) * 86400e6) as bigint)))
    as sort_key
from t_inventory_snapshot inv join t_transaction_details d on inv.detail_id = d.id
join t_transactions t on d.transaction_id = t.id
left join m_foods u on d.food_id = u.id and d.food_type = 'UNIVERSAL' and u.food_kind = 'UNIVERSAL'
order by sort_key, inv_id""")
def o03(led):
    lots = K.stock_lots(led)
    return lots.select("inv_id", S.due_sort_key("limit_date", "transaction_at", "shelf_life_days_guideline")
                       .alias("sort_key")).orderBy("sort_key", "inv_id")


@register("o04_order_by_day", "select day, energy_kcal from (select cast(e.eaten_at as date) as day, "
          f"cast(sum(cast({_amount_sql('energy_kcal')} as decimal(28,8))) as double) as energy_kcal "
          f"from ({_events_sql()}) e {FOOD_JOIN} group by 1) x order by day")
def o04(led):
    return N.daily_nutrition(led, measures=["energy_kcal"]).orderBy("day")


@register("o05_lot_order", """select movement_id, wallet_id, expiry_at, usage_restriction, total, lot_no from (
  select mv.movement_id, mv.wallet_id, l.expiry_at, l.usage_restriction, l.total,
    row_number() over (partition by mv.movement_id order by l.first_transaction_id, l.expiry_at asc nulls last,
                       l.usage_restriction asc nulls first) as lot_no
  from raw_movements mv join (select wallet_id, expiry_at, usage_restriction, cast(sum(amount) as bigint) as total,
      min(transaction_id) as first_transaction_id from t_payments
      where wallet_id is not null and (expiry_at is not null or usage_restriction is not null) group by 1, 2, 3) l
    on mv.wallet_id = l.wallet_id where l.total > 0) x""")
def o05(led):
    """Limited lots a spend may draw from, in the order they are used (first transaction first)."""
    lots = M.limited_groups(led["t_payments"]).filter(c("total") > 0)
    mv = led["raw_movements"].select("movement_id", "wallet_id")
    j = mv.join(lots, "wallet_id")
    w = Window.partitionBy("movement_id").orderBy(c("first_transaction_id"), c("expiry_at").asc_nulls_last(),
                                                  c("usage_restriction").asc_nulls_first())
    return j.select("movement_id", "wallet_id", "expiry_at", "usage_restriction", "total",
                    F.row_number().over(w).cast("long").alias("lot_no"))


@register("o06_first_match", "select name, min(id) as first_id, count(*) as copies from m_foods group by name")
def o06(led):
    """First master row per name (what a lookup by name returns), with the number of copies."""
    return led["m_foods"].groupBy("name").agg(F.min_by("id", "id").alias("first_id"),
                                               F.count(F.lit(1)).alias("copies"))


@register("o07_last_months", """select month from (select distinct cast(date_trunc('month', transaction_at) as date) as month
from t_transactions) m order by month desc limit 12""")
def o07(led):
    """The twelve latest months that have transactions (the limit is the feature)."""
    return (led["t_transactions"].select(F.trunc(F.to_date("transaction_at"), "month").alias("month"))
            .distinct().orderBy(c("month").desc()).limit(12))


@register("o08_top3_by_score", """select wallet_id, id, amount, rn from (select wallet_id, id, amount,
  row_number() over (partition by wallet_id order by amount desc, id desc) as rn from t_payments
  where wallet_id is not null) x where rn <= 3""")
def o08(led):
    """Top three movements per wallet by amount (score desc, tie by id desc): three per part of a wallet, then three of those."""
    best = [c("amount").desc(), c("id").desc()]
    parts = led["t_payments"].filter(c("wallet_id").isNotNull()).select("wallet_id", "id", "amount", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part"))
    first = parts.withColumn("rn", F.row_number().over(Window.partitionBy("wallet_id", "part").orderBy(*best))).filter(c("rn") <= 3)
    return (first.select("wallet_id", "id", "amount", F.row_number().over(Window.partitionBy("wallet_id").orderBy(*best)).cast("long").alias("rn"))
            .filter(c("rn") <= 3))


# ---------------------------------------------------------------- U
@register("u03_distinct_months", "select distinct cast(date_trunc('month', transaction_at) as date) as month from t_transactions order by month")
def u03(led):
    return (led["t_transactions"].select(F.trunc(F.to_date("transaction_at"), "month").alias("month"))
            .distinct().orderBy("month"))


# ---------------------------------------------------------------- C
SERIAL = "(date_diff('second', timestamp '1899-12-30 00:00:00', transaction_at) / 86400.0e0)"


@register("c01_serial_to_ts", f"""select id, {SERIAL} as serial,
  timestamp '1899-12-30 00:00:00' + to_microseconds(cast(round({SERIAL} * 86400e6) as bigint)) as back
from t_transactions""")
def c01(led):
    s = S.ts_to_serial("transaction_at")
    return led["t_transactions"].select("id", s.alias("serial"), S.serial_to_ts(s).alias("back"))


@register("c02_ts_to_serial", f"select id, transaction_at, {SERIAL} as serial from t_transactions")
def c02(led):
    return led["t_transactions"].select("id", "transaction_at", S.ts_to_serial("transaction_at").alias("serial"))


@register("c03_format_ts", "select id, coalesce(strftime(limit_date, '%Y/%m/%d %H:%M'), '---') as limit_text from t_transaction_details")
def c03(led):
    return led["t_transaction_details"].select("id", S.format_ts("limit_date").alias("limit_text"))


_D = "translate(trim({x}), '０１２３４５６７８９', '0123456789')"


@register("c04_parse_yyyymmdd", f"""select receipt_id, line_no, limit_text,
  case when regexp_full_match({_D.format(x='limit_text')}, '[0-9]{{8}}') then try_strptime({_D.format(x='limit_text')}, '%Y%m%d') end
    as limit_at from raw_receipts""")
def c04(led):
    return led["raw_receipts"].select("receipt_id", "line_no", "limit_text",
                                      S.parse_yyyymmdd("limit_text").alias("limit_at"))


@register("c05_parse_yyyymmddhhmm", f"""select receipt_id, line_no, at_text,
  coalesce(case when regexp_full_match({_D.format(x='at_text')}, '[0-9]{{12}}') then try_strptime({_D.format(x='at_text')}, '%Y%m%d%H%M')
                when regexp_full_match({_D.format(x='at_text')}, '[0-9]{{8}}') then try_strptime({_D.format(x='at_text')}, '%Y%m%d') end,
           timestamp '{AS_OF}') as at from raw_receipts""")
def c05(led):
    return led["raw_receipts"].select("receipt_id", "line_no", "at_text",
                                      S.parse_yyyymmddhhmm("at_text", S.ts_lit(AS_OF)).alias("at"))


@register("c06_month_range", """select ym, strptime(ym || '01', '%Y%m%d') as month_start,
  strptime(ym || '01', '%Y%m%d') + interval 1 month - interval 1 second as month_last_second
from (select distinct strftime(transaction_at, '%Y%m') as ym from t_transactions) m""")
def c06(led):
    m = led["t_transactions"].select(F.date_format("transaction_at", "yyyyMM").alias("ym")).distinct()
    return m.select("ym", S.month_start("ym").alias("month_start"), S.month_last_second("ym").alias("month_last_second"))


_R0 = dt.datetime.fromisoformat(AS_OF) - dt.timedelta(days=30)


@register("c07_recent_range", f"select * from t_transactions where transaction_at between timestamp '{_R0}' and timestamp '{AS_OF}'")
def c07(led):
    s, e = S.recent_range(AS_OF, 30)
    return led["t_transactions"].filter((c("transaction_at") >= s) & (c("transaction_at") <= e))


@register("c08_day_spine", """select cast(d.day as date) as day from (select min(cast(transaction_at as date)) as s,
  max(cast(transaction_at as date)) as e from t_transactions) b, range(b.s, b.e + interval 1 day, interval 1 day) d(day)""")
def c08(led):
    """Every calendar day between the first and the last transaction day."""
    b = led["t_transactions"].agg(F.min(F.to_date("transaction_at")).alias("s"), F.max(F.to_date("transaction_at")).alias("e"))
    return b.select(F.explode(S.day_sequence("s", "e")).alias("day"))


@register("c09_month_spine", """select cast(m.month as date) as month from (select max(transaction_at) as last_at from t_transactions) b,
  range(date_trunc('month', b.last_at) - interval 11 month, date_trunc('month', b.last_at) + interval 1 day, interval 1 month) m(month)""")
def c09(led):
    """The twelve calendar months up to the latest transaction's month."""
    b = led["t_transactions"].agg(F.max("transaction_at").alias("last_at"))
    return b.select(F.explode(S.month_sequence("last_at", 12)).alias("month"))


@register("c10_days_in_range", """select month, cast(day(last_day(month)) as bigint) as days_in_month,
  cast(date_diff('day', month, last_day(month)) + 1 as bigint) as days_in_range
from (select distinct cast(date_trunc('month', transaction_at) as date) as month from t_transactions) m""")
def c10(led):
    m = led["t_transactions"].select(F.trunc(F.to_date("transaction_at"), "month").alias("month")).distinct()
    return m.select("month", S.days_in_month("month").alias("days_in_month"),
                    S.days_in_range("month", F.last_day("month")).alias("days_in_range"))


@register("c11_to_day", "select id, cast(transaction_at as date) as day from t_transactions")
def c11(led):
    return led["t_transactions"].select("id", S.to_day("transaction_at").alias("day"))


_DUE = ("coalesce(limit_date, transaction_at + to_microseconds(cast(round(shelf_life_days_guideline * 86400e6) as bigint)))")
_LOTS = """(select inv.id as inv_id, t.transaction_at, d.limit_date, d.limit_type, u.shelf_life_days_guideline
  from t_inventory_snapshot inv join t_transaction_details d on inv.detail_id = d.id
  join t_transactions t on d.transaction_id = t.id
  left join m_foods u on d.food_id = u.id and d.food_type = 'UNIVERSAL' and u.food_kind = 'UNIVERSAL')"""


@register("c12_due_date", f"""select inv_id, {_DUE} as due_at,
  case when limit_date is not null then case when limit_type = 'CONSUMPTION' then 'CONSUMPTION' else 'BEST_BEFORE' end
       when shelf_life_days_guideline is not null then 'GUIDELINE' end as due_kind from {_LOTS} l""")
def c12(led):
    lots = K.stock_lots(led)
    return lots.select("inv_id", S.due_date("limit_date", "transaction_at", "shelf_life_days_guideline").alias("due_at"),
                       S.due_kind("limit_date", "limit_type", "shelf_life_days_guideline").alias("due_kind"))


@register("c13_due_status", f"""select inv_id, case when {_DUE} is null then ''
  when {_DUE} < timestamp '{AS_OF}' then case when limit_date is not null then 'EXPIRED' else 'GUIDELINE_EXCEEDED' end
  when {_DUE} < timestamp '{AS_OF}' + interval 2 day then 'SOON' else '' end as status from {_LOTS} l""")
def c13(led):
    lots = K.stock_lots(led)
    due = S.due_date("limit_date", "transaction_at", "shelf_life_days_guideline")
    return lots.select("inv_id", S.due_status(due, c("limit_date").isNotNull(), AS_OF).alias("status"))


@register("c14_label_maps", """select receipt_id, line_no,
  coalesce(case lower(trim(kind_text)) when 'u' then 'UNIVERSAL' when 'm' then 'MEASURED' when 'p' then 'PROCESSED'
    when 'o' then 'OUT_EAT' when 'a' then 'ADJUSTMENT' when 'x' then 'NONE' end, 'NONE') as kind_code,
  coalesce(case trim(dest_text) when '1' then 'EAT_NOW' when '2' then 'FRIDGE' when '3' then 'FREEZER' when '4' then 'PANTRY'
    when '5' then 'GIFT' end, 'EAT_NOW') as destination_code,
  case trim(limit_kind_text) when '1' then 'CONSUMPTION' when '2' then 'BEST_BEFORE' end as limit_kind_code
from raw_receipts""")
def c14(led):
    r = led["raw_receipts"]
    return r.select("receipt_id", "line_no",
                    S.label(F.lower(F.trim("kind_text")), S.KIND_LETTERS, "NONE").alias("kind_code"),
                    S.label(F.trim("dest_text"), S.DEST_DIGITS, "EAT_NOW").alias("destination_code"),
                    S.label(F.trim("limit_kind_text"), S.LIMIT_KIND_DIGITS, None).alias("limit_kind_code"))


@register("c15_line_gross", f"""select id, cast({TRUNC.format(x=DISPLAY_LINE)} as bigint) as gross,
  cast({TRUNC.format(x=CHECKOUT_LINE)} as bigint) as gross_after_discount from t_transaction_details""")
def c15(led):
    d = led["t_transaction_details"]
    return d.select("id", S.line_gross("unit_price_ex_tax", "quantity", "tax_rate").alias("gross"),
                    S.line_gross("unit_price_ex_tax", "quantity", "tax_rate",
                                 F.coalesce(c("discount_amount"), F.lit(0.0))).alias("gross_after_discount"))


@register("c16_default_tax_rate", """select d.id, d.tax_rate,
  case when not coalesce(t.is_public, true) then 0.0e0 when d.food_type in ('UNIVERSAL','MEASURED','PROCESSED') then 0.08e0
    else 0.10e0 end as default_rate
from t_transaction_details d join t_transactions t on d.transaction_id = t.id""")
def c16(led):
    d = led["t_transaction_details"]
    t = led["t_transactions"].select(c("id").alias("transaction_id"), "is_public")
    return d.join(t, "transaction_id").select("id", "tax_rate", S.default_tax_rate("is_public", "food_type").alias("default_rate"))


@register("c17_direction", "select id, case when amount > 0 then 'INCOME' else 'EXPENSE' end as direction, abs(amount) as amount_abs from t_payments")
def c17(led):
    return led["t_payments"].select("id", S.direction("amount").alias("direction"), F.abs("amount").alias("amount_abs"))


@register("c18_note_text", """select id, concat_ws(' ', case when expiry_at is not null then 'until ' || strftime(expiry_at, '%y/%m/%d') end,
  usage_restriction) as note from t_payments""")
def c18(led):
    return led["t_payments"].select("id", S.note_text("expiry_at", "usage_restriction").alias("note"))


@register("c19_title_fallback", f"""select t.id, coalesce(nullif(t.transaction_name, ''), nullif(b.name, ''), '(untitled)') as title
from {STORE_SQL}""")
def c19(led):
    return G.transaction_store(led).select("id", S.title_fallback("transaction_name", "brand_name").alias("title"))


@register("c20_number_format", "select id, format('{:,}', amount) as amount_text from t_payments")
def c20(led):
    return led["t_payments"].select("id", S.thousands("amount").alias("amount_text"))


@register("c20_number_texts", """select id, printf('%.1f', quantity / 2) as one_decimal,
  case when tax_rate = floor(tax_rate) then cast(cast(floor(tax_rate) as bigint) as varchar) else cast(tax_rate as varchar) end as shortest
from t_transaction_details""")
def c20_texts(led):
    return led["t_transaction_details"].select("id", S.one_decimal(c("quantity") / 2).alias("one_decimal"), S.shortest("tax_rate").alias("shortest"))


@register("c21_food_master_of", """select id, food_type, case when food_type = 'OUT_EAT' then 'PROCESSED'
  when food_type in ('UNIVERSAL','MEASURED','PROCESSED') then food_type end as master_kind from t_transaction_details""")
def c21(led):
    return led["t_transaction_details"].select("id", "food_type", S.food_master_of("food_type").alias("master_kind"))


@register("c22_nutrient_factor", f"select e.food_type, e.qty, {_amount_sql('energy_kcal')} as energy_kcal from ({_events_sql()}) e {FOOD_JOIN}")
def c22(led):
    ev = N.with_food(N.consumption_events(led), led, ["energy_kcal"])
    return ev.select("food_type", "qty", S.nutrient_amount("food_type", "qty", "energy_kcal").alias("energy_kcal"))
