"""Registered nutrition queries (U-01, U-02, J-06, A-01, A-04, A-05, R-06…R-08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nutrition as N
from ..sources.schema import MEASURES, NUTRIENTS
from .catalog import AS_OF, MONTH, register

# --- oracle building blocks ---------------------------------------------------
EVENTS_SQL = """
select t.transaction_at as eaten_at, d.food_type, d.food_id, d.quantity as qty, 'PURCHASE' as source
from t_transaction_details d join t_transactions t on d.transaction_id = t.id
where d.destination = 'EAT_NOW' {tx_range}
union all
select ml.eaten_at, d.food_type, d.food_id, md.amount_consumed as qty, 'STOCK' as source
from t_meal_details md join t_meal_logs ml on md.meal_id = ml.id
join t_transaction_details d on md.detail_id = d.id
where md.consume_type = 'SELF' {meal_range}"""


def _events_sql(start=None, end=None):
    def rng(col):
        if start is None:
            return ""
        return (f"and {col} >= timestamp '{start} 00:00:00' "
                f"and {col} < cast(date '{end}' + interval 1 day as timestamp)")
    return EVENTS_SQL.format(tx_range=rng("t.transaction_at"), meal_range=rng("ml.eaten_at"))


def _amount_sql(m):
    return (f"case when e.food_type = 'MEASURED' then e.qty * (coalesce(f.{m}, 0) / 100.0e0) "
            f"when e.food_type in ('UNIVERSAL','PROCESSED','OUT_EAT') then e.qty * coalesce(f.{m}, 0) else 0.0e0 end")


FOOD_JOIN = """left join m_foods f on e.food_id = f.id and f.food_kind =
  case when e.food_type = 'OUT_EAT' then 'PROCESSED'
       when e.food_type in ('UNIVERSAL','MEASURED','PROCESSED') then e.food_type end"""


def _daily_sql(measures, start=None, end=None, decimal=False):
    sums = ", ".join(
        (f"sum(cast({_amount_sql(m)} as decimal(28,8))) as {m}" if decimal else
         f"cast(sum(cast({_amount_sql(m)} as decimal(28,8))) as double) as {m}") for m in measures)
    return f"""select cast(e.eaten_at as date) as day, {sums}
from ({_events_sql(start, end)}) e {FOOD_JOIN}
group by cast(e.eaten_at as date)"""


def _period_sql(start, end):
    ms = NUTRIENTS
    dsel = ", ".join(f"cast(coalesce(d.{m}, 0) as double) as {m}" for m in ms)
    tsel = ", ".join(f"cast(sum(coalesce(d.{m}, 0)) as double) as {m}" for m in ms)
    asel = ", ".join(f"cast(sum(coalesce(d.{m}, 0)) as double) / (date '{end}' - date '{start}' + 1) as {m}"
                     for m in ms)
    base = f"""(select cast(s.day as date) as day from range(timestamp '{start} 00:00:00', timestamp '{end} 00:00:00' + interval 1 day, interval 1 day) s(day)) sp
left join ({_daily_sql(ms, start, end, decimal=True)}) d on sp.day = d.day"""
    return f"""select 'DAY' as row_kind, sp.day, {dsel} from {base}
union all select 'TOTAL' as row_kind, cast(null as date) as day, {tsel} from {base}
union all select 'AVERAGE' as row_kind, cast(null as date) as day, {asel} from {base}"""


@register("u01_consumption_events", f"select * from ({_events_sql()}) e")
def u01(led):
    """Purchase-time eating UNION ALL eating from stock."""
    return N.consumption_events(led)


@register("u02_food_dimension", "select * from m_foods")
def u02(led):
    return N.food_dimension(led)


@register("j06_food_dimension_join",
          "select e.*, " + ", ".join(f"f.{m}" for m in MEASURES) + f" from ({_events_sql()}) e {FOOD_JOIN}")
def j06(led):
    return N.with_food(N.consumption_events(led), led)


@register("a01_daily_nutrition", _daily_sql(MEASURES))
def a01(led):
    """Flagship: per-day sums of 15 measures over both consumption paths."""
    return N.daily_nutrition(led)


def _month_bounds(ym):
    import calendar
    import datetime as dt
    y, m = int(ym[:4]), int(ym[4:6])
    return dt.date(y, m, 1), dt.date(y, m, calendar.monthrange(y, m)[1])


def _recent_bounds(as_of, days=30):
    import datetime as dt
    end = dt.datetime.fromisoformat(as_of).date()
    return end - dt.timedelta(days=days - 1), end


_RS, _RE = _recent_bounds(AS_OF)
_MS, _ME = _month_bounds(MONTH)


@register("a04_nutrition_period_report", _period_sql(_MS, _ME))
def a04(led):
    return N.nutrition_period_report(led, _MS, _ME)


@register("r06_recent_nutrition", _period_sql(_RS, _RE))
def r06(led):
    return N.recent_nutrition(led, AS_OF)


@register("r07_monthly_nutrition", _period_sql(_MS, _ME))
def r07(led):
    return N.monthly_nutrition(led, MONTH)


def _yearly_sql(as_of):
    import datetime as dt
    d = dt.datetime.fromisoformat(as_of).date()
    k = d.year * 12 + d.month - 1 - 11
    start = dt.date(k // 12, k % 12 + 1, 1)
    import calendar
    end = dt.date(d.year, d.month, calendar.monthrange(d.year, d.month)[1])
    ms = NUTRIENTS
    sums = ", ".join(f"sum(cast({_amount_sql(m)} as decimal(28,8))) as {m}" for m in ms)
    sel = ", ".join(f"cast(coalesce(x.{m}, 0) as double) / day(last_day(sp.month)) as {m}" for m in ms)
    return f"""select sp.month, {sel}
from (select cast(s.m as date) as month from range(timestamp '{start} 00:00:00', timestamp '{end} 00:00:00', interval 1 month) s(m)) sp
left join (select cast(date_trunc('month', e.eaten_at) as date) as month, {sums}
  from ({_events_sql(start, end)}) e {FOOD_JOIN} group by 1) x on sp.month = x.month"""


@register("a05_nutrition_monthly_average", _yearly_sql(AS_OF))
def a05(led):
    return N.nutrition_monthly_average(led, AS_OF, 12)


@register("r08_yearly_nutrition", _yearly_sql(AS_OF))
def r08(led):
    return N.yearly_nutrition(led, AS_OF)


__all__ = ["F"]
