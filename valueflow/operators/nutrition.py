"""Nutrition: consumption events, the unified food dimension and the reports.

Inventory rows: U-01, U-02, J-06, A-01, A-04, A-05, R-06, R-07, R-08.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.schema import MEASURES, NUTRIENTS
from .stock import consumption_between, ensure_consumption

c = F.col


# U-02
def food_dimension(led) -> DataFrame:
    """The three food masters as one set keyed by (food_kind, id).

    The ledger keeps the masters as one table tagged by ``food_kind`` (one
    scan); three separately stored masters are combined with ``unionByName``
    plus a literal kind when loaded.
    """
    return led["m_foods"].filter(c("food_kind").isin("UNIVERSAL", "MEASURED", "PROCESSED"))


# U-01
def consumption_events(led, start_day=None, end_day=None) -> DataFrame:
    """Eaten-at-purchase lines UNION ALL eaten-from-stock items.

    The optional day range is applied on the raw timestamp in each branch
    (``ts >= start AND ts < end + 1 day``) so it can reach the scans; of the
    consumption fold only lots that the range asks for are computed.
    """
    details, tx = led["t_transaction_details"], led["t_transactions"]

    def in_range(ts_col):
        cond = F.lit(True)
        if start_day is not None:
            cond = cond & (c(ts_col) >= S.date_lit(start_day).cast("timestamp_ntz"))
        if end_day is not None:
            cond = cond & (c(ts_col) < F.date_add(S.date_lit(end_day), 1).cast("timestamp_ntz"))
        return cond

    bounded = start_day is not None or end_day is not None
    if bounded and ("t_meal_details" not in led or "consumption_decisions" in led):
        items, meals = consumption_between(led, in_range)
    else:
        ensure_consumption(led)
        items, meals = led["t_meal_details"], led["meal_headers"]
    direct = (details.filter(c("destination") == "EAT_NOW")
              .select("transaction_id", "food_type", "food_id", c("quantity").alias("qty"))
              .join(tx.select(c("id").alias("transaction_id"), "transaction_at")
                    .filter(in_range("transaction_at")), "transaction_id")
              .select(c("transaction_at").alias("eaten_at"), "food_type", "food_id", "qty",
                      F.lit("PURCHASE").alias("source")))
    from_stock = (items.filter(c("consume_type") == "SELF")
                  .select("meal_id", "detail_id", c("amount_consumed").alias("qty"))
                  .join(meals.filter(in_range("eaten_at")), "meal_id")
                  .join(details.select(c("id").alias("detail_id"), "food_type", "food_id"), "detail_id")
                  .select("eaten_at", "food_type", "food_id", "qty", F.lit("STOCK").alias("source")))
    return direct.unionByName(from_stock)


# J-06
def with_food(events: DataFrame, led, measures=MEASURES) -> DataFrame:
    """One left join to the unified food dimension on (master kind, id).

    Equivalent to three type-discriminated joins because the kinds are
    disjoint; OUT_EAT lines look up the processed master.
    """
    foods = food_dimension(led).select(c("food_kind").alias("f_kind"), c("id").alias("f_id"), *measures)
    cond = (S.food_master_of(events["food_type"]) == foods["f_kind"]) & (events["food_id"] == foods["f_id"])
    return events.join(foods, cond, "left").drop("f_kind", "f_id")


def _measure_sums(measures, decimal: bool = False):
    agg = S.decimal_sum if decimal else S.exact_sum
    return [agg(S.nutrient_amount("food_type", "qty", m)).alias(m) for m in measures]


# A-01
def daily_nutrition(led, start_day=None, end_day=None, measures=MEASURES) -> DataFrame:
    """Per day, the sums of the 15 measures over both consumption paths."""
    ev = with_food(consumption_events(led, start_day, end_day), led, measures)
    return ev.groupBy(S.to_day("eaten_at").alias("day")).agg(*_measure_sums(measures))


# A-04
def nutrition_period_report(led, start_day, end_day, measures=NUTRIENTS) -> DataFrame:
    """Zero-filled day rows, a TOTAL row and an AVERAGE-per-calendar-day row.

    Day spine left join daily sums, then GROUPING SETS ((day), ()) via
    ``rollup``; the average divides by the number of spine days.
    """
    daily = (with_food(consumption_events(led, start_day, end_day), led, measures)
             .groupBy(S.to_day("eaten_at").alias("day")).agg(*_measure_sums(measures, decimal=True)))
    spark = led.spark
    spine = spark.range(1).select(F.explode(S.day_sequence(S.date_lit(start_day), S.date_lit(end_day))).alias("day"))
    filled = spine.join(daily, "day", "left")
    rolled = filled.rollup("day").agg(*[F.sum(F.coalesce(c(m), F.lit(0).cast("decimal(38,8)"))).alias(m)
                                        for m in measures])
    n_days = S.days_in_range(S.date_lit(start_day), S.date_lit(end_day)).cast("double")
    # one pass: the total row is dealt out twice, as TOTAL and as AVERAGE
    kinds = F.when(c("day").isNull(), F.array(F.lit("TOTAL"), F.lit("AVERAGE"))).otherwise(F.array(F.lit("DAY")))
    share = F.when(c("row_kind") == "AVERAGE", n_days).otherwise(F.lit(1.0))
    return rolled.withColumn("row_kind", F.explode(kinds)).select(
        "row_kind", "day", *[(c(m).cast("double") / share).alias(m) for m in measures])


# A-05
def nutrition_monthly_average(led, as_of, months: int = 12, measures=NUTRIENTS) -> DataFrame:
    """Last ``months`` calendar months: per-day average over all days of each month.

    One grouped query over the whole period (not one query per month).
    """
    import calendar
    import datetime as dt
    spark = led.spark
    day = _to_date(led, as_of)
    k = day.year * 12 + day.month - 1 - (months - 1)
    start = dt.date(k // 12, k % 12 + 1, 1)
    end = dt.date(day.year, day.month, calendar.monthrange(day.year, day.month)[1])
    spine = spark.range(1).select(F.explode(S.month_sequence(S.ts_lit(as_of), months)).alias("month"))
    ev = with_food(consumption_events(led, start, end), led, measures)
    monthly = ev.groupBy(F.trunc(S.to_day("eaten_at"), "month").alias("month")).agg(
        *_measure_sums(measures, decimal=True))
    j = spine.join(monthly, "month", "left")
    n = S.days_in_month("month").cast("double")
    return j.select("month", *[(F.coalesce(c(m), F.lit(0).cast("decimal(38,8)")).cast("double") / n).alias(m)
                               for m in measures])


# R-06
def recent_nutrition(led, as_of, days: int = 30) -> DataFrame:
    end = _to_date(led, as_of)
    import datetime as dt
    start = end - dt.timedelta(days=days - 1)
    return nutrition_period_report(led, start, end)


# R-07
def monthly_nutrition(led, ym: str) -> DataFrame:
    import calendar
    import datetime as dt
    y, m = int(ym[:4]), int(ym[4:6])
    start = dt.date(y, m, 1)
    end = dt.date(y, m, calendar.monthrange(y, m)[1])
    return nutrition_period_report(led, start, end)


# R-08
def yearly_nutrition(led, as_of) -> DataFrame:
    return nutrition_monthly_average(led, as_of, 12)


def _to_date(led, as_of):
    import datetime as dt
    if isinstance(as_of, dt.datetime):
        return as_of.date()
    if isinstance(as_of, dt.date):
        return as_of
    return dt.datetime.fromisoformat(str(as_of)).date()
