"""Scalar Column functions (inventory C-01 … C-22).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
Times are ``timestamp_ntz``; every "now" is an explicit ``as_of`` argument.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import FOOD_KINDS

# --- fixed values: serial-day epoch of the day-count time encoding ---
SERIAL_EPOCH = "1899-12-30 00:00:00"
# --- fixed values: full-width digits and their ASCII forms ---
FULL_WIDTH_DIGITS = "０１２３４５６７８９"
ASCII_DIGITS = "0123456789"
# --- fixed values: placeholder for a missing time, guideline fallback days ---
MISSING_TIME = "---"
FAR_DUE_DAYS = 9999
SOON_DAYS = 2


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts_lit(value) -> Column:
    """Naive timestamp literal from text or a ``datetime``."""
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(value)).cast("timestamp_ntz")


def date_lit(value) -> Column:
    return F.lit(str(value)).cast("date")


def add_days(ts, days) -> Column:
    """``ts`` plus a possibly fractional number of days (µs resolution)."""
    micros = F.round(_c(days).cast("double") * F.lit(86400e6)).cast("long")
    return F.timestamp_add("MICROSECOND", micros, _c(ts))


# C-01
def serial_to_ts(serial) -> Column:
    """Days since 1899-12-30 (fraction = time of day) -> timestamp_ntz."""
    return add_days(ts_lit(SERIAL_EPOCH), serial)


# C-02
def ts_to_serial(ts) -> Column:
    """timestamp_ntz -> days since 1899-12-30; sub-second part dropped."""
    return F.timestamp_diff("SECOND", ts_lit(SERIAL_EPOCH), _c(ts)).cast("double") / F.lit(86400.0)


# C-03
def format_ts(ts, pattern: str = "yyyy/MM/dd HH:mm") -> Column:
    return F.coalesce(F.date_format(_c(ts), pattern), F.lit(MISSING_TIME))


def normalize_digits(s) -> Column:
    """Trim and map full-width digits to ASCII before any digit test."""
    return F.trim(F.translate(_c(s), FULL_WIDTH_DIGITS, ASCII_DIGITS))


def _parse(s: Column, pattern: str) -> Column:
    return F.try_to_timestamp(s, F.lit(pattern)).cast("timestamp_ntz")


# C-04
def parse_yyyymmdd(s) -> Column:
    """Eight digits -> midnight of that day; anything else (or an invalid date) -> NULL."""
    n = normalize_digits(s)
    return F.when(n.rlike("^[0-9]{8}$"), _parse(n, "yyyyMMdd"))


# C-05
def parse_yyyymmddhhmm(s, default=None) -> Column:
    """Twelve digits -> minute, eight digits -> midnight, otherwise ``default``."""
    n = normalize_digits(s)
    parsed = (F.when(n.rlike("^[0-9]{12}$"), _parse(n, "yyyyMMddHHmm"))
              .when(n.rlike("^[0-9]{8}$"), _parse(n, "yyyyMMdd")))
    return parsed if default is None else F.coalesce(parsed, _c(default))


# C-06
def month_start(ym) -> Column:
    """``YYYYMM`` text -> first instant of the month, or NULL when invalid."""
    n = normalize_digits(ym)
    return F.when(n.rlike("^[0-9]{6}$"), _parse(F.concat(n, F.lit("01")), "yyyyMMdd"))


def month_range(ym: str) -> tuple[Column, Column]:
    """Half-open ``[first instant, first instant of next month)`` of ``YYYYMM``."""
    start = month_start(F.lit(ym))
    return start, F.add_months(start, 1).cast("timestamp_ntz")


def month_last_second(ym) -> Column:
    start = month_start(ym)
    return F.timestamp_add("SECOND", F.lit(-1), F.add_months(start, 1).cast("timestamp_ntz"))


# C-07
def recent_range(as_of, days: int = 30) -> tuple[Column, Column]:
    """Last ``days`` × 24 h up to ``as_of`` (inclusive both ends)."""
    end = _c(as_of) if not isinstance(as_of, (str, _dt.datetime)) else ts_lit(as_of)
    return F.timestamp_add("DAY", F.lit(-days), end), end


# C-08
def day_sequence(start_day, end_day) -> Column:
    return F.sequence(_c(start_day), _c(end_day), F.expr("interval 1 day"))


# C-09
def month_sequence(as_of, months: int = 12) -> Column:
    first = F.trunc(F.to_date(_c(as_of)), "month")
    return F.sequence(F.add_months(first, -(months - 1)), first, F.expr("interval 1 month"))


# C-10
def days_in_range(start_day, end_day) -> Column:
    return (F.datediff(_c(end_day), _c(start_day)) + 1).cast("long")


def days_in_month(day) -> Column:
    return F.dayofmonth(F.last_day(_c(day))).cast("long")


# C-11
def to_day(ts) -> Column:
    return F.to_date(_c(ts))


# C-12
def due_date(limit_date, bought_at, guideline_days) -> Column:
    """Real limit, else purchase + shelf-life guideline, else NULL."""
    return F.coalesce(_c(limit_date), add_days(bought_at, guideline_days))


def due_sort_key(limit_date, bought_at, guideline_days) -> Column:
    """Order key of the stock list: like ``due_date`` but far future when unknown."""
    return F.coalesce(_c(limit_date), add_days(bought_at, F.coalesce(_c(guideline_days), F.lit(float(FAR_DUE_DAYS)))))


def due_kind(limit_date, limit_type, guideline_days) -> Column:
    return (F.when(_c(limit_date).isNotNull(),
                   F.when(_c(limit_type) == "CONSUMPTION", "CONSUMPTION").otherwise("BEST_BEFORE"))
            .when(_c(guideline_days).isNotNull(), "GUIDELINE"))


# C-13
def due_status(due, has_real_limit, as_of) -> Column:
    now = ts_lit(as_of) if isinstance(as_of, (str, _dt.datetime)) else _c(as_of)
    return (F.when(_c(due).isNull(), F.lit(""))
            .when(_c(due) < now, F.when(_c(has_real_limit), "EXPIRED").otherwise("GUIDELINE_EXCEEDED"))
            .when(_c(due) < F.timestamp_add("DAY", F.lit(SOON_DAYS), now), "SOON")
            .otherwise(F.lit("")))


# C-14
# --- fixed values: input codes of the entry screens and display labels (ours) ---
KIND_LETTERS = {"u": "UNIVERSAL", "m": "MEASURED", "p": "PROCESSED", "o": "OUT_EAT", "a": "ADJUSTMENT", "x": "NONE"}
DEST_DIGITS = {"1": "EAT_NOW", "2": "FRIDGE", "3": "FREEZER", "4": "PANTRY", "5": "GIFT"}
CONSUME_DIGITS = {"1": "SELF", "2": "LOSS", "3": "GIFT"}
LIMIT_KIND_DIGITS = {"1": "CONSUMPTION", "2": "BEST_BEFORE"}
PLACE_LABELS = {"FRIDGE": "fridge", "FREEZER": "freezer", "PANTRY": "pantry"}
DEST_LABELS = {"EAT_NOW": "eat now", "FRIDGE": "fridge", "FREEZER": "freezer", "PANTRY": "pantry"}


def label(code, mapping: dict, default: str | None = "") -> Column:
    """Literal-map lookup with a default for unknown / NULL codes."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    hit = F.try_element_at(m, _c(code))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def trunc_long(x) -> Column:
    """Truncate toward zero, then bigint (``int()`` semantics)."""
    x = _c(x)
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long")


# C-15
def line_gross(price, qty, tax, discount=None) -> Column:
    """Truncated line amount incl. tax; with a discount the pre-tax amount is floored at 0."""
    if discount is None:
        return trunc_long(_c(price) * _c(qty) * (F.lit(1.0) + _c(tax)))
    net = F.greatest(_c(price) * _c(qty) - _c(discount), F.lit(0.0))
    return trunc_long(net * (F.lit(1.0) + _c(tax)))


def line_net_taxed(price, qty, tax, discount) -> Column:
    """Untruncated line amount incl. tax (discount floored at 0) for once-per-receipt rounding."""
    net = F.greatest(_c(price) * _c(qty) - F.coalesce(_c(discount), F.lit(0.0)), F.lit(0.0))
    return net * (F.lit(1.0) + _c(tax))


# C-16
# --- fixed values: default tax rates (reduced grocery rate, standard rate) ---
GROCERY_TAX = 0.08
STANDARD_TAX = 0.10


def default_tax_rate(is_public, food_type, given=None) -> Column:
    default = (F.when(~F.coalesce(_c(is_public), F.lit(True)), F.lit(0.0))
               .when(_c(food_type).isin(*FOOD_KINDS), F.lit(GROCERY_TAX))
               .otherwise(F.lit(STANDARD_TAX)))
    return default if given is None else F.coalesce(_c(given), default)


# C-17
def direction(amount) -> Column:
    return F.when(_c(amount) > 0, F.lit("INCOME")).otherwise(F.lit("EXPENSE"))


# C-18
def note_text(expiry, restriction) -> Column:
    exp = F.when(_c(expiry).isNotNull(), F.concat(F.lit("until "), F.date_format(_c(expiry), "yy/MM/dd")))
    return F.concat_ws(" ", exp, _c(restriction))


# C-19
def title_fallback(*cols, default: str = "(untitled)") -> Column:
    return F.coalesce(*[F.nullif(_c(x), F.lit("")) for x in cols], F.lit(default))


# C-20
def thousands(x) -> Column:
    """Integer text with thousands separators."""
    return F.format_number(_c(x).cast("long"), 0)


def one_decimal(x) -> Column:
    return F.format_string("%.1f", _c(x))


def shortest(x) -> Column:
    """Whole numbers without a point, others as they are."""
    x = _c(x)
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


# C-21
def food_master_of(food_type) -> Column:
    t = _c(food_type)
    return F.when(t == "OUT_EAT", F.lit("PROCESSED")).when(t.isin(*FOOD_KINDS), t)


# C-22
def nutrient_amount(food_type, qty, value) -> Column:
    """Contribution of one consumed quantity to one measure.

    Measured foods carry values per 100 g, the other kinds per unit,
    non-food lines contribute 0.  Missing measure values count as 0.
    """
    t, v = _c(food_type), F.coalesce(_c(value), F.lit(0.0))
    return (F.when(t == "MEASURED", _c(qty) * (v / F.lit(100.0)))
            .when(t.isin("UNIVERSAL", "PROCESSED", "OUT_EAT"), _c(qty) * v)
            .otherwise(F.lit(0.0)))


def nutrient_factor(food_type, qty) -> Column:
    t = _c(food_type)
    return (F.when(t == "MEASURED", _c(qty) / F.lit(100.0))
            .when(t.isin("UNIVERSAL", "PROCESSED", "OUT_EAT"), _c(qty))
            .otherwise(F.lit(0.0)))


def exact_sum(x) -> Column:
    """Order-independent sum of doubles: decimal(28,8) per row, double at the end.

    Double addition depends on partition order; the decimal sum gives the
    same answer on any partitioning (and equals the oracle's).
    """
    return decimal_sum(x).cast("double")


def decimal_sum(x) -> Column:
    x = _c(x)
    # zeros, which non-food lines and missing measures give, need no decimal made of them
    return F.sum(F.when(x == 0, F.lit(0).cast("decimal(28,8)")).otherwise(x.cast("decimal(28,8)")))
