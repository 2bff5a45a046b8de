"""Skew-safe window building blocks.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to
one task.  When one wallet or one period holds a third of all rows, that task
sorts a third of the data.  The helpers here split each key into ranges of
the ordering column (``bucket``), do the window work per (key, bucket) in
parallel, and add an offset computed from the small per-bucket totals table
(one row per key and bucket).  Results are exact: integer sums stay integer,
positions are counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

_BUCKET = "__bucket"


def _null_safe_on(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    cond = None
    for k in cols:
        term = left[k].eqNullSafe(right[k])
        cond = term if cond is None else cond & term
    return cond


def bucketed_running_sum(df: DataFrame, keys: list[str], order_col: str, value_col: str,
                         out_col: str, bucket_width: int, tie_cols: list[str] | None = None,
                         inclusive: bool = True) -> DataFrame:
    """Running sum of ``value_col`` per ``keys`` ordered by ``order_col`` (a long).

    ``inclusive`` includes the current row.  NULL keys form their own group.
    Equal to ``sum(value).over(partitionBy(keys).orderBy(order_col, *tie_cols)
    .rowsBetween(unboundedPreceding, 0))`` but parallel within a key.
    """
    ties = tie_cols or []
    b = df.withColumn(_BUCKET, F.floor(F.col(order_col) / F.lit(bucket_width)))
    w = (Window.partitionBy(*keys, _BUCKET).orderBy(order_col, *ties)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1))
    local = b.withColumn("__local", F.coalesce(F.sum(value_col).over(w), F.lit(0).cast("long")))

    totals = b.groupBy(*keys, _BUCKET).agg(F.sum(value_col).alias("__total"))
    wt = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, _BUCKET, F.coalesce(F.sum("__total").over(wt), F.lit(0)).cast("long")
                            .alias("__offset"))
    o = offsets.alias("__o")
    joined = local.alias("__l").join(o, _null_safe_on(local.alias("__l"), o, keys + [_BUCKET]), "inner")
    return (joined.select("__l.*", F.col("__o.__offset"))
            .withColumn(out_col, (F.col("__offset") + F.col("__local")).cast("long"))
            .drop("__offset", "__local", _BUCKET))


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with ``__range`` and ``__at``: dealt into ranges of one order over the whole table, sorted and stored.

    Spark samples the bounds, so a key that fills much of the table is split
    by the order columns after it.  Ranges and places follow the order;
    ``__at`` grows along it.  Stored, as rows and their summaries must see the
    same ranges.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    # the upper bits of the generated id are the range, the lower 33 the place in it
    return stored(ranged, "ranges").withColumn("__range", F.shiftright("__at", 33))


def _beside(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the summary of their (keys, range)."""
    names = {k: f"__of_{k}" for k in [*keys, "__range"]}
    s = summary.withColumnsRenamed(names)
    cond = rows["__range"] == s["__of___range"]
    for k in keys:
        cond = cond & rows[k].eqNullSafe(s[names[k]])
    return rows.join(s, cond).drop(*names.values())


def ranged_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Running sums (this row included) per ``keys`` in ``order``: {new column: value}; integers stay exact.

    A window covers one key inside one range; a key's ranges are offset by
    what the ranges before hold, a row per key and range.
    """
    rows = in_ranges(df.withColumns({f"__v_{n}": v for n, v in sums.items()}), [*(c.asc_nulls_first() for c in map(F.col, keys)), *order])
    local = Window.partitionBy(*keys, "__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "__range").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    offsets = totals.select(*keys, "__range", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    out = _beside(rows.withColumns({n: F.sum(f"__v_{n}").over(local) for n in sums}), offsets, keys)
    return out.withColumns({n: (F.col(n) + F.col(f"__o_{n}")).cast("long") for n in sums}).drop(
        "__at", "__range", *[f"__{x}_{n}" for n in sums for x in "vo"])


def ranged_neighbours(df: DataFrame, keys: list[str], by: str, following: list[str], previous: str) -> DataFrame:
    """Along ``by`` per ``keys``: each of ``following`` becomes its own or the next value that is not null, and the new
    column ``previous`` is ``by`` of the row before (null for the first).

    As ``ranged_sums``: windows inside ranges, and a row per key and range for what crosses them.
    """
    rows = in_ranges(df, [*(c.asc_nulls_first() for c in map(F.col, keys)), F.col(by)])
    along = Window.partitionBy(*keys, "__range").orderBy("__at")
    ahead = along.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ends = rows.groupBy(*keys, "__range").agg(
        F.max(by).alias("__last"), *[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("__at"))).alias(f"__first_{f}") for f in following])
    over = Window.partitionBy(*keys).orderBy("__range")
    later = over.rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select(*keys, "__range", F.lag("__last").over(over).alias("__before"),
                          *[F.first(f"__first_{f}", ignorenulls=True).over(later).alias(f"__next_{f}") for f in following])
    local = rows.withColumns({f: F.first(f, ignorenulls=True).over(ahead) for f in following} | {previous: F.lag(by).over(along)})
    out = _beside(local, carried, keys)
    return out.withColumns({f: F.coalesce(f, f"__next_{f}") for f in following} | {previous: F.coalesce(previous, "__before")}).drop(
        "__at", "__range", "__before", *[f"__next_{f}" for f in following])


def range_numbered(df: DataFrame, order: list[Column], out_col: str) -> DataFrame:
    """1-based position of every row in one order over the whole table; the only window over all runs over a row per range."""
    rows = in_ranges(df, order)
    counts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("__range", before.alias("__before")))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(offsets, "__range").withColumn(out_col, (F.col("__before") + place + 1).cast("long")).drop("__at", "__range", "__before")
