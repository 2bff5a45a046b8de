"""Mixing sources to target weights, with DataFrame functions only.

1. Words per source are summed (map-side first, so a hot source costs one row
   per task).
2. Targets fill up like water: every source gets its weight's share of all
   words, stops at ``cap`` times its own words, and the excess goes to the
   others by weight.  With sources sorted by cap / weight the level follows
   from running sums; no loop is needed.
3. rate = target / words.  A document comes ``floor(rate)`` times, plus once
   more if a uniform number hashed from its id and text is below the fraction.
   One SHA-256 gives eight such numbers; each source uses the one whose words
   come nearest its target (ties: the first), which needs one more sum.

Defined cases: null text has 0 words; the null source is a source of its own
(last in order); a source without words, and an empty table, take nothing;
n repeated rows (same id and text) share floor(n * fraction) more copies out
among them, plus one by the draw; a column named like the result column is
replaced, other columns stay whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_small, set_aside, written

#: A word of the size measure.
WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
DRAWS = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draws(doc_id: Column, text: Column) -> Column:
    """64 hex digits from id and text: ``DRAWS`` numbers of 32 bits."""
    none = F.lit("-")
    return F.sha2(F.concat_ws("|", F.coalesce(doc_id.cast("string"), none), F.coalesce(F.md5(text.cast("binary")), none)), 256)


def uniform(hex64: Column, j: Column | int) -> Column:
    """The ``j``-th number (from 0) in [0, 1)."""
    at = F.lit(j) * 8 + 1 if isinstance(j, int) else j * 8 + 1
    return F.conv(F.substring(hex64, at, F.lit(8)), 16, 10).cast("double") / float(2**32)


def weights_by_rank(sizes: DataFrame) -> DataFrame:
    """(source, words) -> weight 1, 2, 3, repeating in code-point order, null last."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    return sizes.withColumn("weight", ((F.row_number().over(w) - 1) % 3 + 1).cast("double"))


def fill_targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, words, weight) -> adds ``target``: min(cap * words, level * weight), summing to all words.

    One row per source goes through one window; the list of sources is small next to the documents.
    """
    order = Window.orderBy((F.col("words") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ceiling = F.col("words") * F.lit(float(cap))
    return (
        sizes.filter(F.col("weight") > 0)
        .withColumn("left_over", F.sum("words").over(every) - F.coalesce(F.sum(ceiling).over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(after))
        .withColumn("capped", ceiling * F.col("weight_left") < F.col("weight") * F.col("left_over"))
        .withColumn("level", F.min_by(F.when(~F.col("capped"), F.struct("left_over", "weight_left")),
                                      F.when(~F.col("capped"), F.struct(F.col("words") / F.col("weight"), F.col("source").isNull(), F.col("source")))).over(every))
        .select("source", "words", "weight",
                F.when(F.col("capped"), ceiling)
                .otherwise(F.least(ceiling, F.col("weight") * F.col("level.left_over") / F.col("level.weight_left"))).alias("target"))
    )


def source_plan(docs: DataFrame, weights: DataFrame | None = None, cap: float = CAP) -> tuple[DataFrame, bool]:
    """Per source: words, target, rate, and ``pick``, the draw whose words come nearest the target; and whether rows repeat.

    ``weights``: (source, weight); by default 1, 2, 3 repeating in order of the source.
    Sources without a positive weight are not taken.
    """
    base = written(docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
                               draws(F.col("doc_id"), F.col("text")).alias("hex")), "mix")
    sizes = base.groupBy("source").agg(F.sum("size").alias("words"))
    if weights is None:
        sizes = weights_by_rank(sizes)
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(w, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    rates = written(fill_targets(sizes, cap).withColumn(
        "rate", F.when(F.col("words") > 0, F.least(F.col("target") / F.col("words"), F.lit(float(cap)))).otherwise(0.0)), "rates")
    r = rates.select(F.col("source").alias("r_source"), "rate")
    repeats = not base.groupBy(F.xxhash64("source", "hex")).count().filter("count > 1").isEmpty()
    rows = base.groupBy("source", "size", "hex").agg(F.count("*").alias("n")) if repeats else base.withColumn("n", F.lit(1).cast("long"))
    taken = join_small(rows, r, F.col("source").eqNullSafe(F.col("r_source"))).groupBy("source").agg(
        *[F.sum(F.col("size") * (F.col("n") * F.floor("rate") + extras(F.col("n"), F.col("rate"), F.col("hex"), j))).alias(f"taken{j}") for j in range(DRAWS)])
    best = F.array(*[F.abs(F.col(f"taken{j}") - F.col("target")) for j in range(DRAWS)])
    t = taken.withColumnRenamed("source", "t_source")
    plan = written(rates.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "source", "words", "target", "rate", (F.array_position(best, F.array_min(best)) - 1).cast("int").alias("pick")), "plan")
    discard(base, rates)
    return plan, repeats


def extras(n: Column, rate: Column, hex64: Column, pick: Column | int) -> Column:
    """Copies beyond floor(rate) each that ``n`` equal rows get together: floor(n * fraction), plus one if the draw is below the rest."""
    share = n * (rate - F.floor(rate))
    return (F.floor(share) + (uniform(hex64, pick) < share - F.floor(share)).cast("long")).cast("long")


def _numbered(docs: DataFrame) -> DataFrame:
    """Adds __n, how many rows are equal (by __hex and source), and __place, the row's place among them (from 0).

    The rows are written first, so that their numbers hold; places are counted within ranges of the
    numbers and offset by the ranges before, so no group meets in one task."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    same, part = [F.col("source").cast("string"), F.col("__hex")], F.shiftright("__row", 33)
    counts = rows.groupBy(same[0].alias("__s"), F.col("__hex").alias("__h"), part.alias("__p")).agg(F.count("*").alias("__k"))
    group = Window.partitionBy("__s", "__h")
    before = F.sum("__k").over(group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("*", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__k").over(group).alias("__n"))
    local = rows.withColumn("__p2", part).withColumn("__local", F.row_number().over(Window.partitionBy(same[0], "__hex", "__p2").orderBy("__row")) - 1)
    on = same[0].eqNullSafe(F.col("__s")) & (F.col("__hex") == F.col("__h")) & (F.col("__p2") == F.col("__p"))
    return local.join(counts, on).withColumn("__place", F.col("__before") + F.col("__local")).drop(
        "__row", "__p", "__p2", "__s", "__h", "__k", "__before", "__local")


_HELPERS = [f"__{n}" for n in ("size", "hex", "plan", "copy", "n", "place", "row", "p", "p2", "s", "h", "k", "before", "local")]


def mix(docs: DataFrame, weights: DataFrame | None = None, cap: float = CAP, out: str = "_mix") -> DataFrame:
    """Adds the struct ``out``: size, source_size, target, rate, copies.  Rows of sources without weight get no row."""
    docs, back = set_aside(docs.drop(out), _HELPERS)
    plan, repeats = source_plan(docs, weights, cap)
    keys = docs.withColumn("__hex", draws(F.col("doc_id"), F.col("text")))
    keys = _numbered(keys) if repeats else keys.withColumns({"__n": F.lit(1).cast("long"), "__place": F.lit(0).cast("long")})
    keys = keys.withColumn("__size", word_count(F.col("text")))
    joined = join_small(keys, plan.select(F.struct("*").alias("__plan")), F.col("source").cast("string").eqNullSafe(F.col("__plan.source")))
    rate = F.col("__plan.rate")
    more = F.col("__place") < extras(F.col("__n"), rate, F.col("__hex"), F.col("__plan.pick"))
    return back(joined.withColumn(out, F.struct(
        F.col("__size").alias("size"), F.col("__plan.words").alias("source_size"), F.col("__plan.target").alias("target"),
        rate.alias("rate"), (F.floor(rate) + more.cast("long")).cast("long").alias("copies"),
    )).drop("__size", "__hex", "__plan", "__n", "__place"))


def emit(mixed: DataFrame, out: str = "_mix") -> DataFrame:
    """One row per copy, with the columns the documents had."""
    n = F.col(out)["copies"]
    mixed, back = set_aside(mixed, _HELPERS)
    return back(mixed.filter(n > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), n))).drop("__copy", out))
