"""Stock: lots, order-dependent consumption, stock snapshot and report.

Inventory rows: S-03, J-04, J-05, J-13, W-06, A-11, A-13, V-08, R-04, R-11.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..session import ensure_checkpoint_dir, stored
from ..sources.schema import STOCK_PLACES

c = F.col


# S-03
def create_lots(details: DataFrame, transactions: DataFrame) -> DataFrame:
    """One lot per receipt line stored in fridge / freezer / pantry.

    Quantity = bought quantity, time = purchase time.  Join on the
    transaction key (shuffle on ``transaction_id`` when both sides are big).
    """
    lines = details.filter(c("destination").isin(*STOCK_PLACES)).select("id", "transaction_id", "quantity")
    tx = transactions.select(c("id").alias("transaction_id"), "transaction_at")
    return lines.join(tx, "transaction_id").select(
        c("id"), c("id").alias("detail_id"), c("quantity").alias("current_quantity"),
        c("transaction_at").alias("updated_at"))


# W-06 ---------------------------------------------------------------------
DECISION_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("inventory_id", T.LongType()),
    T.StructField("meal_id", T.LongType()), T.StructField("detail_id", T.LongType()),
    T.StructField("amount", T.DoubleType()), T.StructField("consume_type", T.StringType()),
    T.StructField("requested_at", T.TimestampNTZType()), T.StructField("seq", T.LongType()),
    T.StructField("lot_quantity", T.DoubleType()),
    T.StructField("accepted", T.BooleanType()), T.StructField("reason", T.StringType()),
    T.StructField("remaining_after", T.DoubleType()),
])


#: Requests of a lot up to which a plain loop is faster than array steps.
SHORT = 64


def _accepted(amounts: np.ndarray, left: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy decisions of one lot's requests, in order: accepted, and what is left after each.

    A run of requests that fit is one running subtraction in request order, a
    run of requests that do not is one comparison with what is left; both look
    ahead in steps that double.
    """
    n = len(amounts)
    accepted, after = np.zeros(n, dtype=bool), np.empty(n)
    if n <= SHORT:
        for i, a in enumerate(amounts.tolist()):
            if 0 <= a <= left:
                left -= a
                accepted[i] = True
            after[i] = left
        return accepted, after
    at, step, fitting = 0, SHORT, True
    while at < n:
        part = amounts[at : at + step]
        if fitting:
            reach = np.subtract.accumulate(np.concatenate(([left], part)))[1:]
            good = (part >= 0) & (reach >= 0)
        else:
            good = ~((part >= 0) & (part <= left))
        run = len(part) if good.all() else int(np.argmin(good))
        accepted[at : at + run] = fitting
        after[at : at + run] = reach[:run] if fitting else left
        left = float(after[at + run - 1]) if run else left
        at += run
        step = step * 2 if run == len(part) else SHORT
        fitting = fitting if run == len(part) else not fitting
    return accepted, after


def _numbers(column: pa.Array) -> np.ndarray:
    """Doubles with NaN for null."""
    return np.asarray(column.cast(pa.float64()).fill_null(np.nan))


def _runs(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where a new key begins in a sorted batch, and the batch's end; null is a key of its own."""
    new = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for key in keys:
        values, null = np.asarray(batch.column(key).fill_null(0)), np.asarray(batch.column(key).is_null())
        new |= (values[1:] != values[:-1]) | (null[1:] != null[:-1])
    return [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows] if batch.num_rows else []


def _fold_sorted(keys: list[str], start: str):
    """Greedy accept / reject over Arrow rows sorted by ``keys`` and order (ids stay 64-bit integers).

    ``start`` names what a key's first row finds in stock.  State (current key,
    remaining quantity) carries across batches, so a lot's requests are
    streamed, never gathered.  A request is accepted only when 0 <= amount <=
    remaining; rejected requests change nothing.  Same double arithmetic, same
    order, as the row-at-a-time rule.  Rows without a lot are rejected.
    """
    names = [f.name for f in DECISION_SCHEMA.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, left = None, 0.0
        for batch in batches:
            amounts, qty = _numbers(batch.column("amount")), _numbers(batch.column(start))
            accepted, after = np.zeros(batch.num_rows, dtype=bool), np.full(batch.num_rows, np.nan)
            bounds = _runs(batch, keys)
            if len(bounds) > 1:
                firsts = [batch.column(k).take(pa.array(bounds[:-1])).to_pylist() for k in keys]
                for lo, hi, key in zip(bounds, bounds[1:], zip(*firsts)):
                    if key != current:
                        current, left = key, qty[lo]
                    if qty[lo] == qty[lo]:
                        accepted[lo:hi], after[lo:hi] = _accepted(amounts[lo:hi], left)
                        left = after[hi - 1]
            reason = np.where(accepted, None, np.where(qty != qty, "NO_LOT", np.where(~(amounts >= 0), "INVALID_AMOUNT", "OVERDRAW")))
            made = {"accepted": pa.array(accepted), "reason": pa.array(reason, pa.string()), "remaining_after": pa.array(after, from_pandas=True)}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names=names)

    return run


# Requests of one lot beyond which its fold is split over tasks, and requests in one piece of it (a power of two).
HOT_REQUESTS = 1_000_000
PIECE_BITS = 16
# Lots that may be named as hot; beyond, ``HOT_REQUESTS`` rises with the table.
MAX_HOT = 10_000
_COARSE = 4096


def hot_lots(requests: DataFrame, hot: int = HOT_REQUESTS) -> list[int]:
    """Ids of the lots with more than ``hot`` requests, ``MAX_HOT`` at most.

    Sums over buckets of the id are enough to see that no lot is hot.
    """
    ids = requests.select("inventory_id").filter(c("inventory_id").isNotNull()).withColumn("bucket", F.pmod(F.xxhash64("inventory_id"), F.lit(_COARSE)))
    sums = ids.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    total, full = sums.agg(F.sum("n"), F.collect_list(F.when(c("n") > hot, c("bucket")))).first()
    if not full:
        return []
    counts = ids.filter(c("bucket").isin(full)).groupBy("inventory_id").agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.filter(c("n") > max(hot, -(-total // MAX_HOT))).select("inventory_id").collect()]


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per piece of sorted rows: lot, piece, the lot's quantity, its smallest valid amount, all amounts as bytes
    (none if even the smallest exceeds the whole lot)."""
    key, held, qty = None, [], 0.0

    def row() -> pa.RecordBatch:
        amounts = np.concatenate(held)
        least = float(amounts[amounts >= 0].min(initial=np.inf))
        values = [key[0], key[1], qty, least, amounts.tobytes() if least <= qty else None]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["inventory_id", "piece", "qty", "least", "amounts"])

    for batch in batches:
        amounts, bounds = _numbers(batch.column("amount")), _runs(batch, ["inventory_id", "piece"])
        for lo, hi in zip(bounds, bounds[1:]):
            here = (batch.column("inventory_id")[lo].as_py(), batch.column("piece")[lo].as_py())
            if here != key:
                if held:
                    yield row()
                key, held, qty = here, [], batch.column("lot_quantity")[lo].as_py()
            held.append(amounts[lo:hi])
    if held:
        yield row()


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What every piece finds in stock, over pieces sorted by lot and place.  A piece whose smallest amount exceeds what
    is left is refused whole, unseen; the others are folded again."""
    lot, left = None, 0.0
    for batch in batches:
        out = []
        for here, qty, least, amounts in zip(*(batch.column(n).to_pylist() for n in ("inventory_id", "qty", "least")), batch.column("amounts")):
            if here != lot:
                lot, left = here, qty
            out.append(left)
            if least <= left:
                left = float(_accepted(np.frombuffer(amounts.as_buffer(), dtype=np.float64), left)[1][-1])
        yield pa.RecordBatch.from_arrays([batch.column("inventory_id"), batch.column("piece"), pa.array(out, pa.float64())], names=["lot", "place", "found"])


def _fold_hot(rows: DataFrame, piece_bits: int) -> DataFrame:
    """The fold of lots with very many requests, spread over tasks.

    Their rows are put in order by ranges and cut into pieces.  Only the
    amounts, packed, pass through one task per lot, which tells every piece
    what it finds in stock; then the pieces' rows are folded side by side.
    """
    spark = rows.sparkSession
    order = ["inventory_id", "piece", "seq", "request_id"]
    ranged = rows.repartitionByRange("inventory_id", "seq", "request_id").sortWithinPartitions("inventory_id", "seq", "request_id")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hot-lots-{uuid.uuid4().hex}"
    # ids grow by one along a range, so their upper bits number the pieces in order
    ranged.withColumn("piece", F.shiftright(F.monotonically_increasing_id(), piece_bits)).write.parquet(path)
    pieces = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("piece", T.LongType())])).parquet(path)
    narrow = pieces.select("inventory_id", "piece", "seq", "request_id", "amount", "lot_quantity")
    packs = narrow.repartition("inventory_id", "piece").sortWithinPartitions(*order).mapInArrow(
        _packs, "inventory_id long, piece long, qty double, least double, amounts binary")
    starts = packs.repartition("inventory_id").sortWithinPartitions("inventory_id", "piece").mapInArrow(_starts, "lot long, place long, found double")
    placed = pieces.join(starts, (c("inventory_id") == c("lot")) & (c("piece") == c("place"))).drop("lot", "place")
    return placed.repartition("inventory_id", "piece").sortWithinPartitions(*order).mapInArrow(_fold_sorted(["inventory_id", "piece"], "found"), DECISION_SCHEMA)


def greedy_consumption(requests: DataFrame, lots: DataFrame, hot: int = HOT_REQUESTS, piece_bits: int = PIECE_BITS,
                       counted: DataFrame | None = None) -> DataFrame:
    """Decide each consumption request against what is left in its lot.

    Requests naming an unknown lot are rejected (``NO_LOT``).  One shuffle on
    the lot id (requests without a known lot are dealt by themselves); inside
    a partition rows are sorted by (lot, seq) and folded by a streaming
    ``mapInArrow``.  Lots with more than ``hot`` requests are folded in pieces;
    ``counted`` is a cheaper table of requests to find them in.
    """
    lot_cols = lots.select(c("id").alias("inventory_id"), "detail_id", c("current_quantity").alias("lot_quantity"))
    cols = [f.name for f in DECISION_SCHEMA.fields if f.name not in ("accepted", "reason", "remaining_after")]
    rows = requests.join(lot_cols, "inventory_id", "left").select(*cols)
    many = hot_lots(requests if counted is None else counted, hot)
    known = c("lot_quantity").isNotNull()
    usual, parts = rows, []
    if many:
        named = F.broadcast(requests.sparkSession.createDataFrame([(i,) for i in many], "inventory_id long"))
        parts = [_fold_hot(rows.filter(known).join(named, "inventory_id", "left_semi"), piece_bits)]
        usual = rows.join(named.withColumn("hot", F.lit(True)), "inventory_id", "left").filter(c("hot").isNull() | ~known).drop("hot")
    spread = F.when(known, F.lit(0)).otherwise(F.pmod(F.xxhash64("request_id", "seq"), F.lit(1024)))
    folded = (usual.repartition(c("inventory_id"), spread).sortWithinPartitions("inventory_id", "seq", "request_id")
              .mapInArrow(_fold_sorted(["inventory_id"], "lot_quantity"), DECISION_SCHEMA))
    return folded.unionByName(parts[0]) if parts else folded


# R-11 ---------------------------------------------------------------------
def record_consumption(requests: DataFrame, lots: DataFrame, keep: bool = False) -> dict[str, DataFrame]:
    """Batch of consumption requests -> accepted items, rejects, meals, new stock.

    With ``keep`` the decisions are stored, for plans that read several of these.
    """
    decisions = greedy_consumption(requests, lots)
    decisions = stored(decisions, "decisions") if keep else decisions
    items = decisions.filter(c("accepted")).select(
        c("request_id").alias("id"), F.lit(None).cast("string").alias("meal_name"), "meal_id", "inventory_id",
        "detail_id", c("amount").alias("amount_consumed"), "consume_type")
    rejects = decisions.filter(~c("accepted")).select(
        "request_id", "inventory_id", "meal_id", "amount", "reason", c("remaining_after").alias("available"))
    headers = requests.groupBy("meal_id").agg(F.min("requested_at").alias("eaten_at"))
    meals = drop_empty_meals(headers, items).select(
        c("meal_id").alias("id"), "eaten_at", F.lit(None).cast("string").alias("note"))
    return {"decisions": decisions, "t_meal_details": items, "t_meal_logs": meals, "meal_headers": headers, "rejects": rejects,
            "t_inventory": stock_snapshot(lots, decisions)}


# J-13
def drop_empty_meals(meals: DataFrame, items: DataFrame) -> DataFrame:
    """Keep only meals with at least one accepted item (semi join)."""
    return meals.join(items.select("meal_id"), "meal_id", "left_semi")


# A-11
def stock_snapshot(lots: DataFrame, decisions: DataFrame) -> DataFrame:
    """Remaining quantity per lot after the fold; untouched lots keep their quantity.

    ``updated_at`` is the latest accepted request time (purchase time if none).
    """
    last = (decisions.filter(c("accepted")).groupBy("inventory_id")
            .agg(F.max_by("remaining_after", "seq").alias("left"), F.max("requested_at").alias("last_at")))
    return (lots.join(last, lots["id"] == last["inventory_id"], "left")
            .select(lots["id"], lots["detail_id"],
                    F.coalesce(c("left"), lots["current_quantity"]).alias("current_quantity"),
                    F.greatest(lots["updated_at"], F.coalesce(c("last_at"), lots["updated_at"])).alias("updated_at")))


def ensure_consumption(led, keep: bool = False) -> dict[str, DataFrame]:
    """Compute (lazily) the consumption outputs of a ledger once and keep them on it; with ``keep`` the fold is run and stored.

    ``meal_headers`` has every asked-for meal.  Joining items to it drops the
    meals without items, so plans with such a join need no second fold.
    """
    if "t_meal_details" in led and "meal_headers" not in led:  # stored meals are read, not folded again
        led["meal_headers"] = led["t_meal_logs"].select(c("id").alias("meal_id"), "eaten_at")
        led["t_inventory_snapshot"] = led["t_inventory"]
    if "t_meal_details" not in led:
        out = record_consumption(led["consume_requests"], led["t_inventory"], keep)
        led["consumption_decisions"] = out["decisions"]
        led["t_meal_details"] = out["t_meal_details"]
        led["t_meal_logs"] = out["t_meal_logs"]
        led["meal_headers"] = out["meal_headers"]
        led["consumption_rejects"] = out["rejects"]
        led["t_inventory_snapshot"] = out["t_inventory"]
    return led


def consumption_between(led, in_range) -> tuple[DataFrame, DataFrame]:
    """(items, meal headers) of the meals whose time ``in_range(column)`` admits.

    What a lot holds depends on all its earlier requests, but on no other
    lot: only lots that a meal of the range asked for are folded.
    """
    requests = led["consume_requests"]
    meals = requests.groupBy("meal_id").agg(F.min("requested_at").alias("eaten_at")).filter(in_range("eaten_at"))
    asked = requests.join(meals, "meal_id", "left_semi").select("inventory_id").distinct()
    history = requests.join(asked, "inventory_id", "left_semi")
    decisions = greedy_consumption(history, led["t_inventory"], counted=requests)
    items = decisions.filter(c("accepted")).select(c("request_id").alias("id"), "meal_id", "inventory_id", "detail_id",
                                                   c("amount").alias("amount_consumed"), "consume_type")
    return items, meals


# V-08
def check_overdraw(led) -> DataFrame:
    ensure_consumption(led)
    return led["consumption_rejects"]


# J-05
def consumption_lineage(led) -> DataFrame:
    """Meal item -> meal (when) -> purchase line (what, which transaction)."""
    ensure_consumption(led)
    items, meals, details = led["t_meal_details"], led["meal_headers"], led["t_transaction_details"]
    return (items.join(meals, "meal_id")
            .join(details.select(c("id").alias("detail_id"), "transaction_id", "item_name_receipt",
                                 "food_type", "food_id"), "detail_id")
            .select(c("id").alias("item_id"), "meal_id", "eaten_at", "inventory_id", "detail_id",
                    "transaction_id", "item_name_receipt", "food_type", "food_id", "amount_consumed",
                    "consume_type"))


# J-04
def stock_lots(led) -> DataFrame:
    """Lots with their purchase line, purchase time and the universal shelf-life guideline."""
    ensure_consumption(led)
    inv, details, tx = led["t_inventory_snapshot"], led["t_transaction_details"], led["t_transactions"]
    uni = led.foods_of("UNIVERSAL").select(c("id").alias("u_id"), "shelf_life_days_guideline")
    d = details.select(c("id").alias("detail_id"), "transaction_id", "item_name_receipt", "destination",
                       "limit_date", "limit_type", "food_id", "food_type")
    j = (inv.join(d, "detail_id")
         .join(tx.select(c("id").alias("transaction_id"), "transaction_at"), "transaction_id")
         .join(uni, (c("food_id") == c("u_id")) & (c("food_type") == "UNIVERSAL"), "left"))
    return j.select(c("id").alias("inv_id"), "item_name_receipt", "current_quantity", "transaction_at",
                    c("destination").alias("location"), "limit_date", "limit_type", "shelf_life_days_guideline")


# R-04
def stock_report(led, as_of) -> DataFrame:
    """Lots with stock left, due date / kind / status, ordered by effective due date."""
    lots = stock_lots(led).filter(c("current_quantity") > 0)
    due = S.due_date("limit_date", "transaction_at", "shelf_life_days_guideline")
    return (lots.select(
        "inv_id", "item_name_receipt", S.label("location", S.PLACE_LABELS).alias("place"),
        "current_quantity", due.alias("due_at"),
        S.due_kind("limit_date", "limit_type", "shelf_life_days_guideline").alias("due_kind"),
        S.due_status(due, c("limit_date").isNotNull(), as_of).alias("status"),
        S.due_sort_key("limit_date", "transaction_at", "shelf_life_days_guideline").alias("sort_key"))
        .orderBy("sort_key", "inv_id"))


# A-13
def consumption_cost(led) -> DataFrame:
    """Cost of consumed stock by day and kind: consumed quantity × unit price incl. tax."""
    lin = consumption_lineage(led)
    d = led["t_transaction_details"].select(c("id").alias("detail_id"), "unit_price_ex_tax", "tax_rate")
    j = lin.join(d, "detail_id")
    cost = c("amount_consumed") * c("unit_price_ex_tax") * (F.lit(1.0) + c("tax_rate"))
    return (j.groupBy(S.to_day("eaten_at").alias("day"), "consume_type")
            .agg(S.exact_sum(cost).alias("cost"), F.count(F.lit(1)).alias("items")))
