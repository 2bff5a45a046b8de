"""Batch ingest and table maintenance (S-02, S-04, S-05, S-06, S-07, R-09).

The interactive entry screens become DataFrame jobs over raw text batches:
each field is decoded with built-in expressions (letter / digit codes via
literal maps, numbers via guarded casts, dates via the C-04 / C-05 parsers)
and bad rows go to a reject DataFrame instead of a re-prompt.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..session import ensure_checkpoint_dir, stored
from .schema import FOOD_KINDS, STOCK_PLACES

c = F.col


def raw_receipts(star: dict[str, DataFrame]) -> DataFrame:
    """Raw receipt lines (all text) derived from the star tables.

    Store = the transaction's branch (supplier ``o_custkey % 10``) and its
    brand (the supplier's nation); item text = the food master name for food
    lines.  Some fields carry noise on purpose: a brand in lower case or
    without a letter, a shortened branch, an item in upper case, without a
    letter or with two letters swapped, an invalid time, a non-numeric
    price, tax or discount, a negative quantity, an invalid limit date.
    """
    li, o, p = star["lineitem"], star["orders"], star["part"]
    sup, nat = star["supplier"], star["nation"]
    store = sup.join(nat, c("s_nationkey") == c("n_nationkey")).select(
        c("s_suppkey").alias("__store"), "s_name", "n_name")
    lp, ln, ok = c("l_partkey"), c("l_linenumber"), c("o_orderkey")
    without_third = lambda x: F.concat(F.substring(x, 1, 2), F.expr(f"substring({x}, 4)"))
    swapped = lambda x: F.concat(F.substring(x, 1, 2), F.substring(x, 4, 1), F.substring(x, 3, 1), F.expr(f"substring({x}, 5)"))
    hdr = o.withColumn("__store", c("o_custkey") % 10).join(store, "__store", "left").select(
        "o_orderkey",
        F.when(ok % 97 == 0, F.lit("202613011200")).when(ok % 4 == 0, F.date_format("o_orderdate", "yyyyMMdd"))
         .otherwise(F.date_format("o_orderdate", "yyyyMMddHHmm")).alias("at_text"),
        F.when(c("o_orderpriority") == "5-LOW", "n").otherwise("y").alias("public_text"),
        F.when(ok % 9 == 0, F.lower("n_name")).when(ok % 13 == 0, without_third("n_name")).otherwise(c("n_name")).alias("brand_text"),
        F.when(ok % 11 == 0, F.regexp_replace("s_name", "Supplier#", "Sup ")).otherwise(c("s_name")).alias("branch_text"))
    j = (li.join(hdr, c("l_orderkey") == c("o_orderkey"))
         .join(p.select("p_partkey", F.concat_ws(" ", c("p_name"), c("p_brand")).alias("food_name")), c("l_partkey") == c("p_partkey"), "left"))
    price = F.floor(c("l_extendedprice") / c("l_quantity")).cast("string")
    return j.select(
        c("l_orderkey").alias("receipt_id"),
        "at_text", "public_text", "brand_text", "branch_text",
        ln.cast("long").alias("line_no"),
        F.when(lp % 6 >= 2, F.when(ln == 3, F.upper("food_name")).when(ln == 5, without_third("food_name"))
               .when(ln == 7, swapped("food_name")).otherwise(c("food_name")))
         .otherwise(F.concat(F.lit("item "), lp.cast("string"))).alias("item_text"),
        F.when(lp % 6 == 0, (c("l_suppkey") % 15).cast("string")).when(lp % 6 == 1, "a").when(lp % 6 == 2, "u")
         .when(lp % 6 == 3, "m").when(lp % 6 == 4, "p").otherwise("o").alias("kind_text"),
        F.when(ln == 6, F.concat(F.lit("x"), price)).otherwise(price).alias("price_text"),
        F.when(lp % 107 == 0, F.lit("-1")).otherwise(c("l_quantity").cast("string")).alias("qty_text"),
        F.when(lp % 101 == 0, F.lit("abc")).when(ln % 4 == 0, F.lit("")).otherwise(c("l_tax").cast("string")).alias("tax_text"),
        F.when(lp % 103 == 0, F.lit("zz")).when(ln == 2, F.floor(c("l_extendedprice") * c("l_discount")).cast("string")).otherwise(F.lit(""))
         .alias("discount_text"),
        F.when(c("l_returnflag") == "A", "2").when(c("l_returnflag") == "N", "4").otherwise("1").alias("dest_text"),
        F.when(ln == 5, F.lit("20011340")).when(ln % 3 != 0, F.date_format("l_shipdate", "yyyyMMdd"))
         .alias("limit_text"),
        F.when(ln % 2 == 0, "2").otherwise("1").alias("limit_kind_text"),
    )


# S-04
def ingest_receipts(raw: DataFrame, as_of) -> dict[str, DataFrame]:
    """Raw receipt lines -> typed lines + rejects.

    * time: 12 digits = minute, 8 digits = midnight, empty = ``as_of``;
    * ``n`` marks a non-public receipt (tax default 0);
    * kind: letters u/m/p/o/a/x, or category digits (then type NONE);
    * price must be an integer, quantity a number that is not negative;
    * tax: given value (an explicit 0 is kept), empty = the default rate;
    * discount: given value, empty = 0;
    * destination digit only for stockable kinds (default eat now);
    * limit date / kind only for stock destinations; an invalid date counts as none.

    A text that is given and cannot be read rejects the line; the reason names
    the first such field.
    """
    given = lambda col: F.coalesce(F.trim(c(col)) != "", F.lit(False))
    # an empty text is not cast: the failed cast raises inside, which costs more than the rest of the line
    number = lambda col: F.when(given(col), S.normalize_digits(c(col)).try_cast("double"))
    # each field is read once, in a projection of its own; the decisions only name what was read
    read = raw.select(
        "receipt_id", "line_no", "brand_text", "branch_text", "item_text", F.trim(c("dest_text")).alias("dest"),
        F.trim(c("limit_kind_text")).alias("limit_kind"), F.lower(F.trim(c("kind_text"))).alias("kind"),
        S.parse_yyyymmddhhmm("at_text").alias("time"), given("at_text").alias("has_time"),
        F.coalesce(F.lower(F.trim(c("public_text"))) != "n", F.lit(True)).alias("is_public"),
        S.normalize_digits(c("price_text")).alias("price_digits"), number("qty_text").alias("quantity"),
        number("tax_text").alias("tax"), given("tax_text").alias("has_tax"),
        number("discount_text").alias("discount"), given("discount_text").alias("has_discount"),
        F.when(given("limit_text"), S.parse_yyyymmdd("limit_text")).alias("limit"))
    is_digits = c("kind").rlike("^[0-9]+$")
    read = read.select("*", F.when(is_digits, F.lit("NONE")).otherwise(S.label(c("kind"), S.KIND_LETTERS, "NONE")).alias("food_type"),
                       F.when(is_digits, c("kind").try_cast("long")).alias("category_id"),
                       F.when(c("price_digits").rlike("^-?[0-9]+$"), c("price_digits").try_cast("long")).alias("unit_price"))
    read = read.withColumn("destination", F.when(c("food_type").isin(*FOOD_KINDS), S.label(c("dest"), S.DEST_DIGITS, "EAT_NOW")).otherwise(F.lit("EAT_NOW")))
    read = read.withColumn("limit_date", F.when(c("destination").isin(*STOCK_PLACES), c("limit")))
    reason = (F.when(c("has_time") & c("time").isNull(), F.lit("BAD_TIME"))
              .when(c("unit_price").isNull(), F.lit("BAD_PRICE"))
              .when(c("quantity").isNull() | (c("quantity") < 0), F.lit("BAD_QUANTITY"))
              .when(c("has_tax") & (c("tax").isNull() | (c("tax") < 0)), F.lit("BAD_TAX"))
              .when(c("has_discount") & (c("discount").isNull() | (c("discount") < 0)), F.lit("BAD_DISCOUNT")))
    typed = read.select(
        "receipt_id", "line_no", F.coalesce(c("time"), S.ts_lit(as_of)).alias("transaction_at"), "is_public",
        "brand_text", "branch_text", "item_text", "food_type", "category_id", "unit_price", "quantity",
        F.coalesce(c("tax"), S.default_tax_rate(c("is_public"), c("food_type"))).alias("tax_rate"),
        F.coalesce(c("discount"), F.lit(0.0)).alias("discount_amount"), "destination", "limit_date",
        F.when(c("limit_date").isNotNull(), F.when(c("limit_kind") == "2", "BEST_BEFORE").otherwise("CONSUMPTION")).alias("limit_type"),
        reason.alias("reject_reason"))
    typed = stored(typed, "receipt-lines")  # else every use would parse again, and a filter on the reason repeat each parse
    return {"lines": typed.filter(c("reject_reason").isNull()).drop("reject_reason"),
            "rejects": typed.filter(c("reject_reason").isNotNull())}


def raw_consumption(requests: DataFrame) -> DataFrame:
    """Consumption requests as entered: amount, kind digit and time as text, some of them unreadable."""
    digit = F.create_map(*[F.lit(x) for d, kind in S.CONSUME_DIGITS.items() for x in (kind, d)])
    k = c("request_id")
    return requests.select(
        "request_id", "inventory_id", "meal_id", "seq",
        F.when(k % 211 == 0, F.lit("some")).when(k % 223 == 0, F.lit("-1")).otherwise(c("amount").cast("decimal(18,2)").cast("string")).alias("amount_text"),
        F.when(k % 227 == 0, F.lit("9")).when(k % 229 == 0, F.lit("")).otherwise(digit[c("consume_type")]).alias("kind_text"),
        F.when(k % 233 == 0, F.lit("20011340")).when(k % 239 == 0, F.lit("")).when(k % 2 == 0, F.date_format("requested_at", "yyyyMMdd"))
         .otherwise(F.date_format("requested_at", "yyyyMMddHHmm")).alias("at_text"))


def ingest_consumption(raw: DataFrame, as_of) -> dict[str, DataFrame]:
    """Raw consumption lines -> typed requests + rejects.

    Amount: a number that is not negative; kind: digit 1, 2, 3 (empty = eaten
    by oneself); time: 12 or 8 digits (empty = ``as_of``).
    """
    given = lambda col: F.coalesce(F.trim(c(col)) != "", F.lit(False))
    amount, time = S.normalize_digits(c("amount_text")).try_cast("double"), S.parse_yyyymmddhhmm("at_text")
    kind = S.label(S.normalize_digits(c("kind_text")), S.CONSUME_DIGITS, None)
    reason = (F.when(amount.isNull() | (amount < 0), F.lit("BAD_AMOUNT")).when(given("kind_text") & kind.isNull(), F.lit("BAD_KIND"))
              .when(given("at_text") & time.isNull(), F.lit("BAD_TIME")))
    typed = raw.select("request_id", "inventory_id", "meal_id", amount.alias("amount"), F.coalesce(kind, F.lit("SELF")).alias("consume_type"),
                       F.coalesce(time, S.ts_lit(as_of)).alias("requested_at"), "seq", reason.alias("reject_reason"))
    return {"requests": typed.filter(c("reject_reason").isNull()).drop("reject_reason"), "rejects": typed.filter(c("reject_reason").isNotNull())}


# R-09
def _named(col: str) -> Column:
    return F.coalesce(F.trim(c(col)) != "", F.lit(False))


def _following(new: DataFrame, order: list[str], table: DataFrame) -> DataFrame:
    """The rows with ``id``: numbered on from the largest id of ``table``, in this order."""
    from ..operators.windows import range_numbered

    last = table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return range_numbered(new, [c(x).asc_nulls_first() for x in order], "__no").select((F.lit(last) + c("__no")).cast("long").alias("id"), *new.columns)


class Purchases:
    """A batch of raw receipts, bound to the masters and recorded (R-09).

    The batch is parsed once and stored.  Every other table
    is worked out when it is first asked for, by name (``batch["details"]``):

    * ``transactions`` (with checkout totals), ``details``, ``lots``;
    * ``m_brands``, ``m_store_branches``, ``m_foods``: rows to add to the masters.

    An exact name binds first, then the best candidate of the fuzzy lookup
    (Z-04 for stores; for foods the master that the line's type names).  What
    is left is new and numbered on from the largest id in use: brands,
    branches under old and new brands, foods in their kind's master.  A blank
    text names nothing.  All lookups work on distinct texts.
    """

    def __init__(self, raw: DataFrame, led, as_of):
        self.led = led
        self.lines = ingest_receipts(raw, as_of)["lines"]

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def _matched(self) -> DataFrame:
        from ..operators.matching import match_store

        texts = self.lines.filter(_named("brand_text")).select("brand_text", "branch_text").distinct()
        return stored(match_store(texts, self.led["m_brands"], self.led["m_store_branches"]), "stores")

    @cached_property
    def m_brands(self) -> DataFrame:
        new = self._matched.filter(c("brand_id").isNull()).select(c("brand_text").alias("name")).distinct()
        return stored(_following(new, ["name"], self.led["m_brands"]), "new-brands")

    @cached_property
    def _placed(self) -> DataFrame:
        new = self.m_brands.select(c("name").alias("brand_text"), c("id").alias("new_id"))
        return self._matched.join(new, "brand_text", "left").withColumn("brand_id", F.coalesce("brand_id", "new_id")).drop("new_id")

    @cached_property
    def m_store_branches(self) -> DataFrame:
        new = self._placed.filter(c("branch_id").isNull() & _named("branch_text")).select("brand_id", c("branch_text").alias("branch_name")).distinct()
        return stored(_following(new, ["brand_id", "branch_name"], self.led["m_store_branches"]), "new-branches")

    @cached_property
    def stores(self) -> DataFrame:
        """(brand_text, branch_text, brand_id, branch_id) of every store that the lines name."""
        new = self.m_store_branches.select("brand_id", c("branch_name").alias("branch_text"), c("id").alias("new_id"))
        return self._placed.join(new, ["brand_id", "branch_text"], "left").select(
            "brand_text", "branch_text", "brand_id", F.coalesce("branch_id", "new_id").alias("branch_id"))

    @cached_property
    def _asked(self) -> DataFrame:
        from ..operators.matching import kind_of

        kind = kind_of(c("food_type"))
        return stored(self.lines.filter(kind.isNotNull() & _named("item_text")).select(c("item_text").alias("query"), kind.alias("kind")).distinct(), "foods-asked")

    @cached_property
    def _found(self) -> DataFrame:
        from ..operators.matching import food_masters, top_candidates

        masters = food_masters(self.led)
        names = masters.groupBy(c("name").alias("query"), "kind").agg(F.min("id").alias("food_id"))
        exact = stored(self._asked.join(names, ["query", "kind"]), "foods-exact")
        best = top_candidates(self._asked.join(exact, ["query", "kind"], "left_anti"), masters).filter(c("rank") == 1)
        return stored(exact.unionByName(best.select("query", "kind", c("id").alias("food_id"))), "foods-found")

    @cached_property
    def m_foods(self) -> DataFrame:
        new = self._asked.join(self._found, ["query", "kind"], "left_anti").select(c("query").alias("name"), c("kind").alias("food_kind"))
        return stored(_following(new, ["food_kind", "name"], self.led["m_foods"]), "new-foods")

    @cached_property
    def foods(self) -> DataFrame:
        """(query, kind, food_id) of every food that the lines name."""
        return self._found.unionByName(self.m_foods.select(c("name").alias("query"), c("food_kind").alias("kind"), c("id").alias("food_id")))

    @cached_property
    def transactions(self) -> DataFrame:
        stores = self.stores.select(c("brand_text").alias("brand"), c("branch_text").alias("branch"), "brand_id", "branch_id")
        lines = self.lines.join(stores, (c("brand_text") == c("brand")) & c("branch_text").eqNullSafe(c("branch")), "left")
        gross = S.line_gross("unit_price", "quantity", "tax_rate", "discount_amount")
        return lines.groupBy("receipt_id").agg(
            F.min("transaction_at").alias("transaction_at"), F.min("is_public").alias("is_public"),
            F.min("brand_id").alias("brand_id"), F.min("branch_id").alias("branch_id"),
            F.sum(gross).cast("long").alias("total_amount_jpy"), F.count(F.lit(1)).alias("n_lines"))

    @cached_property
    def _numbered(self) -> DataFrame:
        # by receipt, line and content: (receipt, line) need not be unique
        content = ["receipt_id", "line_no", "item_text", "food_type", "category_id", "unit_price", "quantity", "tax_rate",
                   "discount_amount", "destination", "limit_date", "limit_type"]
        return _following(self.lines, content, self.led["t_transaction_details"])

    @cached_property
    def details(self) -> DataFrame:
        from ..operators.matching import kind_of

        foods = self.foods.select(c("query").alias("food"), "kind", "food_id")
        lines = self._numbered.join(foods, (c("item_text") == c("food")) & (kind_of(c("food_type")) == c("kind")), "left")
        return lines.select(
            "id", c("receipt_id").alias("transaction_id"), "line_no", "category_id", "food_type", "food_id",
            c("item_text").alias("item_name_receipt"), c("unit_price").cast("double").alias("unit_price_ex_tax"), "quantity",
            "tax_rate", "discount_amount", "destination", "limit_date", "limit_type")

    @cached_property
    def lots(self) -> DataFrame:
        return self._numbered.filter(c("destination").isin(*STOCK_PLACES)).select(
            "id", c("id").alias("detail_id"), c("quantity").alias("current_quantity"), c("transaction_at").alias("updated_at"))


def record_purchases(raw: DataFrame, led, as_of) -> Purchases:
    """Batch of raw receipts -> transactions, details, lots and the masters' new rows, by name."""
    return Purchases(raw, led, as_of)


# S-02
def append_facts(df: DataFrame, path: str, batch: str, partition_by: list[str] | None = None) -> bool:
    """Append a validated batch to a fact table (Parquet, partitioned); False if the batch is there already.

    A batch is a folder ``batch=<id>``: it is written aside and renamed once
    whole, so a batch that failed half way leaves nothing to read and one
    that is sent again adds nothing (one writer per batch).  Rows are
    gathered by partition value before they are written: a value gets a file
    of the advisory size or several, not one per task.
    """
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, aside = folder(f"{path}/batch={batch}"), f"{path}/_aside/{batch}-{uuid.uuid4().hex}"
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        return False
    gathered = df.hint("rebalance", *partition_by) if partition_by else df
    gathered.write.partitionBy(*(partition_by or [])).parquet(aside)
    if not fs.rename(folder(aside), target):
        raise OSError(f"cannot rename {aside}")
    return True


def read_facts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All committed batches of a fact table."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())])).parquet(path).select(*schema.names)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory named by the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append_round_trip(spark: SparkSession, transactions: DataFrame) -> DataFrame:
    """Write transactions partitioned by month in two batches, one of them sent twice, and read them back."""
    path = scratch_path(spark, "t_transactions")
    t = transactions.withColumn("month", F.trunc(F.to_date("transaction_at"), "month"))
    for batch, rows in (("even", c("id") % 2 == 0), ("odd", c("id") % 2 != 0), ("even", c("id") % 2 == 0)):
        append_facts(t.filter(rows), path, batch, ["month"])
    return read_facts(spark, path, t.schema)


# S-05
def seed_rates(currencies: DataFrame) -> DataFrame:
    """One unit rate per currency, effective from its start (or the serial epoch)."""
    return currencies.select(c("id").alias("currency_id"), F.lit(1.0).alias("rate_to_jpy"),
                             F.lit("VALUE_ADJUST").alias("change_type"),
                             F.coalesce(c("start_at"), S.ts_lit(S.SERIAL_EPOCH)).alias("effective_at"))


def seed_balances(wallets: DataFrame) -> DataFrame:
    """A zero opening movement and a zero plain-money balance per wallet."""
    return wallets.select(c("id").alias("wallet_id"), F.lit(0).cast("long").alias("amount"),
                          F.lit(0).cast("long").alias("current_amount"),
                          F.lit(None).cast("long").alias("origin_payment_id"))


# S-06
def add_missing_column(df: DataFrame, name: str, default, dtype: str = "string") -> DataFrame:
    """Give a stored table a column it lacks (older files), filled with ``default``; a column it has stays as it is."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(dtype))


# S-07
def apply_updates(base: DataFrame, updates: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Latest-wins upsert: the update with the highest seq per key replaces the base row or is added.

    Only the updates are aggregated; the base is joined to the result, which
    Spark broadcasts if it is small, so the base need not be shuffled.
    """
    cols = [x for x in base.columns if x != key]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*[c(x) for x in cols]), c(seq)).alias("__row"))
    new = last.join(base.select(key).join(last.select(key), key, "left_semi"), key, "left_anti")
    joined = base.join(last, key, "left")
    pick = lambda x: F.when(c("__row").isNotNull(), c(f"__row.{x}")).otherwise(base[x]).alias(x)
    return joined.select(key, *[pick(x) for x in cols]).unionByName(new.select(key, *[c(f"__row.{x}").alias(x) for x in cols])).select(*base.columns)
