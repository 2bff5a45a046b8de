"""S-01 scan_ledger and the star-schema adapter.

``Ledger`` is a mapping of table name -> DataFrame.  Two ways to get one:

* ``Ledger.load(spark, root)`` reads stored ledger tables (Parquet, or CSV /
  JSON with the fixed schema) — the production path.
* ``Ledger.from_star(spark, sf_dir)`` derives the ledger tables from the
  driver's TPC-H-like star tables (customer -> wallets, orders ->
  transactions, lineitem -> receipt lines, events -> payment movements, ...).
  Every table is a lazy DataFrame; Catalyst prunes columns and pushes
  filters of the operators down to the Parquet scans of the star tables.

The same mapping is written as SQL in ``plans.oracle.LEDGER_VIEWS_SQL`` for
the DuckDB oracle; ``tests/test_ledger.py`` checks the two agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import size_tasks, stored
from .schema import SCHEMAS

STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _ts(text: str) -> Column:
    """Naive timestamp literal, independent of the session time zone."""
    return F.lit(text).cast("timestamp_ntz")


def _conform(df: DataFrame, name: str) -> DataFrame:
    """Project to the declared schema: column order and types."""
    schema = SCHEMAS[name]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


class Ledger(dict):
    """Table name -> DataFrame."""

    spark: SparkSession

    # ------------------------------------------------------------------ S-01
    @classmethod
    def load(cls, spark: SparkSession, root: str, fmt: str | dict[str, str] = "parquet",
             tables: list[str] | None = None) -> "Ledger":
        """Read stored ledger tables with their fixed schemas (never inferred).

        ``fmt``: one format, or a format per table (Parquet for the others).
        A table's files may be of several schema versions: columns that an
        older file lacks are NULL, columns that the schema does not name are
        not read.  CSV and JSON lines that do not fit the schema are left out
        of the table; ``corrupt`` has their text, by table (such files are
        parsed once, to Parquet in the shared folder).
        """
        led = cls()
        led.spark, led.corrupt = spark, {}
        for name in tables or list(SCHEMAS):
            kind = fmt if isinstance(fmt, str) else fmt.get(name, "parquet")
            if kind == "parquet":
                led[name] = spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")
                continue
            with_text = T.StructType([*(T.StructField(f.name, f.dataType) for f in SCHEMAS[name]), T.StructField("_corrupt", T.StringType())])
            reader = spark.read.schema(with_text).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE")
            rows = stored((reader.option("header", "true") if kind == "csv" else reader).format(kind).load(f"{root}/{name}"), f"{name}-parsed")
            led[name] = rows.filter(F.col("_corrupt").isNull()).drop("_corrupt")
            led.corrupt[name] = rows.filter(F.col("_corrupt").isNotNull()).select(F.col("_corrupt").alias("text"))
        return led

    # ----------------------------------------------------------- star adapter
    @classmethod
    def from_star(cls, spark: SparkSession, sf_dir: str) -> "Ledger":
        """Lazy ledger over the star tables: each table is derived on first use."""
        led = cls()
        led.spark = spark
        led._sf_dir = sf_dir
        led._star = {}
        led._builders = _star_builders(led)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = folder(sf_dir).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        paths = [folder(f"{sf_dir}/{t}.parquet") for t in STAR_TABLES]
        size_tasks(spark, sum(fs.getContentSummary(p).getLength() for p in paths if fs.exists(p)))
        return led

    def star(self, name: str) -> DataFrame:
        if name not in self._star:
            self._star[name] = self.spark.read.parquet(f"{self._sf_dir}/{name}.parquet")
        return self._star[name]

    def __missing__(self, key):
        builders = getattr(self, "_builders", {})
        if key not in builders:
            raise KeyError(key)
        df = builders[key]()
        self[key] = df
        return df

    def __contains__(self, key) -> bool:
        return dict.__contains__(self, key) or key in getattr(self, "_builders", {})

    # ---------------------------------------------------------- conveniences
    def foods_of(self, kind: str) -> DataFrame:
        """One of the three food masters (universal / measured / processed)."""
        return self["m_foods"].filter(F.col("food_kind") == kind)


def _star_builders(led: "Ledger") -> dict:
    """name -> zero-argument builder of that ledger table from the star tables."""
    c = F.col
    st = led.star

    def m_currencies():
        region = st("region")
        return _conform(region.select(
            c("r_regionkey").alias("id"), c("r_name").alias("code"), c("r_name").alias("name"),
            F.lit("u").alias("display_unit"),
            F.when(c("r_regionkey") > 0, _ts("1995-01-01 00:00:00")).alias("start_at"),
            F.when(c("r_regionkey").isin(2, 3), _ts("1998-01-01 00:00:00")).alias("end_at"),
            F.when(c("r_regionkey") == 2, F.lit(3)).when(c("r_regionkey") == 3, F.lit(4)).alias("successor_id"),
        ), "m_currencies")

    def t_currency_rates():
        # One rate per (currency, day) over all orders: partial + final hash aggregate.
        rates = (st("orders")
                 .groupBy((c("o_custkey") % 5).alias("currency_id"), c("o_orderdate").alias("effective_at"))
                 .agg(F.min("o_orderkey").alias("id"),
                      F.max(F.when(c("o_custkey") % 5 == 0, F.lit(1.0))
                            .otherwise(c("o_totalprice") / 1.0e5)).alias("rate_to_jpy")))
        return _conform(rates.withColumn(
            "change_type", F.when(c("id") % 4 == 0, "QUANTITY_ADJUST").otherwise("VALUE_ADJUST")),
            "t_currency_rates")

    def m_wallets():
        wallets = st("customer").join(st("nation"), c("c_nationkey") == c("n_nationkey"))
        return _conform(wallets.select(
            c("c_custkey").alias("id"), c("c_name").alias("name"),
            F.when(c("c_custkey") % 13 == 0, F.lit(None)).otherwise(c("n_regionkey")).alias("currency_id"),
            F.when(c("c_mktsegment") == "HOUSEHOLD", "CASH").when(c("c_mktsegment") == "MACHINERY", "BANK")
             .when(c("c_mktsegment") == "FURNITURE", "CREDIT").when(c("c_mktsegment") == "BUILDING", "PREPAID")
             .otherwise("POINT").alias("wallet_group"),
            (c("c_acctbal") >= 0).alias("is_active"),
        ), "m_wallets")

    def m_foods():
        pk, ps = c("p_partkey"), c("p_size")
        return _conform(st("part").filter(pk % 6 >= 2).select(
            pk.alias("id"), F.concat_ws(" ", c("p_name"), c("p_brand")).alias("name"),
            F.when(pk % 6 == 2, "UNIVERSAL").when(pk % 6 == 3, "MEASURED").otherwise("PROCESSED").alias("food_kind"),
            F.when((pk % 6 == 2) & (ps % 5 != 0), ps.cast("double")).alias("shelf_life_days_guideline"),
            F.when(pk % 11 != 0, c("p_retailprice") / 10).alias("energy_kcal"),
            F.when(pk % 7 != 0, ps * 0.3).alias("protein_g"),
            (ps * 0.2).alias("fat_g"), (ps * 0.9).alias("carb_g"), ((pk % 9) * 0.1).alias("salt_equiv_g"),
            (pk % 10).alias("taste_sweet"), (pk % 8).alias("taste_salty"), (pk % 7).alias("taste_sour"),
            (pk % 5).alias("taste_bitter"), (pk % 4).alias("taste_umami"), (pk % 3).alias("taste_pungent"),
            (pk % 2).alias("taste_cooling"), (ps % 4).alias("taste_astringency"), (ps % 6).alias("taste_richness"),
            (ps % 9).alias("taste_sharpness"),
        ), "m_foods")

    def m_brands():
        return _conform(st("nation").select(c("n_nationkey").alias("id"), c("n_name").alias("name")), "m_brands")

    def m_store_branches():
        return _conform(st("supplier").select(
            c("s_suppkey").alias("id"), c("s_nationkey").alias("brand_id"), c("s_name").alias("branch_name")),
            "m_store_branches")

    def m_categories():
        return _conform(st("nation").filter(c("n_nationkey") < 15).select(
            c("n_nationkey").alias("id"), F.concat(F.lit("CAT_"), c("n_name")).alias("name"),
            F.when(c("n_nationkey") < 11, "EXPENSE").when(c("n_nationkey") < 14, "INCOME").alias("type")),
            "m_categories")

    def t_transactions():
        ok = c("o_orderkey")
        return _conform(st("orders").select(
            ok.alias("id"),
            F.when(ok % 7 == 0, F.lit(None)).otherwise(c("o_orderpriority")).alias("transaction_name"),
            F.when(c("o_orderstatus") == "P", F.lit(None)).otherwise(c("o_custkey") % 10).alias("branch_id"),
            c("o_orderdate").alias("transaction_at"),
            (c("o_orderpriority") != "5-LOW").alias("is_public"),
            F.when(ok % 20 == 0, 1).otherwise(0).alias("tax_adjustment_jpy"),
            F.floor("o_totalprice").alias("total_amount_jpy"),
        ), "t_transactions")

    def t_transaction_details():
        lp, ln = c("l_partkey"), c("l_linenumber")
        kind = (F.when(lp % 6 == 0, "NONE").when(lp % 6 == 1, "ADJUSTMENT").when(lp % 6 == 2, "UNIVERSAL")
                .when(lp % 6 == 3, "MEASURED").when(lp % 6 == 4, "PROCESSED").otherwise("OUT_EAT"))
        dest = (F.when(lp % 6 == 5, "EAT_NOW").when(lp % 6 < 2, "EAT_NOW")
                .when((c("l_returnflag") == "A") & (c("l_linestatus") == "F"), "FRIDGE")
                .when(c("l_returnflag") == "A", "FREEZER").when(c("l_returnflag") == "N", "PANTRY")
                .when(c("l_linestatus") == "F", "EAT_NOW").otherwise("GIFT"))
        return _conform(st("lineitem").select(
            (((c("l_orderkey") * 8 + ln) * 100000 + lp) * 10000 + c("l_suppkey")).alias("id"),
            c("l_orderkey").alias("transaction_id"),
            F.when(lp % 6 == 0, c("l_suppkey") % 15).alias("category_id"),
            kind.alias("food_type"),
            F.when(lp % 6 >= 2, lp).alias("food_id"),
            F.concat(F.lit("item "), lp.cast("string")).alias("item_name_receipt"),
            (c("l_extendedprice") / c("l_quantity")).alias("unit_price_ex_tax"),
            c("l_quantity").alias("quantity"), c("l_tax").alias("tax_rate"),
            F.when(ln == 7, c("l_extendedprice") * 2)
             .otherwise(c("l_extendedprice") * c("l_discount")).alias("discount_amount"),
            dest.alias("destination"),
            F.when(ln % 3 != 0, c("l_shipdate")).alias("limit_date"),
            F.when(ln % 3 == 1, "CONSUMPTION").when(ln % 3 == 2, "BEST_BEFORE").alias("limit_type"),
            F.when(ln % 5 != 0, ln % 5).alias("reliability_level"),
            F.when(ln == 1, "A").when(ln == 2, "B").when(ln == 3, "C").when(ln == 4, "D").when(ln == 5, "J").alias("condition_rank"),
        ), "t_transaction_details")

    def t_payments():
        eid = c("event_id")
        return _conform(st("events").select(
            eid.alias("id"), eid.alias("transaction_id"),
            F.when(c("event_type") == "error", F.lit(None)).otherwise(c("user_id")).alias("wallet_id"),
            (F.when(c("event_type").isin("purchase", "click"), -1).otherwise(1)
             * F.floor(c("value") * 10)).alias("amount"),
            F.when(eid % 4 == 0, F.date_trunc("month", c("ts")).cast("timestamp_ntz")).alias("expiry_at"),
            F.when(eid % 10 == 0, F.concat(F.lit("R"), (eid % 3).cast("string"))).alias("usage_restriction"),
        ), "t_payments")

    def t_inventory():
        from ..operators.stock import create_lots
        return create_lots(led["t_transaction_details"], led["t_transactions"])

    def consume_requests():
        return _consume_requests(led["t_transaction_details"], led["t_transactions"])

    def raw_receipts():
        from .ingest import raw_receipts as build
        # one row group of a star file is read by one task: deal the lines out before they are parsed
        return build({t: st(t) for t in ("lineitem", "orders", "part", "supplier", "nation")}).repartition("receipt_id")

    def raw_movements():
        # Up to four settlement movements per wallet: the customer's latest order of each remainder by four.
        latest = st("orders").groupBy("o_custkey", c("o_orderkey") % 4).agg(
            F.max("o_orderkey").alias("o_orderkey"),
            F.max_by("o_totalprice", "o_orderkey").alias("o_totalprice"),
            F.max_by("o_orderdate", "o_orderkey").alias("o_orderdate"))
        return _conform(latest.select(
            c("o_orderkey").alias("movement_id"), c("o_orderkey").alias("transaction_id"),
            c("o_custkey").alias("wallet_id"), F.floor(c("o_totalprice") / 1000).alias("amount"),
            F.when(c("o_orderkey") % 3 == 0, F.floor(c("o_totalprice") / 4000)).alias("requested_offset"),
            F.when(c("o_orderkey") % 5 == 0, F.lit("20240331")).alias("new_expiry_text"),
            F.when(c("o_orderkey") % 7 == 0, F.lit("R9")).alias("new_restriction"),
            c("o_orderdate").alias("moved_at"),
        ), "raw_movements")

    return {f.__name__: f for f in (m_currencies, t_currency_rates, m_wallets, m_foods, m_brands, m_store_branches,
                                    m_categories, t_transactions, t_transaction_details, t_payments, t_inventory,
                                    consume_requests, raw_receipts, raw_movements)}


def _consume_requests(details: DataFrame, transactions: DataFrame) -> DataFrame:
    """Three requests per lot (fractions 0.5, 0.7, 0.3 of the lot): accept, reject, accept.

    The consume kind rotates with the lot id so every kind reaches the
    accepted side.  Built with a generator (``explode``) on the lot rows,
    not with a join.
    """
    c = F.col
    lots = (details.filter(c("destination").isin("FRIDGE", "FREEZER", "PANTRY"))
            .join(transactions.select(c("id").alias("transaction_id"), "transaction_at"), "transaction_id")
            .select(c("id").alias("lot_id"), "transaction_id", "quantity", "transaction_at"))
    # --- fixed values: request steps (k, fraction of the lot) ---
    steps = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(f).alias("frac"))
                      for k, f in [(1, 0.5), (2, 0.7), (3, 0.3)]])
    kinds = F.array(F.lit("SELF"), F.lit("LOSS"), F.lit("GIFT"))
    req = lots.select("*", F.explode(steps).alias("s"))
    return _conform(req.select(
        (c("lot_id") * 4 + c("s.k")).alias("request_id"),
        c("lot_id").alias("inventory_id"),
        (c("transaction_id") * 4 + c("s.k")).alias("meal_id"),
        (c("quantity") * c("s.frac")).alias("amount"),
        F.element_at(kinds, ((c("s.k") - 1 + c("lot_id")) % 3 + 1).cast("int")).alias("consume_type"),
        F.timestamp_add("DAY", c("s.k"), c("transaction_at")).alias("requested_at"),
        c("s.k").alias("seq"),
    ), "consume_requests")
