"""Money flow: wallets, balances per (wallet, expiry, restriction), offsets, valuation.

Inventory rows: J-01, J-02, J-08, J-11, J-12, A-03, A-09, A-10, A-12, W-01,
W-02, W-05, R-10, R-12.

A balance group is (wallet, expiry_at, usage_restriction); NULL is a legal
value of the last two and groups with NULLs together (``groupBy`` does that;
joins use ``eqNullSafe``).  Plain money is the group with both NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .windows import bucketed_running_sum, range_numbered, ranged_neighbours, ranged_sums

c = F.col
GROUP = ["wallet_id", "expiry_at", "usage_restriction"]


def is_limited(exp="expiry_at", restr="usage_restriction"):
    return c(exp).isNotNull() | c(restr).isNotNull()


# J-01
def wallets_with_currency(led) -> DataFrame:
    """Wallets ⋈ currencies (a wallet without currency drops out), by id."""
    cur = led["m_currencies"].select(c("id").alias("currency_id"), c("name").alias("currency_name"), "display_unit")
    return (led["m_wallets"].join(cur, "currency_id")
            .select("id", "name", "currency_name", "display_unit").orderBy("id"))


def _timed_payments(led) -> DataFrame:
    tx = led["t_transactions"].select(c("id").alias("transaction_id"), "transaction_at")
    return led["t_payments"].join(tx, "transaction_id", "left")


# A-09
def balance_snapshot(payments: DataFrame) -> DataFrame:
    """Running state per balance group.

    ``payments`` needs id, wallet_id, amount, expiry_at, usage_restriction and
    ``transaction_at`` (time of the movement).  Origin = latest movement id for
    limited groups, NULL for plain money.  Movements without a wallet (paid
    by someone else) have no balance.
    """
    p = payments.filter(c("wallet_id").isNotNull())
    return (p.groupBy(*GROUP).agg(
        F.sum("amount").cast("long").alias("current_amount"),
        F.max("id").alias("__last"),
        F.max("transaction_at").alias("updated_at"))
        .select(*GROUP, F.when(is_limited(), c("__last")).alias("origin_payment_id"),
                "current_amount", "updated_at"))


def ledger_balances(led) -> DataFrame:
    return balance_snapshot(_timed_payments(led))


# A-10
def wallet_total(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("wallet_id").agg(F.sum("current_amount").cast("long").alias("total"),
                                             F.count(F.lit(1)).alias("groups"))


# J-02
def wallet_balances(led, snapshot: DataFrame | None = None) -> DataFrame:
    """Active wallets ⋈ currency ⟕ balance rows; a wallet without balance shows 0.

    One row per balance record (not per wallet), as the stored report does.
    """
    snap = ledger_balances(led) if snapshot is None else snapshot
    cur = led["m_currencies"].select(c("id").alias("currency_id"), "display_unit")
    w = led["m_wallets"].filter(c("is_active")).join(cur, "currency_id")
    j = w.join(snap.select("wallet_id", "expiry_at", "usage_restriction", "current_amount"),
               w["id"] == snap["wallet_id"], "left")
    return j.select(w["id"].alias("wallet_id"), "name", "display_unit", "expiry_at", "usage_restriction",
                    F.coalesce(c("current_amount"), F.lit(0).cast("long")).alias("total"),
                    F.concat(S.thousands(F.coalesce(c("current_amount"), F.lit(0))), c("display_unit"))
                    .alias("amount_text"))


# A-03
def limited_groups(payments: DataFrame) -> DataFrame:
    """Limited movements of each wallet grouped by (expiry, restriction).

    Members are summarised (count, first / last id), never collected into
    one array, so a hot group stays a constant-size row.
    """
    p = payments.filter(c("wallet_id").isNotNull() & is_limited())
    return p.groupBy(*GROUP).agg(
        F.sum("amount").cast("long").alias("total"),
        F.count(F.lit(1)).alias("members"),
        F.min("transaction_id").alias("first_transaction_id"),
        F.min("id").alias("first_payment_id"),
        F.max("id").alias("last_payment_id"))


def limited_members(payments: DataFrame) -> DataFrame:
    """The members of the limited groups, a row each with its group's total."""
    p = payments.filter(c("wallet_id").isNotNull() & is_limited())
    g = p.groupBy(*GROUP).agg(F.sum("amount").cast("long").alias("total")).alias("g")
    p = p.alias("p")
    same = ((c("p.wallet_id") == c("g.wallet_id")) & c("p.expiry_at").eqNullSafe(c("g.expiry_at"))
            & c("p.usage_restriction").eqNullSafe(c("g.usage_restriction")))
    return p.join(g, same).select(c("p.id").alias("payment_id"), "p.transaction_id", *[f"p.{k}" for k in GROUP], "p.amount", "g.total")


# W-05
def latest_origin(payments: DataFrame) -> DataFrame:
    """Last movement id that touched each limited group."""
    return (payments.filter(c("wallet_id").isNotNull() & is_limited())
            .groupBy(*GROUP).agg(F.max("id").alias("latest_origin_id")))


# W-01
def remaining_after_movement(payments: DataFrame, bucket_width: int = 1 << 20) -> DataFrame:
    """Balance of a limited group right after each of its movements; 0 for plain money.

    Running sum per group ordered by movement id, computed per id range and
    offset by earlier ranges, so one hot group is spread over many tasks.
    """
    p = payments.filter(c("wallet_id").isNotNull())
    lim = bucketed_running_sum(p.filter(is_limited()), GROUP, "id", "amount", "remaining_amount", bucket_width)
    plain = p.filter(~is_limited()).withColumn("remaining_amount", F.lit(0).cast("long"))
    return lim.unionByName(plain)


# J-08
def balance_attribute_match(payments: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Each movement with the balance row of its group (NULL-equal attributes)."""
    s = snapshot.alias("s")
    p = payments.filter(c("wallet_id").isNotNull()).alias("p")
    cond = ((c("p.wallet_id") == c("s.wallet_id")) & c("p.expiry_at").eqNullSafe(c("s.expiry_at"))
            & c("p.usage_restriction").eqNullSafe(c("s.usage_restriction")))
    return p.join(s, cond).select(c("p.id").alias("payment_id"), c("p.wallet_id"), c("p.expiry_at"),
                                  c("p.usage_restriction"), c("s.current_amount"), c("s.origin_payment_id"))


# W-02
def offset_limited_funds(payments: DataFrame, movements: DataFrame, cap: bool = True,
                         order: str = "first_seen", as_of=None) -> DataFrame:
    """Settle movements against opposite-sign limited lots of their wallet, in order.

    ``movements``: movement_id, transaction_id, wallet_id, amount (spend
    positive), requested_offset (NULL = default, <= 0 = no offset),
    new_expiry_text, new_restriction.  A wallet may have any number of
    movements in a batch; they are settled by movement id, each from what the
    ones before it left of the lots that stood at the batch's start.

    Lot balance = sum of the group's movements.  With ``cap`` a movement takes
    what it needs (the requested offset, else its amount); without it the
    default is all that is left (the interactive default), and a requested
    offset is taken as asked.  Movements and lots lie end to end on one line
    per wallet and sign: a movement takes from a lot where their stretches
    overlap, so the ends of both, put in order, are all that is needed (rows
    grow with movements + lots, not their product).  Running sums and
    neighbours are taken by ranges, so a wallet with very many lots or
    movements is spread over tasks.

    The remainder, if not zero, is one residual row; it becomes a new limited
    lot when the movement names an expiry or restriction.
    """
    mv = movements.select("movement_id", "transaction_id", "wallet_id",
                          (-c("amount")).cast("long").alias("move"), "requested_offset",
                          S.parse_yyyymmdd("new_expiry_text").alias("new_expiry"), "new_restriction")
    lots = limited_groups(payments)
    if as_of is not None:
        lots = lots.filter(c("expiry_at").isNull() | (c("expiry_at") >= S.ts_lit(as_of)))
    if order == "expiry":
        lot_order = [c("expiry_at").asc_nulls_last(), c("first_transaction_id"), c("usage_restriction").asc_nulls_first()]
    else:
        lot_order = [c("first_transaction_id"), c("expiry_at").asc_nulls_last(), c("usage_restriction").asc_nulls_first()]
    line = ["wallet_id", "spends"]
    lots = ranged_sums(lots.filter(c("total") != 0).withColumn("spends", c("total") > 0), line, lot_order,
                       {"lot_no": F.lit(1), "end": F.abs("total")})
    held = lots.groupBy(*line).agg(F.max("end").alias("held"))
    need = F.coalesce(c("requested_offset"), F.abs("move") if cap else c("held"))
    wants = (mv.filter(c("move") != 0).withColumn("spends", c("move") < 0).join(held, line)
             .withColumn("need", F.least(F.greatest(need, F.lit(0)), c("held")).cast("long")).filter(c("need") > 0))
    wants = ranged_sums(wants, line, [c("movement_id")], {"end": c("need")})
    ends = wants.select(*line, "end", F.struct("movement_id", "transaction_id").alias("movement"), F.lit(None).alias("lot")).unionByName(
        lots.select(*line, "end", F.lit(None).alias("movement"), F.struct("lot_no", "expiry_at", "usage_restriction", "total", "end").alias("lot")))
    # equal ends are one place: keep the movement and the lot that end there
    places = ends.groupBy(*line, "end").agg(F.max("movement").alias("movement"), F.max("lot").alias("lot"))
    cut = (ranged_neighbours(places, line, "end", ["movement", "lot"], "from").withColumn("from", F.coalesce("from", F.lit(0)))
           .filter(c("movement").isNotNull() & c("lot").isNotNull() & (c("end") > c("from"))))
    taken = F.when(c("lot.total") < 0, c("end") - c("from")).otherwise(c("from") - c("end"))
    left = F.when(c("lot.total") < 0, c("end") - c("lot.end")).otherwise(c("lot.end") - c("end"))
    offs = cut.select(
        "movement.movement_id", "movement.transaction_id", "wallet_id", F.lit("OFFSET").alias("kind"), c("lot.lot_no").cast("int").alias("lot_no"),
        "lot.expiry_at", "lot.usage_restriction", taken.cast("long").alias("amount"), left.cast("long").alias("remaining_amount"))
    used = offs.groupBy("movement_id").agg(F.sum("amount").alias("used"))
    res = (mv.join(used, "movement_id", "left")
           .withColumn("left", (c("move") - F.coalesce(c("used"), F.lit(0))).cast("long"))
           .filter(c("left") != 0))
    limited_new = c("new_expiry").isNotNull() | c("new_restriction").isNotNull()
    res = res.select(
        "movement_id", "transaction_id", "wallet_id", F.lit("RESIDUAL").alias("kind"),
        F.lit(None).cast("int").alias("lot_no"), c("new_expiry").alias("expiry_at"),
        c("new_restriction").alias("usage_restriction"), c("left").alias("amount"),
        F.when(limited_new, c("left")).otherwise(F.lit(0)).cast("long").alias("remaining_amount"))
    return offs.unionByName(res)


# R-10
def settle_payments(led, cap: bool = True) -> dict[str, DataFrame]:
    """Batch of movements -> new payment rows (offsets + residuals) -> new balance snapshot.

    New payments are numbered on from the largest id in use, by movement and
    lot (residual last).
    """
    pay = led["t_payments"]
    rows = offset_limited_funds(pay, led["raw_movements"], cap=cap)
    last = pay.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = range_numbered(rows, [c("movement_id"), c("lot_no").asc_nulls_last()], "__no")
    new_pay = numbered.select(
        (F.lit(last) + c("__no")).cast("long").alias("id"),
        "transaction_id", "wallet_id", "amount", "remaining_amount", "expiry_at", "usage_restriction")
    tx = led["t_transactions"].select(c("id").alias("transaction_id"), "transaction_at")
    all_pay = pay.unionByName(new_pay.drop("remaining_amount")).join(tx, "transaction_id", "left")
    return {"payments": new_pay, "offsets": rows, "snapshot": balance_snapshot(all_pay)}


# R-12
def expiring_funds(snapshot: DataFrame, as_of, days: int) -> DataFrame:
    """Limited balances that lapse within ``days`` of ``as_of`` or have lapsed."""
    now = S.ts_lit(as_of)
    horizon = F.timestamp_add("DAY", F.lit(days), now)
    return (snapshot.filter(c("expiry_at").isNotNull() & (c("expiry_at") < horizon) & (c("current_amount") != 0))
            .withColumn("status", F.when(c("expiry_at") <= now, "LAPSED").otherwise("EXPIRING")))


# J-11 ---------------------------------------------------------------------
def rate_intervals(rates: DataFrame) -> DataFrame:
    """Validity ``[valid_from, valid_to)`` of each rate; equal instants: highest id wins.

    The window runs over the rate history (one partition per currency), a
    dimension-sized table.
    """
    w = Window.partitionBy("currency_id").orderBy("effective_at", "id")
    return rates.select("currency_id", c("id").alias("rate_id"), "rate_to_jpy",
                        c("effective_at").alias("valid_from"),
                        F.lead("effective_at").over(w).alias("valid_to"))


def rate_as_of(facts: DataFrame, rates: DataFrame, time_col: str, currency_col: str = "currency_id") -> DataFrame:
    """As-of join: each fact gets the latest rate of its currency with effective_at <= time.

    Closed intervals are exploded into the days they touch and joined on
    (currency, day) plus the exact bounds — an equi-join that spreads over
    many keys.  The still-open last interval of each currency (one row per
    currency) is joined by currency; Spark broadcasts it by its size.  Facts
    before the first rate get NULL.
    """
    iv = rate_intervals(rates)
    days = (iv.filter(c("valid_to").isNotNull())
            .select("*", F.explode(F.sequence(F.to_date("valid_from"), F.to_date("valid_to"))).alias("__day")))
    f = facts.withColumn("__day", F.to_date(time_col))
    cd = days.select(c("currency_id").alias("__cc"), c("__day").alias("__dd"), c("rate_id").alias("__rid_c"),
                     c("rate_to_jpy").alias("__rate_c"), c("valid_from").alias("__from_c"), c("valid_to").alias("__to_c"))
    f = f.join(cd, (f[currency_col] == cd["__cc"]) & (f["__day"] == cd["__dd"])
               & (f[time_col] >= cd["__from_c"]) & (f[time_col] < cd["__to_c"]), "left")
    op = (iv.filter(c("valid_to").isNull())
          .select(c("currency_id").alias("__co"), c("rate_id").alias("__rid_o"), c("rate_to_jpy").alias("__rate_o"),
                  c("valid_from").alias("__from_o")))
    f = f.join(op, (f[currency_col] == op["__co"]) & (f[time_col] >= op["__from_o"]), "left")
    return (f.withColumn("rate_id", F.coalesce("__rid_c", "__rid_o"))
            .withColumn("rate_to_jpy", F.coalesce("__rate_c", "__rate_o"))
            .drop("__day", "__cc", "__dd", "__rid_c", "__rate_c", "__from_c", "__to_c",
                  "__co", "__rid_o", "__rate_o", "__from_o"))


def payment_rates(led) -> DataFrame:
    """Each payment of a wallet with a currency, valued at its transaction time."""
    w = led["m_wallets"].select(c("id").alias("wallet_id"), "currency_id")
    p = _timed_payments(led).join(w, "wallet_id").select("id", "wallet_id", "currency_id", "amount", "transaction_at")
    out = rate_as_of(p, led["t_currency_rates"], "transaction_at")
    return out.withColumn("value_jpy", c("amount") * c("rate_to_jpy"))


# A-12
def wallet_value_jpy(led, as_of) -> DataFrame:
    """Wallet totals valued in yen at ``as_of`` (latest rate <= as_of per currency)."""
    r = (led["t_currency_rates"].filter(c("effective_at") <= S.ts_lit(as_of))
         .groupBy("currency_id").agg(F.max_by("rate_to_jpy", F.struct("effective_at", "id")).alias("rate_to_jpy")))
    tot = wallet_total(ledger_balances(led))
    w = led["m_wallets"].select(c("id").alias("wallet_id"), "currency_id")
    return (tot.join(w, "wallet_id").join(r, "currency_id", "left")
            .select("wallet_id", "currency_id", "total", "rate_to_jpy",
                    (c("total") * c("rate_to_jpy")).alias("value_jpy")))


# J-12
def currency_successor(currencies: DataFrame, as_of) -> DataFrame:
    """Follow successor links from each currency to the one valid at ``as_of``.

    Links are doubled: after k joins every currency has moved up to 2^k hops,
    so log2 of the master's size settles all chains (its count is the one
    action).  What has then made more hops than there are currencies runs in a
    cycle: ``valid_currency_id`` and ``hops`` are NULL.
    """
    now = S.ts_lit(as_of)
    moves = c("end_at").isNotNull() & (c("end_at") <= now) & c("successor_id").isNotNull()
    cur = currencies.select(c("id").alias("currency_id"), F.when(moves, c("successor_id")).otherwise(c("id")).alias("at"),
                            moves.cast("long").alias("hops"))
    total = max(1, currencies.count())
    for _ in range(total.bit_length()):
        on = cur.select(c("currency_id").alias("__from"), c("at").alias("__to"), c("hops").alias("__more"))
        cur = cur.join(on, c("at") == c("__from"), "left").select(
            "currency_id", F.coalesce("__to", "at").alias("at"), (c("hops") + F.coalesce("__more", F.lit(0))).alias("hops"))
    ends = c("hops") < total
    return cur.select("currency_id", F.when(ends, c("at")).alias("valid_currency_id"), F.when(ends, c("hops")).alias("hops"))
