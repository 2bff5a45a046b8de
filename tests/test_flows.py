"""Settlement, ingest, matching, successor, update, fold and stream rules on small rows (values are ours)."""

import datetime as dt
import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from valueflow.operators import matching as Z
from valueflow.operators import money as M
from valueflow.operators import stock as K
from valueflow.session import ensure_checkpoint_dir
from valueflow.sources import ingest as I
from valueflow.streaming import streams as ST

NOON = dt.datetime(2024, 1, 1, 12)
MOVES = "movement_id long, transaction_id long, wallet_id long, amount long, requested_offset long, new_expiry_text string, new_restriction string"
PAYS = "id long, transaction_id long, wallet_id long, amount long, expiry_at timestamp_ntz, usage_restriction string"


def settle(moves, lots, cap):
    """Plain twin: movements in order, each takes from the lots in order what is still there."""
    left = {k: list(v) for k, v in lots.items()}
    out = {}
    for mid, wallet, amount, asked in moves:
        need = asked if asked is not None else (amount if cap else 10**12)
        for i, size in enumerate(left.get(wallet, [])):
            take = min(size, max(need, 0))
            if take:
                out[mid, i + 1] = take
                left[wallet][i] -= take
                need -= take
    return out


@pytest.mark.parametrize("cap", [True, False])
def test_several_movements_never_spend_a_lot_twice(spark, cap):
    rng = random.Random(4)
    lots = {w: [rng.randint(1, 300) for _ in range(rng.randint(0, 5))] for w in range(8)}
    moves = [(100 + i, rng.randrange(9), rng.randint(0, 400), rng.choice([None, None, -1, 0, 50, 1000])) for i in range(40)]
    pay = [(w * 10 + i, w * 10 + i, w, size, NOON, f"R{i}") for w, v in lots.items() for i, size in enumerate(v)]
    got = M.offset_limited_funds(spark.createDataFrame(pay, PAYS), spark.createDataFrame([(m, m, w, a, r, None, None) for m, w, a, r in moves], MOVES), cap=cap).collect()
    offs = {(r["movement_id"], r["lot_no"]): -r["amount"] for r in got if r["kind"] == "OFFSET"}
    assert offs == settle(moves, lots, cap)
    assert all(r["remaining_amount"] >= 0 for r in got if r["kind"] == "OFFSET")
    for m, w, amount, _ in moves:  # offsets and residual make up the movement
        assert sum(r["amount"] for r in got if r["movement_id"] == m) == -amount


def test_a_hot_wallet_is_settled_by_ranges(spark):
    """No window over a whole wallet: same offsets as the plain twin with the wallet's rows in many ranges."""
    rng = random.Random(14)
    lots = {1: [rng.randint(1, 40) for _ in range(500)], 2: [7, 9]}
    moves = [(1000 + i, 1 if i % 20 else 2, rng.randint(1, 30), rng.choice([None, None, 5, 0])) for i in range(700)]
    pay = [(w * 1000 + i, w * 1000 + i, w, size, NOON, f"R{i}") for w, v in lots.items() for i, size in enumerate(v)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = M.offset_limited_funds(spark.createDataFrame(pay, PAYS), spark.createDataFrame([(m, m, w, a, r, None, None) for m, w, a, r in moves], MOVES))
    offs = {(r["movement_id"], r["lot_no"]): -r["amount"] for r in found.collect() if r["kind"] == "OFFSET"}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert offs == settle(moves, lots, True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.splitlines() if "windowspecdefinition(wallet_id" in line and "__range" not in line]
    assert not whole


def test_listing_numbers_a_busy_day_by_ranges(spark):
    from valueflow.operators import goods as G

    rows = [(i, NOON if i % 2 else NOON + dt.timedelta(days=i % 40), i % 3) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, transaction_at timestamp_ntz, month long")
    newest = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)
    assert {r["id"]: r["position"] for r in G.list_numbering(df).collect()} == {r[0]: i + 1 for i, r in enumerate(newest)}
    want = {r[0]: i + 1 for m in range(3) for i, r in enumerate(x for x in newest if x[2] == m)}
    assert {r["id"]: r["position"] for r in G.list_numbering(df, ["month"]).collect()} == want


def test_successor_marks_cycles(spark):
    old = dt.datetime(2000, 1, 1)
    rows = [(1, old, 2), (2, old, 1), (3, old, 4), (4, old, 5), (5, old, 6), (6, None, None), (7, old, 3), (8, old, None), (9, dt.datetime(2100, 1, 1), 6), (10, old, 1)]
    df = spark.createDataFrame(rows, "id long, end_at timestamp_ntz, successor_id long")
    got = {r["currency_id"]: (r["valid_currency_id"], r["hops"]) for r in M.currency_successor(df, "2020-01-01 00:00:00").collect()}
    assert got == {1: (None, None), 2: (None, None), 10: (None, None), 3: (6, 3), 4: (6, 2), 5: (6, 1), 6: (6, 0), 7: (6, 4), 8: (8, 0), 9: (9, 0)}


def raw(**given):
    row = {"receipt_id": 1, "at_text": "20240102", "public_text": "y", "brand_text": "B", "branch_text": "S", "line_no": 1, "item_text": "x", "kind_text": "u",
           "price_text": "100", "qty_text": "1", "tax_text": "", "discount_text": "", "dest_text": "2", "limit_text": "20240301", "limit_kind_text": "1"}
    return row | given


def test_every_field_has_its_reject_reason(spark):
    rows = [raw(line_no=1), raw(line_no=2, at_text="202613011200"), raw(line_no=3, price_text="1x"), raw(line_no=4, qty_text="-1"), raw(line_no=5, qty_text="two"),
            raw(line_no=6, tax_text="abc"), raw(line_no=7, discount_text="zz"), raw(line_no=8, at_text=""), raw(line_no=9, limit_text="20011340"), raw(line_no=10, tax_text="0")]
    out = I.ingest_receipts(spark.createDataFrame(rows), NOON)
    assert {r["line_no"]: r["reject_reason"] for r in out["rejects"].collect()} == {
        2: "BAD_TIME", 3: "BAD_PRICE", 4: "BAD_QUANTITY", 5: "BAD_QUANTITY", 6: "BAD_TAX", 7: "BAD_DISCOUNT"}
    lines = {r["line_no"]: r for r in out["lines"].collect()}
    assert lines[1]["tax_rate"] == 0.08 and lines[10]["tax_rate"] == 0.0
    assert lines[8]["transaction_at"] == NOON
    assert lines[9]["limit_date"] is None and lines[9]["limit_type"] is None and lines[1]["limit_type"] == "CONSUMPTION"


@pytest.fixture()
def shops(spark, ledger):
    ledger["m_brands"] = spark.createDataFrame([(5, "B"), (3, "B"), (7, "C")], "id long, name string")
    ledger["m_store_branches"] = spark.createDataFrame([(9, 3, "S"), (8, 3, "S"), (6, 7, "T")], "id long, brand_id long, branch_name string")
    ledger["m_foods"] = spark.createDataFrame([(1, "x", "UNIVERSAL")], "id long, name string, food_kind string")
    ledger["t_transaction_details"] = spark.createDataFrame([(41,)], "id long")
    return ledger


def test_first_match_and_new_branches(spark, shops):
    rows = [raw(), raw(line_no=2, brand_text="New", branch_text="S"), raw(line_no=3, branch_text="T"), raw(line_no=4, brand_text="", branch_text="S")]
    lines = I.ingest_receipts(spark.createDataFrame(rows), NOON)["lines"]
    got = {r["line_no"]: (r["brand_id"], r["branch_id"]) for r in Z.existing_entity_match(lines, shops).collect()}
    assert got == {1: (3, 8), 2: (None, None), 3: (3, None), 4: (None, None)}
    new = {tuple(r) for r in Z.new_entities(lines, shops).collect()}
    assert new == {("BRAND", None, "New"), ("BRANCH", "new:New", "S"), ("BRANCH", "3", "T")}


def test_details_are_numbered_without_collisions(spark, shops):
    rows = [raw(receipt_id=r, line_no=n) for r in (1, 2, 1 << 20) for n in (1, 1, 100, 200)]
    out = I.record_purchases(spark.createDataFrame(rows), shops, NOON)
    ids = [r["id"] for r in out["details"].collect()]
    assert sorted(ids) == list(range(42, 42 + len(rows)))
    assert {r["detail_id"] for r in out["lots"].collect()} == set(ids)


def test_a_batch_is_appended_once(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3) for i in range(300)], "id long, month long").repartition(8)
    path = str(tmp_path / "facts")
    assert I.append_facts(df.filter("id < 200"), path, "a", ["month"]) and I.append_facts(df.filter("id >= 200"), path, "b", ["month"])
    assert not I.append_facts(df.filter("id < 200"), path, "a", ["month"])
    (tmp_path / "facts" / "_aside" / "c-1").mkdir(parents=True)  # a batch that failed half way
    got = I.read_facts(spark, path, df.schema)
    assert sorted(r["id"] for r in got.collect()) == list(range(300)) and got.columns == ["id", "month"]
    assert all(len(list(d.glob("*.parquet"))) <= 2 for d in (tmp_path / "facts" / "batch=a").glob("month=*"))


def test_updates_and_missing_columns(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "c", 3)], "id long, name string, n long")
    updates = spark.createDataFrame([(2, "x", 9, 1), (2, "y", 8, 3), (2, "z", 7, 2), (4, "new", 4, 1), (3, None, 5, 1)], "id long, name string, n long, seq long")
    got = sorted(tuple(r) for r in I.apply_updates(base, updates, "id").collect())
    assert got == [(1, "a", 1), (2, "y", 8), (3, None, 5), (4, "new", 4)]
    assert I.add_missing_column(base, "name", "?").filter("name is null").count() == 1
    assert I.add_missing_column(base, "kind", "?").filter("kind = '?'").count() == 3


def by_row(amounts, left):
    out = []
    for a in amounts:
        ok = a == a and 0 <= a <= left
        left = left - a if ok else left
        out.append((ok, left))
    return out


def test_fold_in_steps_equals_row_by_row():
    rng = random.Random(1)
    for n in (0, 1, 5, 63, 64, 65, 200, 1500):
        for scale in (0.001, 0.1, 5.0):
            amounts = [rng.choice([rng.random() * scale, rng.random() * 0.01, float("nan"), -1.0, 0.0]) if rng.random() < 0.5 else rng.random() * scale for _ in range(n)]
            accepted, after = K._accepted(np.array(amounts, dtype=float), 10.0)
            assert list(zip(accepted.tolist(), after.tolist())) == by_row(amounts, 10.0)


REQUESTS = "request_id long, inventory_id long, meal_id long, amount double, consume_type string, requested_at timestamp_ntz, seq long"
LOTS = "id long, detail_id long, current_quantity double, updated_at timestamp_ntz"
BIG = 2**53 + 1  # the first integer that a double cannot hold


def consumption_case():
    """Three lots with ids beyond 2^53, requests of unknown lots and of no lot between them."""
    rng = random.Random(8)
    lots = [(BIG + i, BIG + 100 + i, q, NOON) for i, q in enumerate((40.0, 7.3, 0.0))]
    ids = [lot[0] for lot in lots] + [5, None]
    amount = lambda: rng.choice([rng.random(), rng.random() * 9, None, -1.0, 0.0])
    requests = [(BIG + 1000 + i, ids[0] if rng.random() < 0.6 else rng.choice(ids), BIG + i % 7, amount(), "SELF", NOON, i // 3) for i in range(600)]
    decided, left = {}, {lot[0]: lot[2] for lot in lots}
    for r in sorted(requests, key=lambda r: (r[6], r[0])):
        if r[1] not in left:
            decided[r[0]] = (r[1], None, False, "NO_LOT", None)
            continue
        (ok, left[r[1]]), = by_row([float("nan") if r[3] is None else r[3]], left[r[1]])
        reason = None if ok else "INVALID_AMOUNT" if r[3] is None or r[3] < 0 else "OVERDRAW"
        decided[r[0]] = (r[1], r[1] + 100, ok, reason, left[r[1]])
    return lots, requests, decided


def found_decisions(df):
    return {r["request_id"]: (r["inventory_id"], r["detail_id"], r["accepted"], r["reason"], r["remaining_after"]) for r in df.collect()}


@pytest.mark.parametrize("hot", [10**6, 50])
def test_fold_keeps_ids_and_splits_hot_lots(spark, hot):
    lots, requests, want = consumption_case()
    df = spark.createDataFrame(requests, REQUESTS).repartition(5)
    got = K.greedy_consumption(df, spark.createDataFrame(lots, LOTS), hot=hot, piece_bits=3)
    assert found_decisions(got) == want
    assert sorted(K.hot_lots(df, 50)) == sorted({i for i in {r[1] for r in requests} - {None} if sum(r[1] == i for r in requests) > 50})
    if hot == 50:  # the hot lot's rows are folded by (lot, piece), only packs by lot
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert got.withColumn("task", F.spark_partition_id()).filter(F.col("inventory_id") == BIG).select("task").distinct().count() > 1
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_range_folds_only_its_lots(spark, ledger):
    day = lambda n: NOON + dt.timedelta(days=n)
    ledger["t_inventory"] = spark.createDataFrame([(i, 100 + i, 10.0, NOON) for i in range(5)], LOTS)
    # lot 0: used up before the range; lot 1: asked in it; lot 2: by a meal that began before it; lots 3 and 4: never in it
    asked = [(1, 0, 1, 9.0, 0), (2, 0, 2, 5.0, 10), (3, 1, 1, 4.0, 0), (4, 1, 2, 6.0, 10), (5, 2, 3, 1.0, 9), (6, 2, 3, 1.0, 10), (7, 3, 4, 2.0, 0), (8, 4, 5, 2.0, 20)]
    ledger["consume_requests"] = spark.createDataFrame([(r, lot, meal, a, "SELF", day(n), r) for r, lot, meal, a, n in asked], REQUESTS)
    items, meals = K.consumption_between(ledger, lambda ts: F.col(ts).between(day(10), day(12)))
    found = items.join(meals, "meal_id").select("id", "amount_consumed").collect()
    assert sorted(map(tuple, found)) == [(4, 6.0)]  # 2 exceeds what 1 left; 5 and 6 belong to a meal of day 9
    assert {r["inventory_id"] for r in items.select("inventory_id").distinct().collect()} == {0, 1}


def test_stream_answers_unknown_lots(spark, tmp_path):
    lots, requests, want = consumption_case()
    lot = {x[0]: (x[1], x[2]) for x in lots}
    rows = [(r[0], r[1], r[2], lot.get(r[1], (None, None))[0], *r[3:], lot.get(r[1], (None, None))[1]) for r in requests]
    df = spark.createDataFrame(rows, "request_id long, inventory_id long, meal_id long, detail_id long, amount double, consume_type string, requested_at timestamp_ntz, seq long, lot_quantity double")
    source = str(tmp_path / "in")
    ST.write_waves(df, source, [F.col("seq") < 90, F.col("seq") >= 90], "inventory_id")
    assert found_decisions(ST.stream_consumption(spark, source, df.schema, str(tmp_path / "out"), str(tmp_path / "check"), files_per_trigger=4)) == want


def test_candidate_pairs_lose_nothing(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abcdeXYZ 0", k=rng.randint(1, 14))) for _ in range(60)]
    queries = [n[: rng.randint(1, len(n))] + rng.choice(["", "q", n[::-1]]) for n in names[:40]]
    df = lambda col, v: spark.createDataFrame([(x,) for x in v], f"{col} string")
    got = {(r["query"], r["name"]) for r in Z.candidate_pairs(df("query", queries), df("name", names)).collect()}
    for q in set(queries):
        for n in set(names):
            m = difflib.SequenceMatcher(None, n, q)
            assert m.ratio() < Z.CUTOFF or (q, n) in got, (q, n)


@pytest.mark.parametrize("few", [Z.FEW_PAIRS, 0])
def test_top_three_equal_full_scoring(spark, monkeypatch, few):
    """All stages, or the last alone: the same places as scoring every pair, at a small part of the scorings."""
    monkeypatch.setattr(Z, "FEW_PAIRS", few)
    rng = random.Random(12)
    words = ["cold", "small", "blue", "widget", "ring", "plate", "bolt", "Brand"]
    names = [f"{rng.choice(words)} {rng.choice(words)} #{rng.randrange(30)}" for _ in range(220)]
    masters = [(i, n, ("A", "B")[i % 2]) for i, n in enumerate(names)] + [(900, names[0], "A"), (901, "zz", "B")]
    typo = lambda n: n[:2] + n[3:] if len(n) % 2 else n[1::-1] + n[2:]
    queries = [typo(n) for n in names[:40]] + [n.upper() for n in names[40:50]] + names[50:60] + ["", "qqq", "zzz", "#1"]
    df = spark.createDataFrame([(q,) for q in queries], "query string")
    seen = []
    keep = Z.stored
    monkeypatch.setattr(Z, "stored", lambda t, name: (seen.append((name, keep(t, name))), seen[-1][1])[1])
    got = {}
    for r in Z.top_candidates(df, spark.createDataFrame(masters, "id long, name string, kind string")).collect():
        got.setdefault((r["query"], r["kind"]), []).append((r["rank"], r["name"], r["score"], r["slots"]))
    total = 0
    for q in {q for q in queries if q}:
        for kind in "AB":
            held = [m[1] for m in masters if m[2] == kind]
            want = difflib.get_close_matches(q, held, n=3, cutoff=0.4)
            total += len(held)
            assert [n for _, n, _, slots in sorted(got.get((q, kind), [])) for _ in range(slots)] == want, (q, kind)
    if not few:
        scored = sum(t.agg(F.sum("scored")).first()[0] or 0 for name, t in seen if name == "match-places")
        assert 0 < scored < 0.25 * total


def receipts_of(spark, texts):
    return spark.createDataFrame([raw(receipt_id=i, line_no=1, brand_text=b, branch_text=s, item_text=item, kind_text=kind) for i, (b, s, item, kind) in enumerate(texts)])


def test_purchases_bind_and_register(spark, ledger):
    """Exact, then fuzzy, then new ids; new branches under new brands; nothing named stays without an id."""
    ledger["m_brands"] = spark.createDataFrame([(3, "Corner Shop"), (9, "Market")], "id long, name string")
    ledger["m_store_branches"] = spark.createDataFrame([(1, 3, "North"), (2, 9, "North")], "id long, brand_id long, branch_name string")
    ledger["m_foods"] = spark.createDataFrame([(4, "rice", "UNIVERSAL"), (5, "rice", "PROCESSED"), (8, "green tea", "PROCESSED")], "id long, name string, food_kind string")
    ledger["t_transaction_details"] = spark.createDataFrame([(70,)], "id long")
    texts = [("Corner Shop", "North", "rice", "u"), ("Corner Shp", "Nrth", "rize", "p"), ("Zyx", "North", "green tea", "o"), ("Zyx", None, "kumquat", "m"),
             ("Abc", "West", "kumquat", "u"), ("Market", "Qqq", "x", "a"), ("", "North", " ", "u"), (None, None, "kumquat", "m")]
    out = I.record_purchases(receipts_of(spark, texts), ledger, NOON)
    rows = lambda name, *cols: sorted(tuple(r) for r in out[name].select(*cols).collect())
    assert rows("m_brands", "id", "name") == [(10, "Abc"), (11, "Zyx")]
    assert rows("m_store_branches", "id", "brand_id", "branch_name") == [(3, 9, "Qqq"), (4, 10, "West"), (5, 11, "North")]
    assert rows("m_foods", "id", "name", "food_kind") == [(9, "kumquat", "MEASURED"), (10, "kumquat", "UNIVERSAL")]
    assert rows("transactions", "receipt_id", "brand_id", "branch_id") == [
        (0, 3, 1), (1, 3, 1), (2, 11, 5), (3, 11, None), (4, 10, 4), (5, 9, 3), (6, None, None), (7, None, None)]
    assert [(i, t, f) for i, t, f in rows("details", "id", "transaction_id", "food_id")] == [
        (71, 0, 4), (72, 1, 5), (73, 2, 8), (74, 3, 9), (75, 4, 10), (76, 5, None), (77, 6, None), (78, 7, 9)]
    again = I.record_purchases(receipts_of(spark, texts[:1]), ledger, NOON)
    assert again["m_brands"].count() == again["m_store_branches"].count() == again["m_foods"].count() == 0


def test_positions_over_ranges(spark):
    from valueflow.operators.windows import range_numbered

    rows = [(i % 5, i) for i in range(1000)] + [(3, None)] * 7
    got = range_numbered(spark.createDataFrame(rows, "a long, b long"), [F.col("a"), F.col("b").asc_nulls_first()], "no").collect()
    assert sorted(r["no"] for r in got) == list(range(1, 1008))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["no"])] == sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    assert range_numbered(spark.createDataFrame([], "a long"), [F.col("a")], "no").count() == 0


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = [(i, i % 3, 10 * (i + 1), None, "R" if i % 2 else None, NOON) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, wallet_id long, amount long, expiry_at timestamp_ntz, usage_restriction string, transaction_at timestamp_ntz")
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    ST.write_waves(df, source, [F.col("id") < 5])
    first = ST.stream_balances(spark, source, df.schema, sink, check)
    assert first.agg(F.sum("current_amount")).first()[0] == sum(10 * (i + 1) for i in range(5))
    ST.write_waves(df, source, [F.col("id") >= 5])
    again = ST.stream_balances(spark, source, df.schema, sink, check)
    want = {(r["wallet_id"], r["usage_restriction"]): r["t"] for r in df.groupBy("wallet_id", "usage_restriction").agg(F.sum("amount").alias("t")).collect()}
    assert {(r["wallet_id"], r["usage_restriction"]): r["current_amount"] for r in again.collect()} == want


def test_a_sink_stays_small_and_replays_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "COMPACT", 4)
    sink = str(tmp_path / "sink")
    merge = ST._epoch_sink(sink, ["a", "b"])
    batch = lambda e: spark.createDataFrame([(e % 3, None if e % 2 else "x", 10 * e), (9, "y", e)], "a long, b string, v long")
    want = {}
    for e in range(10):
        merge(batch(e), e)
        want.update({(r["a"], r["b"]): r["v"] for r in batch(e).collect()})
    schema = batch(0).schema
    found = lambda: {(r["a"], r["b"]): r["v"] for r in ST._latest(spark, sink, ["a", "b"], schema).collect()}
    assert found() == want and ST._folders(spark, sink) == ([7], [8, 9])
    merge(batch(9), 9), merge(batch(7), 7)  # the last epoch again; one that a snapshot covers again
    assert found() == want and ST._folders(spark, sink)[0] == [7]
    (tmp_path / "sink" / "snapshot=11").mkdir()  # a merge that failed half way
    assert found() == want
    assert ST._latest(spark, str(tmp_path / "none"), ["a"], schema).count() == 0


def test_checkpoint_folder_comes_from_the_session(spark):
    assert ensure_checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
