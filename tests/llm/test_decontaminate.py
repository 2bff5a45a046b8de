"""Decontamination against a plain search for every window."""

import pickle
import random

from valueflow.llm import decontaminate as D
from valueflow.llm.common import words


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for at in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[at : at + 13]), set()).add("" if item is None else str(item))
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for win, owners in windows.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    found |= owners
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_equals_plain_search(spark):
    rng = random.Random(2)
    vocabulary = ["a", "b", "c", "Été", "x1", "long"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 8, 13, 14, 20, 40]))) for i in range(25)]
    items += [(3, "entirely new words"), (90, None), (91, ""), (92, "!!!"), (None, "no id here at all"), (93, items[5][1]), (94, "very " * 30)]
    docs = []
    for _ in range(60):
        inside = rng.choice(items)[1] or ""
        docs.append(rng.choice([text(30), text(5) + " , " + inside.upper() + "\n" + text(9), inside, text(200) + " " + inside]))
    docs += [None, "", "...", "no id here at all", "very " * 2000, docs[0]]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(docs)], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    want = plain(docs, items)
    for limit in (D.INDEX_BYTES, 300):  # one group of items, and several
        got = {r["doc_id"]: r["_bench"] for r in D.find_windows(df, bench, index_bytes=limit).collect()}
        for i, w in enumerate(want):
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == w, i
            assert sum(h["end"] - h["start"] for h in got[i]["hits"]) == w[1]
    assert D.find_windows(df.limit(0), bench).count() == 0
    clean = D.find_windows(df, bench.limit(0)).filter(D.is_contaminated(D.F.col("_bench"))).count()
    assert clean == 0


def test_share_of_words(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = [(1, "one two three " + "z " * 57), (2, "one two three " + "z " * 58)]
    df = D.find_windows(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert [r[0] for r in df.filter(D.is_contaminated(D.F.col("_bench"))).select("doc_id").collect()] == [1]


def test_broadcasts_are_bounded_as_built(spark, monkeypatch):
    """One long item, one item many times, one window of many items: no broadcast outgrows the bound."""
    rng = random.Random(5)
    long_item = " ".join(f"w{rng.randrange(3000)}" for _ in range(4000))
    shared = " ".join(f"common{i}" for i in range(13))
    items = [(1, long_item)] * 20 + [(i, shared) for i in range(100, 2100)]
    docs = ["x " + " ".join(long_item.split()[700:760]) + " y", shared, long_item]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    sizes, plain_broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: (sizes.append(len(pickle.dumps(v))), plain_broadcast(v))[1])
    limit = 200_000
    got = {r["doc_id"]: r["_bench"] for r in D.find_windows(df, spark.createDataFrame(items, "item_id long, text string"), index_bytes=limit).collect()}
    assert len(sizes) > 2 and max(sizes) <= 1.25 * limit, sizes
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) for i in (0, 2)] == [(62, 60, ["1"]), (4000, 4000, ["1"])]
    assert got[1]["n_hit"] == 13 and got[1]["items"] == sorted(str(i) for i in range(100, 2100))


def test_words_longer_than_a_hashed_piece():
    texts = [b"", b"a " + b"b" * (2 * D._PIECE) + b" c", b"c A", b"..."]
    found = D.Words(texts)
    assert found.bounds.tolist() == [0, 0, 3, 5, 5]
    assert found.hashes[0] == found.hashes[4] and found.hashes[2] == found.hashes[3] and len(set(found.hashes.tolist())) == 3
