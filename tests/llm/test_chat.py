"""Chat trees: exact round trip, shared turns once, packs within bounds."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from valueflow.llm import chat

TRICKY = st.lists(st.sampled_from(["\\", "###", "#", "</turn>", " </turn>\n", ":", ": ", " ", "\n", "a", "é😀", "### user: "]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), min_size=1, max_size=4))
def test_round_trip(turns):
    pack = chat._Pack()
    pack.add("p", [{"role": r, "text": t} for r, t in turns], 0)
    formatted, _ = chat.leaf_text(pack.row(), pack.leaves[0]["segment"])
    assert chat.read_turns(formatted) == turns
    assert chat.unescape(chat.escape(turns[0][1])) == turns[0][1]


def digest(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def rows_of(conversations):
    return [(c, i, r, t, "x") for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]


def test_trees(spark):
    first = ("user", "the same first turn for all")
    conversations = {i: [first, ("assistant", f"answer {i % 4}"), ("user", "go on"), ("assistant", f"more {i}" * (i % 3))] for i in range(60)}
    conversations |= {100 + i: [first, ("assistant", "answer 1")] for i in range(20)}  # equal, and a prefix of others
    conversations |= {200: [("system", ""), ("assistant", "\\### Assistant: </turn> ok")], 201: [("assistant", "w" * 5000)], 202: [first]}
    df = spark.createDataFrame(rows_of(conversations), "conv_id long, turn long, role string, text string, path string")
    for limit in (chat.PACK_CHARS, 600):
        packs, members = chat.format_conversations(df, limit)
        got = {r["conv_id"]: r for r in members.join(chat.read_back(packs), "path_id").collect()}
        assert set(got) == set(conversations)
        for c, turns in conversations.items():
            assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == digest(turns)
        for p in packs.collect():
            assert len(p["text"]) <= max(limit + 300, 5300)
            assert len({(s["start"], s["end"]) for s in p["segments"]}) == len(p["segments"])
            for s in p["segments"]:
                assert s["position"] == sum(x["end"] - x["start"] for x in s["attends"])
    whole = chat.pack_trees(chat.conversations_in_order(df).coalesce(1)).coalesce(1)
    assert whole.count() >= 1


def test_shared_turns_are_emitted_once():
    pack = chat._Pack()
    a, b, c = {"role": "user", "text": "q"}, {"role": "assistant", "text": "one"}, {"role": "assistant", "text": "two"}
    pack.add("1", [a, b], 0)
    pack.add("2", [a, c], 1)
    assert pack.row()["text"] == "### user: q </turn>\n### assistant: one </turn>\n### assistant: two </turn>\n"
    first, one, two = pack.segments
    assert one["attends"] == two["attends"] == [{"start": 0, "end": first["end"]}]
    assert one["position"] == two["position"] == first["end"]
    assert chat.leaf_text(pack.row(), 2) == ("### user: q </turn>\n### assistant: two </turn>\n", "two")


def test_cases(spark):
    rows = [(1, 1, None, None, "x"), (1, 0, "user", "hi", "x"), (None, 0, "user", "lost", "x"), (2, 0, "user", "b", "x"), (2, 0, "user", "a", "x"), (2, None, "user", "z", "x"), (2, 0, "user", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    packs, members = chat.format_conversations(df)
    got = {r["conv_id"]: r["turns_sha256"] for r in members.join(chat.read_back(packs), "path_id").collect()}
    want = {1: [("user", "hi"), ("", "")], None: [("user", "lost")], 2: [("user", "z"), ("user", "a"), ("user", "a"), ("user", "b")]}
    assert got == {c: digest(t)[1] for c, t in want.items()}
    packs, members = chat.format_conversations(df.limit(0))
    assert packs.count() == 0 and members.count() == 0
