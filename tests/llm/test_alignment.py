"""Token alignment against the plain tokenizers and sets of ends."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from valueflow.llm import alignment as L
from valueflow.llm.queries import TOKENIZERS

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
TEXTS = ["Hello world, this is a test.", "  two  blanks \n\n tab\t end ", "", None, "naïve café 日本語 ﬁ 🙂 ẞ", "<s> [INST] </s> <|endoftext|> don't we'll",
         "a▁b literal mark", "x" * 300, " ", "  odd​spaces", "1234567890 3.14 1e-9", "Hello world, this is a test.", "\x00 control \x7f", "'s 't 're"]


def plain(texts):
    """(n_a, n_b, groups, links) of each text, by the tokenizers' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(A)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=B)
    chars = {c: b for c, b in L._byte_of_char().items()}
    out = []
    for text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_raw = [bytes(chars[c] for c in a_model.id_to_token(i)) for i in a]
        b_raw = [bytes([int(p[3:-1], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
        if not text or b"".join(a_raw) != (" " + text).encode() or b"".join(b_raw) != (" " + text).encode():
            out.append((0, 0, "", []))
            continue
        ends = lambda raw: [sum(map(len, raw[: i + 1])) for i in range(len(raw))]
        a_ends, b_ends = ends(a_raw), ends(b_raw)
        groups, lo = [], 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            side = lambda ids, at: ",".join(str(i) for i, e in zip(ids, at) if lo < e <= cut)  # noqa: E731, B023
            groups.append(side(a, a_ends) + "|" + side(b, b_ends))
            lo = cut
        out.append((len(a), len(b), ";".join(groups), [(i, j) for i, e in zip(a, a_ends) for j, f in zip(b, b_ends) if e == f]))
    return out


def test_equals_plain_alignment(spark):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choices("ab é,.\n1'日 ", k=rng.randrange(400))) for _ in range(60)]
    want = plain(texts)
    counts = Counter(link for *_, links in want for link in links)
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, pairs string").repartition(3)
    aligned = L.align(df, A, B).cache()
    found = {r["doc_id"]: r for r in L.weighed(aligned, L.pair_counts(aligned), L.max_pairs(A, B)).collect()}
    for i, (n_a, n_b, groups, links) in enumerate(want):
        got = found[i]["_align"]
        assert (got["n_a"], got["n_b"], got["groups"], got["n_links"]) == (n_a, n_b, groups, len(links)), texts[i]
        assert got["n_groups"] == (groups.count(";") + 1 if groups else 0)
        assert got["n_best"] == sum(counts[x] == top[x[1]] for x in links) and got["count_sum"] == sum(counts[x] for x in links)
        assert Counter({divmod(p, 2**32): t for p, t in zip(got["pairs"], got["times"])}) == Counter(links)
        assert found[i]["pairs"] == "p"
    assert len(counts) <= L.max_pairs(A, B)


def test_segments_change_nothing(spark):
    text = " ".join(random.Random(1).choices(["word", "  ", "日本", "x\n", "don't", "1,000"], k=3000))
    df = spark.createDataFrame([(1, text), (2, "z" * 5000 + " y")], "doc_id long, text string")
    whole = L.align(df, A, B).select("_align").collect()
    assert whole == L.align(df, A, B, segment=64).select("_align").collect()
    assert len(L.segments(text, True, 64)) > 50 and "".join(L.segments(text, True, 64)) == " " + text
    assert [x[2] for x in plain([text])] == [whole[0][0]["groups"]]


def test_empty_table_and_bytes_that_are_no_text(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = L.align(docs.limit(0), A, B)
    assert L.weighed(none, L.pair_counts(none), 10).count() == 0
    broken = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.lit(b"\xff\xfe x").cast("string")))
    assert [r["_align"]["n_a"] for r in L.align(broken, A, B).collect()] == [0, 0]
    with pytest.raises(ValueError, match="broadcast"):
        L.weighed(none, L.pair_counts(none), L.MAX_PAIRS + 1)


def test_overlaps_share_bytes():
    import numpy as np

    a, b = np.array([2, 3, 7, 9]), np.array([1, 3, 6, 9])
    spans = lambda e: list(zip([0, *e[:-1]], e))
    want = [(i, j) for i, (p, q) in enumerate(spans(a.tolist())) for j, (r, s) in enumerate(spans(b.tolist())) if max(p, r) < min(q, s)]
    assert list(zip(*(x.tolist() for x in L.overlaps(a, b)))) == want
