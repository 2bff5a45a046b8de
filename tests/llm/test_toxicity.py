"""Toxicity: grammar, lexicon, held-out accuracy, edge cases."""

import math

from pyspark.sql import functions as F

from valueflow.llm import toxicity as X
from valueflow.llm.common import holdout, table

SF = "/root/testdata/sf0.1"


def scored(text):
    reader = X.Reader({"idiot": 1.0, "vequ*": 0.5})
    return {s: round(math.expm1(v), 3) for s, v in zip(X.SCORED, reader.evidence(text)) if v}


def test_grammar():
    assert scored("what an idiot") == {"insult": 1.0}
    assert scored("you are an IDIOT") == {"aimed": 1.0}
    assert scored("you are an idiot. idiot") == {"aimed": 1.0, "insult": 1.0}  # a clause ends with its mark
    assert scored("that is not an idiot") == {"negated": 1.0}
    assert scored("nobody knew, said the paper, one long clause ago, idiot") == {"reported": 1.0}
    assert scored("I will hurt you") == {"threat": 1.0} and scored("you I will hurt") == {"threat": 1.0}
    assert scored("stones hurt") == {} and scored("they said stones hurt") == {"reported_threat": 1.0}
    assert scored("un vequance") == {"insult": 0.5}
    assert scored("one two three four five six") == {} and scored(None) == {} and scored("") == {}


def test_composition_equals_running_the_parts_in_turn():
    a = X._window(X.NEGATION, {X.INSULT: "negated"}, list(range(6)))
    b = X.Transducer(0, {(s, y): (1 if s or y == X.REPORT else 0, "reported" if s and y == X.INSULT else y) for s in (0, 1) for y in [*range(6), "negated"]})
    both = a.compose(b)
    import itertools
    for word in itertools.product(range(6), repeat=4):
        state, one, two, want, got = both.start, a.start, b.start, [], []
        for y in word:
            one, mid = a.step(one, y)
            two, out = b.step(two, mid)
            want.append(out)
            state, out = both.step(state, y)
            got.append(out)
        assert got == want


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    held = X.classify(docs, labels).filter(holdout(F.col("doc_id"))).join(labels, "doc_id").select("_toxic.predicted", "toxic", "_toxic.score").collect()
    right = sum(r["predicted"] == r["toxic"] for r in held) / len(held)
    assert right >= 0.97, right
    assert sum(r["predicted"] == 1 and r["toxic"] == 0 for r in held) <= 0.005 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_near_copies_teach_nothing(spark):
    copies = [(f"rare words only here number {i} zanzibar quux plover", 1) for i in range(40)]
    name = lambda i: "q" + chr(97 + i % 26) + chr(97 + i // 26)
    other = [(f"some x{name(i)} nastyword y{name(i)}", 1) for i in range(40)]
    clean = [(f"plain text x{i} of y{i} many kinds", 0) for i in range(400)]
    lexicon = X.learn_lexicon(spark.createDataFrame(copies + other + clean, "text string, label int"))
    assert "nastyword" in lexicon and "quux" not in lexicon and "plover" not in lexicon


def test_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "you idiot", "a"), (3, "you idiot", "a"), (4, "fine " * 50_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    got = [(r["doc_id"], r["_toxic"]["predicted"], r["_toxic"]["score"]) for r in X.classify(docs, none).collect()]
    assert [g[1] for g in got] == [0, 0, 1, 1, 0] and got[2][2] == got[3][2] and got[0][2] == got[1][2]
    odd = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (3, None, 0), (4, 1, 1), (4, 0, 0)], "doc_id long, toxic int, text int")
    assert X.classify(docs, odd).count() == 5
    assert X.classify(docs.limit(0), odd).count() == 0
