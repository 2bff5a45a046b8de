"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words are read as symbols: insult, threat, target, negation, report, or other.
Insult words come from a lexicon (a base list and what labels teach); the other
classes are closed lists.  Four transducers rewrite the symbols of a clause from
left to right and are composed into one:

* negation: within ``REACH`` words after a negation an insult becomes a negated one;
* report: after a word of saying, insults and threats are reported ones;
* target: within ``REACH`` words after a person an insult is aimed at them;
* threat: a threat word with a person within ``REACH`` words before or after it is a threat.

Every arc that consumes an insult or a threat ends in one scored symbol, so a
clause yields a bag of them, not of isolated words.  A document's evidence for a
symbol is log(1 + sum of the words' strengths) over its clauses; the symbols'
weights start from the grammar's own (reported and negated ones low) and are
adjusted on labelled rows by a logistic fit that is drawn towards them.

The lexicon is learned on a bounded sample of labelled rows: words, and stems of
three to eight letters, that occur in documents of label 1 more than chance allows
(likelihood ratio with a Bonferroni bound over all grams) enter with their log
odds as strength.

Defined cases: null and empty texts have no clause and get the constant's score;
without labels the grammar's own weights and base list hold; repeated rows get
equal scores; texts of any length are read whole; an empty table gives no row; a
column named like the result is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .training import SAMPLE_ROWS, fit_logistic, labelled_sample

REACH = 4
STEMS = (3, 4, 5, 6, 7, 8)
MIN_LOG_ODDS = 2.0
TOP_LOG_ODDS = 8.0
THRESHOLD = 0.5
_CACHE = 150_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Closed word lists (English, French, German, Spanish).
BASE = {
    INSULT: "idiot idiots stupid moron morons loser losers scum worthless pathetic imbecile dumbass bastard crétin abruti connard idiota imbécil estúpido trottel dummkopf abschaum".split(),
    THREAT: "kill hurt destroy strangle murder tuer frapper détruire töten umbringen verletzen matar golpear destruir".split(),
    TARGET: "you he she they him her them your tu vous il elle ils toi du ihr sie er dich euch tú usted él ella ellos vosotros".split(),
    NEGATION: "not never no isn't aren't don't ne pas jamais nicht nie kein keine no nunca jamás tampoco".split(),
    REPORT: "said says called wrote quoted claimed dit disait écrit sagte schrieb nannte dijo dice escribió llamó".split(),
}
#: Scored symbols and the weights they start from; the last is the constant.
SCORED = ["insult", "aimed", "negated", "reported", "threat", "reported_threat"]
PRIOR = np.array([5.0, 6.0, 2.0, 2.5, 5.0, 2.0, -3.5])

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
PIECE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]")


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``step(state, symbol)`` gives (state, symbol written). States are integers or tuples of them."""

    start: object
    table: dict = field(hash=False)

    def step(self, state, symbol):
        return self.table.get((state, symbol), self.table.get((state, None), (state, None)))

    def compose(self, after: "Transducer") -> "Transducer":
        """Reads with this one and hands what it writes to ``after``; reachable states only."""
        start = (self.start, after.start)
        table, todo = {}, [start]
        symbols = {s for (_, s) in self.table if s is not None} | {s for (_, s) in after.table if s is not None}
        seen = {start}
        while todo:
            here = todo.pop()
            for s in sorted(symbols, key=str):
                mid, out = self.step(here[0], s)
                end, written = after.step(here[1], s if out is None else out)
                to = (mid, end)
                table[here, s] = (to, s if out is None and written is None else out if written is None else written)
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return Transducer(start, table)


def _window(opener: int, rewrite: dict, symbols: list) -> Transducer:
    """For ``REACH`` symbols after ``opener``, symbols are rewritten."""
    table = {}
    for left in range(REACH + 1):
        for s in symbols:
            to = REACH if s == opener else max(0, left - 1)
            table[left, s] = (to, rewrite.get(s, s) if left else s)
    return Transducer(0, table)


def grammar() -> Transducer:
    """negation . report . target . threat over the word classes."""
    words = [OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT]
    negation = _window(NEGATION, {INSULT: "negated"}, words)
    every = [*words, "negated", "reported", "reported_threat", "aimed"]
    report = Transducer(0, {(state, s): (1 if state or s == REPORT else 0, {INSULT: "reported", THREAT: "reported_threat"}.get(s, s) if state else s)
                            for state in (0, 1) for s in every})
    target = _window(TARGET, {INSULT: "aimed"}, every)
    # state: words left in which a person was named, or (negative) in which a threat word waits for one
    threat = {}
    for state in range(-REACH, REACH + 1):
        for s in every:
            to = REACH if s == TARGET else state - 1 if state > 0 else state + 1 if state < 0 else 0
            out = s
            if s == THREAT:
                to, out = (state - 1, "threat") if state > 0 else (-REACH, s)
            elif s == TARGET and state < 0:
                out = "threat"
            threat[state, s] = (to, out)
    return negation.compose(report).compose(target).compose(Transducer(0, threat))


class Reader:
    """Words to (class, strength), clauses to evidence."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.closed = {w: k for k, ws in BASE.items() if k != INSULT for w in ws}
        self.machine = grammar()
        reader = self

        class Classes(dict):
            def __missing__(self, word):
                if len(self) >= _CACHE:
                    self.clear()
                self[word] = got = reader.read(word)
                return got

        self.classes = Classes()

    def read(self, word: str) -> tuple[int, float]:
        strength = max([self.lexicon.get(word, 0.0), *(self.lexicon.get(word[:n] + "*", 0.0) for n in STEMS if len(word) >= n)])
        return (INSULT, strength) if strength else (self.closed.get(word, OTHER), 1.0)

    def evidence(self, text: str | None) -> list[float]:
        """log(1 + strengths) per scored symbol."""
        low = (text or "").lower()
        classes = self.classes
        if not any(classes[w][0] in (INSULT, THREAT) for w in set(WORD.findall(low))):
            return [0.0] * len(SCORED)
        total = dict.fromkeys(SCORED, 0.0)
        step, state = self.machine.step, self.machine.start
        for piece in PIECE.findall(low):
            if piece in ".!?;:\n":
                state = self.machine.start
                continue
            symbol, strength = classes[piece]
            state, out = step(state, symbol)
            out = "insult" if out == INSULT else out
            if out in total:
                total[out] += strength
        return [math.log1p(total[s]) for s in SCORED]


def grams(text: str) -> set[str]:
    return {g for w in set(WORD.findall(text.lower())) for g in _keys(w)}


def _keys(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def _beyond_chance(up: Column, down: Column, n_up: int, n_down: int, tested: int) -> Column:
    """Strength (log odds up to 1) of grams that pass the likelihood ratio test, else null."""
    p, n, base = up.cast("double"), (up + down).cast("double"), n_up / (n_up + n_down)
    part = lambda k, a, b: F.when(k > 0, k * F.log(a / b)).otherwise(0.0)
    ratio = 2 * (part(p, p / n, F.lit(base)) + part(n - p, (n - p) / n, F.lit(1 - base)))
    odds = F.log((p + 0.5) / (n_up + 1.0)) - F.log((n - p + 0.5) / (n_down + 1.0))
    passed = (p >= 3) & (odds >= MIN_LOG_ODDS) & (ratio >= 2 * math.log(10 * max(tested, 1)))
    return F.when(passed, F.least(odds / TOP_LOG_ODDS, F.lit(1.0)))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Grams that label 1 has more than chance allows, with strengths up to 1; the sample is bounded, so are they.

    Near copies repeat all their words together.  So a gram's documents of label 1 count only as often as it has
    different words before it, and after it: a word of one much-copied text has one such neighbour.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = Counter(), Counter()
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                (up if label else down).update(grams(text))
        names = list(up.keys() | down.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([up[g] for g in names], pa.int64()), pa.array([down[g] for g in names], pa.int64())], ["gram", "up", "down"])

    n_up, n_down = sample.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    lexicon = {w: 1.0 for w in BASE[INSULT]}
    if not n_up or not n_down:
        return lexicon
    counts = sample.select("text", F.col("label").cast("long").alias("label")).mapInArrow(count, "gram string, up long, down long")
    counts = written(counts.groupBy("gram").agg(F.sum("up").alias("up"), F.sum("down").alias("down")), "grams")
    tested = counts.count()
    first = counts.filter(_beyond_chance(F.col("up"), F.col("down"), n_up, n_down, tested).isNotNull())
    wanted = {r["gram"] for r in first.select("gram").collect()}

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            for text in b.column("text").to_pylist():
                found = WORD.findall(text.lower())
                for i, w in enumerate(found):
                    for g in _keys(w):
                        if g in wanted:
                            seen.add((g, 0, found[i - 1] if i else ""))
                            seen.add((g, 1, found[i + 1] if i + 1 < len(found) else ""))
        rows = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["gram", "side", "word"])

    near = sample.filter("label = 1").select("text").mapInArrow(neighbours, "gram string, side long, word string").distinct()
    near = near.groupBy("gram", "side").count().groupBy("gram").agg(F.min("count").alias("near"))
    kept = first.join(near, "gram").withColumn("up", F.least("up", "near"))
    kept = kept.withColumn("strength", _beyond_chance(F.col("up"), F.col("down"), n_up, n_down, tested)).filter(F.col("strength").isNotNull())
    found = {r["gram"]: (r["up"], r["down"], r["strength"]) for r in kept.select("gram", "up", "down", "strength").collect()}
    discard(counts)
    return lexicon | {g: found[g][2] for g in _of_their_own(found, n_up, n_down)}


def _of_their_own(found: dict[str, tuple[int, int, float]], n_up: int, n_down: int) -> list[str]:
    """Grams without the stems whose evidence is that of a stronger, longer gram."""
    most: dict[str, int] = {}
    for g, (up, _, strength) in found.items():
        for n in STEMS:
            stem = g[:n] + "*"
            if stem != g and len(g.rstrip("*")) >= n and stem in found and found[stem][2] < strength:
                most[stem] = max(most.get(stem, 0), up)
    own = []
    for g, (up, down, _) in found.items():
        rest = max(0, up - most.get(g, 0))
        if g not in most or math.log((rest + 0.5) / (n_up + 1)) - math.log((down + 0.5) / (n_down + 1)) >= MIN_LOG_ODDS:
            own.append(g)
    return own


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and symbol weights from a sample of about ``rows`` labelled rows."""
    sample = labelled_sample(docs, labels, "toxic", rows)
    lexicon = learn_lexicon(sample)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for b in batches:
            rows = [reader.evidence(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column("label")], ["x", "y"])

    got = sample.select("text", F.col("label").cast("long").alias("label")).mapInArrow(read, "x array<double>, y long").collect()
    discard(sample)
    if len({r["y"] for r in got}) < 2:
        return Model(lexicon, PRIOR)
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], dtype=float)
    return Model(lexicon, fit_logistic(x, y, PRIOR))


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Chance of label 1, as a column over ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.weights))

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon, weights = sent.value
        reader = Reader(lexicon)
        for batch in batches:
            x = np.array([reader.evidence(t.as_py()) for t in batch]).reshape(-1, len(SCORED))
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -40, 40))), pa.float64())

    return run(F.col(text).cast("string"))


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD, out: str = "_toxic") -> DataFrame:
    """Adds the struct ``out``: score, predicted."""
    model = train(docs, labels, rows)
    scored = docs.withColumn("__score", score(docs, model))
    return scored.withColumn(out, F.struct(F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))).drop("__score")
