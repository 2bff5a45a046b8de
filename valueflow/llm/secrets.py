"""Secret scans, with DataFrame functions only.

Base kinds are regular expressions (assignments, access keys, hex runs); their
leftmost matches are marked with a control character and the text is split at it,
so that the lengths of the pieces give every match's place in code points.  The
lengths are summed in blocks of about the root of their number, as an array that
grows inside a fold is copied at every step.

The method adds spans by a battery of randomness tests.  Candidates are runs of
``MIN_RUN`` or more letters, digits, ``+/_=-``, with or without a digit, that touch no
base span (those are hidden before the runs are looked for).  For each its
encoding is inferred from its characters (decimal, hex, base32, letters and
digits, base64), and three tests compare it with a uniform draw from that
alphabet:

* chi-squared of the counts per character,
* the number of runs (neighbours in the same half of the alphabet form a run),
* the serial correlation of neighbouring places in the alphabet.

A candidate that fails any of them at ``ALPHA_TEST`` is no secret.  For the
rest the null hypothesis is text: the characters' log-likelihood ratio between
the uniform alphabet and a text model (letter groups, changes of case and digits;
a word may begin with a capital)
bounds the chance that text looks like it by exp(-ratio) (Markov), which falls
with the length.  Benjamini-Hochberg at level ``FDR`` over all distinct
candidates of the corpus decides; p-values are counted in steps of 1/8 of their
logarithm, rounded up, so the counts stay a small table.

Defined cases: null text is empty; an empty table gives no row; ties in start are
ordered by kind; repeated rows are judged each; texts of any length are read
whole; a column named like the result column is replaced, others stay whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import set_aside

MARK, HIDE, OTHER = "\x01", "\x02", "\x03"  # a text's own marks are read as the other control character
#: Base kinds, in order.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
KINDS = ["assign", "access", "hex", "random"]
MIN_VALUE = 6
MIN_RUN = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
RUN_OR_HIDDEN = rf"[A-Za-z0-9+/_={HIDE}-]{{{MIN_RUN},}}"
ALPHA_TEST = 1e-4
FDR = 0.01
#: Two-sided limit of a standard normal value at ALPHA_TEST.
Z_LIMIT = 3.89
#: p-values are counted by their logarithm times STEPS, cut at LEAST_LOG_P.
STEPS = 8
_HELPERS = [f"__{k}" for k in (*KINDS, "run")]
LEAST_LOG_P = -400.0

#: Alphabets by name, smallest first: pattern and size.
ENCODINGS = [("decimal", "^[0-9]+$", 10), ("hex", "^([0-9a-f]+|[0-9A-F]+)$", 16), ("base32", "^[A-Z2-7]+=*$", 32), ("base36", "^([a-z0-9]+|[A-Z0-9]+)$", 36),
             ("base62", "^[A-Za-z0-9]+$", 62), ("base64", "^[A-Za-z0-9+/_-]+=*$", 64)]


_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, first: Column) -> Column:
    """``first`` plus the sum of all values before each; for short arrays."""
    step = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, F.struct(first.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), step)["out"]


def places_of(pieces: Column) -> Column:
    """Where each piece begins in the joined text."""

    def blocks(k: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(k["n"]) - 1) / k["width"]).cast("int")), lambda i: F.slice(k["n"], i * k["width"] + 1, k["width"]))
        sums = lambda p: F.transform(p, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda acc, v: acc + v))
        return _let(parts, lambda p: F.flatten(F.zip_with(p, _before(sums(p), F.lit(0)), _before)))

    lengths = F.transform(pieces, lambda x: F.length(x).cast("long"))
    return _let(_let(lengths, lambda n: F.struct(n.alias("n"), F.ceil(F.sqrt(F.size(n))).cast("int").alias("width"))), blocks)


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut up: between, match, between, match, ..., between."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def _matched(pieces: Column) -> Column:
    """Spans of every second piece."""

    def spans(k: Column) -> Column:
        one = lambda i: F.struct(F.get(k["at"], i).alias("start"), (F.get(k["at"], i) + F.length(F.get(k["p"], i))).alias("end"), F.get(k["p"], i).alias("value"))
        found = F.transform(F.sequence(F.lit(1), F.size(k["p"]) - 2, F.lit(2)), one)
        return F.when(F.size(k["p"]) > 1, found).otherwise(F.array().cast(_SPANS))

    return _let(_let(pieces, lambda p: F.struct(p.alias("p"), F.when(F.size(p) > 1, places_of(p)).alias("at"))), spans)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: array of (start, end, text), code points, end exclusive."""
    return _matched(_pieces(F.translate(F.coalesce(text, F.lit("")), MARK, OTHER), pattern))


def hidden(text: Column, pattern: str, keep=lambda value: F.lit(True)) -> Column:
    """The text with every kept match replaced by as many hiding characters."""
    cover = lambda x, i: F.when((i % 2 == 1) & keep(x), F.repeat(F.lit(HIDE), F.length(x))).otherwise(x)
    return F.array_join(F.transform(_pieces(text, pattern), cover), "")


def _long_enough(value: Column) -> Column:
    return F.length(F.regexp_extract(value, ASSIGN, 2)) >= MIN_VALUE


def base_spans(text: Column) -> dict[str, Column]:
    found = {k: matches(text, p) for k, p in BASE.items()}
    found["assign"] = F.filter(found["assign"], lambda m: _long_enough(m["value"]))
    return found


def runs_apart(text: Column) -> Column:
    """Runs that touch no base span: base spans are hidden, and what is longer with hidden characters is dropped."""
    text = F.translate(F.coalesce(text, F.lit("")), MARK + HIDE, OTHER + OTHER)
    for kind, pattern in BASE.items():
        text = hidden(text, pattern, _long_enough) if kind == "assign" else hidden(text, pattern)
    found = _matched(F.split(F.regexp_replace(text, RUN_OR_HIDDEN, f"{MARK}$0{MARK}"), MARK, -1))
    return F.filter(found, lambda m: ~F.contains(m["value"], F.lit(HIDE)))


def _place(c: Column) -> Column:
    """A character's place: digits 0-9, letters 10-35 and 36-61, others from 62."""
    a = F.ascii(c)
    return (F.when(a.between(48, 57), a - 48).when(a.between(97, 122), a - 87).when(a.between(65, 90), a - 29)
            .when(c.isin("+", "-"), F.lit(62)).otherwise(F.lit(63)))


def _places(chars: Column, encoding: Column, size: Column) -> Column:
    """Places within the inferred alphabet, 0 to size - 1."""
    one_case = lambda v: F.when((size <= 36) & (v >= 36) & (v < 62), v - 26).otherwise(v)
    base32 = lambda v: F.when(v < 10, v + 24).otherwise(v - 10)
    return F.transform(chars, lambda c: _let(one_case(_place(c)), lambda v: F.when(encoding == "base32", base32(v)).otherwise(v)).cast("double"))


def _pairs(values: Column) -> Column:
    n = F.size(values)
    return F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


#: Text model: a character keeps its kind with 0.95, but the first capital of a run goes on as _FIRST says (a small letter, a
#: capital, a digit or another); then vowels have 0.40, common consonants 0.52 and rare ones 0.08.
_KEEP = 0.95
_FIRST = {1: 0.80, 2: 0.15, 0: 0.025, 3: 0.025}
_LETTERS = (("aeiou", 0.40), ("tnsrhldcmpgb", 0.52), ("fwyvkxjqz", 0.08))


def _kind(c: Column) -> Column:
    """0 digit, 1 small letter, 2 capital, 3 other."""
    a = F.ascii(c)
    return F.when(a.between(48, 57), 0).when(a.between(97, 122), 1).when(a.between(65, 90), 2).otherwise(3)


def _within_kind(c: Column) -> Column:
    """Log-likelihood of a character among its kind: ten digits, letters by group, four others."""
    out = F.when(F.ascii(c).between(48, 57), -math.log(10.0))
    for letters, share in _LETTERS:
        out = out.when(F.lower(c).isin(*letters), math.log(share / len(letters)))
    return out.otherwise(-math.log(4.0))


def _text_log(chars: Column) -> Column:
    """Log-likelihood of the characters under the text model."""
    first = lambda k: F.when(k == 1, math.log(_FIRST[1])).when(k == 2, math.log(_FIRST[2])).otherwise(math.log(_FIRST[0]))
    # 4: a capital that no capital stands before
    kinds = _let(F.transform(chars, _kind), lambda ks: F.transform(ks, lambda k, i: F.when(
        (k == 2) & ~F.coalesce(F.get(ks, i - 1) == 2, F.lit(False)), 4).otherwise(k)))
    moves = F.aggregate(_pairs(kinds), F.lit(math.log(0.25)), lambda acc, p: acc + F.when(p["a"] == 4, first(p["b"])).when(
        p["a"] == p["b"], math.log(_KEEP)).otherwise(math.log((1 - _KEEP) / 3)))
    return moves + F.aggregate(F.transform(chars, _within_kind), F.lit(0.0), lambda acc, v: acc + v)


def battery(value: Column) -> Column:
    """Of a run of characters: struct of encoding, n, z_chi, z_runs, z_serial, log_p."""
    encoding = F.coalesce(*[F.when(value.rlike(p), F.lit(e)) for e, p, _ in ENCODINGS], F.lit("base64"))
    size = F.coalesce(*[F.when(value.rlike(p), F.lit(float(n))) for _, p, n in ENCODINGS], F.lit(64.0))

    def tests(k: Column) -> Column:
        size, n, places = k["size"], F.size(k["places"]).cast("double"), k["places"]
        squares = F.aggregate(F.transform(F.array_distinct(places), lambda v: F.size(F.filter(places, lambda x: x == v)).cast("double")),
                              F.lit(0.0), lambda acc, c: acc + c * c)
        free = size - 1
        chi = (size / n * squares - n) / free
        switches = F.size(F.filter(_pairs(places), lambda p: (p["a"] < size / 2) != (p["b"] < size / 2))).cast("double")
        mean, variance = free / 2, (size * size - 1) / 12
        pairs = F.greatest(n - 1, F.lit(1.0))  # a run of padding alone has one character; _step rejects it
        product = F.aggregate(_pairs(places), F.lit(0.0), lambda acc, p: acc + (p["a"] - mean) * (p["b"] - mean))
        return F.struct(
            k["encoding"].alias("encoding"), n.alias("n"),
            # Wilson-Hilferty: the cube root of chi-squared / df is close to normal
            ((F.cbrt(chi) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))).alias("z_chi"),
            ((switches - pairs / 2) / (F.sqrt(pairs) / 2)).alias("z_runs"),
            (product / (variance * F.sqrt(pairs))).alias("z_serial"),
            F.greatest(F.lit(LEAST_LOG_P), F.least(F.lit(0.0), k["text"] + n * F.log(size) + F.log(F.lit(float(len(ENCODINGS)))))).alias("log_p"))

    chars = F.split(F.regexp_replace(value, "(?<=.)=+$", ""), "(?!^)(?!$)")
    known = _let(F.struct(encoding.alias("encoding"), size.alias("size"), chars.alias("chars")), lambda k: F.struct(
        k["encoding"].alias("encoding"), k["size"].alias("size"), _places(k["chars"], k["encoding"], k["size"]).alias("places"), _text_log(k["chars"]).alias("text")))
    return _let(known, tests)


def _step(b: Column) -> Column:
    """Step of the p-value; 0 (chance 1) for what fails a test or is too short for one."""
    random = (b["n"] >= 8) & (b["z_chi"] <= Z_LIMIT) & (F.abs(b["z_runs"]) <= Z_LIMIT) & (F.abs(b["z_serial"]) <= Z_LIMIT)
    return F.when(random, F.ceil(b["log_p"] * STEPS)).otherwise(0).cast("long")


def _candidates(docs: DataFrame, text: str) -> DataFrame:
    """Adds __assign, __access, __hex and __random: tested runs apart from these, each with its step."""
    runs = F.when(F.col(text).rlike(RUN), runs_apart(F.col(text))).otherwise(F.array().cast(_SPANS))  # most texts have no run at all
    found = docs.withColumns({f"__{k}": v for k, v in base_spans(F.col(text)).items()} | {"__run": runs})
    tested = F.transform("__run", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), battery(m["value"]).alias("tests")))
    return found.withColumn("__random", tested).drop("__run")


def false_discovery_limit(docs: DataFrame, text: str = "text", level: float = FDR) -> int:
    """Largest step that Benjamini-Hochberg admits over the corpus' distinct candidates (below every step if none).

    What comes back has one row per step, ``STEPS * -LEAST_LOG_P`` at most.
    """
    tested = _candidates(docs, text).select(F.explode("__random").alias("m")).groupBy("m.value").agg(F.first(_step(F.col("m.tests"))).alias("step"))
    steps = sorted((r["step"], r["k"]) for r in tested.groupBy("step").agg(F.count("*").alias("k")).collect())
    total, rank, limit = sum(k for _, k in steps), 0, int(STEPS * LEAST_LOG_P) - 1
    for step, k in steps:
        rank += k
        if step / STEPS <= math.log(level * rank / total):
            limit = step
    return limit


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", level: float = FDR, out: str = "_secrets") -> DataFrame:
    """Adds the struct ``out``: assign, access, hex, random (arrays of start, end, value), base and spans (strings of all spans)."""
    docs, back = set_aside(docs.drop(out), _HELPERS)
    limit = false_discovery_limit(docs.select(text), text, level)
    found = _candidates(docs, text)
    found = found.withColumn("__random", F.transform(F.filter("__random", lambda m: _step(m["tests"]) <= limit), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))))
    named = [_named(k, F.col(f"__{k}")) for k in KINDS]
    return back(found.withColumn(out, F.struct(*[F.col(f"__{k}").alias(k) for k in KINDS], joined(F.concat(*named[:-1])).alias("base"), joined(F.concat(*named)).alias("spans"))
                                 ).drop(*[f"__{k}" for k in KINDS]))
