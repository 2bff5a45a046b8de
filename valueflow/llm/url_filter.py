"""URL filters: rules indexed by their rarest literal token.

Two kinds of rules.  A host rule ``example.org/en/`` fits its host and all
subdomains if the url's path starts with the rule's path; of several the
longest wins.  A pattern rule works on the whole url where no host rule fits:
``*`` stands for any characters, ``^`` for a separator or the end, ``|`` at an
end anchors it, ``||`` anchors at a host label; exceptions (allow) beat blocks,
ties go to the earlier rule.

Every rule is one regular expression, filed under one of its
literal tokens (maximal runs of ASCII letters and digits that the rule bounds
on both sides), the one fewest urls contain.  The tokens of a url fetch the
candidate rules; only those run their expressions, which are compiled when
they are first fetched.  Rules without a bounded token are candidates of every
url.  The index is built once and broadcast, in groups of ``GROUP_RULES``; with
several groups each url is judged by each, and the best of their rules decides.

Defined cases: a null url, or one without ``://``, has an empty host and path
and only the default verdict; an empty table gives no row; repeated rows are
judged each; the longest urls are matched whole; columns of the caller stay,
one named like the result column is replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import set_aside

TOKEN = re.compile(r"[A-Za-z0-9]+")
#: The host runs from the first ``://`` up to one of ``/?#``; the path from there up to ``?`` or ``#``.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Rules of one broadcast (some 300 bytes each) and one pass over the urls.
GROUP_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    kind: str  # host or pattern
    regex: str
    tokens: tuple[str, ...]
    rank: int


def host_rule(host: str, path: str, verdict: str, rank: int = 0) -> Rule:
    """Matched against host + path, whose first ``/`` ends the host."""
    host = host.lower()
    literal = host + path
    inner = [m[0] for m in TOKEN.finditer(literal) if m.end() < len(literal)]
    return Rule(literal, verdict, "host", r"(?:[^/]*\.)?" + re.escape(literal), tuple(inner), rank)


def pattern_rule(text: str, rank: int = 0) -> Rule:
    """``@@`` in front makes it an exception."""
    verdict, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    left = 2 if body.startswith("||") else 1 if body.startswith("|") else 0
    end = body.endswith("|") and len(body) > left
    core = body[left : len(body) - end]
    regex = {0: "", 1: r"\A", 2: r"\A[^:]*://(?:[^/?#]*\.)?"}[left]
    regex += "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}.get(c, re.escape(c)) for c in core) + (r"\Z" if end else "")
    bounded = [
        m[0] for m in TOKEN.finditer(core)
        if (core[m.start() - 1] != "*" if m.start() else left) and (core[m.end()] != "*" if m.end() < len(core) else end)
    ]
    return Rule(text, verdict, "pattern", regex, tuple(bounded), rank)


def make_rules(hosts: Iterable[tuple[str, str, str]], patterns: Iterable[str] = ()) -> list[Rule]:
    """hosts: (verdict, host, path)."""
    hosts, patterns = list(hosts), list(patterns)
    return [host_rule(h, p, v, i) for i, (v, h, p) in enumerate(hosts)] + [pattern_rule(t, i) for i, t in enumerate(patterns)]


def token_counts(urls: DataFrame, url: str, rules: list[Rule]) -> dict[str, int]:
    """In how many urls each token of the rules occurs: at most a row per token comes back."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    found = urls.select(F.explode(F.array_intersect(_tokens(F.col(url)), F.array(*map(F.lit, wanted)))).alias("t")) \
        if len(wanted) <= 64 else \
        urls.select(F.explode(F.array_distinct(_tokens(F.col(url)))).alias("t")).join(
            F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string")), "t")
    return {r["t"]: r["n"] for r in found.groupBy("t").agg(F.count("*").alias("n")).collect()}


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty for null or without ``://``."""
    host = F.translate(F.regexp_extract(url, PARTS, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _tokens(url: Column) -> Column:
    host, path = split_url(url)
    return F.concat(F.regexp_extract_all(F.concat(host, path), F.lit("([A-Za-z0-9]+)"), 1),
                    F.coalesce(F.regexp_extract_all(url, F.lit("([A-Za-z0-9]+)"), 1), F.array().cast("array<string>")))


class Index:
    """Rules by rarest token; ``judge`` runs the expressions of the rules a url's tokens fetch."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, dict[str, list]] = {"host": defaultdict(list), "pattern": defaultdict(list)}
        self.always: dict[str, list] = {"host": [], "pattern": []}
        self.compiled: dict[str, re.Pattern] = {}
        for r in rules:
            if r.tokens:
                rarest = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
                self.by_token[r.kind][rarest].append(r)
            else:
                self.always[r.kind].append(r)

    def candidates(self, kind: str, tokens: set[str]) -> Iterator[tuple[Rule, re.Pattern]]:
        filed = self.by_token[kind]
        for rules in [*(filed[t] for t in tokens & filed.keys()), self.always[kind]]:
            for r in rules:
                if r.regex not in self.compiled:
                    self.compiled[r.regex] = re.compile(r.regex, re.S)
                yield r, self.compiled[r.regex]

    def best(self, url: str | None, host: str, path: str) -> Rule | None:
        """The rule that decides: the longest host rule that fits, else the first pattern, exceptions before blocks."""
        if host:
            place = host + path
            fits = [r for r, x in self.candidates("host", set(TOKEN.findall(place))) if x.match(place)]
            if fits:
                return max(fits, key=lambda r: (len(r.text), -r.rank))
        if url:
            fits = [r for r, x in self.candidates("pattern", set(TOKEN.findall(url))) if x.search(url)]
            if fits:
                return min(fits, key=lambda r: (r.verdict != "allow", r.rank))
        return None

    def judge(self, url: str | None, host: str, path: str) -> tuple[str | None, str | None, str | None]:
        """(host rule, verdict of the rule that decided, pattern rule)."""
        r = self.best(url, host, path)
        return (None, None, None) if r is None else (r.text, r.verdict, None) if r.kind == "host" else (None, r.verdict, r.text)


#: What a group of rules says of a url; of several groups the greatest decides.
_SAYS = T.StructType([T.StructField("host", T.BooleanType()), T.StructField("weight", T.LongType()), T.StructField("order", T.LongType()),
                      T.StructField("text", T.StringType()), T.StructField("verdict", T.StringType())])
_SAYS_ARROW = pa.struct([("host", pa.bool_()), ("weight", pa.int64()), ("order", pa.int64()), ("text", pa.string()), ("verdict", pa.string())])


def _says(r: Rule | None) -> dict | None:
    if r is None:
        return None
    weight = len(r.text) if r.kind == "host" else int(r.verdict == "allow")
    return {"host": r.kind == "host", "weight": weight, "order": -r.rank, "text": r.text, "verdict": r.verdict}


def _judge(index: Broadcast) -> Callable[..., Column]:
    @F.arrow_udf(_SAYS)
    def judge(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for urls, hosts, paths in batches:
            yield pa.array([_says(index.value.best(*row)) for row in zip(urls.to_pylist(), hosts.to_pylist(), paths.to_pylist())], _SAYS_ARROW)

    return judge


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", out: str = "_url",
                group_rules: int = GROUP_RULES) -> DataFrame:
    """Adds the struct ``out``: host, path, rule, verdict, pattern (the pattern rule that decided, if one did)."""
    counts = token_counts(pages, url, rules)
    groups = [rules[lo : lo + group_rules] for lo in range(0, len(rules), group_rules)] or [[]]
    indexes = [pages.sparkSession.sparkContext.broadcast(Index(g, counts)) for g in groups]
    said = [f"__said{i}" for i in range(len(indexes))]
    pages, back = set_aside(pages.drop(out), ["__host", "__path", "__best", *said])
    host, path = split_url(F.col(url))
    judged = pages.withColumn("__host", host).withColumn("__path", path)
    for name, index in zip(said, indexes):
        judged = judged.withColumn(name, _judge(index)(F.col(url), F.col("__host"), F.col("__path")))
    judged = judged.withColumn("__best", F.greatest(*said) if len(said) > 1 else F.col(said[0]))
    best, by_host = F.col("__best"), F.col("__best.host")
    return back(judged.withColumn(out, F.struct(
        F.col("__host").alias("host"), F.col("__path").alias("path"), F.when(by_host, best["text"]).alias("rule"),
        F.coalesce(best["verdict"], F.lit(default)).alias("verdict"), F.when(~by_host, best["text"]).alias("pattern"),
    )).drop("__host", "__path", "__best", *said))
