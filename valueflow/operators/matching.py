"""Name matching against master tables (Z-01 … Z-05, W-04, J-09, J-10).

The score is the standard-library sequence-matcher ratio ``2·M/(|a|+|b|)``
(M = matched characters of the recursive longest-common-block split), with
a cutoff of 0.4 and the best three names per query and master, ties broken
by name descending.  The score is not symmetric: it is computed with the
master name as the first sequence and the query as the second.

Set-based plan, no all-pairs join:

1. every string is cut into character occurrences ``(char, k)``, ordered
   rarest-first over the names;
2. a *prefix filter* for a threshold t: a pair that reaches t shares
   ``M >= t/2·(|a|+|b|)`` occurrences, hence one of the first
   ``|s| - ceil(t/(2-t)·|s|) + 1`` of each string.  Only those are joined,
   and a joined occurrence must leave enough before and after it in both
   strings (position bound) for lengths that can reach t (length bound);
3. the matcher's own quick bound (shared occurrences of the whole strings)
   in the JVM;
4. the exact ratio in Python, by query in order of falling bound.

The top three come from a *threshold algorithm*: steps 2 to 4 run for
t = 0.9, 0.8, 0.4, the later ones only for queries with open places, and within a
query scoring stops once the bound falls below the third score.  The
similarity join (all pairs of 0.4) runs them once and scores every pair.
"""

from __future__ import annotations

import difflib
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

c = F.col

# --- fixed values: cutoff and list length of the candidate lookup ---
CUTOFF = 0.4
TOP_N = 3
MASTER_ORDER = ["UNIVERSAL", "MEASURED", "PROCESSED"]


#: Thresholds of the top-three search, in tenths; the last is the cutoff.
STAGES = (9, 8, 4)
#: Up to so many (query, name) combinations the last stage alone is cheaper.
FEW_PAIRS = 1 << 18


@F.pandas_udf(T.DoubleType())
def match_ratio(candidate: pd.Series, query: pd.Series) -> pd.Series:
    """Sequence-matcher ratio when it reaches the cutoff, else NULL."""
    out = []
    sm = difflib.SequenceMatcher()
    last_q = None
    for cand, q in zip(candidate, query):
        if q != last_q:
            sm.set_seq2(q)
            last_q = q
        sm.set_seq1(cand)
        r = sm.ratio()
        out.append(r if r >= CUTOFF else None)
    return pd.Series(out, dtype="float64")


# Marked non-deterministic only so Catalyst does not inline the UDF into a
# pushed-down filter (that would score every pair twice, and before the
# work-based repartition); the function itself is pure.
match_ratio = match_ratio.asNondeterministic()


def _occurrences(strings: DataFrame) -> DataFrame:
    """(s, ch, k): the k-th occurrence of character ch in each string of the column ``s``."""
    chars = strings.select("s").distinct().select("s", F.explode(F.split(c("s"), "")).alias("ch")).filter(c("ch") != "")
    counts = chars.groupBy("s", "ch").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("s", "ch", F.explode(F.sequence(F.lit(1), c("n").cast("int"))).alias("k"))


def _ordered(occ: DataFrame, freq: DataFrame) -> DataFrame:
    """(s, length, occ, ranked): all occurrence numbers of a string, and its occurrences rarest first.

    A row per string, its arrays bounded by the string's length.  Occurrences that no name has come first.
    """
    o = occ.join(freq, ["ch", "k"], "left")
    item = F.struct(F.coalesce(c("df"), F.lit(0)).alias("df"), "ch", "k", (F.ascii("ch").cast("long") * 65536 + c("k")).alias("no"))
    ranked = o.groupBy("s").agg(F.sort_array(F.collect_list(item)).alias("ranked"))
    return ranked.select("s", F.length("s").alias("length"), F.transform("ranked", lambda x: x["no"]).alias("occ"))


def _indexed(queries: DataFrame, names: DataFrame, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """The ordered occurrences of both sides, with one order for all; stored if several stages read them."""
    occ_n = _occurrences(names)
    freq = occ_n.groupBy("ch", "k").agg(F.count(F.lit(1)).alias("df"))
    both = _ordered(_occurrences(queries), freq), _ordered(occ_n, freq)
    return (stored(both[0], "match-queries"), stored(both[1], "match-names")) if keep else both


def _needed(length: Column, tenths: int) -> Column:
    """Occurrences that a string of this length shares at least with any partner that reaches the threshold."""
    return F.ceil(F.lit(tenths) * length / F.lit(20 - tenths))


def _pairs(iq: DataFrame, i_n: DataFrame, tenths: int, blocks: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query, name, ub): all pairs whose quick bound reaches the threshold; with ``blocks`` (query, block) and
    (name, block) only those that share a block, which comes out too.

    A pair is kept where its first common occurrence meets; nothing is common before, so what may follow bounds it.
    """
    by = ["block"] if blocks else []

    def side(index: DataFrame, what: str, block: DataFrame | None) -> DataFrame:
        rows = index.select(c("s").alias(what), c("length").alias(f"l_{what}"), c("occ").alias(f"o_{what}"))
        rows = rows.join(block, what) if block is not None else rows
        prefix = F.slice(f"o_{what}", 1, (c(f"l_{what}") - _needed(c(f"l_{what}"), tenths) + 1).cast("int"))
        return rows.select(what, f"l_{what}", f"o_{what}", *by, F.posexplode(prefix).alias(f"p_{what}", "no"))

    lq, ln = c("l_query"), c("l_name")
    least = F.ceil(F.lit(tenths) * (lq + ln) / F.lit(20))
    in_reach = (lq * tenths <= ln * (20 - tenths)) & (ln * tenths <= lq * (20 - tenths))
    enough = F.least(lq - c("p_query"), ln - c("p_name")) >= least
    parts = int(iq.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = side(iq, "query", blocks[0] if blocks else None).repartition(parts, "query", "no")  # by work: rows are few and small
    met = asked.join(side(i_n, "name", blocks[1] if blocks else None), [*by, "no"]).filter(in_reach & enough)
    met = met.withColumn("common", F.array_intersect("o_query", "o_name")).filter(F.get("common", F.lit(0)) == c("no"))
    ub = F.lit(2.0) * F.size("common") / (lq + ln)
    return met.select("query", "name", *by, ub.alias("ub")).filter(c("ub") >= F.lit(tenths / 10))


def candidate_pairs(queries: DataFrame, names: DataFrame, block: str | None = None) -> DataFrame:
    """Lossless candidate (query, name) pairs for the 0.4 cutoff, with an upper bound.

    With ``block`` (a column of both sides, such as the master's kind or the
    brand) only pairs inside a block are made.  ``ub`` = 2·(multiset character
    overlap)/(|q|+|n|), the matcher's own quick bound.
    """
    sides = [queries.select("query", *([c(block).alias("block")] if block else [])).distinct(), names.select("name", *([c(block).alias("block")] if block else [])).distinct()]
    iq, i_n = _indexed(sides[0].select(c("query").alias("s")), sides[1].select(c("name").alias("s")))
    pairs = _pairs(iq, i_n, STAGES[-1], tuple(sides) if block else None)
    return pairs.withColumnRenamed("block", block) if block else pairs


def _score(pairs: DataFrame) -> DataFrame:
    """Exact ratio for the given pairs, spread over the cluster by query.

    The scoring stage is CPU-bound on small rows: partition it by work
    (query hash, the session's shuffle-partition count), not by bytes, and
    sort by query so each task reuses the matcher's index of one query.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = pairs.repartition(n, "query").sortWithinPartitions("query")
    return p.withColumn("score", match_ratio(c("name"), c("query"))).filter(c("score").isNotNull())


# Z-05
def similarity_join(queries: DataFrame, masters: DataFrame) -> DataFrame:
    """All (query, kind, name) with score >= cutoff.

    ``queries``: column ``query``, and ``kind`` if each asks one master only
    (pairs are then made inside a kind); ``masters``: columns ``kind``,
    ``name``.  Exact equality always scores 1.0.
    """
    names = masters.select("kind", "name").distinct()
    if "kind" in queries.columns:
        return _score(candidate_pairs(queries, names, "kind")).select("query", "kind", "name", "score")
    scored = _score(candidate_pairs(queries, names))
    return scored.join(names, "name").select("query", "kind", "name", "score")


class _Best:
    """The best places of one query: per kind its (score, name, copies), best first."""

    def __init__(self, n: int):
        self.n, self.kinds, self.scored = n, {}, 0

    def third(self, kind: str) -> float | None:
        """Score of the last place, once all places are taken."""
        places = self.kinds.get(kind, ())
        return places[-1][0] if sum(p[2] for p in places) >= self.n else None

    def wants(self, ub: float, kinds: dict[str, int]) -> bool:
        return any(last is None or ub >= last for last in map(self.third, kinds))

    def add(self, score: float, name: str, kinds: dict[str, int]) -> None:
        for kind, copies in kinds.items():
            places = sorted([*self.kinds.get(kind, ()), (score, name, copies)], reverse=True)
            while sum(p[2] for p in places[:-1]) >= self.n:
                places.pop()
            self.kinds[kind] = places


_PLACES = "query string, block string, kind string, name string, score double, scored long, closed boolean"


def _best_of(pairs: DataFrame, tenths: int, n: int, all_kinds: int) -> DataFrame:
    """The best places of every (query, block) at or above the threshold, from pairs with ``ub`` and ``kinds`` (JSON: copies by kind).

    ``closed`` marks those whose every kind has all its places taken; ``scored`` counts the pairs that were scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, key, best = difflib.SequenceMatcher(), None, _Best(n)
        columns: list[list] = [[] for _ in range(7)]
        read = lru_cache(4096)(json.loads)

        def close() -> None:
            closed = len(best.kinds) == all_kinds and all(best.third(k) is not None for k in best.kinds)
            for at, (kind, places) in enumerate(best.kinds.items()):
                for row, (score, name, _) in enumerate(places):
                    for column, value in zip(columns, (key[0], key[1], kind, name, score, best.scored if at == row == 0 else 0, closed)):
                        column.append(value)

        def taken() -> pa.RecordBatch:
            kinds = [pa.string()] * 4 + [pa.float64(), pa.int64(), pa.bool_()]
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=[f.split()[0] for f in _PLACES.split(", ")])
            for column in columns:
                column.clear()
            return batch

        for batch in batches:
            for query, block, name, ub, kinds in zip(*(batch.column(x).to_pylist() for x in ("query", "block", "name", "ub", "kinds"))):
                if (query, block) != key:
                    if key:
                        close()
                    key, best = (query, block), _Best(n)
                    matcher.set_seq2(query)
                kinds = read(kinds)
                if best.wants(ub, kinds):
                    matcher.set_seq1(name)
                    score = matcher.ratio()
                    best.scored += 1
                    if score >= tenths / 10:
                        best.add(score, name, kinds)
            yield taken()
        if key:
            close()
        yield taken()

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(parts, "query", "block").sortWithinPartitions("block", "query", c("ub").desc(), "name")
    return dealt.select("query", "block", "name", "ub", "kinds").mapInArrow(run, _PLACES)


# W-04
def top_candidates(queries: DataFrame, masters: DataFrame, n: int = TOP_N) -> DataFrame:
    """Best ``n`` listing places per (query, kind): score desc, then name desc.

    ``queries``: column ``query``, and ``kind`` if each asks one master only.
    A name held by several master rows takes one place per row (the id shown
    is the first row with that name).  Runs the stages described above; a
    stage's result is stored, as later ones leave out what it closed.
    """
    one = "kind" in queries.columns
    names = masters.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"))
    block = c("kind").cast("string") if one else F.lit("")
    held = names.withColumn("block", block).groupBy("name", "block").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c("kind").cast("string"), c("copies")))))).alias("kinds"))
    asked = stored(queries.filter(c("query") != "").select("query", block.alias("block")).distinct(), "match-asked")
    texts, listed = asked.select(c("query").alias("s")), names.select(c("name").alias("s"))
    rows, all_kinds = masters.agg(F.count(F.lit(1)), F.lit(1) if one else F.count_distinct("kind")).first()
    few = asked.count() * rows <= FEW_PAIRS
    iq, i_n = _indexed(texts, listed, keep=not few)

    def stage(tenths: int, still: DataFrame, index: DataFrame) -> DataFrame:
        pairs = _pairs(index, i_n, tenths, (still, held.select("name", "block")) if one else None)
        pairs = pairs if one else pairs.withColumn("block", F.lit(""))
        return _best_of(pairs.join(held, ["name", "block"]), tenths, n, all_kinds)

    done = []
    for tenths in () if few else STAGES:
        still = asked
        for table in done:
            still = still.join(table.filter("closed").select("query", "block").distinct(), ["query", "block"], "left_anti")
        if done and still.isEmpty():
            break
        index = iq.join(still.select(c("query").alias("s")), "s", "left_semi") if done else iq
        done.append(stored(stage(tenths, still, index), "match-places"))
    places = stage(STAGES[-1], asked, iq) if few else done[-1]  # what the last stage finds is final
    for table in done[:-1]:
        places = places.unionByName(table.filter("closed"))
    s = places.select("query", c("kind").alias("k"), c("name").alias("held"), "score").join(
        names, (c("k") == c("kind").cast("string")) & (c("held") == c("name"))).drop("k", "held")
    w = Window.partitionBy("query", "kind").orderBy(c("score").desc(), c("name").desc())  # over the few places of a query
    s = s.withColumn("before", F.coalesce(F.sum("copies").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0)))
    s = s.filter(c("before") < n)
    return s.select("query", "kind", "name", "id", "score", (c("before") + 1).cast("long").alias("rank"),
                    F.least(c("copies"), F.lit(n) - c("before")).cast("long").alias("slots"))


def _kind_rank(kind_col):
    return F.array_position(F.array(*[F.lit(k) for k in MASTER_ORDER]), kind_col)


def kind_of(food_type: Column) -> Column:
    """The master that a line's type names: its own, the processed one for eating out; NULL for other lines."""
    return F.when(food_type == "OUT_EAT", F.lit("PROCESSED")).when(food_type.isin(*MASTER_ORDER), food_type)


def food_masters(led) -> DataFrame:
    return led["m_foods"].select("id", "name", c("food_kind").alias("kind"))


# Z-01
def exact_food(queries: DataFrame, masters: DataFrame) -> DataFrame:
    """Exact hits only; the first master in order wins, then the smallest id."""
    q = queries.select("query").distinct()
    hits = (q.join(masters, q["query"] == masters["name"])
            .groupBy("query").agg(F.min_by(F.struct("kind", "id", "name"), F.struct(_kind_rank(c("kind")), c("id"))).alias("hit")))
    return hits.select("query", F.lit("EXACT").alias("match_type"), "hit.kind", "hit.id", "hit.name",
                       F.lit(1.0).alias("score"), F.lit(1).cast("long").alias("rank"), F.lit(1).cast("long").alias("slots"))


def find_food(queries: DataFrame, masters: DataFrame) -> DataFrame:
    """Exact hit, else up to 3 candidates from each master."""
    queries = stored(queries.select("query").distinct(), "match-texts")
    exact = exact_food(queries, masters)
    rest = queries.join(exact.select("query"), "query", "left_anti")
    fuzzy = top_candidates(rest, masters).select(
        "query", F.lit("FUZZY").alias("match_type"), "kind", "id", "name", "score", "rank", "slots")
    return exact.unionByName(fuzzy)


# Z-02
def find_food_candidates(queries: DataFrame, masters: DataFrame) -> DataFrame:
    return top_candidates(queries.select("query").distinct(), masters)


# Z-03
def find_food_in(requests: DataFrame, masters: DataFrame) -> DataFrame:
    """Per (query, food_type): every master row whose name is among the top-3 names of that type's master.

    Rows come in table (id) order and keep the asked type; OUT_EAT searches
    the processed master.
    """
    r = requests.select("query", "food_type").distinct().withColumn(
        "kind", F.when(c("food_type") == "OUT_EAT", F.lit("PROCESSED")).otherwise(c("food_type")))
    r = r.filter(c("kind").isin(*MASTER_ORDER))
    top = top_candidates(r.select("query", "kind"), masters).select("query", "kind", "name", "score")
    rows = top.join(masters, ["kind", "name"]).join(r, ["query", "kind"])
    return rows.select("query", "food_type", "id", "name", "score")


# Z-04
def match_store(requests: DataFrame, brands: DataFrame, branches: DataFrame) -> DataFrame:
    """Brand exact-or-fuzzy; branch exact-or-fuzzy within the chosen brand.

    For a fuzzy brand the best candidate (rank 1) is taken, the batch
    stand-in for the interactive pick.
    """
    req = stored(requests.select(c("brand_text"), c("branch_text")).distinct(), "match-stores")
    bm = brands.select("id", "name", F.lit("BRAND").alias("kind"))
    bq = req.select(c("brand_text").alias("query")).distinct()
    exact_b = bq.join(bm, bq["query"] == bm["name"]).groupBy("query").agg(F.min("id").alias("brand_id"))
    fuzzy_b = (top_candidates(bq.join(exact_b, "query", "left_anti"), bm)
               .filter(c("rank") == 1).select("query", c("id").alias("brand_id")))
    brand_of = stored(exact_b.select("query", "brand_id", F.lit("EXACT").alias("brand_match")).unionByName(
        fuzzy_b.withColumn("brand_match", F.lit("FUZZY"))), "match-brands")
    r = req.join(brand_of, req["brand_text"] == brand_of["query"], "left").drop("query")
    # branch within brand: the brand's id is the master's kind
    br = branches.select("id", c("branch_name").alias("name"), c("brand_id").cast("string").alias("kind"))
    rq = r.filter(c("brand_id").isNotNull()).select(c("branch_text").alias("query"), c("brand_id").cast("string").alias("kind")).distinct()
    exact_s = (rq.join(br.withColumnRenamed("name", "query"), ["query", "kind"])
               .groupBy("query", "kind").agg(F.min("id").alias("branch_id")))
    fuzzy_s = (top_candidates(rq.join(exact_s, ["query", "kind"], "left_anti"), br)
               .filter(c("rank") == 1).select("query", "kind", c("id").alias("branch_id")))
    branch_of = exact_s.withColumn("branch_match", F.lit("EXACT")).unionByName(
        fuzzy_s.withColumn("branch_match", F.lit("FUZZY")))
    out = r.join(branch_of, (c("branch_text") == c("query")) & (c("brand_id").cast("string") == c("kind")), "left")
    return out.select("brand_text", "branch_text", "brand_id", "brand_match", "branch_id", "branch_match")


# J-09
def existing_entity_match(lines: DataFrame, led) -> DataFrame:
    """Exact-name ids of brand, branch-in-brand and food (in the line's master); the first row of a name wins."""
    brands = led["m_brands"].groupBy(c("name").alias("__brand")).agg(F.min("id").alias("brand_id"))
    branches = led["m_store_branches"].groupBy(c("brand_id").alias("__of"), c("branch_name").alias("__branch")).agg(
        F.min("id").alias("branch_id"))
    foods = led["m_foods"].groupBy(c("food_kind").alias("__kind"), c("name").alias("__name")).agg(
        F.min("id").alias("food_id"))
    kind = F.when(c("food_type") == "OUT_EAT", F.lit("PROCESSED")).otherwise(c("food_type"))
    j = lines.join(brands, c("brand_text") == c("__brand"), "left")
    j = j.join(branches, (c("brand_id") == c("__of")) & (c("branch_text") == c("__branch")), "left")
    j = j.join(foods, (kind == c("__kind")) & (c("item_text") == c("__name")), "left")
    return j.drop("__brand", "__of", "__branch", "__kind", "__name")


# J-10
def new_entities(lines: DataFrame, led) -> DataFrame:
    """Names a batch would register: brands, branches and foods not present yet.

    A branch's scope is the id of its brand, or ``new:`` and the brand's text
    where the brand is new too.  Empty names register nothing.
    """
    m = existing_entity_match(lines, led)
    named = lambda col: F.coalesce(F.trim(c(col)) != "", F.lit(False))
    nb = (m.filter(named("brand_text") & c("brand_id").isNull())
          .select(F.lit("BRAND").alias("entity"), F.lit(None).cast("string").alias("scope"), c("brand_text").alias("name")))
    ns = (m.filter(named("branch_text") & named("brand_text") & c("branch_id").isNull())
          .select(F.lit("BRANCH").alias("entity"),
                  F.coalesce(c("brand_id").cast("string"), F.concat(F.lit("new:"), c("brand_text"))).alias("scope"),
                  c("branch_text").alias("name")))
    nf = (m.filter(c("food_type").isin("UNIVERSAL", "MEASURED", "PROCESSED", "OUT_EAT") & named("item_text") & c("food_id").isNull())
          .select(F.lit("FOOD").alias("entity"),
                  F.when(c("food_type") == "OUT_EAT", F.lit("PROCESSED")).otherwise(c("food_type")).alias("scope"),
                  c("item_text").alias("name")))
    return nb.unionByName(ns).unionByName(nf).distinct()
