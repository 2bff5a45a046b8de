"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (all words of a shorter text are one);
two are linked if their Jaccard similarity is ``threshold`` or more.

1. Documents with equal word sequences form a class; only its first row goes on,
   with the class's size, so copies are never paired.
2. Candidates by a lossless prefix filter: with shingles ordered by rarity, two
   sets that reach the threshold share one of the first
   n - ceil(threshold * n) + 1 of each.  Rarity comes from a table of
   ``COUNTERS`` hashed counts over all documents; any fixed order keeps the filter
   exact, and counts let shared passages and boilerplate come last.  Lengths and
   places bound the overlap further inside the join.
   A prefix token of ``HOT`` or more documents gives a star of them instead of pairs.
   Documents of a star whose MinHash values (as in 3) leave them likely to be linked
   are tied into a cluster, so documents that only share a phrase are not; a cluster's
   documents are compared in blocks, and a block gives a row for each document, not
   for each pair.
3. MinHash values of candidate pairs are compared ``STEP`` at a time; after each
   step a pair goes if the posterior probability of reaching the threshold (uniform
   prior) is below ``TOLERANCE``.
4. What is left is verified on the whole shingle sets, which are made for the
   documents of clusters and likely pairs only.
5. Connected components of the links are the duplicate classes.

Rows keep a number that is written with them once, so a lost executor or another
split of the input changes nothing.  Defined cases: null texts are alone; texts
without words equal only the same text; repeated rows, and rows without id, are
documents of their own; texts of any length are read whole; an empty table gives
no row; other columns pass through; columns named like the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, bits_of, discard, join_small, set_aside, words, written
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
COUNTERS = 1 << 20
HASHES = 128
STEP = 32
HOT = 32            # documents that share a prefix token, from which on they are a star
BLOCK = 512         # documents of a cluster that are compared with as many in one group
TOLERANCE = 1e-6
SLICE = 1024        # documents whose shingle sets a worker holds at once
_CACHE = 150_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20_250).integers(0, 2**63, HASHES, dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | bytes | None, cache: dict, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    found = words(text)
    if not found:
        return np.empty(0, dtype=np.uint64)
    ids = np.fromiter(map(cache.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(size, len(ids))
    n = len(ids) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out = (out ^ ids[i : i + n]) * _MUL
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(sh: np.ndarray) -> np.ndarray:
    """``HASHES`` MinHash values, 16 bits of each minimum."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(sh), 4096):
        x = (sh[at : at + 4096, None] ^ _SEEDS) * _MUL
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    return (least & np.uint64(0xFFFF)).astype(np.uint16)


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By number of values compared: the fewest equal ones that a pair is kept with.

    With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1); that it reaches t is the chance of
    at most m successes in n + 1 draws with chance t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def word_print(text: Column) -> Column:
    """Equal for equal word sequences; of a text without words, for equal texts; null for null."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(F.length(plain) > 0, F.md5(plain.cast("binary"))).when(text.isNotNull(), F.concat(F.lit("raw:"), F.md5(text.cast("binary"))))


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    cache = _WordHashes()
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            yield part, [shingles(t.as_py(), cache) for t in part.column(column).cast(pa.binary())]


def rarity_table(docs: DataFrame, tasks: int) -> np.ndarray:
    """Hashed counts of all shingles: ``COUNTERS`` numbers whatever the input, summed in ranges."""
    width = COUNTERS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for _, sets in _texts(batches, "text"):
            if sets:
                total += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        parts = [total[i * width : (i + 1) * width].tobytes() for i in range(64)]
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int64()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in rows["counts"].to_pylist())
        return pa.table({"part": rows["part"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select("text").coalesce(tasks).mapInArrow(count, "part long, counts binary").groupBy("part").applyInArrow(add, "part long, counts binary").collect()
    table = np.zeros(COUNTERS, dtype=np.int64)
    for p in parts:
        table[p["part"] * width : (p["part"] + 1) * width] = np.frombuffer(bytes(p["counts"]), np.int64)
    return np.minimum(table, 2**31 - 1).astype(np.int32)


def prefix_tokens(reps: DataFrame, rarity: np.ndarray, threshold: float) -> DataFrame:
    """(token, rid, n, pos): the rarest shingles of every document that a partner must share one of."""
    sent = reps.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = sent.value
        for b, sets in _texts(batches, "text"):
            tokens, rids, ns, places = [], [], [], []
            for rid, sh in zip(b.column("rid").to_pylist(), sets):
                if not len(sh):
                    continue
                p = len(sh) - math.ceil(threshold * len(sh) - 1e-9) + 1
                order = np.lexsort((sh, rarity[(sh & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:p]
                tokens.append(sh[order].view(np.int64))
                rids.append(np.full(p, rid)), ns.append(np.full(p, len(sh))), places.append(np.arange(p))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(rids), pa.int64()),
                                                  pa.array(np.concatenate(ns).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32))], ["token", "rid", "n", "pos"])

    return reps.select("rid", "text").mapInArrow(run, "token long, rid long, n int, pos int")


def _can_reach(threshold: float, na, nb, pa, pb) -> np.ndarray:
    """Bounds by length and by place of a shared token: whether the pair can still reach the threshold."""
    overlap = np.minimum(pa, pb) + 1 + np.minimum(na - pa - 1, nb - pb - 1)
    return (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9) & (overlap * (1 + threshold) >= threshold * (na + nb) - 1e-9)


def candidates(tokens: DataFrame, threshold: float, hot: int = HOT) -> DataFrame:
    """(a, b, hot): pairs, a < b, that share a prefix token and can still reach the threshold.

    A token of ``hot`` or more documents gives no pairs but a star: its first document with each of the others.
    So there are at most ``hot`` / 2 rows for each row of ``tokens``, however many documents share one.
    """

    def pairs_of(t, r, n, p, star_token) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        starts = np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1))
        sizes = np.diff(np.append(starts, len(t)))
        stars = (sizes >= hot) | (t[starts] == star_token if star_token is not None else False)
        out = []
        for m in np.unique(sizes[~stars & (sizes > 1)]).tolist():
            i, j = np.triu_indices(m, 1)
            base = starts[~stars & (sizes == m)][:, None]
            x, y = (base + i).ravel(), (base + j).ravel()
            fits = _can_reach(threshold, n[x], n[y], p[x], p[y])
            out.append((r[x[fits]], r[y[fits]], np.zeros(int(fits.sum()), dtype=bool)))
        for at, m in zip(starts[stars].tolist(), sizes[stars].tolist()):
            out.append((np.full(m - 1, r[at]), r[at + 1 : at + m], np.ones(m - 1, dtype=bool)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, star_token = None, None  # rows of the token last seen; of a star its first row only
        for b in batches:
            cur = [b.column(c).to_numpy() for c in ("token", "rid", "n", "pos")]
            if held is not None:
                cur = [np.concatenate(x) for x in zip(held, cur)]
            if not len(cur[0]):
                continue
            cut = int(np.searchsorted(cur[0], cur[0][-1]))
            out = pairs_of(*(x[:cut] for x in cur), star_token) if cut else []
            held = [x[cut:] for x in cur]
            if len(held[0]) >= hot or held[0][0] == star_token:
                star_token = held[0][0]
                out += pairs_of(*held, star_token)
                held = [x[:1] for x in held]
            yield from _pair_batches(out)
        if held is not None:
            yield from _pair_batches(pairs_of(*held, star_token))

    by_token = tokens.repartition("token").sortWithinPartitions("token", "rid")
    return by_token.mapInArrow(run, "a long, b long, hot boolean").distinct()


def _pair_batches(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b", "hot"])


def _signed(docs: DataFrame) -> DataFrame:
    """(rid, n, sig): number of shingles and MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _texts(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array([len(s) for s in sets], pa.int32()), pa.array([signature(s).tobytes() for s in sets], pa.binary())], ["rid", "n", "sig"])

    return docs.select("rid", "text").mapInArrow(run, "rid long, n int, sig binary")


def _whole(docs: DataFrame) -> DataFrame:
    """(rid, sh): whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _texts(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array([s.tobytes() for s in sets], pa.binary())], ["rid", "sh"])

    return docs.select("rid", "text").mapInArrow(run, "rid long, sh binary")


def prune(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose posterior probability of reaching the threshold stays above the tolerance at every step."""
    fewest = fewest_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            alive, same = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
            for n, least in fewest.items():
                same = same + (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(axis=1)
                keep = same >= least
                alive, same = alive[keep], same[keep]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return _both(pairs, signed, "sig").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, whole: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold on their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column("sh_a"), batch.column("sh_b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                found.append(both / (len(x) + len(y) - both))
            keep = np.flatnonzero(np.array(found) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(np.array(found)[keep])], ["a", "b", "similarity"])

    return _both(pairs, whole, "sh").mapInArrow(run, "a long, b long, similarity double")


def _in_blocks(members: DataFrame, block: int, *about: DataFrame) -> DataFrame:
    """The members (rid, cluster) with what ``about`` has of their rids, a row of each for every pair (i, j) of blocks of
    its cluster that it is in: every block meets every other in one group of at most about two blocks."""
    blocks = members.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    placed = members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    for table in about:
        placed = placed.join(table, "rid")
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))


def _likely(k: int, others: np.ndarray, sig: np.ndarray, counts: np.ndarray, fewest: dict[int, int], threshold: float) -> np.ndarray:
    """The others that can reach the threshold with document k by their numbers of shingles and, step by step, by MinHash."""
    alive = others[np.minimum(counts[others], counts[k]) >= threshold * np.maximum(counts[others], counts[k]) - 1e-9]
    same = np.zeros(len(alive), dtype=np.int64)
    for n, least in fewest.items():
        same = same + (sig[alive, n - STEP : n] == sig[k, n - STEP : n]).sum(axis=1)
        keep = same >= least
        alive, same = alive[keep], same[keep]
    return alive


def _tie(label: np.ndarray, k: int, others: np.ndarray) -> None:
    """Gives k, the others and what they are tied to the least of their labels."""
    found = np.unique(label[np.append(others, k)])
    if len(found) > 1:
        label[np.isin(label, found)] = found[0]


def ties(stars: DataFrame, signed: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b): of the documents that share a star, those that are likely to be linked, or tied by others that are.

    Linked documents that share a token of many documents are in its star, so they are tied.  Documents that share
    no more than a phrase are not, however many do: clusters do not grow together over phrases.
    """
    fewest = fewest_matches(threshold)

    def run(rows: pa.Table) -> pa.Table:
        rids, own, at_i, at_j, counts = (rows[c].to_numpy() for c in ("rid", "block", "i", "j", "n"))
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)
        left, right = np.flatnonzero(own == at_i[0]), np.flatnonzero(own == at_j[0])
        label = np.arange(len(rids))
        for k in left.tolist():
            open_ = right[(label[right] != label[k]) & (right > k if at_i[0] == at_j[0] else True)]
            _tie(label, k, _likely(k, open_, sig, counts, fewest, threshold))
        some = np.flatnonzero(label != np.arange(len(rids)))
        return pa.table({"a": pa.array(rids[label[some]]), "b": pa.array(rids[some])})

    members = stars.select(F.col("a").alias("cluster"), F.col("b").alias("rid")).unionByName(stars.select(F.col("a").alias("cluster"), F.col("a").alias("rid"))).distinct()
    rows = _in_blocks(members, block, signed).select("cluster", "i", "j", "block", "rid", "n", "sig")
    return rows.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def clusters(tied: DataFrame) -> DataFrame:
    """(rid, cluster) of the documents that ``ties`` tie together."""
    return components(tied).select(F.col("node").alias("rid"), F.col("root").alias("cluster"))


def within_clusters(members: DataFrame, signed: DataFrame, whole: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(rid, links, root) for documents of clusters that have links in theirs.

    ``members``: rid, cluster, size.  In a group of two blocks all pairs are compared by their MinHash values in steps,
    and the rest on the whole sets, but what leaves the group is a row for each document: how many documents it is
    linked with, and a document that links of this group tie it to.
    """
    fewest = fewest_matches(threshold)

    def run(rows: pa.Table) -> pa.Table:
        rids, sizes = rows["rid"].to_numpy(), rows["size"].to_numpy()
        own, at_i, at_j, counts = (rows[c].to_numpy() for c in ("block", "i", "j", "n"))
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)
        sets = [np.frombuffer(x, np.uint64) for x in rows["sh"].to_pylist()]
        right = np.flatnonzero(own == at_j[0])
        place = np.empty(len(rids), dtype=np.int64)
        place[right] = np.arange(len(right))
        known, flat = np.unique(np.concatenate([sets[k] for k in right]), return_inverse=True) if len(right) else (np.empty(0, np.uint64), np.empty(0, np.int64))
        starts = np.concatenate(([0], np.cumsum(counts[right])))[:-1]
        links, label = np.zeros(len(rids), dtype=np.int64), np.arange(len(rids))
        for k in np.flatnonzero(own == at_i[0]).tolist():
            alive = _likely(k, right[right > k] if at_i[0] == at_j[0] else right, sig, counts, fewest, threshold)
            if not len(alive):
                continue
            mine = np.zeros(len(known) + 1, dtype=np.int64)
            at = np.searchsorted(known, sets[k])
            mine[at[known[np.minimum(at, len(known) - 1)] == sets[k]]] = 1
            both = np.add.reduceat(mine[flat], starts)[place[alive]]
            linked = alive[both >= (threshold - 1e-12) * (counts[k] + counts[alive] - both)]
            links[k] += sizes[linked].sum()
            links[linked] += sizes[k]
            _tie(label, k, linked)
        some = np.flatnonzero(links)
        return pa.table({"rid": pa.array(rids[some]), "links": pa.array(links[some]), "root": pa.array(rids[label[some]])})

    rows = _in_blocks(members, block, signed, whole).select("cluster", "i", "j", "block", "rid", "size", "n", "sig", "sh")
    return rows.groupBy("cluster", "i", "j").applyInArrow(run, "rid long, links long, root long")


def _both(pairs: DataFrame, about: DataFrame, column: str) -> DataFrame:
    side = lambda s: about.select(F.col("rid").alias(s), F.col(column).alias(f"{column}_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with ``__rid`` and ``__print``, written to the shared folder."""
    return written(docs.withColumn("__rid", F.monotonically_increasing_id()).withColumn("__print", word_print(F.col("text").cast("string"))), "numbered")


def links(stored: DataFrame, threshold: float = THRESHOLD, hot: int = HOT, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, degree, edges): print, rid, size and least id of every class of copies; per rid the number of linked
    documents; and (a, b) of enough links to connect what is connected."""
    spark = stored.sparkSession
    classes = written(stored.filter(F.col("__print").isNotNull()).groupBy(F.col("__print").alias("print")).agg(
        F.min("__rid").alias("rid"), F.count("*").alias("size"), F.min("doc_id").alias("least_id")), "classes")
    sizes = classes.select("rid", "size")
    rows = stored.filter(F.col("__print").isNotNull() & ~F.col("__print").startswith("raw:")).select(F.col("__rid").alias("rid"), F.col("text").cast("string").alias("text"))
    firsts = bits_of(classes.select("rid"))
    reps = among(rows, "rid", firsts)
    tokens = prefix_tokens(reps, rarity_table(reps, 2 * spark.sparkContext.defaultParallelism), threshold)
    found = written(candidates(tokens, threshold, hot), "candidates")
    asked = bits_of(found.select("a").unionByName(found.select(F.col("b").alias("a"))))
    signed = written(_signed(among(rows, "rid", asked)), "signed")

    tied = written(clusters(ties(found.filter("hot"), signed, threshold, block)), "clusters")
    mark = lambda s: tied.select(F.col("rid").alias(s), F.col("cluster").alias(f"cluster_{s}"))
    pairs = join_small(join_small(found.filter("not hot").select("a", "b"), mark("a"), "a", "left"), mark("b"), "b", "left")
    pairs = pairs.filter("cluster_a is null or cluster_b is null or cluster_a <> cluster_b").select("a", "b")
    likely = written(prune(pairs, signed, threshold), "likely")
    left = bits_of(tied.select("rid").unionByName(likely.select(F.col("a").alias("rid"))).unionByName(likely.select(F.col("b").alias("rid"))))
    whole = written(_whole(among(rows, "rid", left)), "whole")
    inside = written(within_clusters(tied.join(sizes, "rid"), signed, whole, threshold, block), "inside")
    real = written(verify(likely, whole, threshold), "links")
    discard(firsts, found, asked, signed, tied, likely, left, whole)

    partner = lambda me, other: real.select(F.col(me).alias("me"), F.col(other).alias("rid"))
    outside = partner("a", "b").unionByName(partner("b", "a")).join(sizes, "rid").select(F.col("me").alias("rid"), F.col("size").alias("links"))
    degree = outside.unionByName(inside.select("rid", "links")).groupBy("rid").agg(F.sum("links").alias("links"))
    return classes, degree, real.select("a", "b").unionByName(inside.select(F.col("root").alias("a"), F.col("rid").alias("b")))


def join(docs: DataFrame, threshold: float = THRESHOLD, out: str = "_near", hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Adds the struct ``out``: class_id (least id of the component), n_links (documents, copies included, that reach
    the threshold with this one), first (true for one row of each class)."""
    docs, back = set_aside(docs.drop(out), ["__rid", "__print", "__p", "__g"])
    stored = numbered(docs)
    classes, degree, edges = links(stored, threshold, hot, block)
    roots = components(edges).withColumnRenamed("node", "rid")
    classes = classes.join(degree, "rid", "left").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    # a component of one class is its own; only the others look their names up, so one large component fills no task
    names = written(classes.groupBy("root").agg(F.min("least_id").alias("class_id"), F.min("rid").alias("first_rid"), F.count("*").alias("members")).filter("members > 1"), "names")
    named = join_small(classes, names, "root", "left").withColumns({"class_id": F.coalesce("class_id", "least_id"), "first_rid": F.coalesce("first_rid", "rid")})
    groups = named.filter("size > 1 or links > 0").select(
        F.col("print").alias("__p"), F.struct("class_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.col("first_rid")).alias("__g"))
    placed = stored.join(groups, F.col("__print") == F.col("__p"), "left")
    return back(placed.withColumn(out, F.struct(
        F.coalesce(F.col("__g.class_id"), F.col("doc_id")).alias("class_id"), F.coalesce(F.col("__g.n_links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("__g.first_rid") == F.col("__rid"), F.lit(True)).alias("first"))).drop("__rid", "__print", "__p", "__g"))
