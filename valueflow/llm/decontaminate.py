"""Benchmark decontamination: prefix-filtered set join with exact windows.

A window is ``window`` consecutive words of a benchmark item (the whole item if
it has fewer).  A document contains a window only if it contains all the
window's shingles, so one shingle is a sufficient prefix: the rarest, by the
number of times the corpus holds it.  Two passes over the documents, both
without any shuffle of texts:

1. count the benchmark's shingles in the corpus (summed per task first);
2. look up every document position among the prefix shingles; a hit names the
   windows and their offset, the bounds (the window must fit between the
   document's ends), a hash of all the window's words and then the words
   themselves decide.

Windows, their owners and the choice of the prefix are tables.  What goes to the
executors by broadcast are flat sorted arrays: shingle numbers for the first
pass; for the second one entry per (window, item).  Entries are dealt by hash, so
one item, one window or one repeated row can fill several groups; a group has
about ``INDEX_BYTES`` as built.  Beyond one group the documents are passed over
once per group, and hits are merged.

Words: ``words()`` of ``common``; shingles have five words, or all of a shorter
window.  Defined cases: null and empty texts have no words and are clean; items
without words have no window; repeated items and item ids count once; a null item
id is named by the empty string; repeated rows are judged each; texts of any
length are read whole; an empty table gives no row, an empty benchmark no hit; a
column named like the result column is replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _WORD_BYTES, discard, words, written

WINDOW = 13
SHINGLE = 5
INDEX_BYTES = 32 << 20
ENTRY_BYTES = 48  # of an entry besides its window and item: shingle, place, words, hash of the window, offsets
KEY_BYTES = 16    # of a shingle that is counted: its number and its count
BATCH_BYTES = 4 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words are hashed in pieces of so many bytes; a longer word by itself.
_PIECE = 1 << 18
_BASE = 0xD1342543DE82EF95
_POWERS = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(_PIECE, _BASE, dtype=np.uint64))), dtype=np.uint64)
_INVERSE = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(_PIECE, pow(_BASE, -1, 2**64), dtype=np.uint64))), dtype=np.uint64)
_OF_BYTE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], dtype=np.uint64)

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                    ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def shingle_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit number for every ``size`` consecutive word ids."""
    n = max(0, len(ids) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out = out * _STEP + ids[i : i + n]
    return out ^ (out >> np.uint64(29))


class Words:
    """The words of several texts in a row; text d has those from ``bounds[d]`` to ``bounds[d + 1]``."""

    def __init__(self, texts: list[bytes]):
        self.clean = b" ".join(texts).translate(_WORD_BYTES)
        inside = np.frombuffer(self.clean, dtype=np.uint8) != 0x20
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.bounds = np.searchsorted(self.starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self.hashes = np.zeros(len(self.starts), dtype=np.uint64)
        lo = 0
        while lo < len(self.starts):
            first = int(self.starts[lo])
            hi = int(np.searchsorted(self.ends, first + _PIECE, side="right"))
            if hi <= lo:
                word = hashlib.blake2b(memoryview(self.clean)[first : int(self.ends[lo])], digest_size=8).digest()
                self.hashes[lo] = int.from_bytes(word, "little")
                lo += 1
                continue
            piece = _OF_BYTE[np.frombuffer(self.clean, dtype=np.uint8, count=int(self.ends[hi - 1]) - first, offset=first)]
            sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(piece * _POWERS[: len(piece)], dtype=np.uint64)))
            a, b = self.starts[lo:hi] - first, self.ends[lo:hi] - first
            mixed = (sums[b] - sums[a]) * _INVERSE[a]
            self.hashes[lo:hi] = mixed ^ (mixed >> np.uint64(32))
            lo = hi

    def between(self, start: int, end: int) -> bytes:
        """The words from ``start`` to ``end``, a blank between them."""
        return b" ".join(self.clean[self.starts[start] : self.ends[end - 1]].split())


def _hash_at(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit number for the ``sizes`` words from each of ``starts`` on."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for i in range(int(sizes.max(initial=0))):
        more = sizes > i
        out[more] = out[more] * _STEP + hashes[starts[more] + i]
    return out


class Index:
    """Entries (window, number and place of its prefix shingle, item), sorted by the shingle, in flat arrays."""

    def __init__(self, entries: pa.Table, shingle: int = SHINGLE):
        hashes = entries["hash"].to_numpy().view(np.uint64)
        order = np.lexsort((hashes, entries["size"].to_numpy()))
        sizes, self.hashes, self.at = entries["size"].to_numpy()[order], hashes[order], entries["at"].to_numpy()[order]
        windows = entries["win"].take(pa.array(order)).to_pylist()
        self.data, self.offsets = b"".join(windows), np.cumsum([0, *map(len, windows)])
        found = Words(windows)
        self.n = np.diff(found.bounds).astype(np.int32)
        self.whole = _hash_at(found.hashes, found.bounds[:-1], self.n)
        items = entries["item"].combine_chunks().dictionary_encode()
        items = items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items
        self.names, self.item = items.dictionary, items.indices.to_numpy(zero_copy_only=False)[order]
        cuts = np.searchsorted(sizes, np.arange(1, shingle + 2))
        self.ranges = {k: (int(cuts[k - 1]), int(cuts[k])) for k in range(1, shingle + 1) if cuts[k - 1] < cuts[k]}

    def _entries(self, found: Words, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, entries whose prefix shingle is there), about ``most`` at a time."""
        for size, (first, last) in self.ranges.items():
            keys, hashes = self.hashes[first:last], shingle_hashes(found.hashes, size)
            lo = np.searchsorted(keys, hashes)
            places = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == hashes)
            lo = lo[places]
            n = np.searchsorted(keys, hashes[places], side="right") - lo
            cut = np.flatnonzero(np.diff(np.cumsum(n) // most, prepend=0))
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(places)]):
                if a < b:
                    k = n[a:b]
                    within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    yield np.repeat(places[a:b], k), np.repeat(lo[a:b], k) + within + first

    def match(self, found: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and by text the items hit."""
        hit, items = np.zeros(len(found.hashes), dtype=bool), defaultdict(set)
        for places, entries in self._entries(found):
            start = places - self.at[entries]
            end = start + self.n[entries]
            d = np.searchsorted(found.bounds, places, side="right") - 1
            fits = (start >= found.bounds[d]) & (end <= found.bounds[d + 1])
            start, end, d, entries = start[fits], end[fits], d[fits], entries[fits]
            same = _hash_at(found.hashes, start, end - start) == self.whole[entries]
            last, there = None, b""
            for a, b, i, e in zip(start[same].tolist(), end[same].tolist(), d[same].tolist(), entries[same].tolist()):
                if last != (a, b):
                    last, there = (a, b), found.between(a, b)
                if self.data[self.offsets[e] : self.offsets[e + 1]] == there:
                    hit[a:b] = True
                    items[i].add(int(self.item[e]))
        return hit, {i: {self.names[k].as_py() for k in v} for i, v in items.items()}


def _batches(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[Words]:
    """The words of some texts, ``most`` bytes or one text at a time."""
    held, size = [], 0
    for text in texts.cast(pa.binary()):
        held.append(text.as_py() or b"")
        size += len(held[-1])
        if size >= most:
            yield Words(held)
            held, size = [], 0
    if held:
        yield Words(held)


def _pairs(items: DataFrame, window: int) -> DataFrame:
    """(win, item): the distinct windows of every item as words with a blank between them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                found = words(text.as_py())
                n = max(1, len(found) - window + 1) if found else 0
                for at in range(0, n, 4096):
                    wins = [b" ".join(found[i : i + window]) for i in range(at, min(at + 4096, n))]
                    yield pa.RecordBatch.from_arrays([pa.array(wins, pa.binary()), pa.array([item] * len(wins), pa.string())], ["win", "item"])

    return written(items.mapInArrow(cut, "win binary, item string").distinct(), "pairs")


def _shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(win, at, size, hash): every shingle of the windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Words(batch.column(0).to_pylist())
            n = np.diff(found.bounds)
            sizes = np.minimum(n, shingle)
            k = n - sizes + 1
            row = np.repeat(np.arange(len(n)), k)
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            hashes = np.zeros(len(row), dtype=np.uint64)
            for size in np.unique(sizes).tolist():
                own = sizes[row] == size
                hashes[own] = shingle_hashes(found.hashes, size)[found.bounds[row[own]] + at[own]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)),
                                              pa.array(sizes[row].astype(np.int32)), pa.array(hashes.view(np.int64))], ["win", "at", "size", "hash"])

    return written(windows.mapInArrow(cut, "win binary, at int, size int, hash long"), "shingles")


def _groups(table: DataFrame, size: Column, keys: list[str], limit: int) -> Iterator[pa.Table]:
    """The rows dealt by hash into groups of about ``limit`` bytes, one group at a time."""
    n = max(1, -(-(table.agg(F.sum(size)).first()[0] or 0) // limit))
    for g in range(n):
        yield table.filter(F.pmod(F.xxhash64(*keys), F.lit(n)) == g).toArrow()


def _counts(docs: DataFrame, text: str, keys: pa.Table) -> DataFrame:
    """(size, hash, n): how often the corpus holds each shingle of a group, a row per task and shingle held."""
    sizes, hashes = keys["size"].to_numpy(), keys["hash"].to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast({int(s): np.sort(hashes[sizes == s]) for s in np.unique(sizes)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = sent.value
        total = {size: np.zeros(len(keys), dtype=np.int64) for size, keys in shingles.items()}
        for batch in batches:
            for found in _batches(batch.column(0)):
                for size, keys in shingles.items():
                    hashes = shingle_hashes(found.hashes, size)
                    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    places, n = np.unique(at[keys[at] == hashes], return_counts=True)
                    total[size][places] += n
        for size, n in total.items():
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), size, dtype=np.int32)), pa.array(shingles[size][held].view(np.int64)),
                                              pa.array(n[held])], ["size", "hash", "n"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "size int, hash long, n long")


def index_entries(docs: DataFrame, items: DataFrame, text: str, window: int = WINDOW, shingle: int = SHINGLE,
                  index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(win, item, size, hash, at): every window of every item with its prefix, the shingle that the corpus holds least."""
    pairs = _pairs(items, window)
    shingles = _shingles(pairs.select("win").distinct(), shingle)
    keys = written(shingles.select("size", "hash").distinct(), "keys")
    n = None
    for group in _groups(keys, F.lit(KEY_BYTES), ["size", "hash"], index_bytes):
        part = _counts(docs, text, group)
        n = part if n is None else n.unionAll(part)
    held = n.groupBy("size", "hash").agg(F.sum("n").alias("n"))
    prefix = shingles.join(held, ["size", "hash"], "left").groupBy("win").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "at", "size")).alias("p"))
    entries = written(pairs.join(prefix, "win").select("win", "item", "p.size", "p.hash", "p.at"), "entries")
    discard(pairs, shingles, keys)
    return entries


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


def _matcher(sent):
    @F.arrow_udf(RESULT)
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index = sent.value
        for texts, before in batches:
            old = iter(before.to_pylist())
            rows = []
            for text in _batches(texts):
                hit, items = index.match(text)
                for d, (a, b) in enumerate(zip(text.bounds[:-1].tolist(), text.bounds[1:].tolist())):
                    own, found = hit[a:b], items.get(d, set())
                    if (was := next(old)) is not None:
                        found = found | set(was["items"])
                        for s in was["hits"]:
                            own[s["start"] : s["end"]] = True
                    rows.append({"n_words": b - a, "n_hit": int(own.sum()), "items": sorted(found), "hits": _spans(own) if found else []})
            yield pa.array(rows, _ARROW)

    return find


def find_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, out: str = "_bench",
                 index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Adds the struct ``out``: n_words, n_hit, items (sorted ids), hits (word positions, end exclusive)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    entries = index_entries(docs, items.filter(F.col("text").isNotNull()), text, window, index_bytes=index_bytes)
    done, last = docs.withColumn(out, F.lit(None).cast(RESULT)), None
    size = F.octet_length("win") + F.octet_length("item") + F.lit(ENTRY_BYTES)
    for g, group in enumerate(_groups(entries, size, ["win", "item"], index_bytes)):
        if g:
            done = written(done, "windows")
            if last is not None:
                discard(last)
            last = done
        index = docs.sparkSession.sparkContext.broadcast(Index(group))
        done = done.withColumn(out, _matcher(index)(F.col(text).cast("string"), F.col(out)))
    discard(entries)
    return done


def is_contaminated(found: Column, share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (found["n_hit"] > 0) & (found["n_hit"] * share >= found["n_words"])
