"""Cross-tokenizer alignment: the byte ranges of two tokenizations, coalesced into groups.

Each text is encoded twice: a byte-level BPE (A) encodes a blank and the text, a
sentence-piece BPE (B) encodes the text and adds the blank itself, so both cover
the same bytes.  All A and B tokens are lexsorted by start and
``maximum.accumulate`` runs over their ends; a group ends where the next start
reaches the running maximum, which is where an A and a B token both end.  Within
the groups the overlaps are expanded: every (A, B) pair of tokens that share
bytes.  An overlap whose two ranges end together is a link.

Of a link's two tokens one is a suffix of the other, so the vocabularies bound
the number of linked id pairs whatever the corpus: a token has at most as many
partners as it has suffixes.  ``pair_counts`` sums them over all rows (a row per
pair and task moves), ``weighed`` broadcasts the sums, behind that bound.

Texts are encoded in segments of about ``SEGMENT`` characters, cut before a blank
that follows a visible ASCII character: the first tokenizer always splits there,
and a cut is only made if no piece of the second reaches over it.  Groups never
reach over a cut either, so memory is bounded by the segment, the text itself
and its groups; a longer run without blanks is one segment.

Defined cases: texts null or empty, texts that are no UTF-8 and texts whose joined
tokens differ from blank + text in either tokenizer (a literal U+2581, say) have no
tokens: counts of 0, an empty string of groups, no links.  Repeated rows are
aligned and counted each; null ids are kept; empty tables give empty tables;
columns of the caller stay, one named like the result column is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = 1 << 19     # characters of a text that are encoded at once
CHUNK_BYTES = 1 << 20  # bytes of texts that are aligned at once
FLUSH_BYTES = 8 << 20  # bytes of texts in one output batch
MAX_PAIRS = 8 << 20    # pairs that may be broadcast; 24 bytes each

#: Fixed value: the pattern by which byte-level BPE splits a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

RESULT = T.StructType([
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()),
    T.StructField("n_links", T.LongType()), T.StructField("groups", T.StringType()),
    T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType())),
])
_ARROW = pa.struct([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                    ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters are themselves, the rest follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class ByteLevel:
    """A byte-level BPE from its JSON; merges in the order of their ids, as one rank per token."""

    def __init__(self, raw: bytes):
        import tiktoken

        model = json.loads(raw)["model"]
        chars = _byte_of_char()
        ids = {bytes(chars[c] for c in entry): i for entry, i in model["vocab"].items() if all(c in chars for c in entry)}
        merged = [ids[bytes(chars[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
        if merged != sorted(set(merged)):
            raise ValueError("merges are not in the order of their ids")
        single = [bytes([b]) for b in range(256)]
        ranks = {t: i for i, t in enumerate(single)} | {t: i for t, i in ids.items() if len(t) > 1}
        if min(merged, default=256) < 256:
            raise ValueError("merges take the ids of single bytes")
        self.tokens = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.tokens[i] = token
        self.of_byte = np.arange(max(ids.values()) + 1, dtype=np.int64)
        self.of_byte[:256] = [ids[t] for t in single]
        self._encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Texts begin with their blank; token numbers by rank, single bytes by value (``of_byte`` has their ids)."""
        return [self._encoding.encode_ordinary(t) for t in texts]


class Pieces:
    """A sentence-piece model."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.tokens = [bytes([int(n[3:-1], 16)]) if self._model.is_byte(i) else b"" if self._model.is_control(i) or self._model.is_unknown(i)
                       else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.cuts = not any(a != " " and b == " " for t in self.tokens for a, b in zip(t.decode("latin-1"), t.decode("latin-1")[1:]))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Texts come without the blank that the model adds."""
        return self._model.encode(texts, num_threads=1)


def segments(text: str, cuts: bool, size: int = SEGMENT) -> list[str]:
    """A blank and the text, in parts that each begin with a blank and are encoded alike alone or together."""
    text, out, lo = " " + text, [], 0
    while cuts and len(text) - lo > size:
        hi = text.find(" ", lo + size)
        while hi >= 0 and not "!" <= text[hi - 1] <= "~":
            hi = text.find(" ", hi + 1)
        if hi < 0:
            break
        out.append(text[lo:hi])
        lo = hi
    return [*out, text[lo:]]


def coalesced(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the intervals by start, and for each in that order the number of its group.  A group ends where
    the next start reaches the largest end so far."""
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.zeros(len(order), dtype=np.int64)
    breaks[1:] = starts[order][1:] >= reached[:-1]
    return order, np.cumsum(breaks)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all pairs of tokens that share bytes; tokens of each side lie end to end from 0."""
    a_starts = np.concatenate((a_ends[:0], [0], a_ends[:-1]))[: len(a_ends)]
    first = np.searchsorted(b_ends, a_starts, side="right")
    last = np.searchsorted(b_ends, a_ends, side="left")
    many = last - first + 1
    a = np.repeat(np.arange(len(a_ends)), many)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


class Aligner:
    """Both tokenizers and the written forms of their ids."""

    def __init__(self, a_raw: bytes, b_raw: bytes):
        self.a, self.b = ByteLevel(a_raw), Pieces(b_raw)
        self.a_bytes = np.array([len(t) for t in self.a.tokens], dtype=np.int64)
        self.b_bytes = np.array([len(t) for t in self.b.tokens], dtype=np.int64)
        a_ids = self.a.of_byte.tolist()
        self.by_rank = [bytes([r]) if r < 256 else self.a.tokens[r] for r in range(len(a_ids))]
        self.rank_bytes = np.array([len(t) for t in self.by_rank], dtype=np.int64)
        # an A id ends with "," or (last of its group) "|"; a B id with "," or ";"
        self.written = [f"{i}{end}" for ids, ends in ((a_ids, ",|"), (range(len(self.b.tokens)), ",;")) for end in ends for i in ids]

    def encoded(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return self.a.encode(parts), self.b.encode([p[1:] for p in parts])

    def aligned(self, a_tokens: list[list[int]], b_tokens: list[list[int]]) -> list[tuple[int, str, np.ndarray]]:
        """For each part (its tokens cover the same bytes on both sides): number of groups, their text, link pairs."""
        a = np.fromiter(chain.from_iterable(a_tokens), dtype=np.int64)
        b = np.fromiter(chain.from_iterable(b_tokens), dtype=np.int64)
        a_ends, b_ends = np.cumsum(self.rank_bytes[a]), np.cumsum(self.b_bytes[b])
        ends = np.concatenate((a_ends, b_ends))
        starts = ends - np.concatenate((self.rank_bytes[a], self.b_bytes[b]))
        order, group = coalesced(starts, ends)
        of = np.empty_like(group)
        of[order] = group
        a_group, b_group = of[: len(a)], of[len(a) :]
        groups = int(group[-1]) + 1 if len(group) else 0
        a_before = np.searchsorted(a_group, np.arange(groups + 1))  # tokens before each group
        b_before = np.searchsorted(b_group, np.arange(groups + 1))
        last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        last_a[a_before[1:] - 1], last_b[b_before[1:] - 1] = 1, 1
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        n_a, n_b = len(self.by_rank), len(self.b_bytes)
        codes[np.arange(len(a)) + b_before[a_group]] = a + last_a * n_a
        codes[np.arange(len(b)) + a_before[b_group + 1]] = b + last_b * n_b + 2 * n_a
        text = [self.written[c] for c in codes.tolist()]
        over_a, over_b = overlaps(a_ends, b_ends)
        link = a_ends[over_a] == b_ends[over_b]
        pairs = (self.a.of_byte[a[over_a[link]]] << 32) | b[over_b[link]]
        out, at_a, at_b = [], 0, 0
        link_a = over_a[link]
        for one_a, one_b in zip(a_tokens, b_tokens):
            lo, hi = at_a + at_b, at_a + at_b + len(one_a) + len(one_b)
            here = slice(*np.searchsorted(link_a, (at_a, at_a + len(one_a))))
            at_a, at_b = at_a + len(one_a), at_b + len(one_b)
            out.append((int(group_count(a_group, at_a - len(one_a), at_a)), "".join(text[lo:hi])[:-1], pairs[here]))
        return out

    def covers(self, part: str, a: list[int], b: list[int]) -> bool:
        raw = part.encode()
        return b"".join(map(self.by_rank.__getitem__, a)) == raw and b"".join(map(self.b.tokens.__getitem__, b)) == raw


def group_count(groups: np.ndarray, lo: int, hi: int) -> int:
    return groups[hi - 1] - groups[lo] + 1 if hi > lo else 0


_NONE = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": "", "pairs": [], "times": []}


class _Text:
    """What is known of one text while its parts are aligned."""

    def __init__(self):
        self.fine, self.n_a, self.n_b, self.n_groups, self.groups, self.pairs = True, 0, 0, 0, [], []

    def result(self) -> dict:
        if not self.fine or not self.n_a:
            return _NONE
        pairs, times = np.unique(np.concatenate(self.pairs), return_counts=True)
        return {"n_a": self.n_a, "n_b": self.n_b, "n_groups": self.n_groups, "n_links": int(times.sum()), "groups": ";".join(self.groups),
                "pairs": pairs, "times": times.astype(np.int32)}


def align_texts(texts: list[bytes | None], aligner: Aligner, segment: int = SEGMENT) -> list[dict]:
    """The result of each text."""
    states = [_Text() for _ in texts]
    waiting: list[tuple[_Text, str]] = []
    size = 0

    def work() -> None:
        nonlocal waiting, size
        a, b = aligner.encoded([p for _, p in waiting])
        for (state, part), x, y in zip(waiting, a, b):
            state.fine = state.fine and aligner.covers(part, x, y)
        kept = [(state, x, y) for (state, _), x, y in zip(waiting, a, b) if state.fine]
        for (state, x, y), (groups, text, pairs) in zip(kept, aligner.aligned([k[1] for k in kept], [k[2] for k in kept])):
            state.n_a, state.n_b, state.n_groups = state.n_a + len(x), state.n_b + len(y), state.n_groups + groups
            state.groups.append(text), state.pairs.append(pairs)
        waiting, size = [], 0

    for state, raw in zip(states, texts):
        try:
            text = raw.decode() if raw else ""
        except UnicodeDecodeError:
            text = ""
        for part in segments(text, aligner.b.cuts, segment) if text else []:
            waiting.append((state, part))
            size += len(part)
            if size >= CHUNK_BYTES:
                work()
    work()
    return [s.result() for s in states]


def _structs(rows: list[dict]) -> pa.StructArray:
    """The rows as Arrow, lists from flat arrays."""
    lists = {}
    for name, kind, value in (("pairs", np.int64, pa.int64()), ("times", np.int32, pa.int32())):
        flat = np.concatenate([np.asarray(r[name], dtype=kind) for r in rows]) if rows else np.zeros(0, dtype=kind)
        offsets = np.concatenate(([0], np.cumsum([len(r[name]) for r in rows]))).astype(np.int32)
        lists[name] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, value))
    return pa.StructArray.from_arrays([lists.get(f.name, pa.array([r[f.name] for r in rows], f.type) if f.name not in lists else None)
                                       for f in _ARROW], fields=list(_ARROW))


_loaded: dict[tuple[int, int], Aligner] = {}


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", out: str = "_align", segment: int = SEGMENT) -> DataFrame:
    """Adds the struct ``out``: n_a, n_b (tokens), n_groups, n_links, groups (``a1,a2|b1;a3|b2``, decimal ids in order),
    pairs (distinct linked id pairs, A id * 2^32 + B id, ascending) and times (links of each).

    The two vocabulary files are read here and sent to the executors (their size is fixed)."""
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast((Path(a_path).read_bytes(), Path(b_path).read_bytes()))
    key = (hash(raw.value[0]), hash(raw.value[1]))
    names = [c for c in docs.columns if c != out]
    kept = docs.select(*(docs[f"`{c}`"] for c in names))
    schema = T.StructType([*kept.schema.fields, T.StructField(out, RESULT)])
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _loaded:
            _loaded[key] = Aligner(*raw.value)
        for batch in batches:
            texts = batch.column(place).cast(pa.binary())
            lo = 0
            while lo < batch.num_rows:
                hi, some, size = lo, [], 0
                while hi < batch.num_rows and size < FLUSH_BYTES:
                    some.append(texts[hi].as_py())
                    size += len(some[-1] or b"")
                    hi += 1
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, _structs(align_texts(some, _loaded[key], segment))], names=[*names, out])
                lo = hi

    return kept.mapInArrow(run, schema)


def max_pairs(a_path: str, b_path: str) -> int:
    """How many id pairs can be linked at all: those of which one token is a suffix of the other."""
    a, b = ByteLevel(Path(a_path).read_bytes()).tokens, Pieces(Path(b_path).read_bytes()).tokens
    total = 0
    for short, long, equal in ((a, b, True), (b, a, False)):
        count: dict[bytes, int] = {}
        for t in filter(None, short):
            count[t] = count.get(t, 0) + 1
        total += sum(count.get(t[at:], 0) for t in long for at in range(0 if equal else 1, len(t)))
    return total


def pair_counts(aligned: DataFrame, out: str = "_align") -> DataFrame:
    """Per linked pair: pair (A id * 2^32 + B id), n (links in all rows), best (no other A id is linked more often with the B id)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            new = np.concatenate((keys, batch.column(0).flatten().to_numpy(zero_copy_only=False)))
            many = np.concatenate((sums, batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
            keys, at = np.unique(new, return_inverse=True)
            sums = np.zeros(len(keys), dtype=np.int64)
            np.add.at(sums, at, many)
        for lo in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + (1 << 16)]), pa.array(sums[lo : lo + (1 << 16)])], names=["pair", "n"])

    links = aligned.select(F.col(f"{out}.pairs").alias("pairs"), F.col(f"{out}.times").alias("times"))
    counts = links.mapInArrow(summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(2**32 - 1)))
    top = counts.groupBy(F.col("b").alias("b_id")).agg(F.max("n").alias("top"))
    return counts.join(top, F.col("b") == F.col("b_id")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def weighed(aligned: DataFrame, counts: DataFrame, bound: int, out: str = "_align") -> DataFrame:
    """Adds n_best (links whose pair is its B id's most frequent) and count_sum (over links, how often their pair is linked) to the struct.

    ``counts`` (of ``pair_counts``) is broadcast; ``bound`` is the largest number of pairs that the vocabularies allow."""
    if bound > MAX_PAIRS:
        raise ValueError(f"the vocabularies allow {bound} linked pairs, more than the {MAX_PAIRS} that may be broadcast")
    table = counts.sort("pair").toArrow()
    sent = aligned.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy()))
    fields = [f for f in aligned.schema[out].dataType.fields if f.name not in ("n_best", "count_sum")]
    more = [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]
    names = [c for c in aligned.columns if c != out]
    kept = aligned.select(*(aligned[f"`{c}`"] for c in names), out)
    schema = T.StructType([*(kept.schema[c] for c in names), T.StructField(out, T.StructType([*fields, *more]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        for batch in batches:
            struct = batch.column(len(names))
            pairs, times = struct.field("pairs"), struct.field("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = np.asarray(pairs.value_lengths(), dtype=np.int64)
            at = np.searchsorted(keys, pairs.flatten().to_numpy(zero_copy_only=False))
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            total = lambda x: pa.array(np.diff(np.concatenate(([0], np.cumsum(x)))[bounds]), pa.int64())
            columns = [*(struct.field(f.name) for f in fields), total(best[at] * times if len(at) else times), total(n[at] * times if len(at) else times)]
            done = pa.StructArray.from_arrays(columns, names=[f.name for f in [*fields, *more]])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], done], names=[*names, out])

    return kept.mapInArrow(run, schema)
