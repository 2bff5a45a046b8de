"""Chat formatting into prefix trees.

1. The rows of a conversation are put in order of turn; every turn gets a
   fixed-width hash of role and text, and their concatenation is the path.
2. Equal conversations share a path and are formatted once.  Sorting by path is
   depth-first order: conversations with the same first turns are neighbours.
   Range partitions cut between any two paths, so a first turn that a third of
   all conversations share is spread over many tasks.
3. Each task walks its paths and emits packs: the text of every new turn once,
   depth-first.  A turn's segment has the position of its first character in its
   own conversation (position ids count on from the parent) and the intervals of
   the pack that it attends to: its ancestors, neighbours merged, then itself up
   to the character at hand.  A pack ends at ``PACK_CHARS`` (a longer
   conversation has a pack of its own); the next one repeats the turns that its
   first conversation needs, as do range partitions.

Template: ``### role: text </turn>`` and a line feed.  Inside texts and roles a
backslash is put before backslashes and the control strings ``###`` and
``</turn>`` (in roles also before ``:``), so reading back is exact.  The loss mask
covers the escaped text of assistant turns.  Units are code points.

Defined cases: null text or role is empty; rows with the same turn are ordered
by role, then text, and all kept; a null conversation id is a conversation; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

PACK_CHARS = 65_536
WIDTH = 16  # hex digits of a turn's hash in the path
TRAINED = "assistant"
#: Control strings of the template.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
CONTROL = re.compile(r"\\|###|</turn>")
ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
HEADER = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)

_INTERVAL = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SEGMENT = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("position", T.LongType()),
    T.StructField("attends", T.ArrayType(_INTERVAL)), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType()),
])
PACK = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("segments", T.ArrayType(SEGMENT)),
    T.StructField("leaves", T.ArrayType(T.StructType([T.StructField("path_id", T.StringType()), T.StructField("segment", T.LongType())]))),
])


def escape(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns = []
    for piece in formatted.split(CLOSE)[:-1]:  # inside a text a backslash, never a blank, stands before </turn>
        head = HEADER.match(piece)
        turns.append((unescape(head[1]), unescape(piece[head.end():])))
    return turns


class _Pack:
    """One pack being filled: segments of the path last added, and all so far."""

    def __init__(self):
        self.text: list[str] = []
        self.chars = 0
        self.segments: list[dict] = []
        self.leaves: list[dict] = []
        self.open: list[int] = []  # segments of the path last added

    def add(self, path_id: str, turns: list[dict], shared: int) -> None:
        del self.open[shared:]
        for turn in turns[shared:]:
            head = OPEN + escape(turn["role"], ROLE_CONTROL) + MIDDLE
            body = escape(turn["text"])
            start, end = self.chars, self.chars + len(head) + len(body) + len(CLOSE)
            parent = self.segments[self.open[-1]] if self.open else None
            attends = [dict(x) for x in parent["attends"]] if parent else []
            if parent:
                if attends and attends[-1]["end"] == parent["start"]:
                    attends[-1]["end"] = parent["end"]
                else:
                    attends.append({"start": parent["start"], "end": parent["end"]})
            trained = turn["role"] == TRAINED
            self.open.append(len(self.segments))
            self.segments.append({
                "start": start, "end": end, "position": parent["position"] + parent["end"] - parent["start"] if parent else 0,
                "attends": attends, "loss_start": start + len(head) if trained else None,
                "loss_end": start + len(head) + len(body) if trained else None})
            self.text += [head, body, CLOSE]
            self.chars = end
        self.leaves.append({"path_id": path_id, "segment": self.open[-1]})

    def row(self) -> dict:
        return {"text": "".join(self.text), "segments": self.segments, "leaves": self.leaves}


def _packs(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(PACK)
        pack, last = _Pack(), ""
        for batch in batches:
            for row in batch.to_pylist():
                path, turns = row["path"], row["turns"]
                shared = 0
                while path[shared * WIDTH : (shared + 1) * WIDTH] == last[shared * WIDTH : (shared + 1) * WIDTH] != "":
                    shared += 1
                if pack.leaves and (not shared or pack.chars + sum(len(t["text"]) for t in turns[shared:]) > limit):
                    yield pa.RecordBatch.from_pylist([pack.row()], schema)
                    pack, shared = _Pack(), 0
                pack.add(row["path_id"], turns, shared)
                last = path
        if pack.leaves:
            yield pa.RecordBatch.from_pylist([pack.row()], schema)

    return run


def conversations_in_order(rows: DataFrame) -> DataFrame:
    """conv_id, path, path_id, turns (array of role, text), written to the shared folder."""
    turns = rows.select("conv_id", F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    whole = whole.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    path = F.array_join(F.transform("turns", lambda t: F.substring(F.sha2(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256), 1, WIDTH)), "")
    return written(whole.withColumn("path", path).withColumn("path_id", F.sha2("path", 256)), "conversations")


def pack_trees(whole: DataFrame, pack_chars: int = PACK_CHARS) -> DataFrame:
    """Packs (``PACK``) of all distinct conversations of ``conversations_in_order``."""
    distinct = whole.groupBy("path").agg(F.any_value("path_id").alias("path_id"), F.any_value("turns").alias("turns"))
    return distinct.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_packs(pack_chars), PACK)


def leaf_text(pack: dict, segment: int) -> tuple[str, str]:
    """(formatted conversation, escaped text under the loss mask) that ends with a segment, by its attention intervals."""
    own = pack["segments"][segment]
    spans = [*((x["start"], x["end"]) for x in own["attends"]), (own["start"], own["end"])]
    masked = [(s["loss_start"], s["loss_end"]) for s in pack["segments"]
              if s["loss_start"] is not None and any(a <= s["start"] and s["end"] <= b for a, b in spans)]
    text = pack["text"]
    return "".join(text[a:b] for a, b in spans), "".join(unescape(text[a:b]) for a, b in masked)


def read_back(packs: DataFrame) -> DataFrame:
    """What each distinct conversation reads as: path_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for pack in batch.to_pylist():
                for leaf in pack["leaves"]:
                    formatted, loss = leaf_text(pack, leaf["segment"])
                    turns = read_turns(formatted)
                    rows.append((leaf["path_id"], len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)))
            names = ["path_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return packs.mapInArrow(run, "path_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(rows: DataFrame, pack_chars: int = PACK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(packs, membership): the prefix trees, and conv_id with the path_id of its leaf."""
    whole = conversations_in_order(rows)
    return pack_trees(whole, pack_chars), whole.select("conv_id", "path_id")
