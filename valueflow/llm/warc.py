"""WARC archives: a deterministic sharded writer and a reader.

Writing: payloads are hashed once; rows are counted per (id, url, payload).  Of
the rows with equal payloads the first in order is a response record, the others
revisit it and carry no payload.  Records are ordered by (id, url, payload hash,
copy).  Exact running sizes over that order cut it into shards of ``shard_bytes``
(at most ``MAX_SHARDS``: beyond, shards grow), so shards do not depend on
partitions or samples.  One task writes one shard: it streams records, each a
gzip member, rolls to a new file once the compressed size passes ``file_bytes``,
and regenerates headers, lengths, record ids and digests from the rows.  A file is
written under a temporary name and renamed; the manifest of all files is written
under a temporary name and renamed last.  Reruns give the same bytes; a task that
is run again replaces its files by equal ones; without a manifest there is no
archive.

Reading: the files that the manifest names are dealt over tasks, which stream
members and check lengths, block and payload digests.

Texts move once, to their shard's task; everything else works on slim rows.
Archives go to a shared folder by ``pyarrow.fs``.

Defined cases: a null payload is an empty one; ids and urls may be null (they come
last) and are read back as null; urls with blanks, control or non-ASCII characters
are percent-encoded in the target URI and kept as given in a field of their own;
equal rows are records each, told apart by a copy number; payloads under
``min_bytes`` are all responses; a payload of any length is one record (one record
is in memory at a time); an empty table gives a manifest without files and reads
back as an empty table; other columns of the caller are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, parts, scratch, written

SHARD_BYTES = 64 << 20    # payload and headers of one shard, before compression
MAX_SHARDS = 65_536
FILES_PER_SHARD = 8       # a file rolls at this part of a shard, unless told otherwise
RECORD_BYTES = 512        # counted for the headers of a record
COPIES = 4096             # equal rows that one row of the plan stands for
FLUSH_ROWS = 4096
FLUSH_BYTES = 8 << 20
READ_BYTES = 1 << 20
#: Fixed values of the format.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "shard long, seq long, file string, records long, bytes long, sha256 string"
RECORD = ("file string, record_id string, record_type string, id string, url string, date string, payload_bytes long, payload_digest string, "
          "refers_to string, refers_to_record string, payload binary")


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", uri)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path(old), path(new)):
        raise OSError(f"cannot rename {old} to {new}")


# ---- records ----

def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(id_text: str | None, url: str | None, sha: bytes, copy: int) -> str:
    name = json.dumps([id_text, url, sha.hex(), copy]).encode()
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name).digest()[:16], version=5)}>"


def _target(url: str | None, name: str) -> list[tuple[str, str]]:
    uri = "about:blank" if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~_.-|^`{}<>\"\\")
    return [(f"WARC-{name}-URI", uri)] + ([(f"X-{name}-URL", json.dumps(url))] if uri != url else [])


def record_bytes(kind: str, fields: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member; lengths and the block's digest are made here."""
    fields = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def page_record(row: dict, date: str) -> bytes:
    """The response or revisit record of a row of the plan."""
    revisit = row["payload"] is None
    payload = row["payload"] or b""
    digest = row["sha1"] if revisit else hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id(row["id"], row["url"], row["sha"], row["copy"])), ("WARC-Date", date), *_target(row["url"], "Target")]
    if row["id"] is not None:
        fields.append(("X-Page-ID", json.dumps(row["id"])))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["first_id"], row["first_url"], row["sha"], 1)),
                   *_target(row["first_url"], "Refers-To-Target"), ("WARC-Refers-To-Date", date)]
        if row["first_id"] is not None:
            fields.append(("X-Refers-To-ID", json.dumps(row["first_id"])))
    fields += [("WARC-Payload-Digest", f"sha1:{base32(digest)}"), ("Content-Type", "application/http; msgtype=response")]
    return record_bytes("revisit" if revisit else "response", fields, http + payload)


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream, unpacked one at a time."""
    unpack, out = zlib.decompressobj(31), []
    started = False
    for chunk in chunks:
        while chunk:
            started = True
            out.append(unpack.decompress(chunk))
            chunk = unpack.unused_data if unpack.eof else b""
            if unpack.eof:
                yield b"".join(out)
                unpack, out, started = zlib.decompressobj(31), [], False
    if started:
        raise ValueError("the archive ends inside a record")


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a record; its length and block digest are checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    block = rest[:size]
    if not version.startswith("WARC/1.") or rest[size:] != b"\r\n\r\n" or len(block) != size:
        raise ValueError("a record's length is wrong")
    if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise ValueError("a record's block digest is wrong")
    return fields, block


def page_row(file: str, fields: dict[str, str], block: bytes, with_payload: bool) -> dict:
    """What a response or revisit record says; a response's payload digest and length are taken from its payload."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"{file}: a payload does not fit its digest or length")
    told = lambda name: json.loads(fields[name]) if name in fields else None
    return {"file": file, "record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"], "id": told("X-Page-ID"),
            "url": told("X-Target-URL") if "X-Target-URL" in fields else fields["WARC-Target-URI"], "date": fields["WARC-Date"],
            "payload_bytes": size, "payload_digest": digest, "refers_to": told("X-Refers-To-ID"), "refers_to_record": fields.get("WARC-Refers-To"),
            "payload": payload if response and with_payload else None}


# ---- plan ----

def _no(column: str) -> Column:
    return F.isnull(column)


def _order() -> list[Column]:
    return [_no("id"), F.col("id"), _no("url"), F.col("url"), F.col("sha"), F.col("copy")]


def _copies(rows: DataFrame, most: int) -> DataFrame:
    """A row with its number (``copy``, from 1) for each of the ``count`` equal rows that a row stands for."""
    if most > COPIES:
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(count - 1) div {COPIES}"))))
        rows = rows.repartition(parts(rows.sparkSession), "sha", "id", "url", "block")
        numbers = F.sequence(F.col("block") * COPIES + 1, F.least(F.col("count"), (F.col("block") + 1) * COPIES))
    else:
        numbers = F.sequence(F.lit(1).cast("long"), F.col("count"))
    return rows.withColumn("copy", F.explode(numbers)).drop("block", "count")


def _cuts(records: DataFrame, shard_bytes: int) -> list[tuple]:
    """The first key of every shard but the first, from exact running sizes over the whole order."""
    spark = records.sparkSession
    ranged = records.repartitionByRange(parts(spark), *_order()).sortWithinPartitions(*_order())
    ranged = ranged.select("id", "url", "sha", "copy", "size", F.spark_partition_id().alias("range"))

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            sums = []
            for size in batch.column(4).to_pylist():
                sums.append(before)
                before += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "before"])

    placed = written(ranged.mapInArrow(running, T.StructType([*ranged.schema.fields, T.StructField("before", T.LongType())])), "warc-order")
    offsets, at = {}, 0
    for r in sorted(placed.groupBy("range").agg(F.sum("size").alias("size")).collect(), key=lambda r: r["range"]):
        offsets[r["range"]], at = at, at + r["size"]
    offset = F.create_map(*(F.lit(x) for pair in offsets.items() for x in pair))
    shard = F.floor((F.element_at(offset, F.col("range")) + F.col("before")) / shard_bytes).cast("long")
    firsts = placed.groupBy(shard.alias("shard")).agg(F.min(F.struct(_no("id"), "id", _no("url"), "url", "sha", "copy")).alias("key")).collect()
    discard(placed)
    return [_key(*tuple(r["key"])[1::2][:2], *tuple(r["key"])[4:]) for r in sorted(firsts, key=lambda r: r["shard"])[1:]]


def _key(id_, url, sha, copy) -> tuple:
    """Sorts as ``_order`` does."""
    return (id_ is None, id_ if id_ is not None else 0, url is None, (url or "").encode(), bytes(sha), copy)


def _plan(pages: DataFrame, min_bytes: int, shard_bytes: int) -> tuple[DataFrame, list[tuple], list[DataFrame], int]:
    """(records, cuts, scratch tables that the records read, shard_bytes as used)."""
    hashed = pages.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    keys = written(hashed.groupBy("id", "url", "sha", F.unhex(F.sha1("payload")).alias("sha1"), "bytes").count(), "warc-keys")
    many = keys.filter(F.col("bytes") >= min_bytes).groupBy("sha").agg(
        F.min(F.struct(_no("id").alias("no_id"), "id", _no("url").alias("no_url"), "url", F.col("count").alias("same"))).alias("first"),
        F.sum("count").alias("rows"))
    classes = written(many.filter("rows > 1").select(F.col("sha").alias("class"), F.col("first.id").alias("first_id"),
                                                     F.col("first.url").alias("first_url"), F.col("first.same").alias("same")), "warc-classes")
    first = F.col("id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    most, rows, total = keys.agg(F.max("count"), F.sum("count"), F.sum(F.col("count") * F.col("bytes"))).first()
    counted = _copies(keys.join(classes, F.col("sha") == F.col("class"), "left"), most or 0)
    counted = counted.withColumn("revisit", F.col("class").isNotNull() & ~(first & (F.col("copy") == 1)))

    shard_bytes = max(shard_bytes, -(-((total or 0) + RECORD_BYTES * (rows or 0)) // MAX_SHARDS))
    cuts = []
    if (total or 0) + RECORD_BYTES * (rows or 0) > shard_bytes:
        size = F.when(F.col("revisit"), 0).otherwise(F.col("bytes")) + RECORD_BYTES
        cuts = _cuts(counted.select("id", "url", "sha", "copy", size.alias("size")), shard_bytes)

    large = hashed.filter(F.col("bytes") >= min_bytes).join(classes, F.col("sha") == F.col("class"), "left").filter(F.col("class").isNull() | first)
    one = F.lit(1).cast("long").alias("copy")
    texts = large
    if not classes.filter("same > 1").isEmpty():  # equal rows of which one is the response: merged before they move
        texts = large.filter("class is null or same = 1").select("id", "url", "sha", "bytes", "payload").unionByName(
            large.filter("same > 1").groupBy("id", "url", "sha", "bytes").agg(F.first("payload").alias("payload")))
    responses = texts.select("id", "url", "sha", "bytes", one, "payload")
    if min_bytes > 0:
        small = hashed.filter(F.col("bytes") < min_bytes).groupBy("id", "url", "sha", "bytes", "payload").count()
        responses = responses.unionByName(_copies(small, most or 0).select(*responses.columns))
    records = responses.unionByName(counted.filter("revisit").select("id", "url", "sha", "bytes", "copy", "sha1", "first_id", "first_url"),
                                    allowMissingColumns=True)
    return records, cuts, [keys, classes], shard_bytes


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int | None = None, date: str = DATE) -> str:
    """Writes a record per row below ``folder`` (a new one in the shared folder, if none is given) and returns the folder."""
    spark = pages.sparkSession
    folder = _qualified(spark, folder or scratch(spark, "warc"))
    source = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                          F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    records, cuts, tables, shard_bytes = _plan(source, min_bytes, shard_bytes)
    roll = file_bytes or shard_bytes // FILES_PER_SHARD
    sent = spark.sparkContext.broadcast(cuts)

    @F.arrow_udf("int")
    def shard_of(ids: pa.Array, urls: pa.Array, shas: pa.Array, copies: pa.Array) -> pa.Array:
        keys = zip(ids.to_pylist(), urls.to_pylist(), shas.to_pylist(), copies.to_pylist())
        return pa.array([bisect.bisect_right(sent.value, _key(*k)) for k in keys], pa.int32())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, roll)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                writer.add(row.pop("shard"), page_record(row, date))
            if writer.done:
                yield writer.taken()
        writer.close()
        yield writer.taken()

    placed = records.withColumn("shard", shard_of("id", "url", "sha", "copy") if cuts else F.lit(0)).repartitionById(len(cuts) + 1, F.col("shard"))
    placed = placed.sortWithinPartitions("shard", *_order()).withColumns({c: F.col(c).cast("string") for c in ("id", "first_id")})
    made = placed.mapInArrow(write, MANIFEST)
    made.write.parquet(f"{folder}/_manifest")
    _rename(spark, f"{folder}/_manifest", f"{folder}/manifest")
    discard(*tables)
    return folder


class _Writer:
    """Writes the records of one task: files under temporary names, renamed once whole."""

    def __init__(self, folder: str, roll: int):
        self.folder, self.roll, self.shard, self.seq, self.out, self.done = folder, roll, None, 0, None, []
        self.fs, self.path = fs.FileSystem.from_uri(folder)

    def add(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.seq = shard, 0
        if self.out is None:
            self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
            self.name = f"pages-{shard:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.path}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.sha, self.bytes, self.records = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0
            info = f"software: valueflow\r\nformat: WARC File Format 1.1\r\nisPartOf: pages-{shard:06d}\r\n".encode()
            self._put(record_bytes("warcinfo", [("WARC-Record-ID", record_id(self.name, None, b"", 0)), ("WARC-Date", DATE),
                                                ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(record)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        target = f"{self.path}/{self.name}"
        try:
            self.fs.move(self.temp, target)
        except OSError:  # another attempt of this task was first; its file is the same
            if self.fs.get_file_info(target).size != self.bytes:
                raise
            self.fs.delete_file(self.temp)
        self.done.append((self.shard, self.seq, self.name, self.records, self.bytes, self.sha.hexdigest()))
        self.out, self.seq = None, self.seq + 1

    def taken(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                          names=["shard", "seq", "file", "records", "bytes", "sha256"])


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of an archive: shard, seq, file, records, bytes, sha256."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """A row per response or revisit record of the files that the manifest names.  Files are read whole, by one task each."""
    folder = _qualified(spark, folder)
    files = manifest(spark, folder).select("file")
    n = files.count()
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [c.split()[0] for c in RECORD.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)

        for name in (f for b in batches for f in b.column(0).to_pylist()):
            with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                for member in members(iter(lambda: stream.read(READ_BYTES), b"")):
                    fields, block = parsed(member)
                    if fields["WARC-Type"] in ("response", "revisit"):
                        rows.append(page_row(name, fields, block, with_payload))
                        size += len(rows[-1]["payload"] or b"")
                    if len(rows) >= FLUSH_ROWS or size >= FLUSH_BYTES:
                        yield batch()
                        rows, size = [], 0
        yield batch()

    return files.repartition(max(1, min(n, MAX_SHARDS))).mapInArrow(read, RECORD)
