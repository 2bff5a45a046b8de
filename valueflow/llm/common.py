"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows up to which a derived table may be broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 200_000

#: Bytes that are not part of a word (ASCII other than digits and letters) become
#: spaces, A-Z become a-z; every byte of a non-ASCII character stays.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased, as UTF-8 bytes."""
    if not text:
        return []
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return raw.translate(_WORD_BYTES).split()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark drops the shuffle files of a query when it ends; else they stay until the driver happens to collect its garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back (cuts the lineage); its shuffle files go at once."""
    path = scratch(df.sparkSession, name)
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def set_aside(df: DataFrame, helpers: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with columns renamed that clash with helper columns, and what gives them their names again."""
    used, fresh = {c.lower() for c in df.columns} | {h.lower() for h in helpers}, {}
    for column in df.columns:
        if column.lower() in {h.lower() for h in helpers}:
            name = column
            while name.lower() in used:
                name += "_"
            fresh[column] = name
            used.add(name.lower())
    return df.withColumnsRenamed(fresh), lambda out: out.withColumnsRenamed({new: old for old, new in fresh.items()})


def join_small(df: DataFrame, small: DataFrame, on: Column | str | list[str], how: str = "inner",
               rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a derived table: broadcast behind a count of its rows, else left to Spark."""
    if small.limit(rows + 1).count() <= rows:
        small = F.broadcast(small)
    return df.join(small, on, how)


#: Rows of ``bits_of`` that may be broadcast (4 KB each).
BROADCAST_BITS = 8192


def bits_of(ids: DataFrame) -> DataFrame:
    """(__bucket, __bits): the numbers in the only column of ``ids``, a bit each, in rows of 32,768 neighbours; written."""
    i = F.col(ids.columns[0])
    return written(ids.groupBy(F.bitmap_bucket_number(i).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(i)).alias("__bits")), "bits")


def among(df: DataFrame, number: str, bits: DataFrame) -> DataFrame:
    """The rows whose ``number`` is one of ``bits_of``.  The bits go to the rows, so wide rows are not shuffled."""
    place = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = join_small(df.withColumn("__bucket", F.bitmap_bucket_number(number)), bits, "__bucket", rows=BROADCAST_BITS)
    return found.filter(F.getbit(byte, (place % 8).cast("int")) == 1).select(*df.columns)


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def holdout(doc_id: Column) -> Column:
    """True for rows whose ``crc32(doc_id as text) mod 5`` is 0; null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
