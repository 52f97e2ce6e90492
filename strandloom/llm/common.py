"""What the text operators share: durable intermediate tables, bounded text batches, row keys."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are worked through in slices of about this many bytes of text.
SLICE_BYTES = 1 << 20
#: ASCII white space; words are runs of anything else.
SPACES = " \t\n\x0b\x0c\r"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    It is the session's own (spark.checkpoint.dir, or one that was set on the context).
    Only a local session may be without one, as in a test: a temporary folder is made then."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder; the plan above starts from there.

    What was shuffled to make them is no longer needed: the driver's collection of garbage lets the
    executors delete it. discard() deletes the table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that durable() made, once what was made of them is stored."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def met(make: Callable[[], DataFrame], keys: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The rows of make(), (key, m, ...), whose key two different m have at least.

    Keys are first counted alone, combined in each task, so that a frequent one is a row a task; the rows
    are made again for the join, which Spark splits where a key is frequent. keys() makes their key and m alone, if that is less work."""
    both = durable((keys or make)().groupBy("key").agg(F.min("m").alias("a"), F.max("m").alias("b")).where("a <> b").select("key"))
    return make().join(both, "key", "left_semi")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(remainder_of: int, doc_id: Column) -> Column:
    """crc32 of the id as text, modulo remainder_of; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % remainder_of


def release() -> None:
    """Gives memory that a worker has freed back to the system: workers stay for later tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_libc(), "malloc_trim", None):
        trim(0)


@cache
def _libc() -> ctypes.CDLL | None:
    """The C library, if it can be had."""
    try:
        return ctypes.CDLL(None)
    except (OSError, TypeError):
        return None


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of the text column, at least a row each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def row_key(*parts: object) -> bytes:
    """16 bytes that stand for a row, equal for equal rows; null differs from any value."""
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        b = b"" if p is None else p if isinstance(p, bytes) else str(p).encode()
        h.update((b"N" if p is None else b"V") + len(b).to_bytes(8, "little") + b)
    return h.digest()


class Memo(dict):
    """A function's values by key, forgotten together once there are too many."""

    def __init__(self, f, most: int = 300_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.f(key)
        return value
