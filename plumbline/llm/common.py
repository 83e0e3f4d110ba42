"""What several text operators share: sizing, shared storage, Arrow text access and hashing.

Sizing. `Layout` measures a corpus once (rows, bytes) and derives every
partition, group and bucket count from it, so that each task's data stays of
the same size on any input.

Storage. `stored` cuts lineage by writing Parquet into the folder named by
spark.checkpoint.dir, which all executors share. Only where that is unset and
the master is local (as in tests) is a local temporary folder used.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.storage import clear, new_path  # noqa: F401  operators take them from here

U64 = np.uint64


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Write df to shared storage and read it back: later failures restart from the files."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id (bigint), text and further columns of docs, for a map over Arrow batches.

    Rows may be long, so batches are bounded by bytes, not by Spark's 64 MB;
    a session that sets its own bound keeps it.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name).rstrip("b") == str(64 << 20):
        conf.set(name, str(4 << 20))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *more)


@dataclass(frozen=True)
class Layout:
    """Sizes of a run. group_bytes: text of one group of documents; task_bytes: text of one task.

    Groups send packed rows to buckets, so both grow with the root of a corpus
    beyond 64 GB, up to four times, lest a row hold less than a value.
    """

    rows: int
    bytes: int
    partitions: int
    groups: int
    buckets: int

    @staticmethod
    def of(docs: DataFrame, text: str = "text", group_bytes: int = 2 << 20, task_bytes: int = 64 << 20, bucket_bytes: int = 64 << 20) -> Layout:
        n, total = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
        total = int(total or 0)
        grown = min(4.0, max(1.0, math.sqrt(total / (64 << 30))))
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / task_bytes))
        return Layout(n, total, parts, max(1, math.ceil(total / (group_bytes * grown))), max(4 * parts, math.ceil(total / (bucket_bytes * grown))))

    def group(self) -> Column:
        """The group of a row of (doc_id, text): by both, so that rows without an id or with a common one spread too."""
        return F.pmod(F.xxhash64(F.col("doc_id").cast("bigint"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))), F.lit(self.groups)).cast("int")

    def dealt(self, docs: DataFrame) -> DataFrame:
        """doc_id, text and group (bid) of docs, one exchange by group that several passes can share."""
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", self.group().alias("bid")).repartition(self.partitions, "bid")


def text_arrays(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker stays for later tasks, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection of 64-bit words."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inv)):
                p = np.full(size, b, U64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


POWERS = (Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93))


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of (value + 1) * base^i modulo 2^64, n + 1 long."""
    up, _ = POWERS[which].get(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[:-1], out=out[1:])
    return out


def spans_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of values[start:end] for each pair, from the prefix sums; equal content, equal hash."""
    _, down = POWERS[which].get(len(pre))
    return mix((pre[end] - pre[start]) * down[start])


def window_hashes(values: np.ndarray, width: int, which: int = 0, chunk: int = 1 << 18) -> np.ndarray:
    """`spans_hash` of values[i : i + width] for every i with room, a chunk at a time."""
    out = np.empty(max(0, len(values) - width + 1), U64)
    for a in range(0, len(out), chunk):
        m = min(chunk, len(out) - a)
        pre = prefix(values[a : a + m + width - 1], which)
        _, down = POWERS[which].get(len(pre))
        out[a : a + m] = mix((pre[width : width + m] - pre[:m]) * down[:m])
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word [^\\x20\\x09-\\x0D]+, and the n + 1 word offsets of the documents."""
    n = len(data)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    brk = np.zeros(n + 1, bool)
    brk[offsets] = True
    first, last = solid.copy(), solid.copy()
    if n:
        first[1:] &= ~solid[:-1] | brk[1:n]
        last[:-1] &= ~solid[1:] | brk[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def cover(start: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask over n places of the union of [s, s + length), for distinct starts."""
    d = np.zeros(n + 1, np.int32)
    d[start] = 1
    end = np.minimum(start + length, n)
    d[end[end < n]] -= 1
    return np.cumsum(d[:-1], dtype=np.int32) > 0
