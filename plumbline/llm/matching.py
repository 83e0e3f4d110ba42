"""Finding equal strings across a corpus without ever gathering a group of them.

Documents are dealt into groups of a few MB by a hash of their id. A group
sends each distinct value once, packed by hash bucket into one binary row per
(bucket, group); a bucket answers each group with the values it shares with
others. However often a value occurs, a bucket holds it once per group, so hot
values cost no more than the number of groups, and there is no list of pairs.

`shared_values` does so with 32-bit keys, as a filter: false hits are allowed.
Callers that need more then compare wide hashes of whole windows in the same
way (`by_bucket`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SENT = pa.schema([("bucket", pa.int32()), ("bid", pa.int32()), ("vals", pa.binary())])
SENT_DDL = "bucket int, bid int, vals binary"
ANSWER_DDL = "bid int, kind int, bucket int, vals binary"
ANSWER = pa.schema([("bid", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("vals", pa.binary())])


def keys32(h: np.ndarray, buckets: int) -> np.ndarray:
    """(bucket << 32 | low half) of 64-bit hashes."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def pack(bid: int, keys: np.ndarray) -> pa.Table:
    """Distinct keys, one row per bucket."""
    keys = np.unique(keys)
    b = (keys >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(b, prepend=-1))
    low = keys.astype(np.uint32)
    ends = [*cut[1:], len(keys)]
    return pa.table([pa.array(b[cut].astype(np.int32)), pa.array(np.full(len(cut), bid, np.int32)),
                     pa.array([low[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())], schema=SENT)


def _answer_shared(key: tuple, t: pa.Table) -> pa.Table:
    blobs, bids = t.column("vals").to_pylist(), t.column("bid").to_numpy()
    vals = np.frombuffer(b"".join(blobs), np.uint32)
    size = np.array([len(b) // 4 for b in blobs])
    order = np.argsort(vals, kind="stable")
    v = vals[order]
    same = np.zeros(len(v), bool)
    eq = v[1:] == v[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    hit = np.zeros(len(v), bool)
    hit[order] = same
    ends = np.cumsum(size)
    out = [(bids[i], vals[e - s : e][m].tobytes()) for i, (s, e) in enumerate(zip(size, ends)) if (m := hit[e - s : e]).any()]
    k = len(out)
    return pa.table([pa.array([o[0] for o in out], pa.int32()), pa.array([0] * k, pa.int32()),
                     pa.array([key[0].as_py()] * k, pa.int32()), pa.array([o[1] for o in out], pa.binary())], schema=ANSWER)


def shared_values(sent: DataFrame, partitions: int) -> DataFrame:
    """Answers of kind 0: for each group and bucket, its values that another group sent too."""
    return sent.repartition(partitions, "bucket").groupBy("bucket").applyInArrow(_answer_shared, ANSWER_DDL)


def answered_keys(answers: pa.Table) -> np.ndarray:
    """Sorted keys of a group's answers of kind 0."""
    out = [np.zeros(0, np.uint64)]
    for kind, bucket, vals in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "vals"))):
        if kind == 0:
            out.append(np.frombuffer(vals, np.uint32).astype(np.uint64) | np.uint64(bucket) << np.uint64(32))
    return np.sort(np.concatenate(out))


def member(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


#: A wide hash of a window: 64 bits and 32 more.
ENTRY = np.dtype([("h", "<u8"), ("g", "<u4")])


def by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of entries by bucket (stable), the buckets present and the n + 1 cuts."""
    b = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)  # 16 bits are sorted by radix
    order = np.argsort(b, kind="stable")
    present, first = np.unique(b[order], return_index=True)
    return order, present, np.append(first, len(b))
