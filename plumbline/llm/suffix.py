"""Suffix-array dedup on bytes.

A 400-byte string that starts in two places is found in three steps.

1. Winnowing: each 400-byte window picks the smallest of its 48-byte hashes
   (the rightmost on ties), so equal windows pick equal ones. Windows whose
   pick occurs nowhere else are out. Only the picks travel.
2. Two-stage suffix sorting of what remains in a group of documents: suffixes
   smaller than their successor are sorted directly, all others are induced by
   one scan over the byte buckets, and adjacent common prefixes cut the array
   into classes of equal windows. A class of two or more is a repeat.
3. One wide hash per class, and whether it is a repeat already, go to hash
   buckets (see `matching`). Each group gets back a bit per class: a repeat,
   there or elsewhere. It finds the classes of its windows again by hash.

Documents are shuffled once; equal windows are never gathered. Copies of a
whole text are found first, by their MD5 counts: every window of a copy is a
repeat, and one copy in one group takes part in the three steps for all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import matching as M
from plumbline.llm.common import Layout, cover, runs, stored, text_arrays, window_hashes

GRAM = 48
STEP = 8
#: Bytes that a tie passes over at once.
SKIPS = (128, 32)
CHUNK = 1 << 18
SENT_DDL = "bucket int, bid int, h binary, own binary"
OUT_DDL = "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def eights(t: np.ndarray, depth: int) -> np.ndarray:
    """The 8 bytes at each place as a big-endian number, zeros past the end; room for `depth` more places."""
    padded = np.zeros(len(t) + depth + STEP, np.uint64)
    padded[: len(t)] = t
    out = padded.copy()
    for k in range(1, STEP):
        out <<= np.uint64(8)
        out[: len(padded) - k] |= padded[k:]
    return out


def is_small(t: np.ndarray) -> np.ndarray:
    """Is the suffix smaller than its successor? The last suffix is not."""
    n = len(t)
    last = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)  # last place of each run of one byte
    up = np.append(t[last[:-1] + 1] > t[last[:-1]], False)
    return np.repeat(up, np.diff(last, prepend=-1))


def whole(t: np.ndarray, width: int, depth: int) -> np.ndarray:
    """A 64-bit hash of the `width` bytes at each place, zeros past the end; room for `depth` more places."""
    return window_hashes(np.append(t, np.zeros(depth + width, np.uint8)), width)


def sort_directly(pos: np.ndarray, e: np.ndarray, depth: int, alike: np.ndarray, skips: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Places in order of their first `depth` bytes: 8 bytes at once, then 5 more at a time where still tied.

    alike has the `whole` hashes of depth bytes: ties that are all alike are
    left. skips has hashes of fewer bytes, widest first: what all places of a
    tie share is passed over.
    """
    out = pos[np.argsort(e[pos])]
    key = e[out]
    group = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(group, len(out)))
    tied = np.repeat(size > 1, size)
    at, gid = np.flatnonzero(tied), np.repeat(np.arange(len(group)), size)[tied]
    d = np.full(len(at), STEP)
    while len(at):
        first = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
        size = np.diff(np.append(first, len(at)))

        def shared(values: np.ndarray) -> np.ndarray:
            same = np.append(True, values[1:] == values[:-1])
            same[first] = True  # noqa: B023
            return np.repeat(np.logical_and.reduceat(same, first), size)  # noqa: B023

        still = ~shared(alike[out[at]]) & (d < depth)
        at, gid, d = at[still], gid[still], d[still]
        if not len(at):
            break
        first = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
        size = np.diff(np.append(first, len(at)))
        p = out[at]
        for width, values in skips:
            while (more := shared(values[np.minimum(p + d, len(values) - 1)]) & (d < depth)).any():
                d[more] += width
        d = np.minimum(d, depth)
        key = gid.astype(np.uint64) << np.uint64(40) | e[p + d] >> np.uint64(24)
        order = np.argsort(key)
        out[at] = p[order]
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        tied = np.repeat(size > 1, size)
        gid, at, d = (np.cumsum(new) - 1)[tied], at[tied], d[tied] + 5
    return out


def two_stage_suffix_array(t: np.ndarray, e: np.ndarray, depth: int, alike: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of the bytes t, exact to `depth` bytes (ties beyond that in any order)."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int32)
    small = is_small(t)
    direct = sort_directly(np.flatnonzero(small).astype(np.int32), e, depth, whole(t, depth, depth) if alike is None else alike, [*((w, whole(t, w, depth)) for w in SKIPS), (STEP, e)])
    cut = np.searchsorted(t[direct], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    queue[t[n - 1]].append(np.array([n - 1], np.int32))
    out = []
    for c in range(256):
        level = np.concatenate(queue[c]) if queue[c] else np.zeros(0, np.int32)
        bucket = []
        while len(level):  # predecessors with the same byte follow within the bucket
            bucket.append(level)
            pred = level[level > 0] - 1
            level = pred[(t[pred] == c) & ~small[pred]]
        bucket.append(direct[cut[c] : cut[c + 1]])
        queue[c] = []
        done = np.concatenate(bucket)
        if not len(done):
            continue
        out.append(done)
        pred = done[done > 0] - 1
        pred = pred[~small[pred] & (t[pred] > c)]
        chars = t[pred]
        pred = pred[np.argsort(chars, kind="stable")]
        present, first = np.unique(t[pred], return_index=True)
        for b, piece in zip(present.tolist(), np.split(pred, first[1:])):
            queue[b].append(piece)
    return np.concatenate(out)


def common_prefixes(sa: np.ndarray, e: np.ndarray, depth: int, alike: np.ndarray) -> np.ndarray:
    """Is the common prefix of each place with the one before it in sa at least `depth` bytes? (multiple of 8)

    alike has `whole` hashes: only places where they agree are compared.
    """
    h = alike[sa]
    alive = np.flatnonzero(h[1:] == h[:-1]) + 1
    here, before = sa[alive], sa[alive - 1]
    for d in range(0, depth, STEP):
        same = e[here + d] == e[before + d]
        if not same.all():
            alive, here, before = alive[same], here[same], before[same]
    out = np.zeros(len(sa), bool)
    out[alive] = True
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i with room, by block prefixes and suffixes."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    b = padded.reshape(-1, width)
    head = np.minimum.accumulate(b, axis=1).ravel()
    tail = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


#: Answers of kind 2 and 3: the MD5 of a text with copies, in a group that leaves it to another one or sorts it.
ELSEWHERE, HERE = 2, 3


class Group:
    def __init__(self, docs: pa.Table, answers: pa.Table, length: int):
        self.length = length
        self.data, self.offsets = text_arrays(docs.column("text"))
        size = np.diff(self.offsets)
        end = np.repeat(self.offsets[1:].astype(np.int32), size)
        left = end - np.arange(len(self.data), dtype=np.int32)  # bytes to the document's end
        raw = self.data.tobytes()
        told = {v: k for k, v in zip(answers.column("kind").to_pylist(), answers.column("vals").to_pylist()) if k >= ELSEWHERE}
        copied, extra = np.zeros(len(size), bool), np.zeros(len(size), bool)
        seen = set()
        for d, (i, j) in enumerate(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist())):
            md5 = hashlib.md5(raw[i:j], usedforsecurity=False).digest()
            copied[d] = md5 in told
            extra[d] = told.get(md5) == ELSEWHERE or md5 in seen
            seen.add(md5)
        fit = left >= length
        self.copied = np.repeat(copied, size) & fit
        self.fit = fit & ~np.repeat(extra, size)

    def picks(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows (starts), the index of the pick of each, and the keys of the picks."""
        w = self.length - GRAM + 1
        start = np.flatnonzero(self.fit)
        if not len(start):
            return start, start, np.zeros(0, np.uint64)
        h = window_hashes(self.data, GRAM)
        at = np.empty(len(self.data) - self.length + 1, np.uint32)
        low = np.uint64(0xFFFFFFFF)
        for a in range(0, len(at), CHUNK):
            m = min(CHUNK, len(at) - a)
            part = h[a : a + m + w - 1]
            rank = (part & ~low) | (low - np.arange(a, a + len(part), dtype=np.uint64))
            at[a : a + m] = low - (sliding_min(rank, w) & low)
        at = at[start]
        new = np.append(True, at[1:] != at[:-1])
        return start, np.cumsum(new, dtype=np.int32) - 1, M.keys32(h[at[new]], buckets)

    def candidates(self, shared: np.ndarray, buckets: int) -> np.ndarray:
        start, which, keys = self.picks(buckets)
        if not len(start):
            return start
        _, inv, cnt = np.unique(keys, return_inverse=True, return_counts=True)
        return start[((cnt[inv] > 1) | M.member(keys, shared))[which]]

    def classes(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows in suffix order, the class of each, and the index of each class's first."""
        region = cover(start, self.length, len(self.data))
        back = np.flatnonzero(region).astype(np.int32)
        t = self.data[back]
        e = eights(t, self.length)
        alike = whole(t, self.length, self.length)
        sa = back[two_stage_suffix_array(t, e, self.length, alike)] if len(t) else back
        wanted = np.zeros(len(self.data), bool)
        wanted[start] = True
        sa = sa[wanted[sa]]
        place = np.cumsum(region, dtype=np.int32) - 1
        same = common_prefixes(place[sa], e, self.length, alike) if len(sa) else np.zeros(0, bool)
        return sa, np.cumsum(~same) - 1, np.flatnonzero(~same)

    def entries(self, at: np.ndarray) -> np.ndarray:
        """96-bit hashes of the windows that start at `at`."""
        out = np.empty(len(at), M.ENTRY)
        out["h"] = window_hashes(self.data, self.length)[at]
        out["g"] = window_hashes(self.data ^ np.uint8(0x5A), self.length, 1)[at] >> np.uint64(32)
        return out


def _ranked(ent: np.ndarray) -> np.ndarray:
    """Order of entries by h, then g. The plain sort is much faster than lexsort; g only matters where it differs within one h."""
    order = np.argsort(ent["h"])
    h, g = ent["h"][order], ent["g"][order]
    if ((h[1:] == h[:-1]) & (g[1:] != g[:-1])).any():
        return np.lexsort((ent["g"], ent["h"]))
    return order


def _send_classes(bid: int, docs: pa.Table, answers: pa.Table, length: int, buckets: int) -> pa.Table:
    grp = Group(docs, answers, length)
    sa, cls, first = grp.classes(grp.candidates(M.answered_keys(answers), buckets))
    ent = grp.entries(sa[first])
    ranked = _ranked(ent)
    ent, own = ent[ranked], (np.bincount(cls, minlength=len(first)) > 1)[ranked]
    order, present, cut = M.by_bucket(ent["h"].astype(np.uint64), buckets)
    ij = list(zip(cut[:-1], cut[1:]))
    return pa.table([pa.array(present, pa.int32()), pa.array(np.full(len(present), bid), pa.int32()),
                     pa.array([ent[order[i:j]].tobytes() for i, j in ij], pa.binary()), pa.array([np.packbits(own[order[i:j]]).tobytes() for i, j in ij], pa.binary())], names=["bucket", "bid", "h", "own"])


def _answer_any(key: tuple, t: pa.Table) -> pa.Table:
    """Answers of kind 1: a bit per class a group sent, 1 if it repeats there or another group sent it too."""
    blobs = t.column("h").to_pylist()
    sizes = [len(b) // M.ENTRY.itemsize for b in blobs]
    ent = np.frombuffer(b"".join(blobs), M.ENTRY)
    order = _ranked(ent)
    s = ent[order]
    eq = (s["h"][1:] == s["h"][:-1]) & (s["g"][1:] == s["g"][:-1])
    hit = np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8), count=n) for o, n in zip(t.column("own").to_pylist(), sizes)]).astype(bool)
    hit[order[1:][eq]] = True
    hit[order[:-1][eq]] = True
    ends = np.cumsum(sizes)
    k = t.num_rows
    return pa.table([t.column("bid").combine_chunks(), pa.array([1] * k, pa.int32()), pa.array([key[0].as_py()] * k, pa.int32()),
                     pa.array([np.packbits(hit[i:j]).tobytes() for i, j in zip([0, *ends[:-1]], ends)], pa.binary())], schema=M.ANSWER)


def _remove(docs: pa.Table, answers: pa.Table, length: int, buckets: int, keep: bool) -> pa.Table:
    grp = Group(docs, answers, length)
    at = grp.candidates(M.answered_keys(answers), buckets)
    ent = grp.entries(at)
    ranked = _ranked(ent)
    ent = ent[ranked]
    new = np.append(True, (ent["h"][1:] != ent["h"][:-1]) | (ent["g"][1:] != ent["g"][:-1]))[: len(ent)]
    cls, heads = np.cumsum(new) - 1, ent[new]
    order, present, cut = M.by_bucket(heads["h"].astype(np.uint64), buckets)
    got = {b: v for k, b, v in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "vals"))) if k == 1}
    repeat = np.zeros(len(heads), bool)
    for b, i, j in zip(present.tolist(), cut[:-1], cut[1:]):
        repeat[order[i:j]] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=j - i)
    hit = grp.copied.copy()
    hit[at[ranked[repeat[cls]]]] = True
    gone = cover(np.flatnonzero(hit), length, len(grp.data))
    kept, removed, spans, sha = [], [], [], []
    for i, j in zip(grp.offsets[:-1], grp.offsets[1:]):
        m = gone[i:j]
        body = grp.data[i:j][~m].tobytes()
        kept.append(body if keep else None)
        removed.append(int(m.sum()))
        spans.append(len(runs(m)[0]))
        sha.append(hashlib.sha256(body).hexdigest())
    return pa.table([docs.column("doc_id").cast(pa.int64()), pa.array(kept, pa.binary()), pa.array(np.diff(grp.offsets), pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
                    names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, length: int = 400, keep_bytes: bool = True) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts anywhere else.

    Takes doc_id and text (null: empty), ignores other columns. Matches lie
    within a document; overlaps and repeats inside one document count, and so
    do rows that repeat another row. `length` is a multiple of 8 from 56 on.
    Returns doc_id, kept (remaining bytes end to end, null without
    keep_bytes), n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256.
    """
    if length % STEP or length < GRAM + STEP:
        raise ValueError(f"length must be a multiple of {STEP} and at least {GRAM + STEP}")
    lay = Layout.of(docs)
    nb = lay.buckets
    keyed = lay.dealt(docs)

    def send(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        return M.pack(key[0].as_py(), Group(t, answers, length).picks(nb)[2])

    def send_classes(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        return _send_classes(key[0].as_py(), t, answers, length, nb)

    def remove(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        return _remove(t, answers, length, nb, keep_bytes)

    copies = stored(_copies(docs, lay, length), "copies")
    shared = M.shared_values(keyed.groupBy("bid").cogroup(_to(copies, lay)).applyInArrow(send, M.SENT_DDL), lay.partitions)
    classes = keyed.groupBy("bid").cogroup(_to(copies.unionByName(shared), lay)).applyInArrow(send_classes, SENT_DDL)
    found = classes.repartition(lay.partitions, "bucket").groupBy("bucket").applyInArrow(_answer_any, M.ANSWER_DDL)
    return keyed.groupBy("bid").cogroup(_to(copies.unionByName(shared).unionByName(found), lay)).applyInArrow(remove, OUT_DDL)


def _to(answers: DataFrame, lay: Layout):
    return answers.repartition(lay.partitions, "bid").groupBy("bid")


def _copies(docs: DataFrame, lay: Layout, length: int) -> DataFrame:
    """Answers of kind 2 and 3, one for each text with copies and group that holds it; the lowest group sorts it."""
    held = docs.where(F.octet_length("text") >= length).groupBy(F.unhex(F.md5(F.col("text").cast("binary"))).alias("vals"), lay.group().alias("bid")).agg(F.count("*").alias("n"))
    all_of = held.groupBy("vals").agg(F.sum("n").alias("n_all"), F.min("bid").alias("first")).where("n_all > 1")
    return held.join(all_of, "vals").select("bid", F.when(F.col("bid") == F.col("first"), HERE).otherwise(ELSEWHERE).alias("kind"), F.lit(0).alias("bucket"), "vals")
