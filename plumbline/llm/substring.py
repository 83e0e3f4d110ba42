"""Substring dedup on words, by difference-cover anchors.

A window of L words is hashed nowhere but at its anchors: runs of
L - v + 1 words that start at places i with (i mod v) in a difference cover of
v. For any two equal windows, starting at i and j, some shift d < v puts both
i + d and j + d on cover places, so they share an aligned anchor. Anchors that
no other place shares rule out most windows; the rest are extended to whole
windows, hashed with 96 bits and compared corpus-wide for the earliest place.

Data flow: documents are shuffled once, into groups of about 2 MB (the same
exchange serves all three passes); anchors, window hashes and answers travel
packed (see `matching`). Work is linear in the text; no group of equal windows
is gathered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import matching as M
from plumbline.llm.common import Layout, cover, mix, prefix, spans_hash, text_arrays, words_of

#: A perfect difference cover of 13: every residue is a difference of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
SENT_DDL = "bucket int, bid int, h binary, g binary, doc binary, pos binary"
OUT_DDL = "doc_id bigint, text string, n_words bigint, n_removed bigint, kept_sha256 string"


class Group:
    """The words of a group of documents and the hashes that the passes need."""

    def __init__(self, docs: pa.Table, length: int):
        self.length, self.width = length, length - PERIOD + 1
        ids = docs.column("doc_id").to_pandas().to_numpy(dtype=object) if docs.num_rows else np.zeros(0, object)
        self.ids = np.array([-(1 << 63) if x is None or x != x else int(x) for x in ids], np.int64)
        self.data, self.offsets = text_arrays(docs.column("text"))
        self.start, self.end, self.first = words_of(self.data, self.offsets)
        n = len(self.start)
        doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.doc, self.place = doc, np.arange(n) - self.first[doc] if n else np.zeros(0, np.int64)
        self.left = self.first[doc + 1] - np.arange(n) if n else np.zeros(0, np.int64)  # words to the document's end
        self.word = spans_hash(prefix(self.data), self.start, self.end)

    def anchors(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors and their keys."""
        on = np.isin(self.place % PERIOD, COVER) & (self.left >= self.width)
        at = np.flatnonzero(on)
        pre = prefix(self.word)
        return at, M.keys32(spans_hash(pre, at, at + self.width), buckets)

    def windows(self, shared: np.ndarray, buckets: int) -> np.ndarray:
        """Starts of the windows with an anchor that occurs again, here or in another group."""
        at, keys = self.anchors(buckets)
        _, inv, cnt = np.unique(keys, return_inverse=True, return_counts=True)
        hit = at[(cnt[inv] > 1) | M.member(keys, shared)]
        near = np.zeros(len(self.start) + 1, np.int32)
        np.add.at(near, np.maximum(hit - PERIOD + 1, 0), 1)
        np.add.at(near, hit + 1, -1)
        return np.flatnonzero((np.cumsum(near[:-1]) > 0) & (self.left >= self.length))

    def classes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """h and g (64 and 32 bits) of each window; the index of the earliest window of its class, and of its class."""
        h = spans_hash(prefix(self.word, 0), at, at + self.length, 0)
        g = (spans_hash(prefix(mix(self.word), 1), at, at + self.length, 1) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((self.place[at], self.ids[self.doc[at]], g, h))
        new = np.ones(len(at), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        cls = np.empty(len(at), np.int64)
        cls[order] = np.cumsum(new) - 1
        return h, g, order[new], cls


def _send_windows(bid: int, docs: pa.Table, answers: pa.Table, length: int, buckets: int) -> pa.Table:
    grp = Group(docs, length)
    at = grp.windows(M.answered_keys(answers), buckets)
    h, g, earliest, _ = grp.classes(at)
    earliest = earliest[np.lexsort((grp.place[at[earliest]], grp.ids[grp.doc[at[earliest]]]))]  # runs of places compress
    order, present, cut = M.by_bucket(h[earliest], buckets)
    pick = earliest[order]
    doc, pos = grp.ids[grp.doc[at[pick]]], grp.place[at[pick]].astype(np.int32)
    delta = lambda x, i, j: np.diff(x[i:j], prepend=x.dtype.type(0)).tobytes()
    ij = list(zip(cut[:-1], cut[1:]))
    return pa.table([
        pa.array(present, pa.int32()), pa.array(np.full(len(present), bid), pa.int32()),
        pa.array([h[pick[i:j]].tobytes() for i, j in ij], pa.binary()), pa.array([g[pick[i:j]].tobytes() for i, j in ij], pa.binary()),
        pa.array([delta(doc, i, j) for i, j in ij], pa.binary()), pa.array([delta(pos, i, j) for i, j in ij], pa.binary()),
    ], names=["bucket", "bid", "h", "g", "doc", "pos"])


def _answer_first(key: tuple, t: pa.Table) -> pa.Table:
    """Answers of kind 1: a bit per entry a group sent, 1 if another group has the class at an earlier place."""
    col = {c: t.column(c).to_pylist() for c in ("h", "g", "doc", "pos")}
    h = np.frombuffer(b"".join(col["h"]), np.uint64)
    g = np.frombuffer(b"".join(col["g"]), np.uint32)
    doc = np.concatenate([np.cumsum(np.frombuffer(b, np.int64)) for b in col["doc"]])
    pos = np.concatenate([np.cumsum(np.frombuffer(b, np.int32)) for b in col["pos"]])
    order = np.lexsort((pos, doc, g, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    first = order[new][np.cumsum(new) - 1]  # the earliest of each class; rows of one document may be in several groups
    late = np.empty(len(h), bool)
    late[order] = (doc[order] != doc[first]) | (pos[order] != pos[first])
    ends = np.cumsum([len(b) // 8 for b in col["h"]])
    bits = [np.packbits(late[i:j]).tobytes() for i, j in zip([0, *ends[:-1]], ends)]
    k = t.num_rows
    return pa.table([t.column("bid").combine_chunks(), pa.array([1] * k, pa.int32()), pa.array([key[0].as_py()] * k, pa.int32()), pa.array(bits, pa.binary())], schema=M.ANSWER)


def _remove(docs: pa.Table, answers: pa.Table, length: int, buckets: int, keep_text: bool) -> pa.Table:
    grp = Group(docs, length)
    at = grp.windows(M.answered_keys(answers), buckets)
    h, _, earliest, cls = grp.classes(at)
    late = np.zeros(len(earliest), bool)  # by class: is an earlier place in another group?
    sent = earliest[np.lexsort((grp.place[at[earliest]], grp.ids[grp.doc[at[earliest]]]))]
    order, present, cut = M.by_bucket(h[sent], buckets)
    got = {b: v for k, b, v in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "vals"))) if k == 1}
    for b, i, j in zip(present.tolist(), cut[:-1], cut[1:]):
        if b in got:
            late[cls[sent[order[i:j]]]] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=j - i).astype(bool)
    where = np.stack([grp.ids[grp.doc[at]], grp.place[at]]) if len(at) else np.zeros((2, 0), np.int64)
    again = (where != where[:, earliest[cls]]).any(0) if len(at) else np.zeros(0, bool)
    gone = cover(at[late[cls] | again], length, len(grp.start))
    out_text, sha, removed = [], [], []
    raw = grp.data.tobytes()
    for d in range(len(grp.ids)):
        a, b = grp.first[d], grp.first[d + 1]
        m = gone[a:b]
        text = b" ".join([raw[s:e] for s, e in zip(grp.start[a:b][~m].tolist(), grp.end[a:b][~m].tolist())])
        removed.append(int(m.sum()))
        sha.append(hashlib.sha256(text).hexdigest())
        out_text.append(text.decode("utf-8", "replace") if keep_text else None)
    return pa.table([docs.column("doc_id").cast(pa.int64()), pa.array(out_text, pa.string()), pa.array(np.diff(grp.first), pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "text", "n_words", "n_removed", "kept_sha256"])


def substring_dedup(docs: DataFrame, length: int = 20, keep_text: bool = True) -> DataFrame:
    """Remove every word covered by a window of `length` words that also starts earlier.

    Takes doc_id (integer) and text, ignores other columns. Earlier means a
    smaller doc_id, or the same document and an earlier start; windows are
    judged on the input. A null text has no words and gives an empty one. Rows
    that repeat a doc_id count as the same document: equal places in them are
    not earlier than each other. A null doc_id sorts before all others.
    Returns doc_id, text (kept words, one space between; null without
    keep_text), n_words, n_removed and kept_sha256 (of the kept text).
    """
    if length < PERIOD:
        raise ValueError(f"length must be at least {PERIOD}")
    lay = Layout.of(docs)
    nb = lay.buckets
    keyed = lay.dealt(docs)

    def send(key: tuple, t: pa.Table) -> pa.Table:
        return M.pack(key[0].as_py(), Group(t, length).anchors(nb)[1])

    def send_windows(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        return _send_windows(key[0].as_py(), t, answers, length, nb)

    def remove(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        return _remove(t, answers, length, nb, keep_text)

    shared = M.shared_values(keyed.groupBy("bid").applyInArrow(send, M.SENT_DDL), lay.partitions)
    windows = keyed.groupBy("bid").cogroup(shared.repartition(lay.partitions, "bid").groupBy("bid")).applyInArrow(send_windows, SENT_DDL)
    first = windows.repartition(lay.partitions, "bucket").groupBy("bucket").applyInArrow(_answer_first, M.ANSWER_DDL)
    answers = shared.unionByName(first).repartition(lay.partitions, "bid")
    return keyed.groupBy("bid").cogroup(answers.groupBy("bid")).applyInArrow(remove, OUT_DDL)
