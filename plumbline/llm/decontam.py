"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be altered by k = m * rate edits and still
counts. Cut into k + 1 pieces, at least one piece survives any k edits, so an
Aho-Corasick pass over a document for all pieces of all items finds every
place to look at; Myers' bit-parallel algorithm then decides whether some
substring there lies within distance k of the whole item.

Texts and items are compared in lower case with white space collapsed.
Documents are not shuffled. Items go to the executors in blocks of a bounded
size; each further block is another pass over the documents.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, stored, text_arrays, texts

#: Edits allowed per character of an item, and the shortest piece worth a search.
RATE, LEAST = 0.08, 10
#: Characters of items in one block.
BLOCK_CHARS = 4 << 20


def clean(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(m: int, rate: float = RATE) -> int:
    """Edits allowed; never so many that a piece is shorter than LEAST."""
    return max(0, min(int(m * rate), m // LEAST - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(start, piece) of k + 1 nearly equal parts."""
    m, n = len(item), k + 1
    cut = [m * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


@functools.lru_cache(maxsize=4096)
def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_distance(pattern: str, text: str, stop: int = -1) -> int:
    """Least edit distance of pattern to any substring of text (Myers 1999); ends early at `stop` or less."""
    m, masks = len(pattern), _masks(pattern)
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if best <= stop:
                    return best
        ph = ph << 1 & full
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
    return best


class Matcher:
    """Finds items within their budgets in a text."""

    def __init__(self, items: list[tuple[int | bytes, str]], rate: float = RATE):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items if t]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for a, p in pieces(t, k):
                where.setdefault(p, []).append((n, a))
        self.auto = ahocorasick.Automaton()
        for p, at in where.items():
            self.auto.add_word(p, (len(p), at))
        if where:
            self.auto.make_automaton()
        self.empty = not where

    def find(self, text: str) -> list[tuple[int | bytes, int]]:
        """(item, distance) of every item found, once each."""
        if self.empty:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, at) in self.auto.iter(text):
            for n, a in at:
                starts.setdefault(n, set()).add(end + 1 - size - a)
        found: dict[int, int] = {}
        for n, begins in starts.items():
            _, item, k = self.items[n]
            if item in text:
                found[n] = 0
                continue
            best, lo, hi = k + 1, 0, -1
            for begin in [*sorted(begins), len(text) + 2 * len(item) + 2 * k]:  # windows that overlap are read once
                if begin - k > hi and hi >= 0:
                    best = min(best, best_distance(item, text[lo:hi], 0))
                    hi = -1
                if hi < 0:
                    lo = max(0, begin - k)
                hi = begin + len(item) + k
            if best <= k:
                found[n] = best
        return [(self.items[n][0], d) for n, d in sorted(found.items())]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[bytes, str]]]:
    """Distinct texts of items and their MD5, in blocks of BLOCK_CHARS, streamed; texts that differ in case or white space alone are distinct."""
    rows = benchmark.where("text is not null").select("text").distinct().select(_md5("text").alias("md5"), "text").orderBy("md5").toLocalIterator()
    held, size = [], 0
    for r in rows:
        t = clean(r["text"])
        if not t:
            continue
        held.append((bytes(r["md5"]), t))
        size += len(t)
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _md5(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def hits(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, md5, item, distance) of each document row and distinct item text found in it; md5 and item are MD5s of the two texts."""
    src = texts(docs)
    spark, out = docs.sparkSession, None
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            import hashlib

            m = Matcher(shared.value, rate)
            for b in it:
                _, off = text_arrays(b.column(1))
                for i, j in slices(off, 2 << 20):
                    ids, rows = b.column(0).slice(i, j - i).to_pylist(), []
                    for d, t in zip(ids, b.column(1).slice(i, j - i).to_pylist()):
                        if t and (found := m.find(clean(t))):
                            key = hashlib.md5(t.encode(), usedforsecurity=False).digest()
                            rows += [(d, key, n, dist) for n, dist in found]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.int32()))], ["doc_id", "md5", "item", "distance"])

        part = src.mapInArrow(run, HIT_DDL)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], HIT_DDL)


HIT_DDL = "doc_id bigint, md5 binary, item binary, distance int"


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, md5, item_id, distance) of each document row and item found in it.

    Takes doc_id and text of docs, item_id and text of benchmark; null and
    blank texts match nothing. Items shorter than 2 * LEAST characters, or
    with a budget below one edit, must occur unaltered. Each text is searched
    once; every item that has it gets its rows, an item without an id as -1.
    Items equal in id and text are one; rows of docs that repeat keep a row each.
    """
    known = benchmark.where("text is not null").select(_md5("text").alias("item"), F.coalesce(F.col("item_id").cast("bigint"), F.lit(-1).cast("bigint")).alias("item_id")).distinct()
    return hits(docs, benchmark, rate).join(known, "item").select("doc_id", "md5", "item_id", "distance")


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs whose text holds no item; columns as they are.

    Rows are told apart by their text; the join moves texts only if the texts
    to drop are too many to broadcast (Spark checks the size).
    """
    gone = stored(hits(docs, benchmark, rate).select("md5").distinct(), "leaks")
    return docs.join(gone, _md5("text") == gone["md5"], "left_anti")
