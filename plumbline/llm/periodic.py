"""Periodic runs of words, in linear time and by comparisons of words alone.

A run is a maximal stretch with smallest period q. Each has a root that is the
longest Lyndon word at its start, under the order of words or its reverse, so
all runs are found among the pairs (i, next smaller suffix of i) of the two
orders (the runs theorem of Bannai et al.). `lyndon` finds those pairs from
left to right, together with the lengths for which the two suffixes agree:

* Suffixes whose next smaller one is not known yet form a stack. A new suffix
  is compared with its top first; what agrees with one entry and what this
  entry shares with the one below tell the next comparison, or where to go on.
* The match that reaches furthest to the right is kept as a box: the words
  before `reach` repeat those `shift` earlier. A pair inside the box has been
  compared before, `shift` to the left; its result is taken over, and only a
  match that touches the end of the box is extended, from `reach` on.

So no word is compared twice as a right end (Ellert and Fischer's reuse of
matched extensions): the time is linear for any order of words, without
suffix arrays, ranks or hashes. The beginning of a run is sought word by word,
once a run of three roots and over less than a period.

Each text is worked on whole by itself; documents are independent, so the work
is one map and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import give_back, texts

Runs = list[tuple[int, int, int]]
#: Words of a text from which places are kept in arrays, not lists: four bytes each.
COMPACT = 1 << 16
DDL = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string, collapsed_sha256 string"
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    ("collapsed", pa.string()), ("collapsed_sha256", pa.string())])


def lyndon(w: Sequence, flip: bool = False) -> tuple[Sequence[int], Sequence[int]]:
    """For each place its next smaller suffix (len(w): none) and how many words the two agree in.

    flip reverses the order of words; a suffix that ends first is the smaller one in both.
    """
    n = len(w)
    many = n >= COMPACT
    fill = (lambda v: array("i", [v]) * n) if many else (lambda v: [v] * n)
    nxt, agree, prev, back = fill(n), fill(0), fill(-1), fill(0)  # back: words shared with the suffix at prev
    shift = left = reach = 0  # the box; left is where its right copy starts
    for i in range(1, n):
        p, c = i - 1, w[i]
        if i < reach:  # p >= left: the copy of the pair has been compared
            a = i - shift
            x = agree[p - shift] if nxt[p - shift] == a else back[a] if prev[a] == p - shift else reach - i
            inside = i + x < reach
            if not inside:
                x = reach - i
        else:
            x, inside = 0, False
        while True:
            if not inside:  # i + x is no further left than reach: go on from there
                e = i + x
                while e < n and w[p + x] == w[e]:
                    x += 1
                    e += 1
                if e >= reach:
                    shift, left, reach = i - p, i, e
            else:
                e = i + x
            if e < n and ((w[e] < w[p + x]) if x else (c < w[p])) == flip:
                prev[i], back[i] = p, x
                break
            nxt[p], agree[p] = i, x
            y, p = back[p], prev[p]
            if p < 0:
                break
            if x > y:  # it differs from the one below where the one above did, which was larger
                prev[i], back[i] = p, y
                break
            if inside:  # in the box until the start of its right copy is popped
                if p >= left:
                    a = i - shift
                    x = agree[p - shift] if nxt[p - shift] == a else back[a] if prev[a] == p - shift else reach - i
                    inside = i + x < reach
                    if not inside:
                        x = reach - i
                else:
                    inside = x < y
            elif x < y:  # the one below agrees with the one above beyond the difference
                continue
    return nxt, agree


def find_runs(w: Sequence, times: int = 4, least: int = 6) -> Runs:
    """(start, length, period) of the runs of at least `times` periods and `least` items, by start, then period."""
    if times < 3:
        raise ValueError("runs of less than three periods are not sought")
    n, found = len(w), set()
    for flip in (False, True):
        nxt, agree = lyndon(w, flip)
        for i, x in enumerate(agree):
            if x < 2 or nxt[i] == n:
                continue
            q = nxt[i] - i
            if x < (times - 2) * q or (i >= q and nxt[i - q] == i and agree[i - q] >= q):  # too short, or not the first root of its run
                continue
            s = i
            while s and w[s - 1] == w[s - 1 + q]:
                s -= 1
            if (length := nxt[i] + x - s) >= max(least, times * q):
                found.add((s, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(w: Sequence, runs: Runs) -> list:
    """The items outside all runs, and the first period of each: an item goes if any run holds it after its first period."""
    kept, at = [], 0
    for a, z in sorted((s + q, s + length) for s, length, q in runs):
        if a > at:
            kept += w[at:a]
        at = max(at, z)
    return kept + w[at:]


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, keep_text: bool = True) -> DataFrame:
    """Runs of the words [^\\x20\\x09-\\x0D]+ of each row of docs (doc_id, text; other columns ignored).

    A run is a stretch of words with smallest period q, at least `least` words
    and `times` periods long, that no neighbouring word extends. rewrite, if
    given, gets doc_id and the words and returns the words to be searched.
    Returns doc_id, n_words, runs (start, length, period; by start, then
    period), collapsed (the words left when all periods of a run but its first
    are dropped, joined by one space; null without keep_text) and its SHA-256.
    A null or empty text has no words and no runs. Each row is judged by
    itself, so repeated rows and ids get equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, spans, text, sha = [], [], [], []
            for doc_id, value in zip(b.column(0).to_pylist(), b.column(1)):
                w = value.as_buffer().to_pybytes().split() if value.is_valid else []  # bytes: \x20 \x09-\x0D only
                if rewrite:
                    w = rewrite(doc_id, w)
                found = find_runs(w, times, least)
                kept = b" ".join(collapse(w, found))
                n.append(len(w))
                spans.append([{"start": s, "length": k, "period": q} for s, k, q in found])
                sha.append(hashlib.sha256(kept).hexdigest())
                text.append(kept.decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans, SCHEMA.field("runs").type), pa.array(text, pa.string()), pa.array(sha, pa.string())], schema=SCHEMA)
            del w, value, b
            give_back()

    return texts(docs).mapInArrow(run, DDL)
