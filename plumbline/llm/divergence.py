"""Source divergence audit: term rates of each source of a language, compared with each other and with the language.

Counting. A map task counts the terms of its documents and puts them into one
radix trie of bytes a language; a leaf holds how many documents have the term
and a counter for each source. A trie is kept as its leaves in byte order, each
with the number of bytes it shares with the leaf before, which is all that a
trie's shape is. The tries are cut by prefix range (language and first bytes of
the term) and written. Sorted by prefix range, the pieces of a range follow
each other, so a reader merges them into one trie, some pieces at a time, and
walks it in UTF-8 order. Its memory is one range's terms; how often a term
occurs does not matter, and no group is gathered.

Rates. The kept terms, with the counter of each source, are written once in
that order. Totals of (language, source) follow from them, and a second walk
streams over the terms: for each language it adds up the distances of all
pairs of sources in a matrix, and keeps the candidate terms of each source
that still can be among the first. Matrices and candidates of the tasks are
added up by ordinary aggregation. A language with more than BLOCK sources has
its sources cut into blocks, and each pair of blocks is a walk of its own, so
a matrix has a bounded size whatever the number of sources.

All arithmetic is exact: rates are whole billionths, found by long division.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import give_back, stored, texts

#: A rate is a number of these parts.
PARTS = 1_000_000_000
#: Bytes of a term that name its prefix range.
LEAD = 3
#: (language, source, term) counters that a task holds before it hands its tries over.
HELD = 1 << 18
#: Leaves that one task merges, about; prefix ranges with more are cut further.
LEAVES = 1 << 19
#: Pieces of a prefix range that are merged at a time.
AT_ONCE = 64
#: Bytes of terms that are compared at once for what they share.
HEAD = 16
#: Words of one text that are counted at a time.
CHUNK = 1 << 16
#: Most sources of a language in one matrix, and most groups whose totals one walk gets.
BLOCK, GROUPS = 512, 1 << 16
#: Letters stay, A-Z as small ones, and so do all bytes from 128 on; the rest parts terms.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

PIECE = pa.schema([
    ("lang", pa.string()), ("lead", pa.binary()), ("names", pa.list_(pa.string())), ("shared", pa.list_(pa.int32())), ("tails", pa.list_(pa.binary())),
    ("docs", pa.list_(pa.int64())), ("width", pa.list_(pa.int32())), ("source", pa.list_(pa.int32())), ("count", pa.list_(pa.int64()))])
PIECE_DDL = "lang string, lead binary, names array<string>, shared array<int>, tails array<binary>, docs array<bigint>, width array<int>, source array<int>, count array<bigint>"


def shared_prefix(terms: list[bytes]) -> np.ndarray:
    """How many bytes each of the sorted terms shares with the one before: with the terms, the shape of their radix trie."""
    out = np.zeros(len(terms), np.int32)
    if len(terms) > 1:
        head = np.array(terms, f"S{HEAD}").view(np.uint8).reshape(len(terms), HEAD)  # no term holds a zero byte
        differs = head[1:] != head[:-1]
        out[1:] = np.where(differs.any(1), differs.argmax(1), HEAD)
        for i in np.flatnonzero(out == HEAD):
            x, y, k = terms[i - 1], terms[i], HEAD
            while k < len(x) and x[k] == y[k]:
                k += 1
            out[i] = k
    return out


@dataclass(frozen=True)
class Trie:
    """A radix trie as its leaves in byte order, with the numbers that each holds.

    docs: documents with the term. Leaf i has the next width[i] counters of
    source (number in names) and count, by source.
    """

    terms: list[bytes]
    docs: np.ndarray
    width: np.ndarray
    source: np.ndarray
    count: np.ndarray
    names: list[str]

    @staticmethod
    def of(terms: list[bytes], docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, count: np.ndarray, names: list[str]) -> Trie:
        """From counters in any order, several of one leaf and source too."""
        key, inverse = np.unique(leaf * len(names) + source, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, inverse, count)
        return Trie(terms, docs, np.bincount(key // max(1, len(names)), minlength=len(terms)), key % max(1, len(names)), total, names)

    @staticmethod
    def grown(in_docs: Counter, groups: dict[str, Counter]) -> Trie:
        """From the documents of each term and its occurrences by source."""
        terms = sorted(in_docs)
        at = dict(zip(terms, range(len(terms))))
        names = sorted(groups)
        numbers = lambda values, n: np.fromiter(values, np.int64, n)
        leaf = [numbers(map(at.__getitem__, groups[s]), len(groups[s])) for s in names]
        count = [numbers(groups[s].values(), len(groups[s])) for s in names]
        none = np.zeros(0, np.int64)
        source = np.repeat(np.arange(len(names)), [len(x) for x in leaf])
        return Trie.of(terms, numbers(map(in_docs.__getitem__, terms), len(terms)), np.concatenate([none, *leaf]), source, np.concatenate([none, *count]), names)

    @staticmethod
    def merged(tries: list[Trie], least: int = 1) -> Trie:
        """The tries in one, with the leaves that `least` documents have."""
        at: dict[bytes, int] = {}
        place = [np.fromiter((at.setdefault(t, len(at)) for t in trie.terms), np.int64, len(trie.terms)) for trie in tries]
        docs = np.zeros(len(at), np.int64)
        for trie, own in zip(tries, place):
            docs[own] += trie.docs  # a trie has a term once
        terms = sorted(t for t, k in at.items() if docs[k] >= least)
        new = np.full(len(at), -1, np.int64)
        new[[at[t] for t in terms]] = np.arange(len(terms))
        names = sorted({s for trie in tries for s in trie.names})
        known = {s: k for k, s in enumerate(names)}
        cells = [np.zeros((3, 0), np.int64)]
        for trie, own in zip(tries, place):
            leaf = new[np.repeat(own, trie.width)]
            cells.append(np.stack([leaf, np.array([known[s] for s in trie.names], np.int64)[trie.source], trie.count])[:, leaf >= 0])
        leaf, source, count = np.concatenate(cells, axis=1)
        return Trie.of(terms, docs[new >= 0][np.argsort(new[new >= 0])], leaf, source, count, names)

    def pieces(self, lang: str, size: int = LEAD) -> pa.RecordBatch:
        """The trie cut by prefix range (terms that share `size` bytes), front coded, a row a piece."""
        lead = np.array(self.terms, f"S{size}")
        first = np.append(True, lead[1:] != lead[:-1])
        shared = np.where(first, 0, shared_prefix(self.terms))
        cut = np.append(np.flatnonzero(first), len(self.terms))
        inner = np.append(0, np.cumsum(self.width))[cut]
        names, source = [], np.empty(len(self.source), np.int32)
        for i, j in zip(inner[:-1], inner[1:]):
            used, source[i:j] = np.unique(self.source[i:j], return_inverse=True)
            names.append([self.names[k] for k in used])
        listed = lambda values, off: pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))
        tails = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array([t[k:] for t, k in zip(self.terms, shared.tolist())], pa.binary()))
        return pa.RecordBatch.from_arrays([
            pa.array([lang] * len(names), pa.string()), pa.array([self.terms[k][:size] for k in cut[:-1]], pa.binary()), pa.array(names, pa.list_(pa.string())), listed(shared.astype(np.int32), cut), tails,
            listed(self.docs, cut), listed(self.width.astype(np.int32), cut), listed(source, inner), listed(self.count, inner)], schema=PIECE)

    @staticmethod
    def read(row: dict[str, pa.Scalar]) -> Trie:
        """The trie of a piece."""
        numbers = {c: row[c].values.to_numpy().astype(np.int64) for c in ("docs", "width", "source", "count")}
        terms, t = [], b""
        for k, tail in zip(row["shared"].values.to_pylist(), row["tails"].values.to_pylist()):
            t = t[:k] + tail
            terms.append(t)
        return Trie(terms, **numbers, names=row["names"].as_py())


def term_tries(docs: DataFrame) -> DataFrame:
    """Pieces of the tries of each map task, by language and prefix range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_docs: dict[str, Counter] = {}
        groups: dict[str, dict[str, Counter]] = {}

        def hand_over() -> Iterator[pa.RecordBatch]:
            for lang in sorted(in_docs):
                rows = Trie.grown(in_docs.pop(lang), groups.pop(lang)).pieces(lang)
                for i in range(0, rows.num_rows, 1024):
                    yield rows.slice(i, 1024)
            give_back()

        for b in batches:
            for value, lang, source in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = value.as_buffer().to_pybytes().translate(FOLD).split() if value.is_valid else []
                if not words:
                    continue
                group = groups.setdefault(lang, {}).setdefault(source, Counter())
                seen: set[bytes] = set()
                for i in range(0, len(words), CHUNK):
                    group.update(words[i : i + CHUNK])
                    seen.update(words[i : i + CHUNK])
                in_docs.setdefault(lang, Counter()).update(seen)
                del words, seen
            if sum(len(c) for g in groups.values() for c in g.values()) > HELD:
                yield from hand_over()
        yield from hand_over()

    empty = F.lit("")
    return texts(docs, F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source")).mapInArrow(run, PIECE_DDL)


KEPT_DDL = "lang string, term binary, sources array<string>, counts array<bigint>"
KEPT = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def kept_terms(docs: DataFrame, least: int = 30) -> DataFrame:
    """lang, term, sources, counts: the terms in at least `least` documents of a language, merged and walked by prefix range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tries, out = None, [], []

        def walked() -> None:
            trie = Trie.merged(tries, least)
            ends = np.cumsum(trie.width)
            for term, i, j in zip(trie.terms, (ends - trie.width).tolist(), ends.tolist()):
                out.append({"lang": now[0], "term": term, "sources": [trie.names[k] for k in trie.source[i:j]], "counts": trie.count[i:j].tolist()})
            tries.clear()

        for b in batches:
            cols = {c: b.column(c) for c in PIECE.names}
            for k, at in enumerate(zip(cols["lang"].to_pylist(), cols["lead"].to_pylist())):
                if at != now or len(tries) >= AT_ONCE:
                    if at == now:  # many pieces of a range: one trie for all so far
                        tries[:] = [Trie.merged(tries)]
                    else:
                        walked()
                    now = at
                tries.append(Trie.read({c: v[k] for c, v in cols.items()}))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=KEPT)
                out.clear()
        walked()
        yield pa.RecordBatch.from_pylist(out, schema=KEPT)
        tries.clear()
        give_back()

    pieces = stored(term_tries(docs), "tries")  # counted once: the sample that sets the ranges reads what is written
    ranges = stored(pieces.groupBy("lang", "lead").agg(F.sum(F.size("docs")).alias("leaves")), "ranges")
    leaves, most = ranges.agg(F.sum("leaves"), F.max("leaves")).first()
    if most and most > LEAVES:  # a range that is too large for a task is cut by more bytes, in all its pieces
        hot = ranges.where(F.col("leaves") > LEAVES).select("lang", "lead")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, lang in enumerate(b.column(0).to_pylist()):
                    yield Trie.read({c: b.column(c)[k] for c in PIECE.names}).pieces(lang, 3 * LEAD)

        pieces = stored(pieces.join(hot, ["lang", "lead"], "left_anti").unionByName(pieces.join(hot, ["lang", "lead"], "left_semi").select(*PIECE.names).mapInArrow(cut, PIECE_DDL)), "tries")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(leaves or 0) // LEAVES))
    dealt = pieces.repartitionByRange(parts, "lang", "lead").sortWithinPartitions("lang", "lead")
    return dealt.mapInArrow(run, KEPT_DDL)


def rates(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(PARTS * counts / total) for 0 <= counts <= total < 2^53, exact: three digits of the quotient at a time."""
    q, r = np.divmod(counts, total)
    for _ in range(3):
        d, r = np.divmod(r * 1000, total)
        q = q * 1000 + d
    return q + 1


def _blocks(totals: DataFrame) -> Iterator[list[dict]]:
    """Walks: lists of pairs of blocks of a language, their sources and totals, up to GROUPS sources a walk."""
    walk, size = [], 0
    for r in totals.orderBy("lang").toLocalIterator():  # a row a language and block of sources
        pair = {"lang": r["lang"], "total": r["total"], "own": r["own"], "left": (list(r["left"]), list(r["left_total"])), "right": (list(r["right"]), list(r["right_total"])), "same": r["a"] == r["b"]}
        if walk and size + len(r["left"]) + len(r["right"]) > GROUPS:
            yield walk
            walk, size = [], 0
        walk.append(pair)
        size += len(r["left"]) + len(r["right"])
    if walk:
        yield walk


class _Audit:
    """What one task gathers of one pair of blocks: the distance matrix and the candidates of its sources."""

    def __init__(self, pair: dict, top: int):
        self.pair, self.top = pair, top
        (left, lt), (right, rt) = pair["left"], pair["right"]
        self.at = [{s: k for k, s in enumerate(x)} for x in (left, right)]
        self.total = [np.array(t, np.int64) for t in (lt, rt)]
        self.sums = np.zeros((len(left), len(right)), np.int64)
        self.best: list[tuple[np.ndarray, ...]] = []
        self.terms: list[bytes] = []

    def take(self, terms: list[bytes], sources: list[list[str]], counts: list[list[int]], prior: int) -> None:
        """The next terms, in byte order."""
        grid = [np.full((len(terms), len(t)), prior, np.int64) for t in self.total]
        whole = np.array([sum(c) for c in counts], np.int64)
        for side, at in enumerate(self.at if not self.pair["same"] else self.at[:1]):
            row = np.repeat(np.arange(len(terms)), [len(s) for s in sources])
            col = np.array([at.get(s, -1) for s in itertools.chain.from_iterable(sources)], np.int64)
            n = np.array(list(itertools.chain.from_iterable(counts)), np.int64)
            ok = col >= 0
            grid[side][row[ok], col[ok]] += n[ok]
        p = [rates(grid[0], self.total[0][None, :])]
        p.append(p[0] if self.pair["same"] else rates(grid[1], self.total[1][None, :]))
        for k in range(len(self.total[0])):
            self.sums[k] += np.abs(p[0][:, k : k + 1] - p[1]).sum(0)
        if self.pair["same"]:
            q = rates(whole + prior, np.full(len(terms), self.pair["own"], np.int64))
            f = p[0] - q[:, None]
            row, col = np.nonzero((f > 0) & (grid[0] > prior))
            before = len(self.terms)
            self.terms += terms
            self.best.append((col, f[row, col], row + before))
            self._least()

    def _least(self) -> None:
        """Only the first `top` of each source stay, ties in byte order."""
        col, f, term = (np.concatenate(x) for x in zip(*self.best))
        place = np.empty(len(self.terms), np.int64)
        place[sorted(range(len(self.terms)), key=self.terms.__getitem__)] = np.arange(len(self.terms))
        order = np.lexsort((place[term], -f, col))
        col, f, term = col[order], f[order], term[order]
        keep = np.arange(len(col)) - np.searchsorted(col, col) < self.top
        used, term = np.unique(term[keep], return_inverse=True)
        self.terms = [self.terms[k] for k in used]
        self.best = [(col[keep], f[keep], term)]


OUT_DDL = "lang string, source string, part string, item string, value bigint"
OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _walk(kept: DataFrame, walk: list[dict], prior: int, top: int) -> DataFrame:
    """Partial results of all tasks: rows of part `pair` to be added up, and of part `term` to be ranked."""
    shared = kept.sparkSession.sparkContext.broadcast(walk)  # at most GROUPS groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audits: dict[str, list[_Audit]] = {}
        for pair in shared.value:
            audits.setdefault(pair["lang"], []).append(_Audit(pair, top))
        for b in batches:
            for lang, rows in itertools.groupby(b.to_pylist(), lambda r: r["lang"]):
                rows = list(rows)
                for audit in audits.get(lang, ()):
                    step = max(1, (1 << 18) // len(audit.total[0]))
                    for i in range(0, len(rows), step):
                        part = rows[i : i + step]
                        audit.take([r["term"] for r in part], [r["sources"] for r in part], [r["counts"] for r in part], prior)
        for audit in itertools.chain.from_iterable(audits.values()):
            left, right, lang = audit.pair["left"][0], audit.pair["right"][0], audit.pair["lang"]
            a, b = np.nonzero(np.triu(audit.sums, 1) if audit.pair["same"] else audit.sums)
            cols = [[left[k] for k in a], [right[k] for k in b], audit.sums[a, b].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(cols[0], pa.string()), pa.array(["pair"] * len(a), pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], schema=OUT)
            for col, f, term in audit.best:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(col), pa.string()), pa.array([left[k] for k in col], pa.string()), pa.array(["term"] * len(col), pa.string()), pa.array([audit.terms[k].decode() for k in term], pa.string()), pa.array(f)], schema=OUT)
        del audits
        give_back()

    return kept.mapInArrow(run, OUT_DDL)


def source_divergence(docs: DataFrame, least: int = 30, prior: int = 5, top: int = 50) -> DataFrame:
    """How the sources of each language differ: lang, source, part, item, value, rank.

    docs has text, lang and source (null: empty) and doc_id; other columns are
    ignored, and so are ids: each row is a document. A term is a run of
    letters A-Z, a-z (folded) and characters beyond ASCII. A language keeps
    the V terms in at least `least` of its documents; a source with N
    occurrences of them gives a kept term with c the rate
    1 + floor(10^9 * (c + prior) / (N + prior * V)), the whole language
    likewise. Part `pair`: the summed differences of rates to each other
    source of the language, all of them (0 where no term is kept). Part
    `term`: terms of the source with a rate above the language's, and by how
    much, the first `top`. Ranks go by value descending, then item in byte
    order. No rows give no rows.
    """
    empty = F.lit("")
    kept = stored(kept_terms(docs, least), "kept")
    groups = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source")).distinct()
    said = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    size = kept.groupBy("lang").agg((F.count("*") * prior).alias("v"))
    groups = stored(groups.join(said, ["lang", "source"], "left").join(size, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")), "groups")
    own = groups.groupBy("lang").agg(F.sum("n").alias("own"), F.count("*").alias("k"))
    cut = groups.join(own, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.ceil(F.col("k") / BLOCK)))
    block = cut.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("source", (F.col("n") + F.col("v")).alias("total")))).alias("m"), F.first(F.col("own") + F.col("v")).alias("own"), F.first("v").alias("v"))
    side = lambda name, at: block.select("lang", F.col("block").alias(at), F.col("m.source").alias(name), F.col("m.total").alias(f"{name}_total"), *([F.col("own"), F.col("v")] if at == "a" else []))
    totals = stored(side("left", "a").join(side("right", "b"), "lang").where("a <= b").withColumn("total", F.col("own")), "blocks")
    found = None
    for walk in _blocks(totals.where("v > 0")):  # one, unless there are many thousand sources
        part = stored(_walk(kept, walk, prior, top), "walked")
        found = part if found is None else found.unionByName(part)
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    if found is None:
        sums, terms = pairs.withColumn("value", F.lit(0).cast("bigint")), pairs.withColumn("value", F.lit(0).cast("bigint")).where("false")
    else:
        both = found.where("part = 'pair'").groupBy("lang", F.least("source", "item").alias("x"), F.greatest("source", "item").alias("y")).agg(F.sum("value").alias("value"))
        ends = pairs.withColumn("x", F.least("source", "item")).withColumn("y", F.greatest("source", "item"))
        sums = ends.join(both, ["lang", "x", "y"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
        terms = found.where("part = 'term'").select("lang", "source", "item", "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = [sums.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(by)), terms.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)]
    return out[0].unionByName(out[1]).select("lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), "rank")
