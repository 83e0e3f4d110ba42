"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints (copies collapse first) are laid out in tiles of bounded
size. A tile holds fingerprints of one cell; cells are counts for which a
difference bounds the distance from below, and tile pairs whose cells differ
too much are skipped. Every remaining pair of tiles is compared whole: numpy
exclusive-or and bit counts, no sampling and no candidate cap. A pair of tiles
gives back a forest of its links, at most one fewer than its members, and
`components` joins those.

Two kinds of link:

* `simhash_components`: 64-bit fingerprints, at most `radius` differing bits.
  Cells are population counts of equal parts of the fingerprint; the sum of
  their differences is at most the number of differing bits.
* `near_groups`: sets of word shingles (XXH64 hashes) of Jaccard similarity
  `min_sim` or more. Nothing is estimated. A set of n hashes shares at least
  ceil(min_sim * n) of them with any set that similar, so a first pass finds
  the hashes that occur in another set too (packed by bucket, see `matching`),
  and only texts with that many of them go on. Two such sets share one of the
  first n - ceil(min_sim * n) + 1 hashes of either in any common order (prefix
  filter); texts that do, and whose sizes, places and parity maps allow it
  (population count of an exclusive-or, as above), are candidates, and every
  candidate pair is decided on its two whole sets. Hashes frequent in a sample
  come last in the order, so they rarely make candidates; the order does not
  affect the result. Pairs whose SimHashes differ in RADIUS bits or fewer
  (fingerprints of the sets in tiles, as above) and pairs of neighbours are
  decided first and their components found; then all pairs that these leave
  in different components, a list of more than LIST entries in pairs of blocks.

The comparison of tiles is quadratic in the distinct fingerprints of
neighbouring cells. It is dealt over tile pairs, so it spreads over any
cluster, but its total work grows faster than the input; candidates grow with
the square of the texts that share a rare hash without being linked.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import matching as M
from plumbline.llm.common import Layout, give_back, mix, slices, stored, text_arrays, texts
from plumbline.llm.components import components, forest

SEED = 42
#: Fingerprints of a tile: a 64th of all, within these bounds.
TILE_LEAST, TILE_MOST = 2048, 32768
#: Sets of the sample that orders hashes, and most hashes ranked by it.
SAMPLE, RANKED = 5000, 1 << 20
#: Entries of one block of a hash's list: longer lists are compared block by block.
LIST = 4096
#: Bits of a parity map of a set: two maps differ in no more bits than their sets in hashes.
PARITY = 512
#: Prefix entries of a bucket, pairs of one step.
BUCKET, STEP = 1 << 19, 1 << 20
#: Differing bits up to which SimHash puts sets together, before the whole sets decide.
RADIUS = 3
#: Ids from here on stand for rows without one.
NULL_ID = (1 << 63) - (1 << 41)


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of every run of `size` words, lower-cased A-Z, repeats included; fewer words: the whole sequence."""
    w = text.lower().split()  # bytes: ASCII letters and \x20 \x09-\x0D only
    if not w:
        return []
    if len(w) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    line = b" ".join(w)
    ends = list(itertools.accumulate(map(len, w), lambda a, b: a + b + 1))
    digest = xxhash.xxh64_intdigest
    starts = [0] + [e + 1 for e in ends[: len(w) - size]]
    return [digest(line[s:e], SEED) for s, e in zip(starts, ends[size - 1 :])]


def majority(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the hash lists h[cut[i]:cut[i + 1]]: a bit is 1 if set in over half; empty lists give 0."""
    n = np.diff(cut)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n > 0)
    if not len(some):
        return out
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = np.add.reduceat(bits, cut[some], axis=0, dtype=np.int64)
    packed = np.packbits(votes * 2 > n[some, None], axis=1)
    out[some] = packed.view(">u8").ravel().astype(np.uint64)
    return out


def _hash_lists(data: np.ndarray, offsets: np.ndarray, size: int, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw = data.tobytes()
    for i, j in slices(offsets, limit):
        lists = [shingle_hashes(raw[offsets[k] : offsets[k + 1]], size) for k in range(i, j)]
        cut = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        yield i, j, np.fromiter(itertools.chain.from_iterable(lists), np.uint64, cut[-1]), cut


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each text as a signed long; null text or no words: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_arrays(b.column(1))
            fp = [majority(h, cut) for _, _, h, cut in _hash_lists(data, off, shingle)]
            fp = np.concatenate(fp) if fp else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
            del data
            give_back()

    return texts(docs).mapInArrow(run, "doc_id bigint, fp bigint")


ENTRY = np.dtype([("h", "<u8"), ("node", "<i8"), ("n", "<i4"), ("at", "<i4")])


def _sets(text: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges (i, j) of the texts: sorted distinct shingle hashes, their rows, and the offsets."""
    data, off = text_arrays(text)
    for i, j, h, cut in _hash_lists(data, off, size):
        doc = np.repeat(np.arange(j - i), np.diff(cut))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        yield i, j, h, doc, np.searchsorted(doc, np.arange(j - i + 1))


def _set_key(h: np.ndarray) -> bytes:
    return hashlib.md5(h.tobytes(), usedforsecurity=False).digest()


def least_overlap(n: np.ndarray, min_sim: float) -> np.ndarray:
    """Hashes that a set of n must share with any set as similar as min_sim."""
    return np.ceil(n * min_sim - 1e-9).astype(np.int64)


def _distinct_sets(text: pa.Array, size: int) -> tuple[list[bytes], dict[bytes, np.ndarray]]:
    """The key of each text's set, and the sets by key."""
    keys, sets = [], {}
    for _, _, h, _, cut in _sets(text, size):
        for x, y in zip(cut[:-1], cut[1:]):
            keys.append(_set_key(h[x:y]))
            sets.setdefault(keys[-1], h[x:y])
    return keys, sets


def shared_sets(docs: DataFrame, shingle: int = 5, min_sim: float = 0.8) -> DataFrame:
    """(doc_id, key, n, hashes): MD5 and size of each text's set of shingle hashes, and the set itself.

    hashes is null for sets that share too few hashes with other sets to be
    similar to any, and for all but the smallest doc_id of a key and group of
    documents. A set in the same group with an equal key is no other set.
    """
    lay = Layout.of(docs)
    nb = lay.buckets
    keyed = lay.dealt(docs)

    def send(key: tuple, t: pa.Table) -> pa.Table:
        _, sets = _distinct_sets(t.column("text"), shingle)
        give_back()
        return M.pack(key[0].as_py(), M.keys32(np.concatenate([np.zeros(0, np.uint64), *sets.values()]), nb))

    def pick(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        keys, sets = _distinct_sets(t.column("text"), shingle)
        elsewhere = M.answered_keys(answers)
        found, often = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets.values()]), return_counts=True)
        again = found[(often > 1) | M.member(M.keys32(found, nb), elsewhere)]
        live = {k for k, h in sets.items() if len(h) and M.member(h, again).sum() >= least_overlap(np.array(len(h)), min_sim)}
        ids = t.column("doc_id").to_pylist()
        first: dict[bytes, int] = {}
        for i, k in zip(ids, keys):
            first[k] = min(i, first.get(k, i))
        del found, often, again, elsewhere
        body, given = [], set()
        for i, k in zip(ids, keys):
            ok = k in live and i == first[k] and k not in given
            body.append(sets[k].tobytes() if ok else None)
            if ok:
                given.add(k)
        give_back()
        return pa.table([t.column("doc_id").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array([len(sets[k]) for k in keys], pa.int64()), pa.array(body, pa.binary())], names=["doc_id", "key", "n", "hashes"])

    shared = M.shared_values(keyed.groupBy("bid").applyInArrow(send, M.SENT_DDL), lay.partitions)
    return keyed.groupBy("bid").cogroup(shared.repartition(lay.partitions, "bid").groupBy("bid")).applyInArrow(pick, "doc_id bigint, key binary, n bigint, hashes binary")


def _one_in(sets: DataFrame) -> int:
    return max(1, sets.count() // SAMPLE)


def _ranks(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that occur repeatedly in a sample of the sets (node, hashes), sorted, and how often; only the order of prefixes depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64))], ["h"])

    some = sets.where(F.pmod(F.xxhash64("node"), F.lit(_one_in(sets))) == 0)
    t = some.select("hashes").mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("k")).where("k > 1").orderBy(F.desc("k"), "h").limit(RANKED).toArrow()
    h, k = t.column("h").to_numpy().view(np.uint64), t.column("k").to_numpy()
    order = np.argsort(h)
    return h[order], k[order]


def prefixes(sets: DataFrame, ranks: tuple[np.ndarray, np.ndarray], min_sim: float = 0.8) -> DataFrame:
    """(node, n, fp, prefix, parity) of each set (node, n, hashes): its SimHash, its first hashes in the order of the ranks, and its parity map."""
    shared = sets.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for b in batches:
            first, odd, fp = [], [], []
            for x in b.column(2).to_pylist():
                h = np.frombuffer(x, np.uint64)
                fp.append(majority(h, np.array([0, len(h)]))[0])
                odd.append(np.packbits((np.bincount((mix(h) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(bool)).tobytes())
                rank = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, often[at], 0)
                first.append(h[np.lexsort((h, rank))][: len(h) - least_overlap(np.array(len(h)), min_sim) + 1].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(first, pa.binary()), pa.array(odd, pa.binary())], ["node", "n", "fp", "prefix", "parity"])

    return sets.select("node", "n", "hashes").mapInArrow(run, "node bigint, n bigint, fp bigint, prefix binary, parity binary")


def _ball(cell: tuple[int, ...], reach: int) -> Iterator[tuple[int, ...]]:
    """Cells whose counts differ by `reach` in sum at most."""
    if not cell:
        yield ()
        return
    for d in range(-reach, reach + 1):
        for tail in _ball(cell[1:], reach - abs(d)):
            yield (cell[0] + d, *tail)


def _compare_tiles(reps: DataFrame, n: int, reach: int, match) -> DataFrame:
    """Compare reps (node, cell array<int>, item binary) with those of neighbouring cells, tile by tile.

    match(x, y) takes items as rows of bytes and returns the index pairs that
    link and those that are open. Rows of kind 0 are links (u, v), a forest
    for each tile pair; rows of kind 1 say that node u has an open pair in the
    tile pair (a, b), on side v. The number of cells is bounded by their
    definition, so their counts go to the driver; fingerprints never do.
    """
    spark = reps.sparkSession
    counts = {tuple(r["cell"]): r["count"] for r in reps.groupBy("cell").count().toLocalIterator()}
    tile = max(TILE_LEAST, min(TILE_MOST, n // 64))
    tiles: dict[tuple[int, ...], tuple[int, int]] = {}
    total = 0
    for c in sorted(counts):
        tiles[c] = (total, math.ceil(counts[c] / tile))
        total += tiles[c][1]
    known = spark.sparkContext.broadcast(tiles)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total)
    table = spark.createDataFrame([(list(c), at, k) for c, (at, k) in tiles.items()], "cell array<int>, first int, k int")
    tiled = reps.join(F.broadcast(table), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("node"), F.col("k"))).cast("int").alias("tile"), "cell", "node", "item")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        me, cell = t.column("tile")[0].as_py(), tuple(t.column("cell")[0].as_py())
        body = [pa.array([t.column("node").to_numpy().tobytes()], pa.binary()), pa.array([b"".join(t.column("item").to_pylist())], pa.binary())]
        for c in _ball(cell, reach):
            first, k = known.value.get(c, (0, 0))
            for x in range(first, first + k):  # a row at a time: one copy of the tile is held
                yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in (min(me, x), max(me, x), int(x < me))], *body], ["a", "b", "side", "nodes", "items"])
        del t, body
        give_back()

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("side").to_pylist(), t.column("nodes").to_pylist(), t.column("items").to_pylist()))
        u, v, left, right = _compare_sides(rows[0][1:], rows[-1][1:], match)
        del rows
        give_back()
        a, b = key[0].as_py(), key[1].as_py()
        sides = [(left, 0)] + ([(right, 1)] if a != b else [])
        m, k = len(u), sum(len(x) for x, _ in sides)
        return pa.table([pa.array([0] * m + [1] * k, pa.int32()), pa.array([a] * (m + k), pa.int32()), pa.array([b] * (m + k), pa.int32()),
                         pa.array(np.concatenate([u, *[x for x, _ in sides]])), pa.array(np.concatenate([v, *[np.full(len(x), w, np.int64) for x, w in sides]]))], names=["kind", "a", "b", "u", "v"])

    pairs = tiled.repartition(parts, "tile").groupBy("tile").applyInArrow(spread, "a int, b int, side int, nodes binary, items binary")
    return pairs.repartition(parts, "a", "b").groupBy("a", "b").applyInArrow(compare, "kind int, a int, b int, u bigint, v bigint")


def _compare_sides(left: tuple[bytes, bytes], right: tuple[bytes, bytes], match) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forest links between two packed lists of (nodes, items), and the nodes of either side that keep an open pair.

    If both are the same list, open nodes of both sides are given as the left ones.
    """
    same = left == right
    a, b = np.frombuffer(left[0], np.int64), np.frombuffer(right[0], np.int64)
    size = len(left[1]) // max(len(a), 1)
    x, y = (np.frombuffer(r[1], np.uint8).reshape(-1, size) for r in (left, right))
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_a, open_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    step = max(1, (1 << 18) // max(len(b), 1))  # all of them may link
    for i in range(0, len(a), step):
        (p, q), (op, oq) = match(x[i : i + step], y)
        if len(p):
            u, v = forest(np.concatenate([u, a[i + p]]), np.concatenate([v, b[q]]))
        if len(op):
            apart = a[i + op] != b[oq]
            if len(u):  # pairs that are connected already are settled
                root = lambda z: np.where(u[np.minimum(np.searchsorted(u, z), len(u) - 1)] == z, v[np.minimum(np.searchsorted(u, z), len(u) - 1)], z)  # noqa: B023, E731
                apart &= root(a[i + op]) != root(b[oq])
            open_a[i + op[apart]] = True
            open_b[oq[apart]] = True
    if same:
        open_a |= open_b
    return u, v, a[open_a], b[open_b]


NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _parts_for(n: int) -> int:
    """Parts of the fingerprint whose bits are counted: more for more fingerprints. Any number gives the same links."""
    return 1 if n < 300_000 else 2 if n < 3_000_000 else 4


def _tile_links(reps: DataFrame, radius: int) -> DataFrame:
    """Forest links (u, v) of reps (fp, node), each fingerprint once, that differ in at most `radius` bits: all pairs of tiles that can hold such."""
    n = reps.count()
    k = _parts_for(n)
    bits = 64 // k
    mask = (1 << bits) - 1
    count = [F.bit_count(F.shiftrightunsigned("fp", i * bits).bitwiseAND(F.lit(mask if bits < 64 else -1))) for i in range(k)]
    cells = reps.select("node", F.array(*count).alias("cell"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("item"))

    def match(x: np.ndarray, y: np.ndarray) -> tuple:
        a, b = (np.ascontiguousarray(z).view(np.uint64).ravel() for z in (x, y))
        return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius), NONE

    return _compare_tiles(cells, n, radius, match).select("u", "v")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs (doc_id, text; other columns ignored).

    Fingerprints with at most `radius` differing bits link; component_id is
    the smallest doc_id reachable, itself included. Texts that are null or
    have no word have fingerprint zero and link like any other. A null doc_id
    is passed over: component_id is null where no linked row has an id. Rows
    that repeat keep a row each.
    """
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    no_id = F.lit(NULL_ID) + F.xxhash64("fp").bitwiseAND(F.lit((1 << 40) - 1))
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("m")).select("fp", F.coalesce("m", no_id).alias("node")), "reps")
    comp = components(_tile_links(reps, radius))
    roots = reps.join(comp.select(F.col("u").alias("node"), "v"), "node", "left").select("fp", F.coalesce("v", "node").alias("root"))
    return fps.join(roots, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("root") < F.lit(NULL_ID), F.col("root")).alias("component_id"))


def _shared_hashes(reps: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(bucket, h, node, n, at, prev): prefix entries whose hash several nodes have, and the one before in order of size.

    reps has node, n and prefix. Entries travel packed by bucket of the hash.
    hot has hashes too frequent for one bucket, sorted, and how many parts
    theirs are cut into; the first of a part is its own prev.
    """
    spark = reps.sparkSession
    total = reps.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / 8 / BUCKET))
    shared = spark.sparkContext.broadcast(hot)

    def parts_of(h: np.ndarray) -> np.ndarray:
        """Parts of each hash, 1 for most."""
        known, parts = shared.value
        if not len(known):
            return np.ones(len(h), np.int64)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, parts[at], 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            e = np.concatenate(held)
            part = mix(e["node"].view(np.uint64)) % parts_of(e["h"]).astype(np.uint64)
            which = (mix(e["h"] + part) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(which, kind="stable")
            cut = np.searchsorted(which[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(some), pa.array([e[order[cut[k] : cut[k + 1]]].tobytes() for k in some], pa.binary())], ["bucket", "entries"])

        for b in batches:
            k = pa.compute.binary_length(b.column(2)).to_numpy() // 8
            e = np.zeros(k.sum(), ENTRY)
            e["h"] = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64)
            e["node"], e["n"] = np.repeat(b.column(0).to_numpy(), k), np.repeat(b.column(1).to_numpy(), k)
            e["at"] = np.arange(len(e)) - np.repeat(np.cumsum(k) - k, k)
            held.append(e)
            size += len(e)
            if size >= STEP:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(t.column("entries").to_pylist()), ENTRY)
        e = e[np.lexsort((e["node"], e["n"], e["h"]))]
        same = np.append(e["h"][1:] == e["h"][:-1], False)
        keep = np.flatnonzero(same | np.append(False, same[:-1]) | (parts_of(e["h"]) > 1))
        first = np.append(False, same[:-1])[keep]
        prev = np.where(first, e["node"][np.maximum(keep - 1, 0)], e["node"][keep])
        e = e[keep]
        return pa.table([pa.array(np.full(len(e), key[0].as_py())), *[pa.array(np.ascontiguousarray(e[c]).astype(np.int64, copy=False) if c != "h" else np.ascontiguousarray(e[c]).view(np.int64)) for c in ENTRY.names], pa.array(prev)],
                        names=["bucket", *ENTRY.names, "prev"])

    packed = reps.select("node", "n", "prefix").mapInArrow(pack, "bucket bigint, entries binary")
    return packed.groupBy("bucket").applyInArrow(gather, "bucket bigint, h bigint, node bigint, n bigint, at bigint, prev bigint")


def _apart(min_sim: float):  # noqa: ANN202
    """A function of a group (h, node, n, at, root, mine, a, b, parity): candidate pairs (u, v), u < v, of nodes with different roots.

    Where a < b, only pairs between these two blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        odd = np.frombuffer(b"".join(t.column("parity").to_pylist()), np.uint64).reshape(t.num_rows, -1)
        h, node, n, at, root, mine, a, b = (t.column(c).to_numpy() for c in ("h", "node", "n", "at", "root", "mine", "a", "b"))
        across = len(a) > 0 and a[0] != b[0]
        order = np.lexsort((node, n, h))
        odd = odd[order]
        h, node, n, at, root, mine = (x[order] for x in (h, node, n, at, root, mine))
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        for a, z in zip(edge, np.append(edge[1:], len(h))):
            if (root[a:z] == root[a]).all():
                continue
            most = np.searchsorted(n[a:z], n[a:z] / min_sim + 1e-6, "right") + a  # partners end here: they are larger at most by the ratio
            ahead = most - np.arange(a, z) - 1
            upto = np.cumsum(ahead)
            i = 0
            while i < z - a:
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + STEP, "right")))
                k = ahead[i:j]
                p = np.repeat(np.arange(a + i, a + j), k)
                q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(k) - k, k)
                # the first shared hash of a pair as similar as min_sim leaves room for its overlap
                need = np.ceil((n[p] + n[q]) * (min_sim / (1 + min_sim)) - 1e-6)
                ok = (root[p] != root[q]) & (np.minimum(n[p] - at[p], n[q] - at[q]) >= need)
                if across:
                    ok &= mine[p] != mine[q]
                p, q, need = p[ok], q[ok], need[ok]
                ok = np.bitwise_count(odd[p] ^ odd[q]).sum(1, dtype=np.int64) <= n[p] + n[q] - 2 * need
                u, v = node[p[ok]], node[q[ok]]
                pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], ["u", "v"])
                i = j

    return run


def _blocks(entries: DataFrame) -> DataFrame:
    """entries (bucket, h, node, ...) of hashes with several roots, with the group (bucket, a, b) they are compared in and their block, mine.

    A list of up to LIST entries is compared in its bucket; a longer one is cut
    into blocks by a hash of the node, and each pair of blocks is a group.
    """
    lists = entries.groupBy("h").agg(F.count("*").alias("k"), (F.min("root") != F.max("root")).alias("open")).where("open")
    some = entries.join(lists.select("h", F.ceil(F.col("k") / LIST).cast("int").alias("s")), "h")
    mine = some.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    return dealt.select(F.when(F.col("s") > 1, F.col("h")).otherwise(F.col("bucket")).alias("bucket"), F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "h", "node", "n", "at", "root")


def _linked(pairs: DataFrame, sets: DataFrame, min_sim: float) -> DataFrame:
    """The pairs (u, v) whose sets (node, hashes) have a Jaccard similarity of min_sim or more."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # merges the two sorted runs
                k = int((both[1:] == both[:-1]).sum())
                ok.append(k >= min_sim * (len(both) - k) - 1e-9)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["u", "v"])

    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_set")) for c in "uv")
    return pairs.join(left, "u").join(right, "v").select("u", "v", "u_set", "v_set").mapInArrow(decide, "u bigint, v bigint")


def simhash_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """Pairs (u, v) of nodes of prints (node, fp) that SimHash puts together: each with the first of its fingerprint, and those of fingerprints within `radius` bits along the forests of `_tile_links`."""
    reps = stored(prints.groupBy("fp").agg(F.min("node").alias("first")), "reps")
    same = prints.join(reps, "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    return same.unionByName(_tile_links(reps.select("fp", F.col("first").alias("node")), radius)).where("u <> v")


def near_groups(docs: DataFrame, shingle: int = 5, min_sim: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """doc_id and group (smallest doc_id of the rows linked by similarity `min_sim` or more) of each row.

    The sets that may have a partner get SimHash fingerprints; what these put
    together within `radius` bits is decided on the whole sets first. Pairs as
    similar as min_sim often lie further apart (about ten bits at 0.8), so
    neighbours in lists of shared hashes are decided with them, and after that
    all pairs still in different components: the radius changes no result.

    Rows whose texts have equal shingle sets (copies, up to case and white
    space) are always together. doc_id must not be null.
    """
    sk = stored(shared_sets(docs, shingle, min_sim), "sets")
    reps = stored(sk.groupBy("key").agg(F.min("doc_id").alias("node")), "reps")
    live = sk.where("hashes is not null").join(reps.withColumnRenamed("node", "doc_id"), ["key", "doc_id"], "left_semi")
    sets = stored(live.dropDuplicates(["key", "doc_id"]).select(F.col("doc_id").alias("node"), "n", "hashes"), "live")
    ranks = _ranks(sets)
    often = ranks[1] * _one_in(sets)  # in all sets, about
    first = stored(prefixes(sets, ranks, min_sim), "prefixes")
    shared = stored(_shared_hashes(first, (ranks[0][often > BUCKET], -(-often[often > BUCKET] // BUCKET))), "shared")
    heads = shared.where("node = prev")
    heads = heads.join(heads.groupBy("h").agg(F.min("node").alias("least"), F.count("*").alias("k")).where("k > 1").select("h", "least"), "h").select("node", F.col("least").alias("prev"))
    alike = simhash_pairs(first.select("node", "fp"), radius).select(F.col("u").alias("node"), F.col("v").alias("prev"))
    pairs = alike.unionByName(shared.select("node", "prev")).unionByName(heads).where("node <> prev")
    near = pairs.select(F.least("node", "prev").alias("u"), F.greatest("node", "prev").alias("v")).distinct()
    links = stored(_linked(near, sets, min_sim), "links")
    comp = components(links).select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted = stored(shared.join(comp, "node", "left").select("bucket", "h", "node", "n", "at", F.coalesce("root", "node").alias("root")), "rooted")
    maps = first.select("node", "n", "parity").distinct()  # an id with several texts has a map for each size
    rest = _blocks(rooted).join(maps, ["node", "n"]).groupBy("bucket", "a", "b").applyInArrow(_apart(min_sim), "u bigint, v bigint").distinct()
    comp = components(links.unionByName(_linked(rest, sets, min_sim)))
    roots = reps.join(comp.select(F.col("u").alias("node"), "v"), "node", "left").select("key", F.coalesce("v", "node").alias("group"))
    return sk.join(roots, "key").select("doc_id", "group")


def simhash_dedup(docs: DataFrame, shingle: int = 5, min_sim: float = 0.8) -> DataFrame:
    """The rows of docs with one row of each near-duplicate group (`near_groups`: SimHash in tiles, then whole sets) kept, the one with the smallest doc_id.

    Columns stay as they are. Rows with a null or empty text are alike and one
    stays. Rows with the same doc_id are one document; the row with the
    smallest text stays for it. Rows with a null doc_id are kept as they are.
    Only the ids to drop are joined, so texts move only if these are too many
    to broadcast (Spark checks the size).
    """
    groups = stored(near_groups(docs.where("doc_id is not null"), shingle, min_sim), "groups")
    again = stored(groups.groupBy("doc_id").count().where("count > 1").join(groups.where("doc_id = group").select("doc_id").distinct(), "doc_id").select("doc_id"), "again")
    gone = stored(groups.where("doc_id <> group").select("doc_id").unionByName(again).distinct(), "gone")
    rest = [c for c in docs.columns if c != "doc_id"]
    one = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.coalesce("text", F.lit(""))).alias("_row"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("doc_id", "_row.*").select(*docs.columns))
