"""Exact join of texts by the Jaccard similarity of their word n-grams.

1. A text is the set of 64-bit hashes of its n-grams. A set that shares too few
   hashes with other sets links with none and is passed over; hashes travel
   packed by bucket (see `matching`), each once a group of documents.
2. The others become points of their counts by hash group (see `rtree`). Two
   linked sets share one of the first hashes of either in any common order, so
   sets meet in the lists of those hashes, the rare ones first.
3. Neighbours in a list, in order of size, are decided first, and components
   found. Only lists with several components go on: a list is an R-tree, whose
   join with itself gives the pairs of different components that the summed
   minima of counts leave open. A list beyond LIST sets is cut by size class
   into blocks; a block with its upper corner is a node of a tree over tasks,
   and only pairs of blocks that pass the same bound are brought together.
4. Open pairs are decided on their two whole sets: first the likeliest pair of
   each two components in a list; then, in lists where two that had more pairs
   are still apart, every such pair.

No list is sampled or cut off, and no pair within a component is listed. What
grows faster than the input are open pairs: sets that share a rare n-gram and
have similar counts everywhere, without being linked.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import matching as M
from plumbline.llm import simhash as S
from plumbline.llm.common import Layout, give_back, mix, prefix, spans_hash, stored, text_arrays, words_of
from plumbline.llm.components import components
from plumbline.llm.rtree import GROUPS, RTree, count_vector, may_link, overlap_bound

#: Sets of one list that one task compares; longer lists are cut into blocks of about as many.
LIST = 4096
ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts (A-Z as small letters), and the text of each; fewer words: the whole sequence as one."""
    big = (data >= 65) & (data <= 90)
    if big.any():
        data = np.where(big, data + 32, data).astype(np.uint8)
    start, end, first = words_of(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = spans_hash(prefix(data), start, end)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    left = first[text + 1] - np.arange(len(word))  # words to the text's end, this one included
    at = np.flatnonzero((left >= size) | (np.arange(len(word)) == first[text]))
    n = np.minimum(left[at], size)
    h = mix(word[at] + n.astype(np.uint64))
    for k in range(1, size):
        more = n > k
        h[more] = mix(h[more] * ODD + word[at[more] + k])
    return h, text[at]


def gram_sets(text: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text."""
    data, off = text_arrays(text)
    h, which = gram_hashes(data, off, size)
    order = np.lexsort((h, which))
    h, which = h[order], which[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (which[1:] != which[:-1])
    h, which = h[new], which[new]
    return np.split(h, np.searchsorted(which, np.arange(1, len(off) - 1))) if len(off) > 1 else []


def _key(h: np.ndarray) -> bytes:
    return hashlib.md5(h.tobytes(), usedforsecurity=False).digest()


def live_sets(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, key, n, hashes): MD5 and size of each text's set, and the set itself if it may link with another.

    hashes is given once for a key and group of documents, with its smallest id.
    """
    lay = Layout.of(docs)
    nb = lay.buckets
    keyed = lay.dealt(docs)

    def send(key: tuple, t: pa.Table) -> pa.Table:
        data, off = text_arrays(t.column("text"))
        out = M.pack(key[0].as_py(), M.keys32(np.unique(gram_hashes(data, off, size)[0]), nb))
        del data, off
        give_back()
        return out

    def pick(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        own = gram_sets(t.column("text"), size)
        ids, keys = t.column("doc_id").to_pylist(), [_key(h) for h in own]
        first: dict[bytes, int] = {}  # the row that gives the set
        for r, (i, k) in enumerate(zip(ids, keys)):
            if i is not None and (k not in first or i < ids[first[k]]):
                first[k] = r
        sets = {k: own[r] for r, k in enumerate(keys)}
        found, often = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets.values()]), return_counts=True)
        again = found[(often > 1) | M.member(M.keys32(found, nb), M.answered_keys(answers))]
        body: list[bytes | None] = [None] * len(ids)
        for k, r in first.items():
            h = own[r]
            if len(h) and M.member(h, again).sum() * den >= num * len(h):
                body[r] = h.tobytes()
        out = pa.table([t.column("doc_id").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array([len(h) for h in own], pa.int64()), pa.array(body, pa.binary())], names=["doc_id", "key", "n", "hashes"])
        del own, sets, found, often, again, body
        give_back()
        return out

    shared = M.shared_values(keyed.groupBy("bid").applyInArrow(send, M.SENT_DDL), lay.partitions)
    return keyed.groupBy("bid").cogroup(shared.repartition(lay.partitions, "bid").groupBy("bid")).applyInArrow(pick, "doc_id bigint, key binary, n bigint, hashes binary")


def _points(sets: DataFrame) -> DataFrame:
    """(node, point) of each set (node, hashes): its counts by group as packed 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count_vector(np.frombuffer(x, np.uint64)).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["node", "point"])

    return sets.select("node", "hashes").mapInArrow(run, "node bigint, point binary")


def _vectors(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, GROUPS)


def _bounded(pairs: DataFrame, sets: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) that the bound of their points leaves open."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(k).to_numpy() for k in (2, 4))
            keep = pa.array(may_link(overlap_bound(_vectors(b.column(3)), _vectors(b.column(5)), n, m), n, m, num, den))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["u", "v"])

    sized = points.join(sets.select("node", "n"), "node")
    near = [sized.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("point").alias(f"{c}_p")) for c in "uv"]
    return pairs.join(near[0], "u").join(near[1], "v").select("u", "v", "u_n", "u_p", "v_n", "v_p").mapInArrow(bound, "u bigint, v bigint")


def _decided(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) that are linked, by their whole sets (node, hashes)."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort(kind="stable")  # merges the two sorted runs
                k = int((both[1:] == both[:-1]).sum())
                ok.append(den * k >= num * (len(both) - k))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["u", "v"])

    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_set")) for c in "uv")
    return pairs.join(left, "u").join(right, "v").select("u", "v", "u_set", "v_set").mapInArrow(decide, "u bigint, v bigint")


PAIR_DDL = "u bigint, v bigint, h bigint, more boolean"


def _pairs(tree: RTree, h: int, node: np.ndarray, n: np.ndarray, root: np.ndarray, points: np.ndarray, num: int, den: int, one: bool, across: bool = False, at: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The tree's pairs as (u, v), u < v, of the list h; one: of each two components met in a step only the pair with the largest bound for its sizes, and whether there are more."""
    for i, j in tree.pairs(num, den, across):
        if at is not None:  # the first shared hash of a pair leaves room for its overlap
            ok = may_link(np.minimum(n[i] - at[i], n[j] - at[j]), n[i], n[j], num, den)
            i, j = i[ok], j[ok]
        more = np.zeros(len(i), bool)
        if one and len(i):
            share = overlap_bound(points[i], points[j], n[i], n[j]) / (n[i] + n[j])
            a, b = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
            order = np.lexsort((-share, b, a))
            first = np.flatnonzero(np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
            more = np.diff(np.append(first, len(i))) > 1
            i, j = i[order[first]], j[order[first]]
        u, v = node[i], node[j]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(np.full(len(i), h)), pa.array(more)], ["u", "v", "h", "more"])


def _in_lists(num: int, den: int, one: bool):  # noqa: ANN202
    """A function of a bucket's rows (h, node, n, at, root, point): open pairs of each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        points = _vectors(t.column("point"))
        h, node, n, at, root = (t.column(c).to_numpy() for c in ("h", "node", "n", "at", "root"))
        del t
        order = np.argsort(h, kind="stable")
        edge = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
        for a, z in zip(edge, np.append(edge[1:], len(h))):
            own = order[a:z]
            tree = RTree(points[own], n[own], root[own])
            yield from _pairs(tree, h[own[0]], node[own], n[own], root[own], points[own], num, den, one, at=at[own])
        del points
        give_back()

    return run


BLOCK_DDL = "h bigint, class int, sub int, least bigint, most bigint, root0 bigint, root1 bigint, top binary, nodes binary, sizes binary, roots binary, points binary"


def _block(t: pa.Table) -> pa.Table:
    """A block of a long list, packed, with its upper corner: a node of the tree over tasks."""
    points = _vectors(t.column("point"))
    node, n, root = (t.column(c).to_numpy() for c in ("node", "n", "root"))
    h, cls, sub = (t.column(c)[0].as_py() for c in ("h", "class", "sub"))
    return pa.Table.from_pylist([{
        "h": h, "class": cls, "sub": sub, "least": int(n.min()), "most": int(n.max()), "root0": int(root.min()), "root1": int(root.max()), "top": points.max(0).tobytes(),
        "nodes": node.tobytes(), "sizes": n.tobytes(), "roots": root.tobytes(), "points": points.tobytes()}],
        pa.schema([("h", pa.int64()), ("class", pa.int32()), ("sub", pa.int32()), *[(c, pa.int64()) for c in ("least", "most", "root0", "root1")], *[(c, pa.binary()) for c in ("top", "nodes", "sizes", "roots", "points")]]))


def _in_blocks(entries: DataFrame, num: int, den: int, one: bool) -> DataFrame:
    """Open pairs (u, v) of lists that are too long for a task: entries (h, node, n, root, point)."""
    cls = F.floor(F.log("n") / math.log(den / num) + 1e-9).cast("int")  # linked sets differ by one class at most
    parts = entries.withColumn("class", cls)
    many = parts.groupBy("h", "class").agg(F.ceil(F.count("*") / LIST).cast("int").alias("s"))
    cut = parts.join(many, ["h", "class"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
    blocks = stored(cut.select("h", "class", "sub", "node", "n", "root", "point").groupBy("h", "class", "sub").applyInArrow(_block, BLOCK_DDL), "blocks")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {c: b.column(c).to_numpy() for c in ("a_least", "b_least", "a_most", "b_most", "a_root0", "a_root1", "b_root0", "b_root1")}
            most = overlap_bound(_vectors(b.column("a_top")), _vectors(b.column("b_top")), col["a_most"], col["b_most"])
            keep = may_link(most, col["a_least"], col["b_least"], num, den) & ((col["a_root0"] != col["b_root1"]) | (col["a_root1"] != col["b_root0"]))
            yield b.select(["h", "a_class", "a_sub", "b_class", "b_sub"]).filter(pa.array(keep))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                same = (r["a_class"], r["a_sub"]) == (r["b_class"], r["b_sub"])
                sides = "a" if same else "ab"
                node, n, root = (np.concatenate([np.frombuffer(r[f"{s}_{c}"], np.int64) for s in sides]) for c in ("nodes", "sizes", "roots"))
                points = np.concatenate([np.frombuffer(r[f"{s}_points"], np.uint16).reshape(-1, GROUPS) for s in sides])
                side = np.concatenate([np.full(len(r[f"{s}_nodes"]) // 8, k) for k, s in enumerate(sides)])
                yield from _pairs(RTree(points, n, root, side), r["h"], node, n, root, points, num, den, one, across=not same)
            give_back()

    named = lambda s, cols: blocks.select("h", *[F.col(c).alias(f"{s}_{c}") for c in ("class", "sub", *cols)])
    corner, body = ("least", "most", "root0", "root1", "top"), ("nodes", "sizes", "roots", "points")
    after = (F.col("a_class") < F.col("b_class")) | (F.col("a_sub") <= F.col("b_sub"))
    nodes = named("a", corner).join(named("b", corner), "h").where(F.col("b_class").between(F.col("a_class"), F.col("a_class") + 1) & after)
    some = nodes.mapInArrow(bounded, "h bigint, a_class int, a_sub int, b_class int, b_sub int")
    met = some.join(named("a", body), ["h", "a_class", "a_sub"]).join(named("b", body), ["h", "b_class", "b_sub"])
    return met.mapInArrow(compare, PAIR_DDL)


def _open_pairs(rooted: DataFrame, points: DataFrame, num: int, den: int, one: bool) -> DataFrame:
    """Pairs (u, v) of different roots that the bounds leave open in the lists of rooted (bucket, h, node, n, at, root); see `_pairs` for one."""
    lists = stored(rooted.groupBy("h").agg(F.count("*").alias("k"), (F.min("root") != F.max("root")).alias("open")).where("open").select("h", "k"), "lists")
    entries = rooted.join(lists, "h").join(points, "node")
    parts = int(rooted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ("bucket", "h", "node", "n", "at", "root", "point")
    out = entries.where(F.col("k") <= LIST).select(*cols).repartition(parts, "bucket").groupBy("bucket").applyInArrow(_in_lists(num, den, one), PAIR_DDL)
    long = lists.where(F.col("k") > LIST)
    return out if long.isEmpty() else out.unionByName(_in_blocks(entries.where(F.col("k") > LIST), num, den, one))


def _rooted(entries: DataFrame, comp: DataFrame) -> DataFrame:
    """entries with the root of their node's component."""
    roots = comp.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return entries.join(roots, "node", "left").select("bucket", "h", "node", "n", "at", F.coalesce("root", "node").alias("root"))


def jaccard_components(docs: DataFrame, shingle: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text; other columns ignored).

    A text's set are its distinct runs of `shingle` words [^\\x20\\x09-\\x0D]+
    (A-Z as small letters); fewer words: the whole sequence. Rows link where
    den * intersection >= num * union; component_id is the smallest doc_id
    reachable by links, itself included. A null text, or one without words,
    has an empty set and links with nothing. A row with a null doc_id links
    nothing and has a null component. Rows that repeat, and rows with one
    doc_id and several texts, keep a row each; such texts count as one
    document only where they link by themselves. Sets are compared by 64-bit
    hashes of their members.
    """
    sk = stored(live_sets(docs, shingle, num, den), "sets")
    reps = stored(sk.where("doc_id is not null and n > 0").groupBy("key").agg(F.min("doc_id").alias("node")), "reps")
    live = sk.where("hashes is not null").join(reps.withColumnRenamed("node", "doc_id"), ["key", "doc_id"], "left_semi")
    sets = stored(live.dropDuplicates(["key", "doc_id"]).select(F.col("doc_id").alias("node"), "n", "hashes"), "live")
    ranks = S._ranks(sets)  # noqa: SLF001
    often = ranks[1] * S._one_in(sets)  # noqa: SLF001  in all sets, about
    first = S.prefixes(sets, ranks, num / den).select("node", "n", "prefix")
    shared = stored(S._shared_hashes(first, (ranks[0][often > S.BUCKET], -(-often[often > S.BUCKET] // S.BUCKET))), "shared")  # noqa: SLF001
    points = stored(_points(sets), "points")
    heads = shared.where("node = prev")
    heads = heads.join(heads.groupBy("h").agg(F.min("node").alias("least"), F.count("*").alias("k")).where("k > 1").select("h", "least"), "h").select("node", F.col("least").alias("prev"))
    pairs = shared.select("node", "prev").unionByName(heads).where("node <> prev")
    near = pairs.select(F.least("node", "prev").alias("u"), F.greatest("node", "prev").alias("v")).distinct()
    links = stored(_decided(stored(_bounded(near, sets, points, num, den), "bounded"), sets, num, den), "links")
    rooted = stored(_rooted(shared, components(links)), "rooted")
    # of two components that meet in a list the likeliest pair first; most are one component then
    found = stored(_open_pairs(rooted, points, num, den, True), "open")
    links = stored(links.unionByName(_decided(found.select("u", "v").distinct(), sets, num, den)), "links")
    comp = components(links)
    end = [comp.select(F.col("u").alias(c), F.col("v").alias(f"{c}_root")) for c in "uv"]
    apart = found.where("more").join(end[0], "u", "left").join(end[1], "v", "left").where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v"))
    lists = stored(apart.select("h").distinct(), "unfinished")
    if not lists.isEmpty():  # those that are still two: all their pairs
        rest = stored(_rooted(rooted.join(lists, "h", "left_semi").drop("root"), comp), "rest")
        found = stored(_open_pairs(rest, points, num, den, False).select("u", "v").distinct(), "open")
        comp = components(links.unionByName(_decided(found, sets, num, den)))
    roots = reps.join(comp.select(F.col("u").alias("node"), "v"), "node", "left").select("key", F.coalesce("v", "node").alias("group"))
    return sk.join(roots, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("group")), "doc_id")).alias("component_id"))
