"""Connected components by alternating large and small stars, all in DataFrames.

Edges are pairs of ids. Each round replaces a vertex's links by links to the
smallest id it knows; the number of rounds grows with the logarithm of a
component's size. A vertex of any degree is only ever reduced to a minimum
(combined before the shuffle); the join back to its links is an ordinary
equi-join whose skewed keys adaptive execution splits. Nothing is collected.
Up to ONE_TASK edges (4 MB), counted first, are settled by one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import give_back, stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (vertex, smallest of its component) of the given edges, by min-label passes with pointer jumping."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(ids))
    while True:
        rx, ry = root[x], root[y]
        live = rx != ry
        if not live.any():
            break
        hi, lo = np.maximum(rx[live], ry[live]), np.minimum(rx[live], ry[live])
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
    child = np.flatnonzero(root != np.arange(len(ids)))
    return ids[child], ids[root[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:  # a batch at a time: memory stays bounded
        u, v = forest(b.column(0).to_numpy(), b.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        give_back()


#: Edges that one task may hold whole.
ONE_TASK = 1 << 18


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    u, v = forest(t.column("u").to_numpy(), t.column("v").to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
    del t
    give_back()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v): every vertex that has a smaller one in its component, with the smallest.

    edges: u, v (bigint, not null). Raises an error where max_rounds do not do.
    """
    # stored first: two Python steps in one stage would take two workers a core
    e = stored(edges.where("u <> v").select("u", "v"), "edges")
    e = stored(e.mapInArrow(_contract, "u bigint, v bigint").distinct(), "edges")
    print_of = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = print_of(e)
    if before[0] <= ONE_TASK:  # the end of the rounds below, in one
        return stored(e.coalesce(1).mapInArrow(_settle, "u bigint, v bigint"), "edges")
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v")
        e = stored(small.where("u <> v").distinct(), "edges")
        after = print_of(e)
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError(f"components had not settled after {max_rounds} rounds")
    return e
