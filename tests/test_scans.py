import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import scans, tables
from plumbline.operators.tables import range_join
from plumbline.plans.queries import QUERIES


def rows_of(seed, n=400):
    """One key holds most rows; null keys and values, and long stretches of nulls."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        rows.append((i, key, rng.randrange(50), None if rng.random() < 0.3 or 100 < i < 180 else round(rng.gauss(0, 5), 2)))
    return rows


def test_scans_over_pieces_equal_windows(spark):
    df = spark.createDataFrame(rows_of(1), "id long, k string, t int, v double")
    for parts in (1, 7, 60):
        t = scans.pieces(df, "k", ["t", "id"], parts)
        if parts > 1:
            assert t.rows.where("k = 'hot'").select("_piece").distinct().count() > parts // 2  # the hot key is spread
        out = scans.rolling_mean(scans.last_known(scans.running_sum(t, "v", "total"), "v", "known"), "v", 5, "rolling").rows
        w = Window.partitionBy("k").orderBy("t", "id")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        want = df.select("id", F.sum("v").over(upto).alias("total"), F.last_value("v", True).over(upto).alias("known"), F.avg("v").over(w.rowsBetween(-5, 0)).alias("rolling"))
        near = lambda d: {r.id: tuple(None if x is None else round(x, 6) + 0.0 for x in (r.total, r.known, r.rolling)) for r in d.collect()}
        assert near(out) == near(want)


def test_scan_of_no_rows(spark):
    df = spark.createDataFrame([], "id long, k string, t int, v double")
    t = scans.pieces(df, "k", ["t", "id"])
    assert scans.rolling_mean(scans.running_sum(t, "v", "s"), "v", 3, "r").rows.count() == 0


def test_range_join_against_pairs(spark):
    rng = random.Random(6)
    points = [(i, rng.choice("ab"), rng.randrange(-5000, 5000)) for i in range(150)] + [(900, "a", None), (901, None, 3), (902, "b", -(1 << 60))]
    spans = []
    for i in range(80):
        a = rng.randrange(-5000, 5000)
        spans.append((i, rng.choice("ab"), a, a + rng.choice([-3, 0, 1, 2, 7, 64, 900, 9000])))
    spans += [(800, "a", None, 9), (801, "a", 3, None), (802, None, 0, 9), (803, "b", -(1 << 61), 1 << 61), (804, "a", -64, 64), (804, "a", -64, 64)]
    p, q = spark.createDataFrame(points, "p int, k string, at long"), spark.createDataFrame(spans, "q int, k string, a long, z long")
    want = sorted((x, y) for x, k, t in points for y, m, a, z in spans if None not in (t, a, z, k) and k == m and a <= t < z)
    for width in (1, 10, 1000):
        assert sorted((r.p, r.q) for r in range_join(p, q, "k", "at", "a", "z", width).collect()) == want
    assert range_join(p, q.limit(0), "k", "at", "a", "z").count() == 0


@pytest.mark.parametrize("pairs", [0, 12, 90])
def test_range_join_of_keys_with_few_and_many_rows(spark, monkeypatch, pairs):
    """All keys through the tree, some of them, and none; a key may have many points or many spans."""
    monkeypatch.setattr(tables, "PAIRS", pairs)
    rng = random.Random(pairs)
    points = [(i, k, rng.randrange(-99, 99)) for k, n in ((1, 80), (2, 3), (3, 9), (4, 5), (None, 9)) for i in range(n)] + [(900, 1, None)]
    spans = [(i, k, a := rng.randrange(-99, 99), a + rng.choice([-1, 0, 1, 9, 200])) for k, n in ((1, 3), (2, 85), (3, 9), (5, 40), (None, 9)) for i in range(n)]
    p, q = spark.createDataFrame(points, "p int, k int, at long"), spark.createDataFrame(spans, "q int, k int, a long, z long")
    want = sorted((x, k, y) for x, k, t in points for y, m, a, z in spans if None not in (t, k) and k == m and a <= t < z)
    for width in (1, 10):
        got = range_join(p, q, "k", "at", "a", "z", width)
        assert got.columns == ["k", "p", "at", "q", "a", "z"]
        assert sorted((r.p, r.k, r.q) for r in got.collect()) == want


def test_range_join_copies_and_broadcasts_nothing_for_small_keys(spark, sf):
    """A broadcast of copied rows took the driver's memory: Spark takes the table for as small as its stored columns."""
    for df in (QUERIES["interval_join"](spark, sf), range_join(*[spark.range(9000).select((F.col("id") % 2000).alias("k"), *c) for c in ([F.col("id").alias("at")], [F.col("id").alias("a"), (F.col("id") + 700).alias("z")])], "k", "at", "a", "z")):
        plan = df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and "Generate" not in plan
