import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import attribution, curves, factors, templates, validation
from plumbline.sources import CURVES, TEMPLATES, event_curves, read, write
from plumbline.streaming import read_curves, sessions, windowed_features

T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(c, T0 + dt.timedelta(hours=h), v) for c, h, v in rows], CURVES)


def test_features_of_constant_and_single_point_curves(spark):
    got = {r.curve_id: r for r in curves.curve_features(frame(spark, [(1, 0, 5.0), (2, 0, 3.0), (2, 2, 3.0), (3, 0, 1.0), (3, 1, 3.0), (3, 4, 3.0)])).collect()}
    assert got[1].n == 1 and got[1].rel_peak is None and got[1].slope_per_hour is None
    assert got[2].slope_per_hour == 0.0 and got[2].rel_peak == 0.0
    assert got[3].rel_peak == 0.25  # the first of two equal peaks
    assert curves.curve_normalize(frame(spark, [(2, 0, 3.0), (2, 2, 3.0)])).where("scaled is null").count() == 2


def test_empty_curves(spark):
    e = frame(spark, [])
    for f in (curves.curve_features, curves.curve_normalize, curves.curve_resample, curves.curve_ffill, curves.rolling_rows, curves.rolling_range, curves.sessionize_gaps):
        assert f(e).count() == 0


def test_daily_grid_fills_gaps(spark):
    c = frame(spark, [(1, 0, 1.0), (1, 72, 4.0)])
    assert [r.value for r in curves.curve_ffill(c).orderBy("day").collect()] == [1.0, 1.0, 1.0, 4.0]


def test_templates_tie_reject_and_every_curve_once(spark):
    t = spark.createDataFrame([("b", 0, 0.0, True), ("b", 1, 1.0, True), ("a", 0, 1.0, True), ("a", 1, 0.0, True)], TEMPLATES)
    s = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 0, 9.0), (2, 1, 9.0), (3, 7, 0.0), (4, 0, 0.0), (4, 1, 1.0)], "curve_id long, bucket int, value double")
    got = {r.curve_id: (r["class"], r.is_target) for r in templates.template_assign(s, t, 1.0).collect()}
    assert got == {1: ("a", True), 2: ("extra", False), 3: ("extra", False), 4: ("b", True)}
    assert {r.curve_id for r in templates.dtw_assign(s, t, 1.0).collect()} == {1, 2, 3, 4}


def test_dtw_matches_plain_recursion():
    import numpy as np

    def plain(a, b):
        if not a or not b:
            return 0.0 if not a and not b else float("inf")
        return abs(a[-1] - b[-1]) + min(plain(a[:-1], b), plain(a, b[:-1]), plain(a[:-1], b[:-1]))

    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = list(rng.normal(size=5)), list(rng.normal(size=4))
        assert abs(templates._dtw(np.array([a, a[::-1]]), np.array(b), 9)[0] - plain(a, b)) < 1e-9


def test_tiers_equal_ntile(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 5)) for i in range(11)] + [(99, None)], "id long, v double")
    got = {r.id: r.tier for r in factors.strength_tier(df, "id", "v").collect()}
    order = sorted((float(i * 7 % 5), i) for i in range(11))
    want = {i: factors.TIERS[0 if k < 4 else 1 if k < 8 else 2] for k, (_, i) in enumerate(order)}
    assert got == want | {99: None}
    assert {r.tier for r in factors.strength_tier(df, "id", "v", (1.0, 3.0)).where("v = 2").collect()} == {"medium"}


def test_asof_keeps_unmatched(spark):
    left = spark.createDataFrame([(1, 1, 5), (2, 1, 1), (3, 2, 9)], "id int, k int, t int")
    right = spark.createDataFrame([(1, 2, 0.5), (1, 5, 0.7)], "k int, t int, v double")
    assert {r.id: r.asof_v for r in factors.asof_factor(left, right, "k", "t", "v").collect()} == {1: 0.7, 2: None, 3: None}


def test_folds_do_not_share_groups(spark, sf):
    f = validation.group_folds(spark.createDataFrame([(i, i % 7) for i in range(50)] + [(99, None)], "row_id int, g int"), "g", 3)
    assert f.where("g is not null").groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert f.count() == 51 and f.where("fold is null").count() == 1


pairs = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("abcd"), st.integers(0, 2)), min_size=1, max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(pairs)
def test_macro_f1_against_hand_count(spark, rows):
    df = spark.createDataFrame(rows, "label string, prediction string, fold int")
    classes = {r[0] for r in rows} | {r[1] for r in rows}

    def f1(c):
        tp = sum(r[0] == c == r[1] for r in rows)
        return 2 * tp / (sum(r[0] == c for r in rows) + sum(r[1] == c for r in rows))

    got = validation.macro_f1(df).first()
    assert got.n_classes == len(classes) and abs(got.macro_f1 - sum(map(f1, classes)) / len(classes)) < 1e-5
    assert all(0 <= r.macro_f1 <= 1 for r in validation.macro_f1(df, per_fold="fold").collect())


def test_linear_shapley_sums(spark):
    df = spark.createDataFrame([(i, float(i), float(3 * i + i % 2)) for i in range(9)], "id long, x double, y double")
    assert all(abs(r.base + r.phi - r.prediction) < 1e-3 for r in attribution.linear_shapley(df, "id", "x", "y").collect())
    flat = attribution.linear_shapley(df.withColumn("x", F.lit(1.0)), "id", "x", "y")
    assert {r.phi for r in flat.collect()} == {0.0}


def test_tree_shapley_rows_sum(spark, sf):
    from plumbline.plans.queries import QUERIES

    got = QUERIES["tree_shapley"](spark, sf).groupBy("row_id", "class").agg(
        F.sum("phi").alias("s"), F.first("base").alias("b"), F.first("prediction").alias("p")).collect()
    assert got and all(abs(r.b + r.s - r.p) < 1e-9 for r in got)


def test_forest_predicts_each_row_once(spark, sf):
    from plumbline.plans.queries import QUERIES

    p = QUERIES["forest_grouped_cv"](spark, sf)
    assert p.count() == p.select("row_id").distinct().count() > 0


def test_formats_round_trip(spark, sf, tmp_path):
    c = event_curves(spark, sf)
    for fmt in ("parquet", "orc", "json", "csv"):
        write(c, str(tmp_path / fmt), fmt)
        assert read(spark, str(tmp_path / fmt), fmt, CURVES).exceptAll(c).count() == 0
    with pytest.raises(ValueError):
        read(spark, str(tmp_path / "csv"), "csv")


def test_stream_equals_batch_on_closed_windows(spark, sf, tmp_path):
    c = event_curves(spark, sf)
    c.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = windowed_features(read_curves(spark, str(tmp_path / "in"), c.schema)).writeStream.format("memory").queryName("wf").outputMode("append").start()
    q.processAllAvailable(); q.stop()
    batch = windowed_features(c.withColumn("ts", F.col("ts").cast("timestamp")))
    got = spark.table("wf")
    assert got.count() > 0 and got.exceptAll(batch).count() == 0
    last = got.agg(F.max("end")).first()[0]
    assert batch.where(F.col("end") <= last).exceptAll(got).count() == 0
    assert sessions(c.withColumn("ts", F.col("ts").cast("timestamp"))).agg(F.sum("n")).first()[0] == c.count()


def test_interval_join_against_pairs(spark):
    import datetime as dt
    import random

    from plumbline.operators.tables import interval_join

    rng = random.Random(4)
    day = lambda x: dt.datetime(2024, 1, 1) + dt.timedelta(hours=x)
    points = [(i, rng.choice("ab"), day(rng.randrange(300))) for i in range(80)] + [(90, "a", None), (91, None, day(3))]
    spans = [(i, rng.choice("ab"), day(s := rng.randrange(300)), day(s + rng.randrange(-3, 90))) for i in range(40)] + [(50, "a", None, day(9)), (51, "a", day(5), day(5)), (52, "a", day(24), day(48)), (52, "a", day(24), day(48))]
    p = spark.createDataFrame(points, "p int, k string, at timestamp_ntz")
    q = spark.createDataFrame(spans, "q int, k string, a timestamp_ntz, z timestamp_ntz")
    got = sorted((r.p, r.q) for r in interval_join(p, q, "k", "at", "a", "z").collect())
    assert got == sorted((x, y) for x, k, t in points for y, l, a, z in spans if t and a and k == l and a <= t < z)


def test_strength_tier_ties_and_small_tables(spark):
    for n in (0, 1, 2, 3, 7, 50):
        rows = [(i, float(i % 3)) for i in range(n)] + [(1000, None)]
        got = {r.id: r.tier for r in factors.strength_tier(spark.createDataFrame(rows, "id int, v double").repartition(5), "id", "v").collect()}
        ranked = sorted(rows[:-1], key=lambda r: (r[1], r[0]))
        sizes = [n // 3 + (i < n % 3) for i in range(3)]
        want = [t for t, k in zip(factors.TIERS, sizes) for _ in range(k)]
        assert [got[i] for i, _ in ranked] == want and got[1000] is None


def test_balanced_forest_and_tables_of_odd_rows(spark):
    from plumbline.operators import tables
    from plumbline.operators.validation import baseline_report, forest_grouped_cv

    rows = [(i, i % 4, "rare" if i % 9 == 0 else "common", float(i % 9 == 0) + i % 5 * 0.1) for i in range(120)] + [(200, None, "rare", 1.0), (201, 1, None, 1.0), (202, 1, "rare", None)]
    df = spark.createDataFrame(rows, "row_id long, g int, label string, x double")
    pred = forest_grouped_cv(df, ["x"], "label", "g", k=4, trees=5, depth=2, balanced=True)
    report = {r["class"]: r for r in baseline_report(pred).collect()}
    assert pred.count() == 120 and report["rare"].recall > 0.9 and report["rare"].majority_recall == 0 and report["common"].majority_recall == 1
    empty = df.limit(0)
    assert tables.pivot_counts(empty, "g", "label", ["rare"]).count() == 0 and tables.top_rows(empty, "g", [F.asc("x")], 2).count() == 0
    assert {r.g: r.rare for r in tables.pivot_counts(df, "g", "label", ["rare"]).collect()}[None] == 1
    assert tables.without_match(df, df.where("g = 1").select("g"), "g").where("g is null").count() == 1
    assert [r["rank"] for r in tables.top_rows(df.where("g = 2"), "g", [F.desc("x"), F.asc("row_id")], 3).collect()] == [1, 2, 3]


def test_tiers_of_a_fold_are_cut_by_the_others(spark):
    rows = [(i, float(i % 7), i % 3) for i in range(60)] + [(100, None, 0), (101, 2.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, part int")  # a column named as one of the operator's own
    got = {r.id: r.tier for r in factors.strength_tier_by_fold(df, "id", "x", "part").collect()}
    for i, x, f in rows:
        others = sorted((v, k) for k, v, g in rows if g is not None and v is not None and g != f)
        n = len(others)
        lo, hi = (others[k][0] for k in (n // 3 + (n % 3 > 0), 2 * (n // 3) + n % 3))
        assert got[i] == (None if x is None or f is None else "weak" if x < lo else "medium" if x < hi else "strong")
    alone = spark.createDataFrame([(1, 1.0, 4), (2, 2.0, 4)], "id long, x double, fold int")
    assert [r.tier for r in factors.strength_tier_by_fold(alone, "id", "x", "fold").collect()] == [None, None]
    assert factors.strength_tier_by_fold(alone.limit(0), "id", "x", "fold").count() == 0


def test_templates_of_a_fold_come_from_the_others(spark):
    shapes = spark.createDataFrame([(i, b, v) for i, vs in enumerate([(0.0, 1.0), (0.0, 0.9), (1.0, 0.0), (0.9, 0.0), (0.5, None), (1.0, 0.1)]) for b, v in enumerate(vs)], "curve_id long, bucket int, value double")
    labels = spark.createDataFrame([(0, "rise", 0), (1, "rise", 1), (2, "fall", 0), (3, "fall", 1), (4, None, 1), (5, "fall", None)], "curve_id long, class string, fold int")
    got = {r.curve_id: (r["class"], r.distance) for r in templates.template_assign_by_fold(shapes, labels).collect()}
    assert got == {0: ("rise", 0.005), 1: ("rise", 0.005), 2: ("fall", 0.005), 3: ("fall", 0.005), 4: ("fall", 0.25)}  # 4: both are as near, the first wins
    strict = {r.curve_id: r["class"] for r in templates.template_assign_by_fold(shapes, labels, 0.1).collect()}
    assert strict[4] == "extra" and strict[0] == "rise"
    only = labels.where("fold = 0")
    assert {r["class"] for r in templates.template_assign_by_fold(shapes, only).collect()} == {"extra"}


def test_forest_report_compares_with_the_majority(spark, sf):
    from plumbline.plans.queries import QUERIES

    pred = QUERIES["forest_grouped_cv"](spark, sf).collect()
    out = {r["class"]: r for r in QUERIES["forest_report"](spark, sf).collect()}
    assert set(out) == {r.label for r in pred} | {r.prediction for r in pred}
    for c, r in out.items():
        mine = [p for p in pred if p.label == c]
        assert r.support == len(mine) and r.recall == round(sum(p.prediction == c for p in mine) / max(1, len(mine)), 6)


def test_clashing_names_of_folds_and_asof(spark):
    df = spark.createDataFrame([(1, "a", 9), (2, "b", 9), (3, None, 9)], "id long, g string, fold int")
    assert sorted((r.id, r.fold) for r in validation.group_folds(df, "g").collect()) == [(1, 0), (2, 1), (3, None)]
    with pytest.raises(ValueError, match="fold"):
        validation.group_folds(df, "fold")
    left = spark.createDataFrame([(1, 5, "x", "y", "z", 0.0), (1, None, "x", None, "z", 0.0), (2, 5, None, "y", "z", 0.0)], "k long, t long, _side0 string, _v0 string, asof string, asof_p double")
    right = spark.createDataFrame([(1, 3, 0.5), (1, 5, 0.7), (1, 6, 0.9)], "k long, t long, p double")
    out = factors.asof_factor(left, right, "k", "t", "p")
    assert out.columns == ["k", "t", "_side0", "_v0", "asof", "asof_p"]
    assert {(r.k, r.t, r["_side0"], r["_v0"], r.asof): r.asof_p for r in out.collect()} == {(1, 5, "x", "y", "z"): 0.7, (1, None, "x", None, "z"): None, (2, 5, None, "y", "z"): None}
