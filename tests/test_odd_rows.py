"""Nulls, ties, ragged rows and clashing names in the curve operators."""

import datetime as dt

import pytest

from plumbline.operators import curves, factors, templates

T0 = dt.datetime(2024, 1, 1)
CURVES = "curve_id long, ts timestamp_ntz, value double"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_rolling_means_of_ties_and_nulls(spark):
    rows = [(1, at(0), 1.0), (1, at(0), 3.0), (1, at(5), None), (1, at(30), 5.0), (2, at(1), 7.0), (None, at(1), 9.0), (None, at(2), 11.0)]
    df = spark.createDataFrame(rows, CURVES)
    key = lambda d: sorted(((r.curve_id, r.ts, r.value, r.rolling) for r in d.collect()), key=str)
    assert key(curves.rolling_rows(df, 1)) == sorted([(1, at(0), 1.0, 1.0), (1, at(0), 3.0, 2.0), (1, at(5), None, 3.0), (1, at(30), 5.0, 5.0), (2, at(1), 7.0, 7.0), (None, at(1), 9.0, 9.0), (None, at(2), 11.0, 10.0)], key=str)
    # samples at one time see each other in a range
    assert key(curves.rolling_range(df, 1)) == sorted([(1, at(0), 1.0, 2.0), (1, at(0), 3.0, 2.0), (1, at(5), None, 2.0), (1, at(30), 5.0, 5.0), (2, at(1), 7.0, 7.0), (None, at(1), 9.0, 9.0), (None, at(2), 11.0, 10.0)], key=str)


def test_sessions_split_beyond_the_gap_only(spark):
    rows = [(1, at(0), 1.0), (1, at(12), None), (1, at(24), 1.0), (1, at(24), 2.0), (1, at(37), 1.0), (2, at(3), 1.0), (None, at(0), 1.0), (None, at(40), 1.0)]
    got = sorted(((r.curve_id, r.session, r.n, r.first_ts, r.last_ts) for r in curves.sessionize_gaps(spark.createDataFrame(rows, CURVES), 12.0).collect()), key=str)
    assert got == sorted([(1, 0, 4, at(0), at(24)), (1, 1, 1, at(37), at(37)), (2, 0, 1, at(3), at(3)), (None, 0, 1, at(0), at(0)), (None, 1, 1, at(40), at(40))], key=str)


def test_centroids_of_ragged_null_and_tied_vectors(spark):
    rows = [(1, [0.0, 0.0], "a"), (2, [2.0, 2.0], "b"), (3, [1.0, 1.0], None), (4, [2.0], None), (5, None, "a"), (6, [], "b"), (7, [0.0, 0.0, 9.0], None), (8, [None, 2.0], None)]
    got = {r.id: (r.nearest, r.distance) for r in templates.nearest_centroid(spark.createDataFrame(rows, "id long, vec array<double>, class string"), "id", "vec", "class").collect()}
    assert got == {1: ("a", 0.0), 2: ("b", 0.0), 3: ("a", 2.0), 4: ("b", 0.0), 7: ("a", 0.0), 8: ("b", 0.0)}


def test_factor_join_names_and_keys(spark):
    left = spark.createDataFrame([(1, 0.5), (2, 0.7), (None, 0.9)], "id long, v double")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "id long, f string")
    assert sorted(((r.id, r.v, r.f) for r in factors.factor_join(left, right, "id", "id").collect()), key=str) == [(1, 0.5, "x"), (1, 0.5, "y"), (2, 0.7, None), (None, 0.9, None)]
    with pytest.raises(ValueError, match="v"):
        factors.factor_join(left, right.withColumnRenamed("f", "v"), "id", "id")
