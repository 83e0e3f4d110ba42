import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import first_seen, matched_streams, sessions, windowed_features
from plumbline.streaming.state import closed_sessions, merged, use_state_store

T0 = dt.datetime(2024, 1, 1)
CURVES = "curve_id long, ts timestamp, value double"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def feed(spark, folder, rows, schema=CURVES):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(query_of, checkpoint, name):
    """Take what is there, then stop: the next call goes on from the checkpoint."""
    q = query_of.writeStream.format("parquet").option("path", name).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    return q


def test_merged_sessions():
    assert merged([(9, 9, 1, 1.0), (0, 0, 1, 2.0), (4, 4, 1, 3.0)], 4) == [(0, 4, 2, 5.0), (9, 9, 1, 1.0)]
    assert merged([(0, 3, 2, 1.0), (9, 12, 2, 1.0), (6, 6, 1, 1.0)], 3) == [(0, 12, 5, 3.0)] and merged([], 3) == []


def test_stateful_sessions_equal_batch_after_restart_and_late_rows(spark, tmp_path):
    use_state_store(spark)
    rng = random.Random(2)
    rows = [(rng.randrange(5), at(rng.randrange(0, 3000)), float(rng.randrange(9))) for _ in range(160)]
    rows = [r for r in rows if r[0] != 3 or r[1] < at(900)]  # one curve ends early
    rows.sort(key=lambda r: r[1])
    # out of order by up to 50 minutes, which the watermark of an hour allows
    order = sorted(rows, key=lambda r: (r[1] + dt.timedelta(minutes=rng.randrange(50)), r[0]))
    out, folder, checkpoint = str(tmp_path / "out"), tmp_path / "in", tmp_path / "checkpoint"
    for i in range(0, len(order), 40):
        feed(spark, folder, [*order[i : i + 40], (1, None, 1.0), (None, at(5), 1.0), (2, at(6), None)])
        stream = spark.readStream.schema(CURVES).option("maxFilesPerTrigger", 1).parquet(str(folder))
        run(closed_sessions(stream, 2.0), checkpoint, out)  # a new query each time: state comes from the checkpoint
    # a row far behind the watermark is dropped, one far ahead closes all sessions
    feed(spark, folder, [(1, at(-9000), 7.0)])
    feed(spark, folder, [(9, at(99_000), 1.0)])
    run(closed_sessions(spark.readStream.schema(CURVES).option("maxFilesPerTrigger", 1).parquet(str(folder)), 2.0), checkpoint, out)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = sorted(map(tuple, closed_sessions(spark.createDataFrame(rows, CURVES), 2.0).collect()))
    assert got == want and len(got) > 20


def test_two_streams_meet_as_in_a_batch_and_forget(spark, tmp_path):
    rng = random.Random(4)
    left = sorted([(rng.randrange(4), at(rng.randrange(0, 5000)), float(k)) for k in range(120)], key=lambda r: r[1])
    right = sorted([(rng.randrange(4), at(rng.randrange(0, 5000)), k) for k in range(120)], key=lambda r: r[1])
    more = "curve_id long, ts timestamp, mark long"
    one, two = tmp_path / "l", tmp_path / "r"
    for i in range(0, 120, 30):
        feed(spark, one, left[i : i + 30])
        feed(spark, two, right[i : i + 30], more)
    feed(spark, one, [(99, at(90_000), 0.0), (None, at(90_000), 0.0)])
    feed(spark, two, [(98, at(90_000), 0)], more)
    a = spark.readStream.schema(CURVES).option("maxFilesPerTrigger", 1).parquet(str(one))
    b = spark.readStream.schema(more).option("maxFilesPerTrigger", 1).parquet(str(two))
    out = str(tmp_path / "out")
    q = run(matched_streams(a, b, "curve_id", "90 minutes", "10 minutes"), tmp_path / "c", out)
    batch = matched_streams(spark.createDataFrame(left, CURVES), spark.createDataFrame(right, more), "curve_id", "90 minutes", "10 minutes")
    want = sorted((l, lt, v, rt, m) for l, lt, v in left for r, rt, m in right if l == r and lt - dt.timedelta(minutes=90) <= rt <= lt + dt.timedelta(minutes=10))
    key = lambda d: sorted((r.curve_id, r.ts, r.value, r.right_ts, r.mark) for r in d.collect())
    assert key(batch) == want and key(spark.read.parquet(out)) == want and want
    held = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert max(held) < 150 and held[-1] <= 4  # of 240 rows, and after the last watermark


def test_repeats_within_the_watermark_go_and_keys_are_forgotten(spark, tmp_path):
    rows = [(k % 40, at(k), float(k)) for k in range(200)]  # each key again after 40 minutes
    for i in range(0, 200, 50):
        feed(spark, tmp_path / "in", rows[i : i + 50])
    feed(spark, tmp_path / "in", [(999, at(90_000), 0.0)])
    stream = spark.readStream.schema(CURVES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = run(first_seen(stream, ["curve_id"], "10 hours"), tmp_path / "c", str(tmp_path / "out"))
    got = sorted((r.curve_id, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.curve_id, r.value) for r in first_seen(spark.createDataFrame([*rows, (999, at(90_000), 0.0)], CURVES), ["curve_id"]).collect())
    assert got == want and len(want) == 41
    assert [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress][-1] <= 1


@pytest.mark.parametrize("kind", ["sliding", "sessions"])
def test_sliding_windows_and_sessions_as_streams(spark, tmp_path, kind):
    rng = random.Random(7)
    rows = sorted([(rng.randrange(3), at(rng.randrange(0, 6000)), float(rng.randrange(5))) for _ in range(90)], key=lambda r: r[1])
    for i in range(0, 90, 30):
        feed(spark, tmp_path / "in", rows[i : i + 30])
    feed(spark, tmp_path / "in", [(50, at(90_000), 1.0)])
    work = (lambda d: windowed_features(d, "4 hours", "1 hour")) if kind == "sliding" else (lambda d: sessions(d, "5 hours"))
    stream = spark.readStream.schema(CURVES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(work(stream), tmp_path / "c", str(tmp_path / "out"))
    got, want = spark.read.parquet(str(tmp_path / "out")), work(spark.createDataFrame(rows, CURVES))
    assert sorted(map(tuple, got.where(F.col("curve_id") < 50).collect())) == sorted(map(tuple, want.collect())) and want.count() > 20
