import hashlib
import random
import re

import pytest

from plumbline.llm.substring import COVER, PERIOD, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length=20):
    seen, words = {}, []
    for i, t in rows:
        w = WORD.findall(t or "")
        words.append((i, w))
        for s in range(len(w) - length + 1):
            k, at = tuple(w[s : s + length]), (i if i is not None else -(1 << 63), s)
            seen[k] = min(seen.get(k, at), at)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] < (i if i is not None else -(1 << 63), s):
                gone |= set(range(s, s + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bb", "é", "ccc", "d d"]) + str(rng.randrange(40))
    shared = [word() for _ in range(60)]
    rows = []
    for i in range(40):
        w = [word() for _ in range(rng.randrange(0, 90))]
        if i % 3 == 0:
            k = rng.randrange(0, 30)
            w[10:10] = shared[k : k + rng.choice((19, 20, 21, 30))]
        if i % 7 == 0:
            w += w
        rows.append((i * 5 - 20, rng.choice((" ", "\n", " \t")).join(w)))
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, None), (1003, ""), (1004, " \n"), (1005, "x " * 50), (1006, "x " * 70), (None, "x " * 21)]
    return rows + [rows[9], rows[9]]


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "q", 7) for r in rows], "doc_id long, text string, bid string, bucket int").repartition(5)
    assert rows_of(substring_dedup(df)) == brute(rows)


def test_many_groups(spark, monkeypatch):
    from plumbline.llm import common

    old = common.Layout.of.__func__ if hasattr(common.Layout.of, "__func__") else common.Layout.of
    monkeypatch.setattr(common.Layout, "of", staticmethod(lambda d, *a, **k: old(d, "text", 400, 4000, 900)))
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(substring_dedup(df)) == brute(rows)


def test_table_and_empty(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(substring_dedup(df)) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert substring_dedup(df.limit(0)).count() == 0


def test_rows_without_ids_spread_over_groups(spark, monkeypatch):
    """Rows with a null or a common id do not meet in one group, and their equal places are not earlier than each other."""
    from plumbline.llm import common

    old = common.Layout.of
    made = []
    monkeypatch.setattr(common.Layout, "of", staticmethod(lambda d, *a, **k: made.append(old(d, "text", 400, 4000, 900)) or made[-1]))
    rng = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(rng.choice((None, None, 7)), " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(40))) + (f" {shared}" if i % 3 == 0 else "")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(substring_dedup(df)) == brute(rows)
    lay = made[-1]
    assert lay.groups > 40 and max(r["count"] for r in df.select(lay.group().alias("g")).groupBy("g").count().collect()) < 30
