import functools
import random

import pytest

from plumbline.llm import decontam
from plumbline.llm.decontam import Matcher, best_distance, budget, clean, decontaminate, matches, pieces
from plumbline.llm.queries import QUERIES


def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_distance_against_plain_dp():
    rng = random.Random(0)
    for _ in range(300):
        p, t = ("".join(rng.choice("abé") for _ in range(rng.randrange(1, n))) for n in (90, 140))
        assert best_distance(p, t) == plain_distance(p, t)


def edit(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        s[i : i + 1] = rng.choice(([], [rng.choice("xyz")], [s[i], "q"]))
    return "".join(s)


def test_pieces_cover_an_item():
    for m in (20, 57, 233):
        assert "".join(p for _, p in pieces("x" * m, budget(m))) == "x" * m and min(len(p) for _, p in pieces("x" * m, budget(m))) >= decontam.LEAST


@pytest.mark.parametrize("seed", range(4))
def test_finds_what_brute_force_finds(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(2, 40)))) for i in range(12)] + [(50, "aaaaaaaaaa" * 12)]
    m = Matcher(items)
    for _ in range(40):
        i, item = rng.choice(items)
        k = budget(len(item))
        text = " ".join(word() for _ in range(30)) + " " + edit(rng, item, rng.choice((0, k, k + 3))) + " " + " ".join(word() for _ in range(30)) + rng.choice(("", "a" * 300))
        want = [(n, d) for n, t in items if (d := plain_distance(t, text)) <= budget(len(t))]
        assert sorted(m.find(text)) == sorted(want)


def test_rows_blocks_and_odd_values(spark, monkeypatch):
    items = [(1, "The Quick  brown fox jumps over the lazy dog again"), (2, None), (3, ""), (4, "tiny"), (5, "the quick brown fox jumps over the lazy dog again")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, "x the quick brown\nfox jumps over the lazy dog again y", "a"), (2, "the quick brwn fox jumps ober the lazy dog again", "b"), (3, None, "c"), (4, "", "d"), (5, "has a Tiny word", "e"), (6, "quick brown fox", "f"), (None, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG AGAIN", "g"), (1, "x the quick brown\nfox jumps over the lazy dog again y", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, md5 string")
    for size in (4 << 20, 8):
        monkeypatch.setattr(decontam, "BLOCK_CHARS", size)
        got = sorted((str(r.doc_id), r.item_id, r.distance) for r in matches(df, bench).collect())
        assert [g for g in got if g[1] == 1] == [("1", 1, 0), ("1", 1, 0), ("2", 1, 2), ("None", 1, 0)]
        assert [g for g in got if g[1] == 4] == [("5", 4, 0)]
    out = decontaminate(df, bench)
    assert out.columns == df.columns and sorted(r.md5 for r in out.collect()) == ["c", "d", "f"]
    assert decontaminate(df, bench.limit(0)).count() == len(docs) and decontaminate(df.limit(0), bench).count() == 0


def test_items_with_one_text_each_get_their_rows(spark):
    text = "the quick brown fox jumps over the lazy dog again"
    bench = spark.createDataFrame([(7, text), (3, text), (3, text), (None, text), (3, "another item of the benchmark, not found anywhere")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {text} y"), (2, "nothing"), (1, f"x {text} y")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.distance) for r in matches(docs, bench).collect()) == [(1, i, 0) for i in (-1, -1, 3, 3, 7, 7)]


def test_very_long_text(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    item = " ".join(word() for _ in range(40))
    long = " ".join(word() for _ in range(200_000))
    docs = spark.createDataFrame([(1, long[:400_000] + " " + edit(rng, item, budget(len(item))) + " " + long[400_000:]), (2, long)], "doc_id long, text string")
    assert [r.doc_id for r in matches(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()] == [1]


def test_whole_table_against_brute_force(spark, sf, tmp_path):
    """op2's rows are all pairs of a document and an item within its budget, by Myers' distance over whole texts without pieces.

    The benchmark is the table's, with every second item edited about as often as is allowed.
    """
    rng = random.Random(11)
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.item_id, edit(rng, r.text, max(0, budget(len(clean(r.text))) - rng.randrange(-2, 3))) if r.item_id % 2 else r.text) for r in bench.collect()]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    items = [(i, clean(t)) for i, t in rows if clean(t)]
    distance = functools.lru_cache(maxsize=None)(best_distance)
    want = {(r.doc_id, i, d) for r in docs.collect() for i, t in items if (d := 0 if t in clean(r.text) else distance(t, clean(r.text))) <= budget(len(t))}
    got = [tuple(r) for r in QUERIES["op2_decontamination"](spark, str(tmp_path)).select("doc_id", "item_id", "distance").collect()]
    assert set(got) == want and len(got) == len(want)
    assert any(d for _, _, d in want) and any(not d for _, _, d in want)
