import hashlib
import random
import re
import zlib

import duckdb
import pytest

from plumbline.llm.periodic import collapse, find_runs, lyndon, periodic_runs
from plumbline.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, times=4, least=6):
    """Every maximal stretch of every period, the smallest period checked by trying all."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if i > s and length >= max(least, times * q) and all(any(w[k] != w[k + d] for k in range(s, s + length - d)) for d in range(1, q)):
                out.append((s, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_next(w, flip):
    key = [(-x if flip else x) for x in w]
    less = lambda a, b: key[a:] < key[b:]  # noqa: E731  a list that ends first is the smaller one
    n = len(w)
    return [next((j for j in range(i + 1, n) if less(j, i)), n) for i in range(n)]


def words(rng):
    n, k = rng.randrange(0, 45), rng.choice([1, 2, 2, 3, 4, 9])
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 3 + 1))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w + w[::-1] + w if rng.random() < 0.3 else w


def test_next_smaller_suffixes_and_agreements():
    rng = random.Random(3)
    for _ in range(1500):
        w = words(rng)
        for flip in (False, True):
            nxt, agree = lyndon(w, flip)
            assert list(nxt) == brute_next(w, flip)
            for i, j in enumerate(nxt):
                if j < len(w):
                    assert w[i : i + agree[i]] == w[j : j + agree[i]] and w[i + agree[i] : i + agree[i] + 1] != w[j + agree[i] : j + agree[i] + 1]


@pytest.mark.parametrize("times,least", [(4, 6), (3, 3), (4, 1), (6, 9)])
def test_runs_equal_those_of_all_periods(times, least):
    rng = random.Random(times)
    for _ in range(1500):
        w = words(rng)
        assert find_runs(w, times, least) == brute_runs(w, times, least), w


class Counted:
    seen = 0

    def __init__(self, v):
        self.v = v

    def __eq__(self, other):
        Counted.seen += 1
        return self.v == other.v

    def __lt__(self, other):
        Counted.seen += 1
        return self.v < other.v


def test_comparisons_are_linear():
    fib = ["a", "ab"]
    while len(fib[-1]) < 80_000:
        fib.append(fib[-1] + fib[-2])
    tm = "a"
    while len(tm) < 80_000:
        tm = "".join(x + ("b" if x == "a" else "a") for x in tm)
    hard = ["a" * 80_000, fib[-1], tm, "ab" * 40_000, (("a" * 50 + "b") * 60 + "c") * 30, [x for _ in range(80) for x in range(1000)], [x for r in range(80) for x in [*range(1000), 5000 + r * 7 % 199]], [x for _ in range(80) for x in range(1000, 0, -1)]]
    for s in hard:
        w = [Counted(x) for x in s]
        Counted.seen = 0
        lyndon(w, False)
        lyndon(w, True)
        assert Counted.seen <= 2 * 5 * len(w)


def expected(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha(lines), sha(kept))


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    """Every row whose text has up to 1200 words, in whole; the longer ones are met by the tests above."""
    docs = [r for r in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()]
    short = {i for i, t in docs if len(WORD.findall(t or "")) <= 1200}
    got = [r for r in rows_of(QUERIES["op13_periodic_runs"](spark, sf)) if r[0] in short]
    want = sorted((expected(i, t) for i, t in docs if i in short), key=str)
    assert got == want and len(got) > 100 and any(r[1] for r in got)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a a a a a"), (5, "a a a a a a"), (6, "x " + "é ü " * 4 + "y"), (6, "x " + "é ü " * 4 + "y"), (None, "b " * 9),
            (7, "a b a b a b a b z z z z z z"), (8, "a a a a " * 6), (9, "A a " * 9), (30, "p q " * 30), (38, "r s t " * 20 + "u"), (-4, "k " * 7)]
    rows += [(i, f"m{i} n " * (i % 9) + "tail") for i in range(100, 160)]
    df = spark.createDataFrame([(*r, 3, "runs") for r in rows], "doc_id long, text string, start int, runs string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(QUERIES["op13_periodic_runs"](spark, str(tmp_path))) == sorted((expected(*r) for r in rows), key=str)


def test_long_text_and_empty_table(spark):
    n = 200_000
    w = [f"w{i % 1000 if i < n // 2 else i}" for i in range(n)]
    df = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    r = periodic_runs(df).first()
    assert r.n_words == n and [tuple(x) for x in r.runs] == [(0, n // 2, 1000)]
    assert r.collapsed.split() == w[:1000] + w[n // 2 :] == collapse(w, [(0, n // 2, 1000)])
    assert r.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest()
    assert periodic_runs(df.where("doc_id > 1")).count() == 0
