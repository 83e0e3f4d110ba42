import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from plumbline.llm import jaccard
from plumbline.llm.queries import QUERIES
from plumbline.llm.rtree import GROUPS, RTree, count_vector, may_link

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, size=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows):
    """All pairs that share a shingle, decided on their sets."""
    sets, holders = [grams(t) for _, t in rows], defaultdict(list)
    for k, s in enumerate(sets):
        for x in s if rows[k][0] is not None else ():
            holders[x].append(k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        if rows[k][0] is None:
            continue
        for j, both in Counter(j for x in s for j in holders[x] if j > k).items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(k), find(j)), key=lambda r: rows[r][0])
                root[b] = a
    return sorted(((i, len(s), None if i is None else rows[find(k)][0]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    out = got(QUERIES["op11_jaccard_join"](spark, sf))
    assert out == brute(rows) and any(r[0] != r[2] for r in out)


def corpus(seed):
    """Families of edited texts around the threshold, a common passage, copies and odd texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(50))
    common = " ".join(word() for _ in range(30))
    rows = []
    for f in range(12):
        base = [word() for _ in range(rng.choice((3, 8, 30, 120)))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w) + (" " + common if f % 3 == 0 else ""))
    rows += ["x y z a b c d e f g h i j k l m n o p q r s t u v", "x y z a b c d e f g h i j k l m n o p q r s t u w"]  # 21 of 23 shingles: 0.913
    # exactly 85 of 100: 88 and 103 words with all shingles of the shorter in the longer one
    line = [f"t{k}" for k in range(103)]
    rows += [" ".join(line), " ".join(line[:88]), " ".join(line[:87])]
    rows += [common] * 4 + ["A B", "a b", "b a", "A  b\n", "x", "X", " ", "", None, None]
    return list(enumerate(rows, -3))


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, seed):
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    rows += [rows[5], rows[5], (None, rows[7][1]), (None, None), (None, "only here")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, key string").repartition(4)
    assert got(jaccard.jaccard_components(df)) == brute(rows)


@pytest.mark.parametrize("most", [1, 5])
def test_long_lists_are_cut_into_blocks(spark, monkeypatch, most):
    """Many sets around one passage, with every list beyond the bound of a task."""
    monkeypatch.setattr(jaccard, "LIST", most)
    rng = random.Random(most)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(60):
        tail = [f"u{k // 3}-{j}" for j in range(rng.choice((4, 9, 30)))]
        rows.append((k, " ".join((passage + tail if k % 2 else tail + passage) + [f"v{rng.randrange(99)}"] * (k % 3 == 0))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = got(jaccard.jaccard_components(df))
    assert out == brute(rows) and len({r[2] for r in out}) > 2


def test_very_long_text_and_empty_table(spark):
    rng = random.Random(9)
    w = [str(rng.randrange(1000)) for _ in range(120_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:-4000])), (3, "a"), (4, " ".join(w[:60_000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.jaccard_components(df)) == brute(rows)
    assert jaccard.jaccard_components(df.where("doc_id > 9")).count() == 0


def test_tree_gives_the_pairs_of_the_bound():
    rng = np.random.default_rng(0)
    for n in (1, 2, 17, 300):
        sets = []
        for k in range(n):
            if k and rng.random() < 0.5:
                b = sets[rng.integers(len(sets))]
                sets.append(np.unique(np.append(b[rng.random(len(b)) < 0.95], rng.integers(0, 1 << 60, 3).astype(np.uint64))))
            else:
                sets.append(np.unique(rng.integers(0, 1 << 60, rng.integers(1, 200)).astype(np.uint64)))
        p, size = np.array([count_vector(h) for h in sets]).reshape(-1, GROUPS), np.array([len(h) for h in sets], np.int64)
        root, side = rng.integers(0, max(1, n // 2), n), rng.integers(0, 2, n)
        for across in (False, True):
            out = [(min(a, b), max(a, b)) for i, j in RTree(p, size, root, side).pairs(85, 100, across) for a, b in zip(i.tolist(), j.tolist())]
            want = {(a, b) for a in range(n) for b in range(a + 1, n) if root[a] != root[b] and (not across or side[a] != side[b]) and may_link(np.minimum(p[a], p[b]).sum(dtype=np.int64), size[a], size[b], 85, 100)}
            assert len(out) == len(set(out)) and set(out) == want
            for a, b in [(a, b) for a in range(min(n, 40)) for b in range(a)]:
                both = len(np.intersect1d(sets[a], sets[b]))
                assert both <= np.minimum(p[a], p[b]).sum()
