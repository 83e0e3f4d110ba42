import random
import re

import numpy as np
import pytest
import xxhash

from plumbline.llm import simhash
from plumbline.llm.components import components, forest
from plumbline.llm.simhash import near_groups, simhash_components, simhash_dedup


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def plain_fp(t):
    w = words(t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=2):
    fp = [plain_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{fp[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "é", "ab", "XYZ", "q"]) + str(rng.randrange(60))
    rows, base = [], [[word() for _ in range(rng.randrange(60, 300))] for _ in range(8)]
    for i in range(n):
        w = list(rng.choice(base)) if i % 2 else [word() for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            if w:
                w[rng.randrange(len(w))] = word()
        rows.append((i * 3 - 50, rng.choice((" ", "\n", "  ")).join(w)))
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "one two"), (None, "no id"), (None, "other no id"), (None, rows[1][1]), rows[5], (907, "w " * 5000)]


@pytest.mark.parametrize("tile", [2048, 16])
@pytest.mark.parametrize("parts", [1, 4])
def test_components_match_brute_force(spark, monkeypatch, tile, parts):
    monkeypatch.setattr(simhash, "TILE_LEAST", tile)
    monkeypatch.setattr(simhash, "_parts_for", lambda n: parts)
    rows = corpus(tile)
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, fp int, fingerprint string").repartition(3)
    got = rows_of(simhash_components(df))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(rows)


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_cells_lose_no_pair(spark, monkeypatch, parts):
    """Random fingerprints with flipped bits: every pair within the radius ends up in cells that are compared."""
    rng = np.random.default_rng(parts)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 300)]
    pairs = [(f, f ^ (1 << int(a)) ^ (1 << int(b))) for f in fps for a, b in [rng.choice(64, 2, replace=False)]]
    bits = 64 // parts

    def cell(f):
        return tuple((f >> i * bits & (1 << bits) - 1).bit_count() for i in range(parts))

    for f, g in pairs:
        assert cell(g) in set(simhash._ball(cell(f), 2))


def test_table_and_empty(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(simhash_components(df)) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert simhash_components(df.limit(0)).count() == 0
    assert simhash_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("one_task", [0, 1 << 18])
def test_forest_and_components(spark, monkeypatch, one_task):
    monkeypatch.setattr("plumbline.llm.components.ONE_TASK", one_task)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    u, v = forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    want = dict(zip(u.tolist(), v.tolist()))
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()}
    assert got == want


@pytest.mark.parametrize("tile", [2048, 8])
def test_near_groups_against_jaccard(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE_LEAST", tile)
    rng = random.Random(11)
    word = lambda: "w" + str(rng.randrange(5000))
    rows = []
    for b in range(12):
        base = [word() for _ in range(rng.choice((12, 80, 700, 3000)))]
        rows.append(base)
        for p in (0.003, 0.01, 0.08, 0.3):
            rows.append([word() if rng.random() < p else w for w in base])
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in rows]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    group = {r.doc_id: r.group for r in near_groups(df).collect()}
    for i in range(len(rows)):
        for j in range(i):
            sim = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if sim >= 0.86:
                assert group[i] == group[j], (i, j, sim)
    for i, g in group.items():  # nothing is grouped that no chain of fairly similar texts connects
        assert g == i or any(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.74 for j in group if j != i and group[j] == g)


def test_dedup_keeps_one_of_each_group_and_all_columns(spark):
    rows = [(1, "a b c d e f g h", "x"), (2, "A b  c d e f g h", "y"), (3, "other words are here now ok", "z"), (4, None, "n"), (5, "", "e"), (None, "a b c d e f g h", "null"), (3, "other words are here now ok", "z"), (7, "b second text of one id entirely", "p"), (7, "a first text of one id", "q"), (2, "A b  c d e f g h", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, group string")
    out = simhash_dedup(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "4", "7", "None"]
    assert [r.group for r in got if r.doc_id == 7] == ["q"]


@pytest.mark.parametrize("shingles", [5, 9, 45, 450, 4500])
def test_near_groups_at_exactly_the_threshold(spark, shingles):
    """Pairs at 0.8 (8 of 10 parts shared) are all linked, pairs one hash short are not, whatever their size."""
    total = shingles
    common = round(total * 8 / 9) if total % 9 == 0 else None
    rows, want = [], {}
    for k in range(40):
        # n tokens as shingles of one word each: sets a and b share c of n each, so the similarity is c / (2 n - c)
        if common is None:  # 4 of 5: one side has one word more
            a = [f"k{k}x{i}" for i in range(4)]
            b = [*a, f"k{k}y"]
            c = [f"k{k}z{i}" for i in range(4)]
            d = [*c[:3], f"k{k}v"]
        else:
            a = [f"k{k}x{i}" for i in range(total)]
            b = a[:common] + [f"k{k}y{i}" for i in range(total - common)]
            c = [f"k{k}z{i}" for i in range(total)]
            d = c[: common - 1] + [f"k{k}v{i}" for i in range(total - common + 1)]
        for j, w in enumerate((a, b, c, d)):
            rows.append((4 * k + j, " ".join(w)))
            want[4 * k + j] = 4 * k if j < 2 else 4 * k + j
    got = {r.doc_id: r.group for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle=1).collect()}
    assert got == want


@pytest.mark.parametrize("limits", [{}, {"LIST": 4, "BUCKET": 16, "STEP": 64}])
def test_near_groups_equal_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():  # long lists in blocks, frequent hashes in several buckets
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(5)
    rows = []
    for b in range(30):
        base = [f"b{b}w{i}" for i in range(rng.choice((3, 6, 9, 40, 200)))] + [f"foot{i}" for i in range(12)]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append(w)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.group for r in near_groups(df).collect()} == {i: find(i) for i in range(len(rows))}


def test_only_sets_shared_enough_go_on(spark):
    """Sets that are 79 % shared are left out, sets that are 80 % shared are not; of equal sets in a group one is given."""
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:80] + [f"a{i}" for i in range(20)])), (3, " ".join(words[:79] + [f"b{i}" for i in range(21)])), (4, " ".join(words).upper()), (5, ""), (6, "alone")]
    got = {r.doc_id: r for r in simhash.shared_sets(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), shingle=1).collect()}
    assert got[2].hashes is not None and got[3].hashes is None and got[5].hashes is None and got[6].hashes is None
    assert got[1].key == got[4].key and got[1].hashes is not None and got[4].hashes is None
    assert [got[i].n for i in range(1, 7)] == [100, 100, 100, 100, 0, 1]


def test_repeated_ids_and_empty_sets(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n"), (3, ""), (4, None), (5, "  "), (2, "h i j k l m n")]
    got = sorted((r.doc_id, r.group) for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (5, 3)]
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_groups_go_through_simhash(spark, monkeypatch):
    """Sets get fingerprints, those within the radius are put together, and the whole sets decide; any radius gives the same groups."""
    rng = random.Random(8)
    rows = []
    for b in range(25):
        base = [f"b{b}w{i}" for i in range(rng.choice((30, 200, 900)))]
        for k in (0, 1, 1, 2):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append(w)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(3)
    seen, pairs_of = [], simhash.simhash_pairs

    def pairs(prints, radius):
        out = pairs_of(prints, radius)
        seen.append(({r.node: r.fp for r in prints.collect()}, {(r.u, r.v) for r in out.collect()}))
        return out

    monkeypatch.setattr(simhash, "simhash_pairs", pairs)
    groups = []
    for radius in (0, 3, 9):
        groups.append({r.doc_id: r.group for r in near_groups(df, radius=radius).collect()})
        fp, got = seen[-1]
        shingles = {i: {" ".join(rows[i][k : k + 5]) for k in range(len(rows[i]) - 4)} for i in fp}
        for i, sh in shingles.items():
            h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
            assert fp[i] & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        close = [(i, j) for i in fp for j in fp if j < i and ((fp[i] ^ fp[j]) & (1 << 64) - 1).bit_count() <= radius]
        edges = [(np.array([e[k] for e in x]), np.array([e[1 - k] for e in x])) for x, k in ((close, 0), (sorted(got), 0))]
        want, have = (dict(zip(*map(np.ndarray.tolist, forest(*e)))) for e in edges)
        assert have == want and close
    assert groups[0] == groups[1] == groups[2] and len(seen) == 3
