import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, least=30, prior=5, top=50):
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        t = TERM.findall((text or "").translate(FOLD))
        count[lang or "", source or ""].update(t)
        docs[lang or ""].update(set(t))
    out = []
    for lang in {g[0] for g in count}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for k, s in count if k == lang]
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])
        rate = lambda c: {t: 1 + 10**9 * (c[t] + prior) // (sum(c[u] for u in kept) + prior * len(kept)) for t in kept}
        p, q = {s: rate(count[lang, s]) for s in sources}, rate(whole)
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, x in (("pair", pair), ("term", term)) for k, (v, item) in enumerate(x)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocab = [rng.choice("abcdeéüzЖ中") * rng.randrange(1, 4) + str(rng.choice("xyzXYZßя")) for _ in range(60)]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["web", "web", "web", "b", "ü", None, "z"])
        w = rng.choices(vocab, k=rng.randrange(0, 25)) + [source or "none"] * rng.randrange(0, 3)
        rows.append((rng.choice([" ", "1", "_", "\n", "@"]).join(w) if rng.random() < 0.95 else None, lang, source))
    rows += [("", "only", "s"), (None, "none", None), ("q" * 70000 + " " + "ab " * 80000, "en", "web"), ("ab cd", "de", "rare")] + rows[:5]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k // 2 or None, *r, "x", 5) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, count int")


@pytest.mark.parametrize("seed,least,leaves", [(0, 30, 1 << 19), (1, 3, 40), (2, 1, 3)])
def test_same_as_brute_force(spark, monkeypatch, seed, least, leaves):
    monkeypatch.setattr(D, "LEAVES", leaves)  # with few, some ranges are cut further
    monkeypatch.setattr(D, "HELD", 400)
    monkeypatch.setattr(D, "AT_ONCE", 3)
    rows = corpus(seed)
    assert got(D.source_divergence(frame(spark, rows).repartition(6), least)) == brute(rows, least)


def test_more_sources_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 3)
    monkeypatch.setattr(D, "GROUPS", 7)
    rng = random.Random(5)
    rows = [(" ".join(rng.choices(["a", "b", "cc", "é", "dd"], k=9)), rng.choice(["en", "fr"]), f"s{rng.randrange(11)}") for _ in range(200)]
    assert got(D.source_divergence(frame(spark, rows), 4, top=2)) == brute(rows, 4, top=2)


def test_ties_and_nothing_kept(spark):
    rows = [("b a é z", "en", s) for s in ("x", "y", "z") for _ in range(12)] + [("extra", "en", "y")]
    assert got(D.source_divergence(frame(spark, rows), 5)) == brute(rows, 5)
    out = got(D.source_divergence(frame(spark, rows), 1000))
    assert out == brute(rows, 1000) and {r[4] for r in out} == {0}
    assert D.source_divergence(frame(spark, rows).where("false")).count() == 0


def test_rates_are_exact():
    rng = random.Random(1)
    for _ in range(2000):
        total = rng.randrange(1, 1 << rng.randrange(1, 52))
        c = rng.randrange(0, total + 1)
        assert D.rates(np.array([c]), np.array([total]))[0] == 1 + 10**9 * c // total


def test_tries_merge_whatever_their_order(monkeypatch):
    monkeypatch.setattr(D, "HEAD", 4)
    rng = random.Random(2)
    words = [bytes(rng.choices(b"ab\xc3\xa9", k=rng.randrange(1, 12))) for _ in range(400)]
    want, by_source = Counter(words), Counter()
    for _ in range(4):
        rng.shuffle(words)
        parts = [(Counter(), {}) for _ in range(3)]
        by_source.clear()
        for k, w in enumerate(words):
            docs, groups = parts[k % 3]
            docs[w] += 1
            groups.setdefault(f"s{k % 2}", Counter())[w] += 1
            by_source[w, f"s{k % 2}"] += 1
        rows = [D.Trie.grown(*p).pieces("en") for p in parts]
        tries = [D.Trie.read({c: b.column(c)[k] for c in D.PIECE.names}) for b in rows for k in range(b.num_rows)]
        rng.shuffle(tries)
        whole = D.Trie.merged([D.Trie.merged(tries[:9]), *tries[9:]])
        assert whole.terms == sorted(want) and whole.docs.tolist() == [want[t] for t in whole.terms]
        leaf = np.repeat(np.arange(len(whole.terms)), whole.width)
        assert {(whole.terms[i], whole.names[s]): n for i, s, n in zip(leaf, whole.source, whole.count.tolist())} == by_source
        some = D.Trie.merged(tries, 3)
        assert some.terms == [t for t in sorted(want) if want[t] >= 3] and some.docs.tolist() == [want[t] for t in some.terms]
        shared = D.shared_prefix(whole.terms)
        assert all(a[:k] == b[:k] and a[k : k + 1] != b[k : k + 1] for a, b, k in zip(whole.terms, whole.terms[1:], shared[1:].tolist()))
