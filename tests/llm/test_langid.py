import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import langid
from plumbline.llm.langid import identify, keep_known_languages


def clean(t):
    out = [" "] * 3
    body = ""
    for c in t.lower():
        body += c if c.isalpha() else " "
    body = " ".join(body.split(" ")).lstrip(" ")
    while "  " in body:
        body = body.replace("  ", " ")
    return "".join(out), body if any(c.isalpha() for c in body) else ""


def gram_list(t):
    pad, body = clean(t)
    s = pad + body
    return [s[i - 3 : i + 1] for i in range(3, len(s))]


def test_grams():
    texts = ["Ab, cd!", "", "12 34", "é x", " a ", "𝔄b"]
    keys, cut = langid.grams(texts)
    for t, i, j in zip(texts, cut[:-1], cut[1:]):
        got = ["".join(chr(int(k) >> s & 0xFFFF) for s in (48, 32, 16, 0)) for k in keys[i:j]]
        assert got == [g.replace("𝔄", "￿").replace("𝔞", "￿") for g in gram_list(t)]


class Plain:
    """Textbook interpolated Kneser-Ney over strings."""

    def __init__(self, texts):
        self.c = {4: Counter(g for t in texts for g in gram_list(t))}
        for o in (3, 2, 1):
            self.c[o] = Counter(g[1:] for g in self.c[o + 1])

    def p(self, g):
        o = len(g)
        if o == 0:
            return 1 / (len(self.c[1]) + 1)
        n = np.array(list(self.c[o].values()))
        one, two = (n == 1).sum(), (n == 2).sum()
        d = one / (one + 2 * two) if one and two else 0.75
        same = {k: v for k, v in self.c[o].items() if k[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return self.p(g[1:])
        return max(self.c[o].get(g, 0) - d, 0) / total + d * len(same) / total * self.p(g[1:])


def counts_of(texts):
    k, n = np.unique(np.concatenate([langid.grams(texts)[0]]), return_counts=True)
    return k, n


def test_model_matches_textbook():
    rng = random.Random(0)
    texts = {"x": ["".join(rng.choice("abc d") for _ in range(60)) for _ in range(4)], "y": ["".join(rng.choice("abzé ") for _ in range(60)) for _ in range(4)]}
    m = langid.Model({k: counts_of(v) for k, v in texts.items()})
    probe = ["abc zé q", "dd", "é", "unseen words here", texts["x"][0]]
    keys, cut = langid.grams(probe)
    n, h = np.diff(cut), langid.entropies(langid.sums(m.logs(keys)), cut)
    for col, lang in enumerate(m.langs):
        plain = Plain(texts[lang])
        for k, t in enumerate(probe):
            g = gram_list(t)
            assert n[k] == len(g)
            assert abs(h[k, col] - -sum(math.log(plain.p(x)) for x in g) / len(g)) < 1e-4


def test_probabilities_sum_to_one():
    m = langid._Language(*counts_of(["ab abc cab bca aab", "cc ab"]))
    syms = np.append(m.p[1][0], np.uint64(9999))
    for ctx in m.bow[4][0][:20]:
        assert abs(m.prob(4, (ctx << np.uint64(16)) | syms).sum() - 1) < 1e-9


def held(i, n=5):
    return zlib.crc32(str(i).encode()) % n == 0


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    got = {r.doc_id: r for r in identify(df, train).collect()}
    truth = {r.doc_id: r.lang for r in df.collect()}
    mine = [i for i in truth if held(i)]
    assert all(got[i].train == (not held(i)) for i in truth) and len(mine) > 100
    assert sum(got[i].lang_pred == truth[i] for i in mine) / len(mine) > 0.97
    assert sum(r.rejected for r in got.values()) < 0.01 * len(got)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows_and_filter(spark):
    rows = [(i, "the cat sat on the mat and the dog ran", "en") for i in range(30)] + [(100 + i, "der hund und die katze sind nicht hier", "de") for i in range(30)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "12345 !!", "en"), (None, "the cat sat on the mat and the dog", None), (204, "die katze", None), (205, "zzxqj kkvw qqq xzxzx jjqk " * 40, None), (0, rows[0][1], "en"), (206, "the cat sat on the mat and the dog ran " * 3000, None)]
    df = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, lang string, md5 string")
    got = {(r.doc_id): r for r in identify(df).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202, None, 204)] == ["und", "und", "und", "en", "de"]
    assert got[205].rejected and not got[204].rejected and got[200].score == 0
    kept = keep_known_languages(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in (200, 201, 202, 205))
    assert identify(df.limit(0)).count() == 0 and keep_known_languages(df.limit(0)).count() == 0
    none = identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"} and all(r.rejected for r in none)


def test_shards_score_as_the_whole_model_and_keep_all_counts(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and text is not null")
    texts = {}
    for r in df.collect():
        texts.setdefault(r.lang, []).append(r.text)
    whole = langid.Model({k: counts_of(v) for k, v in texts.items()})
    probe = [t[:3000] for v in texts.values() for t in v[:10]] + ["", "12", "qqxz unseen zzkw"]
    monkeypatch.setattr(langid, "SHARD_GRAMS", 8000)
    made = list(langid.train_models(df))
    shards = [m for _, m in made]
    assert len(shards) == made[0][0] > 2 and all(m.langs == whole.langs for m in shards)
    assert sum(len(m.p[4].hash) for m in shards) == len(whole.p[4].hash)
    keys, _ = langid.grams(probe)
    assert abs(whole.logs(keys) - langid.sharded_logs(keys, len(shards), len(whole.langs), shards.__getitem__)).max() < 1e-4
    got = {r.doc_id: r.lang_pred for r in identify(df).collect()}
    monkeypatch.setattr(langid, "SHARD_GRAMS", 1 << 30)
    assert got == {r.doc_id: r.lang_pred for r in identify(df).collect()}


def test_histograms_and_distances_of_every_window():
    rng = np.random.default_rng(0)
    cut = np.array([0, 100, 100, 3000, 3007])
    logs = -rng.random((3007, 3)).astype(np.float32) * 9
    own = np.array([1, 0, 2, 0])
    total = langid.sums(logs)
    got = langid.histograms(total, cut, own)
    parts = lambda a, z: [-logs[x : min(x + 128, z)].astype(float).mean(0) for x in range(a, z, 128)]
    for x, size in enumerate(langid.LENGTHS):
        want = np.zeros((2, 3, langid.BINS), int)
        for i, o in enumerate(own):
            for a in range(cut[i], cut[i + 1] - size + 1, size):
                h = np.array(parts(a, a + size))
                want[0, o, int(h.min(1).mean() / langid.BIN)] += 1
                h[:, o] = np.inf
                want[1, h.mean(0).argmin(), int(h.min(1).mean() / langid.BIN)] += 1
        assert abs(got[x] - want).sum() <= 4  # sums in another order may cross an edge of a bin
    d = langid.distances(total, cut)
    assert d[1] == 0 and abs(d[0] + logs[:100].mean(0).max()) < 1e-5 and abs(d[3] + logs[3000:].mean(0).max()) < 1e-5
    edges = [*range(100, 100 + 22 * 128, 128), 3000]
    assert abs(d[2] - sum(-logs[a:z].sum(0).max() for a, z in zip(edges[:-1], edges[1:])) / 2900) < 1e-4


def test_limit_separates():
    own, other = np.zeros(100, int), np.zeros(100, int)
    own[40:50], other[70:80] = 100, 100
    assert abs(langid.limit_of(own, other) - 60 * langid.BIN) < 2 * langid.BIN
    own[75] = 5  # a few windows in another language do not move it
    assert langid.limit_of(own, other) < 71 * langid.BIN
    assert langid.limit_of(own[:40], other) is None
    assert langid.limit_of(own, other * 0) > 50 * langid.BIN


def test_unknown_languages_and_junk_are_rejected(spark):
    """Each language in turn is unknown: its texts are rejected, those of the others are not."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: (r.lang, r.text) for r in df.collect()}
    rng = random.Random(1)
    junk = [(10**6 + i, "".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(300)), None) for i in range(50)]
    for left_out in ("en", "es"):
        both = df.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string"))
        got = {r.doc_id: r for r in identify(both, (F.col("lang") != left_out) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).collect()}
        unknown = [got[i].rejected for i, (lang, t) in text.items() if lang == left_out and len(t) >= 100]
        known = [got[i].rejected for i, (lang, t) in text.items() if lang != left_out and held(i)]
        print(left_out, sum(unknown) / len(unknown), len(unknown), sum(known) / len(known), len(known))
        assert sum(unknown) / len(unknown) > 0.95 and sum(known) / len(known) < 0.01
        assert all(got[i].rejected for i, _, _ in junk)
    long = {x: " ".join(t for lang, t in text.values() if lang == x and len(t) > 800)[:900] for x in ("en", "de", "fr", "es")}
    mixed = [(2 * 10**6 + k, f"{long[a]} {long[b]}", None) for k, (a, b) in enumerate((a, b) for a in long for b in long if a != b)]
    both = df.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(mixed, "doc_id long, text string, lang string"))
    rejected = {r.doc_id for r in identify(both).collect() if r.rejected}
    assert not rejected & {i for i, _, _ in mixed} and len(rejected) <= 2  # texts in several known languages stay
