import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality
from plumbline.llm.quality import NAMES, Discriminant, classify, statistics


def test_log_density_difference():
    rng = np.random.default_rng(0)
    d = len(NAMES)
    x = {0: rng.normal(size=(400, d)) * 2, 1: rng.normal(size=(900, d)) + 1}
    m = Discriminant({k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()}, pooled=0.0, diagonal=0.0, scale=1.0)
    probe = rng.normal(size=(5, d))

    def dens(v, p):
        w = d / (d + len(v))
        own, other = np.cov(v.T), sum((len(u) - 1) * np.cov(u.T) for u in x.values()) / (1300 - 2)
        cov = (1 - w) * own + w * other + 1e-6 * np.eye(d)
        z = p - v.mean(0)
        return -0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) + np.linalg.slogdet(cov)[1])

    want = 1 / (1 + np.exp(-(dens(x[1], probe) - dens(x[0], probe) + np.log(900 / 400))))
    assert np.allclose(m.score(probe), want, atol=1e-6)


def test_statistics_by_hand():
    text = ["The cat THE cat\nx | 12!\n", "", "a"]
    raw = [t.encode() for t in text]
    off = np.cumsum([0] + [len(r) for r in raw])
    x = dict(zip(NAMES, statistics(np.frombuffer(b"".join(raw), np.uint8), off).T))
    assert np.allclose(x["log_words"], np.log1p([7, 0, 1]))
    assert np.isclose(x["distinct_words"][0], np.log(6.5 / 1.5)) and np.isclose(x["shouted"][0], np.log(1.5 / 6.5)) and np.isclose(x["bars"][0], np.log(1.5 / 6.5))
    assert np.isclose(x["distinct_lines"][0], np.log(2.5 / 0.5)) and all(np.isfinite(v).all() for v in x.values())


def train():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = classify(docs, labels, "quality", train()).join(labels, "doc_id").where(~train()).select("quality", "score", "predicted").toPandas()
    pos, neg = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    auc = np.mean([(pos > n).mean() + 0.5 * (pos == n).mean() for n in neg])
    print("auc", auc, "accuracy", (got.predicted == got.quality).mean(), "of 0", (got.predicted[got.quality == 0] == 0).mean(), len(got))
    assert auc > 0.95 and (got.predicted == got.quality).mean() > 0.93


def test_odd_rows(spark):
    rows = [(i, "good words in a row " * (1 + i % 3), "x") for i in range(20)] + [(100 + i, "BAD!! $$$ ### " * (1 + i % 4), "y") for i in range(20)] + [(200, None, "z"), (201, "", "z"), (None, "good words", "z"), (3, "good words in a row", "x"), (202, "w " * 50000, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, x string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100 + i, 0, 0) for i in range(20)] + [(200, None, 0), (None, 1, 0), (201, 7, 0)], "doc_id long, quality int, toxic int")
    got = classify(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert min(by[i] for i in range(20)) > max(by[100 + i] for i in range(20)) and by[200] == by[201]
    assert len({r.score for r in classify(df, labels.limit(0)).collect()}) == 1
    assert classify(df.limit(0), labels).count() == 0
    assert quality.features(df).count() == len(rows)


def plain_statistics(text):
    """The statistics of one text, counted word by word and line by line."""
    import re
    from collections import Counter

    raw = (text or "").encode()
    logit = lambda part, whole: np.log((part + 0.5) / (max(whole - part, 0) + 0.5))
    white, digit, upper, lower = b" \t\n\x0b\x0c\r", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123))
    mark = b"!\"'(),-.:;?"
    n = lambda s, of: sum(c in of for c in s)
    letters = lambda s: sum(c in upper or c in lower or c >= 128 for c in s)
    odd = lambda c: c < 128 and c not in white + digit + upper + lower + mark
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    k, size = [len(x) for x in w], len(w)
    lines = [x for x in re.findall(rb"[^\n]*\n|[^\n]+", raw) if len(x) > 1]
    lines = [x[:-1] if x.endswith(b"\n") else x for x in lines]
    top = lambda items: max(Counter(items).values(), default=0)
    return [
        np.log1p(len(raw)), np.log1p(size), np.log1p(np.mean(k) if w else 0), np.log1p(np.std(k) if w else 0),
        logit(n(raw, upper), len(raw)), logit(n(raw, digit), len(raw)), logit(n(raw, mark), len(raw)), logit(sum(map(odd, raw)), len(raw)), logit(n(raw, white), len(raw)),
        logit(len(set(w)), size), logit(sum(a == b for a, b in zip(w, w[1:])), size), logit(top(w), size), logit(len(set(lines)), len(lines)), np.log1p(size / max(len(lines), 1)),
        logit(sum(x <= 3 for x in k), size), logit(sum(odd(x[-1]) for x in w), size), logit(sum(n(x, upper) > 1 and not n(x, lower) for x in w), size),
        logit(sum(not letters(x) and len(x) == 1 for x in w), size), logit(sum(letters(x) == len(x) for x in w), size), logit(top(zip(w, w[1:])), size)]


def test_whole_table_against_plain_counting(spark, sf):
    """All rows of the query: statistics counted anew, densities from inverse covariances, shares and scale tried one by one."""
    import itertools
    import zlib

    from plumbline.llm.queries import QUERIES

    docs = {r.doc_id: plain_statistics(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known = [i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 4 != 2]
    fold = {r.doc_id: r.f for r in quality.features(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", F.pmod(F.xxhash64("x"), F.lit(quality.FOLDS)).alias("f")).collect()}
    d = len(NAMES)

    def model(ids, pooled, diagonal):
        x = {k: np.array([docs[i] for i in ids if labels[i] == k]) for k in (0, 1)}
        common = sum((len(v) - 1) * np.cov(v.T) for v in x.values()) / (len(ids) - 2)
        parts = []
        for k in (0, 1):
            a = min(1.0, pooled + d / (d + len(x[k])))
            cov = (1 - diagonal) * ((1 - a) * np.cov(x[k].T) + a * common) + diagonal * np.diag(np.diag(common) + 1e-3) + 1e-6 * np.eye(d)
            parts.append((x[k].mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]))
        dens = lambda v: [-0.5 * ((v - m) @ c @ (v - m) + g) for m, c, g in parts]
        return (lambda v: dens(v)[1] - dens(v)[0]), np.log(len(x[1]) / len(x[0]))

    best = None
    for pooled, diagonal in itertools.product(quality.POOLED, quality.DIAGONAL):
        losses = np.zeros(len(quality.SCALE))
        for f in range(quality.FOLDS):
            odds, prior = model([i for i in known if fold[i] != f], pooled, diagonal)
            for i in known:
                if fold[i] == f:
                    losses += [np.logaddexp(0, -(1 if labels[i] else -1) * (s * odds(np.array(docs[i])) + prior)) for s in quality.SCALE]
        for s, loss in zip(quality.SCALE, losses):
            if best is None or round(loss, 6) < best[0]:
                best = (round(loss, 6), pooled, diagonal, s)
    odds, prior = model(known, *best[1:3])
    got = {r.doc_id: r for r in QUERIES["op5_quality"](spark, sf).collect()}
    assert set(got) == set(docs)
    for i, x in docs.items():
        want = 1 / (1 + np.exp(-(best[3] * odds(np.array(x)) + prior)))
        assert abs(got[i].score - want) < 1e-6 and got[i].predicted == int(got[i].score >= 0.7) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
