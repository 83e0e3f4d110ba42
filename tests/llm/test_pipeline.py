import hashlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, common
from plumbline.llm.decontam import clean


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_each_stage_on_its_input(spark, sf):
    docs = common.documents(spark, sf)
    cols = docs.columns
    bench = [clean(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        if name != "byte_bpe":
            assert out.columns == cols
            out = common.stored(out, name)
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "language_id":
            assert all(any(c.isalpha() for c in r.text) for r in after.values()) and len(gone) < 0.02 * len(before)
        if name == "simhash_near_dedup":
            sets = {i: shingles(r.text) for i, r in before.items()}
            sim = lambda a, b: len(a & b) / max(1, len(a | b)) if a or b else 1.0
            kept = sorted(after)
            assert all(any(sim(sets[i], sets[j]) > 0.6 for j in before if j != i) for i in gone)
            assert not any(sim(sets[i], sets[j]) >= 0.86 for k, i in enumerate(kept) for j in kept[:k])
        if name == "decontamination":
            assert not any(b in clean(r.text) for r in after.values() for b in bench if b)
            assert all(any(b[:10] in clean(before[i].text) or b[-10:] in clean(before[i].text) for b in bench) for i in gone)
        if name == "pii":
            assert not gone and not any("@mail" in r.text for r in after.values())
            assert all(r.n_chars == len(r.text) for r in after.values())
            assert sum(before[i].text != after[i].text for i in after) < 0.2 * len(after)
        if name == "byte_bpe":
            enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
            for i, r in after.items():
                ids = enc.encode_ordinary(before[i].text)
                assert r.ids == ids and r.n_tokens == len(ids)
                assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
                assert r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest()
            assert not gone
        docs = out


def test_run_equals_stages(spark, sf):
    docs = common.documents(spark, sf)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.doc_id for r in docs.collect())


def test_odd_rows_and_columns(spark, sf, tmp_path):
    """Nulls in every column, empty and repeated rows, copies, ties and clashing columns, beside the whole table.

    Rows without a letter go; rows with one id are one; the smallest id of a
    group of copies stays; rows without an id stay; benchmark items go,
    personal data is replaced. What the table keeps without the odd rows is kept with them.
    """
    src = common.documents(spark, sf)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    alone = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    text = {r.doc_id: r.text for r in src.collect()}
    same = [i for i in sorted(alone) if bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).encode_ordinary(text[i]) == alone[i] and len(text[i].split()) > 60]
    a, b, c, d, e = (text[i] for i in same[:5])
    item = max((r.text for r in bench.collect()), key=len)
    flip = lambda t: " ".join(reversed(t.split()))
    rows = [
        (same[0], a, "xx", None, None), (same[0], a, None, "s", 1),  # the row again
        (10**9, b, None, None, None), (10**9 + 1, b.upper().replace(" ", "  ") if b.isascii() else b, None, None, None),  # copies
        (10**9 + 2, None, "en", "s", 0), (10**9 + 3, "", None, None, 0), (10**9 + 4, "12 345 ...", None, None, None), (None, None, None, None, None),
        (None, flip(c), None, None, None), (None, flip(c), None, None, None),  # no id: both stay
        (10**9 + 5, f"{flip(d)} {item} {flip(d)}", None, None, None),
        (10**9 + 6, f"{flip(e)} jane.roe@example.org {flip(d)}", None, None, None),
    ]
    odd = src.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    extra = ["md5", "_md5", "spans", "terms", "entity", "group", "node", "key", "_row", "_new", "item", "rejected"]
    odd.select("*", *[F.lit(None if k % 2 else f"x{k}").cast("string").alias(c) for k, c in enumerate(extra)]).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert {i: r.ids for r in out if (i := r.doc_id) is not None and i < 10**9}.keys() == alone.keys()
    assert all(r.ids == alone[r.doc_id] for r in out if r.doc_id in set(same)) and len([r for r in out if r.doc_id is not None]) == len(alone) + 1
    assert [r.ids for r in out if r.doc_id is None] == [enc.encode_ordinary(flip(c))] * 2
    assert [enc.decode(r.ids) for r in out if r.doc_id is not None and r.doc_id >= 10**9] == [f"{flip(e)} [EMAIL] {flip(d)}"]


def test_empty_table(spark, sf, tmp_path):
    common.documents(spark, sf).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
