import hashlib
import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex

from plumbline.llm import bpe
from plumbline.llm.bpe import bpe_round_trip
from plumbline.llm.common import text_arrays

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " ", "\n\n  x", "a b  c", "\x1c\x1d\x85 y", "it's we'll I'D", "٣٤ ½ 一二三 नमस्ते", "👩‍👩‍👧 <|endoftext|>", "\x00\x00a", "tab\tend   ", "word " * 3000, "é" * 5000, "ab" * 20000, "​　z"]


def want(rows):
    enc = bpe.encoding(PATH, P.PATTERN)
    out = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        raw = b"".join(enc.decode_single_token_bytes(k) for k in ids)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()), key=str)


def test_odd_texts_as_the_library(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, ODD[3])]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, name string").repartition(3)
    out = bpe_round_trip(df, PATH, P.PATTERN)
    assert rows_of(out) == want(rows)
    assert all(r.decoded == (ODD[r.doc_id] or "") for r in out.where("doc_id is not null").collect())


@pytest.mark.parametrize("size", [4 << 20, 20_000])
def test_table_as_the_library(spark, sf, monkeypatch, size):
    monkeypatch.setattr(bpe, "BATCH_BYTES", size)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(bpe_round_trip(df, PATH, P.PATTERN, keep=False)) == want([(r.doc_id, r.text) for r in df.collect()])


def test_texts_are_cut_once(spark, tmp_path):
    rows = [(i, f"text {i} of {i % 7}  words") for i in range(50)]

    def seen(it):
        for b in it:
            with open(tmp_path / "seen", "a") as f:
                f.write(f"{b.num_rows}\n")
            yield b

    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).mapInArrow(seen, "doc_id long, text string")
    assert rows_of(bpe_round_trip(df, PATH, P.PATTERN, keep=False)) == want(rows)
    assert sum(map(int, (tmp_path / "seen").read_text().split())) == 2 * len(rows)  # measured once, cut once


def test_empty(spark, sf):
    assert bpe_round_trip(spark.read.parquet(f"{sf}/documents.parquet").limit(0), PATH, P.PATTERN).count() == 0


def test_white_space_class_agrees():
    pat, enc = regex.compile(P.PATTERN), bpe.encoding(PATH, P.PATTERN)
    for c in list(range(0x3100)) + [0xFEFF, 0x1F600, 0xE000]:
        for s in (chr(c), f"a{chr(c)}b", f" {chr(c)} "):
            pieces = [k for w in pat.findall(s) for k in enc._encode_single_piece(w.encode())]
            assert pieces == enc.encode_ordinary(s), hex(c)


def test_batch_holds_few_words_at_a_time():
    """The words of a batch are not all in memory at once: by themselves they take about twelve times the text."""
    docs = [" ".join(f"w{(7 * i + k * k) % 900}" for k in range(4000)) for i in range(150)] + ["", "x"]
    data, off = text_arrays(pa.array(docs))
    pat = regex.compile(P.PATTERN)
    tracemalloc.start()
    b = bpe.Batch(pa.array(range(len(docs))), data, off, pat, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    words = [w.decode() for w in b.words]
    assert ["".join(words[c] for c in b.codes[i:j]) for i, j in zip(b.cut[:-1], b.cut[1:])] == docs
    often = np.bincount(b.codes, minlength=len(words))
    assert (np.diff(often) <= 0).all() and len(set(words)) == len(words)
    assert peak < 8 * len(data)
