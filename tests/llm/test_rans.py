import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import rans
from plumbline.llm.rans import Block, Table, block_bytes, quantise, token_files

PATH = P.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(1, 40))
def test_block_round_trip(ids, lanes):
    a = np.array(ids, np.uint32)
    t = Table(quantise(np.bincount(a, minlength=1)))
    words, marks = rans.encode(a, t, lanes)
    got = [rans.decode_piece(words, w, s, (marks[k + 1][0] * lanes if k + 1 < len(marks) else len(a)) - r * lanes, t) for k, (r, w, s) in enumerate(marks)]
    assert np.concatenate([np.zeros(0, np.uint32), *got]).tolist() == ids


def test_large_skewed_block_pieces_and_damage():
    rng = np.random.default_rng(0)
    a = np.minimum(rng.zipf(1.3, 200_000), 49_000).astype(np.uint32)
    t = Table(quantise(np.bincount(a)))
    raw = block_bytes(np.arange(2), np.ones(2), np.array([1000, 199_000]), a, t)
    b = Block(raw)
    assert len(b.marks) > 1 and (b.piece(1, t) == a[b.marks[1][0] * b.lanes :][: len(b.piece(1, t))]).all()
    assert (b.ids(t) == a).all() and len(raw) < 0.8 * 2 * len(a)
    with pytest.raises(ValueError):
        Block(raw[:-1] + bytes([raw[-1] ^ 1]))


def test_quantise_keeps_rare_ids():
    f = quantise(np.array([10**12, 1, 0, 1]))
    assert f.sum() == 1 << rans.SCALE and (f > 0).tolist() == [True, True, False, True]
    assert quantise(np.array([0, 7])).tolist() == [0, 1 << rans.SCALE]


def want(rows, end=2):
    tok = rans.tokenizer(PATH)[0]
    out, at = [], 0
    lists = [(i, tok.encode(t or "", add_special_tokens=False).ids + [end]) for i, t in rows]
    for i, ids in sorted(lists, key=lambda x: -(1 << 63) if x[0] is None else x[0]):
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def rows_of(df):
    return [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.orderBy("start").collect()]


def test_odd_texts_as_the_library(spark):
    texts = ["", None, "A  b\tC\n", "É é a b", "x ́y", "It's 1234 !!", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΟΔΟΣ", "İI", "👩‍👩‍👧", "w" * 3000, "go " * 9000, "\x1c\x85　z", "ﬁ Å"]
    rows = [(i * 7 - 20, t) for i, t in enumerate(texts)] + [(None, "no id")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, start int").repartition(3)
    assert rows_of(token_files(df, PATH)) == want(rows)


@pytest.mark.parametrize("remember", [150_000, 50])
def test_table_as_the_library(spark, sf, monkeypatch, remember):
    monkeypatch.setattr(rans, "BLOCK_IDS", 5000 if remember == 50 else 1 << 18)
    monkeypatch.setattr(rans, "REMEMBER", remember)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = token_files(df, PATH)
    assert rows_of(out) == want([(r.doc_id, r.text) for r in df.collect()])
    assert all(len(r.ids) == r.n_tokens for r in out.collect())


def test_repeated_rows_and_empty(spark, sf):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (0, "c")], "doc_id long, text string")
    assert [r[:3] for r in rows_of(token_files(df, PATH))] == [(0, 0, 2), (1, 2, 3), (1, 5, 3)]
    assert token_files(df.limit(0), PATH).count() == 0
