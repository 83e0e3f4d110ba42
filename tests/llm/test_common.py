import numpy as np
import pyarrow as pa

from plumbline.llm import common
from plumbline.llm.common import cover, prefix, runs, slices, spans_hash, text_arrays, words_of


def test_text_arrays_of_slices_nulls_and_chunks():
    a = pa.array(["é", None, "", "abc", "x"])
    for col, want in ((a, ["é", "", "", "abc", "x"]), (a.slice(2, 2), ["", "abc"]), (pa.chunked_array([a, a.slice(3)]), ["é", "", "", "abc", "x", "abc", "x"]), (pa.chunked_array([], pa.string()), [])):
        d, o = text_arrays(col)
        assert [d[i:j].tobytes().decode() for i, j in zip(o[:-1], o[1:])] == want


def test_slices_cover_all_rows_once():
    off = np.array([0, 5, 5, 50, 52, 53])
    for limit in (1, 4, 10, 1000):
        got = list(slices(off, limit))
        assert [k for i, j in got for k in range(i, j)] == list(range(5))
    assert list(slices(np.array([0]), 9)) == []


def test_words_do_not_cross_documents():
    raw, off = b"ab c" + b"de" + b"" + b" \x0bf\n", np.array([0, 4, 6, 6, 10])
    s, e, first = words_of(np.frombuffer(raw, np.uint8), off)
    assert [raw[i:j] for i, j in zip(s, e)] == [b"ab", b"c", b"de", b"f"] and first.tolist() == [0, 2, 3, 3, 4]


def test_hashes_depend_on_content_only():
    a = np.frombuffer(b"hello world hello", np.uint8)
    h = spans_hash(prefix(a), np.array([0, 12, 6]), np.array([5, 17, 11]))
    assert h[0] == h[1] != h[2]


def test_runs_and_cover():
    m = cover(np.array([1, 2, 8]), 3, 10)
    assert m.tolist() == [False, True, True, True, True, False, False, False, True, True]
    assert [x.tolist() for x in runs(m)] == [[1, 8], [5, 10]]


def test_stored_and_clear(spark):
    common.clear(spark)
    df = common.stored(spark.range(5), "five")
    assert df.count() == 5 and common.clear(spark) == 1 and common.clear(spark) == 0
