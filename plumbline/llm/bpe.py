"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut by the tokenizer's pattern into pre-tokens. A batch of about
4 MB of text turns them into codes of its own dictionary, commonest first.
Two things leave a batch, in one row: its distinct words and its code at every
position. The rows are shuffled by name and read twice from there: once to send
the words on by hash bucket, once to meet the answers. A bucket gathers each
word of the corpus once per batch, encodes it once, and answers each batch in
the order it asked; ids and positions of a batch meet again by the batch's
content hash, and documents are reassembled by position. Decoding joins ids
with the table of token bytes, whose size the vocabulary fixes.

No text is shuffled: dictionaries, byte planes of codes, and ids are, each
compressed. Texts are cut once. A batch is named by a hash of its rows, so one
that is cut differently when a lost task runs again would be found missing and
fail the job, not mix answers.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Layout, give_back, slices, text_arrays, texts

BATCH_BYTES = 4 << 20
#: Text of a batch whose words are held one by one at a time.
PIECE_BYTES = 1 << 18
#: Words that are decoded at a time.
PIECE_WORDS = 1 << 16
PACK, UNPACK = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
CUT_DDL = "name binary, ids binary, known binary, cut binary, codes binary, buckets binary, words binary"
OUT_DDL = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def token_bytes(path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all bytes end to end by id, and the offsets."""
    enc = encoding(path, pattern)
    known = {rank: tok for tok, rank in enc._mergeable_ranks.items()}  # noqa: SLF001
    rows = [known.get(i, b"") for i in range(max(known, default=-1) + 1)]
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def gather(data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the rows `which` of a ragged array, and its offsets."""
    size = (offsets[1:] - offsets[:-1])[which]
    out = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(out[-1]) + np.repeat(offsets[which] - out[:-1], size)
    return data[at], out


def planes(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return PACK.compress(raw.tobytes())


def unplanes(blob: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(UNPACK.decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def pack_words(words: list[bytes]) -> bytes:
    size = np.array([len(words), *map(len, words)], np.uint32)
    return PACK.compress(size.tobytes() + b"".join(words))


def unpack_words(blob: bytes) -> list[bytes]:
    raw = UNPACK.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4)).tolist()
    body = raw[4 + 4 * n :]
    return [body[i:j] for i, j in zip([0, *ends[:-1]], ends)]


class Batch:
    """Dictionary, codes and name of one slice of documents."""

    def __init__(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, pattern: regex.Pattern, buckets: int):
        raw = data.tobytes()
        seen: dict[str, int] = defaultdict(itertools.count().__next__)  # in the order they come
        parts, sizes = [], []
        for i, j in slices(offsets, PIECE_BYTES):  # the words of a piece at a time, not of the batch
            lists = [pattern.findall(raw[x:y].decode("utf-8", "replace")) for x, y in itertools.pairwise(offsets[i : j + 1].tolist())]
            sizes += map(len, lists)
            parts.append(np.fromiter(map(seen.__getitem__, itertools.chain.from_iterable(lists)), np.uint32, sum(sizes[i:j])))
        words, often = list(seen), np.zeros(len(seen), np.int64)
        for x in parts:
            often += np.bincount(x, minlength=len(words))
        order = np.argsort(-often, kind="stable")
        code = np.empty(len(words), np.uint32)
        code[order] = np.arange(len(words), dtype=np.uint32)
        self.words = [words[k].encode() for k in order.tolist()]
        self.cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.codes = code[np.concatenate(parts)] if parts else np.zeros(0, np.uint32)
        self.bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in self.words), np.uint32, len(self.words))
        name = xxhash.xxh3_128(raw)
        name.update(np.ascontiguousarray(offsets).tobytes())
        name.update(repr(ids.to_pylist()).encode())
        self.name = name.digest()


def _batches(it: Iterator[pa.RecordBatch], pattern: str, buckets: int) -> Iterator[tuple[pa.Array, Batch]]:
    pat = regex.compile(pattern)
    for b in it:
        data, off = text_arrays(b.column(1))
        for i, j in slices(off, BATCH_BYTES):
            ids = b.column(0).slice(i, j - i)
            yield ids, Batch(ids, data[off[i] : off[j]], off[i : j + 1] - off[i], pat, buckets)
            give_back()


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    present, first = np.unique(bucket[order], return_index=True)
    return zip(present.tolist(), np.split(order, first[1:]) if len(present) else [])


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, keep: bool = True) -> DataFrame:
    """Encode every text with a tiktoken vocabulary file and decode it again.

    Takes doc_id and text (null: empty), ignores other columns; rows that
    repeat keep a row each. Every match of `pattern` is encoded by itself, as
    the tiktoken library does; special tokens do not exist. Returns doc_id,
    n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers),
    decoded_sha256, and with keep also ids and the decoded text.
    """
    lay = Layout.of(docs)
    buckets = max(4 * lay.partitions, lay.bytes // (32 << 20))
    src = texts(docs)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, b in _batches(it, pattern, buckets):
            known = np.array([x is not None for x in ids.to_pylist()], np.uint8)
            row = [b.name, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), known.tobytes(), b.cut.tobytes(), planes(b.codes), planes(b.bucket), pack_words(b.words)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], ["name", "ids", "known", "cut", "codes", "buckets", "words"])

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in it:
            for name, bucket, blob in zip(t.column("name"), t.column("buckets"), t.column("words")):
                words = unpack_words(blob.as_py())
                rows = [(k, pack_words([words[x] for x in at.tolist()])) for k, at in by_bucket(unplanes(bucket.as_py(), np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([name.as_py()] * len(rows), pa.binary()), pa.array([w for _, w in rows], pa.binary())], ["bucket", "name", "words"])
                del words
                give_back()

    def encode(key: tuple, t: pa.Table) -> pa.Table:
        enc, ids_of, out = encoding(path, pattern), {}, []
        for blob in t.column("words"):
            size, ids = [], []
            for w in unpack_words(blob.as_py()):
                if (x := ids_of.get(w)) is None:
                    x = ids_of[w] = enc._encode_single_piece(w)  # noqa: SLF001
                size.append(len(x))
                ids += x
            out.append(planes(np.array([len(size), *size, *ids], np.uint32)))
        del ids_of
        give_back()
        return pa.table([t.column("name"), pa.array([key[0].as_py()] * t.num_rows, pa.int32()), pa.array(out, pa.binary())], names=["name", "bucket", "answer"])

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict(zip(right.column("bucket").to_pylist(), right.column("answer").to_pylist()))
        tab, tab_off = token_bytes(path, pattern)
        cols: list[list] = [[], [], [], [], [], []]
        for row in left.to_pylist():
            ids, known, cut = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8), np.frombuffer(row["cut"], np.int64)
            codes, bucket = unplanes(row["codes"], np.uint32), unplanes(row["buckets"], np.uint32)
            size = np.zeros(len(bucket), np.int64)
            parts = []
            for k, at in by_bucket(bucket):
                if k not in got:
                    raise RuntimeError("a batch was cut differently when its task ran again; run the job again")
                a = unplanes(got[k], np.uint32)
                size[at] = a[1 : 1 + a[0]]
                parts.append((at, a[1 + a[0] :]))
            flat = np.concatenate([p for _, p in parts]) if parts else np.zeros(0, np.uint32)
            order = np.concatenate([a for a, _ in parts]) if parts else np.zeros(0, np.int64)
            begin = np.zeros(len(bucket), np.int64)
            begin[order] = np.cumsum(size[order]) - size[order]
            for i, j in slices(cut, PIECE_WORDS):
                part = codes[cut[i] : cut[j]]
                n = size[part]
                off = np.concatenate([[0], np.cumsum(n)])
                tokens = flat[np.arange(off[-1]) + np.repeat(begin[part] - off[:-1], n)]
                edge = off[cut[i : j + 1] - cut[i]]
                text, text_off = gather(tab, tab_off, tokens)
                for d in range(i, j):
                    x, y = edge[d - i], edge[d - i + 1]
                    mine = tokens[x:y]
                    body = text[text_off[x] : text_off[y]].tobytes()
                    for c, v in zip(cols, (int(ids[d]) if known[d] else None, len(mine), hashlib.sha256(mine.astype("<u4").tobytes()).hexdigest(),
                                           hashlib.sha256(body).hexdigest(), mine.astype(np.int32) if keep else None, body.decode("utf-8", "replace") if keep else None)):
                        c.append(v)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        out = joined(left, right)
        give_back()  # here all but the result is free
        return out

    batches = src.mapInArrow(cut, CUT_DDL).repartition(lay.partitions, "name")  # one exchange, read twice: no column is left out before it
    asked = batches.mapInArrow(ask, "bucket int, name binary, words binary").repartition(lay.partitions, "bucket")
    answers = asked.groupBy("bucket").applyInArrow(encode, "name binary, bucket int, answer binary").repartition(lay.partitions, "name")
    return batches.groupBy("name").cogroup(answers.groupBy("name")).applyInArrow(assemble, OUT_DDL)
