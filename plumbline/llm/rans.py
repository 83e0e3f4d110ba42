"""Token ids as files of rANS blocks.

Static range asymmetric numeral system. One frequency table, counted over all
ids, is shared by all blocks. A block holds whole documents in order and
decodes by itself: its ids are dealt row-wise to interleaved lanes with 64-bit
states and 32-bit renormalisation, so one step codes a row of all lanes in a
few vector operations. A checkpoint every CHECK_ROWS rows holds the lane states
and the place in the stream, so a block can be decoded in pieces by parallel
readers; CRC-32 checksums cover the ids of each piece and the block's bytes.

Block layout, little-endian: magic "RNB1", crc32 of all that follows, then
n_docs, n_ids, lanes, n_checkpoints, n_words as 64-bit integers; document ids
(64-bit), known flags (bytes), lengths (64-bit); per checkpoint the first row,
the first word, the crc32 of its ids (64-bit) and the lane states; the words.

Files are written by Spark's committing Parquet writer, a block a row, so lost
tasks leave no halves and any store works.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Layout, new_path, prefix, slices, spans_hash, stored, text_arrays, texts

SCALE = 20
LOW = 1 << 31
LANES, BLOCK_IDS, CHECK_ROWS = 1024, 1 << 18, 128
MAGIC = b"RNB1"


# --- coding

def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^SCALE; every id that occurs keeps at least 1."""
    total = counts.sum()
    if total == 0:
        return counts.astype(np.int64)
    f = np.where(counts > 0, np.maximum(1, (counts.astype(float) / total * (1 << SCALE)).astype(np.int64)), 0)
    over = int(f.sum()) - (1 << SCALE)
    order = np.argsort(-f, kind="stable")
    for i in order:  # the commonest ids give or take the rounding
        if not over:
            break
        step = -over if over < 0 else min(over, int(f[i]) - 1)
        f[i] += step if over < 0 else -step
        over += step if over < 0 else -step
    if over:
        raise ValueError("more distinct ids than the table has slots")
    return f


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode(ids: np.ndarray, t: Table, lanes: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Words of the stream and the checkpoints (row, word, states before that row)."""
    rows = -(-len(ids) // lanes)
    x = np.full(lanes, LOW, np.uint64)
    chunks, marks = [], []
    emitted = 0
    for r in range(rows - 1, -1, -1):
        s = ids[r * lanes : (r + 1) * lanes]
        y = x[: len(s)]
        f = t.freq[s]
        big = y >= f << np.uint64(63 - SCALE)
        if big.any():
            chunks.append((y[big] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            emitted += len(chunks[-1])
            y = np.where(big, y >> np.uint64(32), y)
        q = y // f
        x[: len(s)] = (q << np.uint64(SCALE)) + (y - q * f) + t.cum[s]
        if r % CHECK_ROWS == 0:
            marks.append((r, emitted, x.copy()))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    return words, [(r, len(words) - e, s) for r, e, s in marks[::-1]]


def decode_piece(words: np.ndarray, first: int, states: np.ndarray, n: int, t: Table) -> np.ndarray:
    """The n ids that follow a checkpoint."""
    lanes = len(states)
    x, at = states.astype(np.uint64), first
    out = np.empty(n, np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for i in range(0, n, lanes):
        k = min(lanes, n - i)
        y = x[:k]
        slot = y & mask
        s = t.symbol[slot]
        out[i : i + k] = s
        y = t.freq[s] * (y >> np.uint64(SCALE)) + slot - t.cum[s]
        low = y < np.uint64(LOW)
        m = int(low.sum())
        if m:
            y[low] = (y[low] << np.uint64(32)) | words[at : at + m]
            at += m
        x[:k] = y
    return out


def block_bytes(doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray, t: Table) -> bytes:
    lanes = max(1, min(LANES, len(ids) // CHECK_ROWS))
    words, marks = encode(ids, t, lanes)
    body = [struct.pack("<5q", len(doc_ids), len(ids), lanes, len(marks), len(words)), doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), sizes.astype("<i8").tobytes()]
    ends = [m[0] * lanes for m in marks[1:]] + [len(ids)]
    for (row, word, states), end in zip(marks, ends):
        crc = zlib.crc32(ids[row * lanes : end].astype("<u4").tobytes())
        body.append(struct.pack("<3q", row, word, crc) + states.astype("<u8").tobytes())
    body.append(words.astype("<u4").tobytes())
    raw = b"".join(body)
    return MAGIC + struct.pack("<I", zlib.crc32(raw)) + raw


class Block:
    """A parsed block; `piece(k)` decodes from checkpoint k to the next."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC or zlib.crc32(raw[8:]) != struct.unpack("<I", raw[4:8])[0]:
            raise ValueError("damaged block")
        docs, self.n, self.lanes, marks, n_words = struct.unpack_from("<5q", raw, 8)
        at = 48
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.known = np.frombuffer(raw, np.uint8, docs, at := at + 8 * docs)
        self.sizes = np.frombuffer(raw, "<i8", docs, at := at + docs)
        at += 8 * docs
        self.marks = []
        for _ in range(marks):
            row, word, crc = struct.unpack_from("<3q", raw, at)
            self.marks.append((row, word, crc, np.frombuffer(raw, "<u8", self.lanes, at + 24)))
            at += 24 + 8 * self.lanes
        self.words = np.frombuffer(raw, "<u4", n_words, at)

    def piece(self, k: int, t: Table) -> np.ndarray:
        row, word, crc, states = self.marks[k]
        end = self.marks[k + 1][0] * self.lanes if k + 1 < len(self.marks) else self.n
        ids = decode_piece(self.words, word, states, end - row * self.lanes, t)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("damaged ids")
        return ids

    def ids(self, t: Table) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *[self.piece(k, t) for k in range(len(self.marks))]])


# --- tokenizing

#: Pieces that a worker remembers, in two generations of this size; it changes speed and memory only.
REMEMBER = 350_000


def _classes() -> np.ndarray:
    t = np.full(256, 3, np.uint8)
    t[[9, 10, 11, 12, 13, 32]] = 0
    t[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
    t[list(b".,!*#$%&")] = 2
    return t


#: White space, letters and digits, punctuation that the tokenizer never joins with those, the rest.
KIND = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Memory:
    """A map that forgets what was not used for a generation."""

    def __init__(self):
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def get(self, keys: list[bytes]) -> list[bytes | None]:
        out = list(map(self.new.get, keys))
        for i in [i for i, v in enumerate(out) if v is None]:
            if (v := self.old.get(keys[i])) is not None:
                out[i] = self.new[keys[i]] = v
        return out

    def turn(self) -> None:
        if len(self.new) > REMEMBER:
            self.new, self.old = {}, self.new


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), Memory()


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of the pieces, and the n + 1 piece offsets of the documents.

    The tokenizer drops white space, and no step of it reaches across white
    space or between a letter or digit and punctuation of KIND 2.
    """
    n = len(data)
    kind = KIND[data]
    edge = np.ones(n + 1, bool)
    if n:
        edge[1:n] = (kind[1:] == 0) | (kind[:-1] == 0) | (kind[1:] + kind[:-1] == 3) & (kind[1:] != 0) & (kind[:-1] != 0) & (kind[1:] != 3) & (kind[:-1] != 3)
        edge[offsets] = True
    at = np.flatnonzero(edge)
    solid = kind[at[:-1]] != 0
    start, end = at[:-1][solid], at[1:][solid]
    return start, end, np.searchsorted(start, offsets)


def _hashes(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each piece, a part of the documents at a time to keep the prefix sums small."""
    out = np.empty(len(start), np.uint64)
    for i, j in slices(offsets, 1 << 20):
        at, k = offsets[i], slice(first[i], first[j])
        out[k] = spans_hash(prefix(data[at : offsets[j]]), start[k] - at, stop[k] - at)
    return out


def encode_texts(data: np.ndarray, offsets: np.ndarray, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (UTF-8 end to end), each with the end id, and the n + 1 offsets.

    Distinct pieces are found by hash; each is looked up or encoded by the
    library once. Lower case first, as the tokenizer does, makes fewer pieces;
    special tokens are found before that, so bytes that could be one stay.
    """
    tok, memory = tokenizer(path)
    raw = data.tobytes()
    if b"<|" not in raw:
        data = LOWER[data]
        raw = data.tobytes()
    start, stop, first = pieces_of(data, offsets)
    _, index, which = np.unique(_hashes(data, offsets, start, stop, first), return_index=True, return_inverse=True)
    keys = [raw[i:j] for i, j in zip(start[index].tolist(), stop[index].tolist())]
    ids = memory.get(keys)
    todo = []
    for k in [k for k, v in enumerate(ids) if v is None]:
        w = keys[k]
        if w.isalpha() and w.islower():  # ASCII letters: one token sequence of the library's model, nothing to normalise
            ids[k] = memory.new[w] = array("I", [t.id for t in tok.model.tokenize(w.decode())]).tobytes()
        else:
            todo.append(k)
    for i in range(0, len(todo), 4096):
        part = todo[i : i + 4096]
        for k, e in zip(part, tok.encode_batch_fast([keys[k].decode("utf-8", "replace") for k in part], add_special_tokens=False)):
            ids[k] = memory.new[keys[k]] = array("I", e.ids).tobytes()
    memory.turn()
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), "<u4")
    begin = np.cumsum(size) - size
    n = size[which]
    off = np.concatenate([[0], np.cumsum(n)])
    docs = len(offsets) - 1
    cut = off[first] + np.arange(docs + 1)  # each document's end id takes a place
    out = np.full(off[-1] + docs, end, "<u4")
    doc = np.repeat(np.arange(docs), np.diff(off[first]))
    out[np.arange(off[-1]) + doc] = flat[np.arange(off[-1]) + np.repeat(begin[which] - off[:-1], n)]
    return out, cut


def tokens(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, n, ids): little-endian ids of every text with its end id, 16 bits each where that is enough."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, off = text_arrays(b.column(1))
            for i, j in slices(off, 4 << 20):
                flat, cut = encode_texts(data[off[i] : off[j]], off[i : j + 1] - off[i], path, end)
                short = flat.astype("<u2") if len(flat) and flat.max() < 1 << 16 else flat
                raw, size = short.tobytes(), short.itemsize
                blobs = [raw[size * x : size * y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(cut)), pa.array(blobs, pa.binary())], ["doc_id", "n", "ids"])

    return texts(docs).mapInArrow(run, "doc_id bigint, n bigint, ids binary")


def unpack(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4")


def frequencies(tok: DataFrame) -> np.ndarray:
    """Counts of every id over all rows. One row an id reaches the driver: the vocabulary bounds it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in it:
            blobs, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, len(blobs), 512):
                c = np.bincount(np.concatenate([unpack(x, n) for x, n in zip(blobs[i : i + 512], sizes[i : i + 512])]))
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
                total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    rows = tok.select("ids", "n").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_blocks(tok: DataFrame, out: str, partitions: int) -> None:
    """Files under `out`: `table` (the frequencies) and `blocks` (shard, block, first, n_ids, data), in ascending doc_id order.

    Shards are ranges of doc_id, in order. Equal doc_ids lie next to each
    other, ordered by their ids; null comes first.
    """
    spark = tok.sparkSession
    freq = quantise(frequencies(tok))
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq) if f], "id int, freq int").coalesce(1).write.parquet(f"{out}/table")
    shared = spark.sparkContext.broadcast(freq)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, first, number = Table(shared.value), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        size, shard = 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            doc = np.array([d or 0 for d, _ in held], np.int64)
            data = block_bytes(doc, np.array([d is not None for d, _ in held]), np.array([len(x) for _, x in held]), ids, t)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["shard", "block", "first", "n_ids", "data"])

        for b in it:
            for shard, d, blob, n in zip(*(b.column(k).to_pylist() for k in range(4))):
                ids = unpack(blob, n)
                if held and size + len(ids) > BLOCK_IDS:
                    yield flush()
                    first, number, held, size = first + size, number + 1, [], 0
                held.append((d, ids))
                size += len(ids)
        if held:
            yield flush()

    ordered = tok.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "ids", "n").mapInArrow(run, "shard int, block int, first bigint, n_ids bigint, data binary").write.parquet(f"{out}/blocks")


def read_blocks(spark, out: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, with keep_ids, ids, all from the files."""
    freq = spark.read.parquet(f"{out}/table").collect()  # a row an id that occurs
    full = np.zeros(max((r.id for r in freq), default=-1) + 1, np.int64)
    for r in freq:
        full[r.id] = r.freq
    shared = spark.sparkContext.broadcast(full)
    blocks = spark.read.parquet(f"{out}/blocks")
    sizes = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # a row a file
    before, at = [], 0
    for s in sorted(sizes):
        before.append((s, at))
        at += sizes[s]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(shared.value)
        for b in it:
            for shard, first, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                blk = Block(data)
                ids = blk.ids(t)
                cut = np.concatenate([[0], np.cumsum(blk.sizes)])
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(crc), pa.int32()), pa.array(blk.doc_ids, pa.int64(), mask=blk.known == 0), pa.array(first + cut[:-1]), pa.array(blk.sizes, pa.int64()), pa.array(crc, pa.int64()),
                    pa.array([ids[i:j].astype(np.int32) if keep_ids else None for i, j in zip(cut[:-1], cut[1:])], pa.list_(pa.int32()))],
                    ["shard", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])

    docs = blocks.select("shard", "first", "data").mapInArrow(run, "shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>")
    offsets = spark.createDataFrame(before, "shard int, before bigint")
    return docs.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def token_files(docs: DataFrame, path: str, end: int = 2, out: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Tokenize, write rANS files under `out` (default: a new folder of the shared storage) and read them back.

    Takes doc_id and text (null: empty, so only the end id), ignores other
    columns; rows that repeat keep a row each. An empty table gives files
    without blocks and no rows.
    """
    spark = docs.sparkSession
    lay = Layout.of(docs)
    out = out or new_path(spark, "tokens")
    write_blocks(stored(tokens(docs, path, end), "ids", "zstd"), out, lay.partitions)
    return read_blocks(spark, out, keep_ids)
