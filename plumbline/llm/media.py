"""Media columns: what binary values really hold, by signature sniffing.

An Aho-Corasick automaton finds every magic byte sequence in one pass over a
value; a validator of that format then walks its structure from there and
gives its exact length, or refuses. A valid file at offset 0 corrects the
declared type; valid files elsewhere are carved. Values are handled one by one
in Arrow batches; nothing is shuffled.

`wav_column` stores payloads losslessly as 8-bit PCM samples, `payload` reads
them back through the same validator.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import new_path, slices, text_arrays, texts

UNIT = 576
UNKNOWN = "application/octet-stream"
FOUND_DDL = "detected string, length bigint, candidates int, embedded array<struct<type:string,offset:bigint,length:bigint,sha256:string>>"


# --- validators: (bytes, offset) -> length of a well-formed file there, or None

def _u32(b: bytes, at: int, big: bool = False) -> int:
    if at + 4 > len(b):
        raise IndexError
    return int.from_bytes(b[at : at + 4], "big" if big else "little")


def riff_chunks(b: bytes, at: int) -> Iterator[tuple[bytes, int, int]]:
    """(tag, start, size) of the chunks of a RIFF file, after checking that they fill it exactly."""
    end = at + 8 + _u32(b, at + 4)
    if end > len(b):
        raise IndexError
    p = at + 12
    while p < end:
        size = _u32(b, p + 4)
        if p + 8 + size > end:
            raise IndexError
        yield b[p : p + 4], p + 8, size
        p += 8 + size + (size & 1)
    if p not in (end, end + 1):
        raise IndexError


def _wav(b: bytes, at: int) -> int | None:
    if b[at + 8 : at + 12] != b"WAVE":
        return None
    seen = {}
    for tag, start, size in riff_chunks(b, at):
        seen[tag] = (start, size)
    if b"fmt " not in seen or b"data" not in seen or seen[b"fmt "][1] < 16:
        return None
    _, channels, rate, per_s, align, bits = struct.unpack_from("<HHIIHH", b, seen[b"fmt "][0])
    ok = channels and rate and bits in (8, 16, 24, 32, 64) and align == channels * bits // 8 and per_s == rate * align and seen[b"data"][1] % align == 0
    return 8 + _u32(b, at + 4) if ok else None


def _along(known: dict[int, int], p: int, step: Callable[[int], tuple[int, bool]]) -> int:
    """Where the chain from place p ends (-1: nowhere): step gives the next place of the chain, or its end and True.

    Every place has one outcome, whichever magic its chain began at; it is
    remembered for all places on the way, so no link is followed twice.
    """
    way, end = [], -1
    while True:
        if p in known:
            end = known[p]
            break
        way.append(p)
        try:
            p, done = step(p)
        except (IndexError, struct.error):
            break
        if p < 0 or done:
            end = p
            break
    for q in way:
        known[q] = end
    return end


def _length(end: int, at: int) -> int | None:
    return end - at if end >= 0 else None


def _png(b: bytes, at: int, ends: Ends) -> int | None:
    def chunk(p: int) -> tuple[int, bool]:
        n, tag = _u32(b, p, True), b[p + 4 : p + 8]
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != _u32(b, p + 8 + n, True):
            return -1, True
        return p + 12 + n, tag == b"IEND"

    def later(p: int) -> tuple[int, bool]:
        return (-1, True) if b[p + 4 : p + 8] == b"IHDR" else chunk(p)

    if _u32(b, at + 8, True) != 13 or b[at + 12 : at + 16] != b"IHDR" or chunk(at + 8)[0] < 0:
        return None
    return _length(_along(ends.known("png"), at + 33, later), at)


def _gif(b: bytes, at: int, ends: Ends) -> int | None:
    width, height, flags = struct.unpack_from("<HHB", b, at + 6)
    if not width or not height:
        return None
    inner = ends.known("gif data")

    def blocks(p: int) -> int:
        return _along(inner, p, lambda p: (p + 1 + b[p], not b[p]))

    def block(p: int) -> tuple[int, bool]:
        kind = b[p]
        if kind == 0x3B:
            return p + 1, True
        if kind == 0x21:
            return blocks(p + 2), False
        if kind == 0x2C:
            local = b[p + 9]
            return blocks(p + 10 + (3 << (local & 7) + 1 if local & 0x80 else 0) + 1), False
        return -1, True

    return _length(_along(ends.known("gif"), at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), block), at)


def _bmp(b: bytes, at: int) -> int | None:
    size, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    if zero or head not in (40, 52, 56, 64, 108, 124) or not 14 + head <= start <= size <= len(b) - at:
        return None
    width, height, planes, bits, packed = struct.unpack_from("<iiHHI", b, at + 18)
    if width <= 0 or not height or planes != 1 or bits not in (1, 4, 8, 16, 24, 32):
        return None
    return size if packed or start + (width * bits + 31) // 32 * 4 * abs(height) <= size else None


def _jpeg(b: bytes, at: int, ends: Ends) -> int | None:
    def coded(p: int) -> tuple[int, bool]:
        """From a 0xFF of entropy-coded data to the next one, up to a marker that is neither stuffing nor a restart."""
        if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
            return p, True
        return b.find(b"\xff", p + 2), False

    def segment(p: int) -> tuple[int, bool]:
        kind, size = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
        if b[p] != 0xFF or kind < 0xC0 or size < 2:
            return -1, True
        p += 2 + size
        if kind != 0xDA:
            return p, False
        p = b.find(b"\xff", p)
        p = _along(ends.known("jpeg data"), p, coded) if p >= 0 else p
        return (p + 2, True) if p >= 0 and b[p + 1] == 0xD9 else (p, False)

    return _length(_along(ends.known("jpeg"), at + 2, segment), at)


def _gzip(b: bytes, at: int) -> int | None:
    d, rest = zlib.decompressobj(31), memoryview(b)[at:]
    for i in range(0, len(rest), 1 << 16):
        tail = rest[i : i + (1 << 16)]
        while tail:
            d.decompress(tail, 1 << 20)
            tail = d.unconsumed_tail
        if d.eof:
            return min(len(rest), i + (1 << 16)) - len(d.unused_data)
    return None


def _places(b: bytes, mark: bytes) -> list[int]:
    out, at = [], b.find(mark)
    while at >= 0:
        out.append(at)
        at = b.find(mark, at + 1)
    return out


class Ends:
    """What the magics of a value share: end marks, collected once, and where chains of blocks lead."""

    def __init__(self, b: bytes):
        self.b = b
        self.chains: dict[str, dict[int, int]] = {}

    def known(self, what: str) -> dict[int, int]:
        """Outcomes of the chain places of a format."""
        return self.chains.setdefault(what, {})

    @functools.cached_property
    def zips(self) -> dict[int, int]:
        """Start of a zip file -> its end, by its first end record, which says how far back the file begins."""
        b, out = self.b, {}
        for end in _places(b, b"PK\x05\x06"):
            if end + 22 <= len(b):
                size, start, note = struct.unpack_from("<IIH", b, end + 12)
                if end - size >= 0 and b[end - size : end - size + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
                    out.setdefault(end - size - start, end + 22 + note)
        return out

    @functools.cached_property
    def pdfs(self) -> tuple[list[int], list[int]]:
        """Places of %PDF- and of %%EOF."""
        return _places(self.b, b"%PDF-"), _places(self.b, b"%%EOF")


def _zip(b: bytes, at: int, ends: Ends) -> int | None:
    end = ends.zips.get(at)
    return end - at if end else None


def _pdf(b: bytes, at: int, ends: Ends) -> int | None:
    """The first end whose cross-references are where it says, before the next header."""
    heads, marks = ends.pdfs
    k = bisect.bisect_right(heads, at)
    for end in marks[bisect.bisect_left(marks, at) : bisect.bisect_left(marks, heads[k] if k < len(heads) else len(b))]:
        s = b.rfind(b"startxref", max(at, end - 64), end)
        digits = b[s + 9 : end].strip() if s >= 0 else b""
        ref = at + int(digits) if digits.isdigit() else -1
        if at < ref < end and (b[ref : ref + 4] == b"xref" or b" obj" in b[ref : ref + 24]):
            return end + 5 - at
    return None


def _ogg(b: bytes, at: int, ends: Ends) -> int | None:
    def page(p: int) -> tuple[int, bool]:
        if b[p : p + 4] != b"OggS" or b[p + 4]:
            return -1, True
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        return (-1, True) if end > len(b) else (end, bool(b[p + 5] & 4))

    return _length(_along(ends.known("ogg"), at, page), at)


#: Magic bytes, media type, validator.
SIGNATURES: tuple[tuple[bytes, str, Callable[..., int | None]], ...] = (
    (b"RIFF", "audio/wav", _wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"BM", "image/bmp", _bmp),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
    (b"OggS", "audio/ogg", _ogg),
)


#: Validators that use what other magics of the value have found.
SHARING = {_zip, _pdf, _png, _gif, _jpeg, _ogg}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind, check in SIGNATURES:
        a.add_word(magic.decode("latin-1"), (len(magic), kind, check))
    a.make_automaton()
    return a


def sniff_bytes(b: bytes) -> tuple[str, int, int, list[tuple[str, int, int]]]:
    """Type and length of the file at offset 0 (UNKNOWN, 0: none), magic hits, and valid files elsewhere (outermost, in order)."""
    detected, length, hits, carved, free, ends = UNKNOWN, 0, 0, [], 1, Ends(b)
    for end, (size, kind, check) in automaton().iter(b.decode("latin-1")):
        at = end + 1 - size
        hits += 1
        if at and at < free:
            continue
        try:
            n = check(b, at, ends) if check in SHARING else check(b, at)
        except (IndexError, struct.error, zlib.error):
            n = None
        if n:
            if at:
                carved.append((kind, at, n))
                free = at + n
            else:
                detected, length = kind, n
    return detected, length, hits, carved


def sniff(df: DataFrame, data: str = "data", declared: str = "media_type") -> DataFrame:
    """df with `found` (detected, length, candidates, embedded) and `corrected`, its declared type if the bytes agree.

    corrected is the detected type where a valid file starts the value, else
    UNKNOWN where the declared type is one that could have been confirmed,
    else the declared type. A null or empty value holds nothing. `found` and
    `corrected` replace columns of these names.
    """
    known = {k for _, k, _ in SIGNATURES}

    @F.pandas_udf(FOUND_DDL)
    def look(col):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = []
        for b in col:
            kind, n, hits, carved = sniff_bytes(bytes(b) if b is not None else b"")
            rows.append((kind, n, hits, [{"type": k, "offset": o, "length": m, "sha256": hashlib.sha256(b[o : o + m]).hexdigest()} for k, o, m in carved]))
        return pd.DataFrame(rows, columns=["detected", "length", "candidates", "embedded"])

    out = df.withColumn("found", look(F.col(data)))
    kind = F.col("found.detected")
    return out.withColumn("corrected", F.when(kind != UNKNOWN, kind).when(F.col(declared).isin(*known), UNKNOWN).otherwise(F.col(declared)))


def carve(df: DataFrame, data: str = "data", declared: str = "media_type") -> DataFrame:
    """One row per embedded file: df's other columns, type, offset and bytes."""
    rest = [c for c in df.columns if c not in (data, declared, "carved_type", "carved_offset", "carved")]
    e = sniff(df, data, declared).select(*rest, data, F.explode("found.embedded").alias("_e"))
    return e.select(*rest, F.col("_e.type").alias("carved_type"), F.col("_e.offset").alias("carved_offset"),
                    F.expr(f"substring(`{data}`, CAST(_e.offset + 1 AS INT), CAST(_e.length AS INT))").alias("carved"))


# --- payloads as 8-bit samples

def wav(payload: bytes, rate: int = 8000) -> bytes:
    pad = len(payload) & 1
    return (b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
            + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * pad)


def payload(b: bytes) -> bytes:
    """Samples of a WAV file that `_wav` accepts."""
    return next(b[s : s + n] for tag, s, n in riff_chunks(b, 0) if tag == b"data")


def wav_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, data (WAV of the text's bytes, padded with 255 to a positive multiple of 576), media_type as declared (unknown)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raw, off = text_arrays(b.column(1))
            for i, j in slices(off, 2 << 20):
                data = []
                for s, e in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist()):
                    body = raw[s:e].tobytes()
                    data.append(wav(body + b"\xff" * (UNIT - len(body) if not body else -len(body) % UNIT)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(off[i : j + 1])), pa.array(data, pa.binary()), pa.array([UNKNOWN] * (j - i))], ["doc_id", "n_bytes", "data", "media_type"])

    return texts(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, data binary, media_type string")


def text_media(docs: DataFrame) -> DataFrame:
    """Store every text as media, read it back and describe it; a row per row of docs (doc_id, text; null text: empty).

    feature: the sniffed type, declared type, length, hits of magic bytes,
    embedded files, and mean, deviation and distinct values of the samples.
    """
    spark = docs.sparkSession
    path = new_path(spark, "media")
    wav_column(docs).write.option("compression", "zstd").parquet(path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for doc, n, data, declared in zip(*(b.column(k) for k in range(4))):
                blob = data.as_py()
                kind, length, hits, carved = sniff_bytes(blob)
                if kind != "audio/wav" or length != len(blob):
                    raise ValueError("stored media is damaged")
                p = payload(blob)
                counts = np.bincount(np.frombuffer(p, np.uint8), minlength=256)
                mean = counts @ np.arange(256) / len(p)
                dev = float(np.sqrt(max(0.0, counts @ np.arange(256) ** 2 / len(p) - mean * mean)))
                feature = f"{kind};declared={declared.as_py()};hits={hits};embedded={len(carved)};mean={mean:.4f};dev={dev:.4f};values={int((counts > 0).sum())}"
                rows.append((doc.as_py(), n.as_py(), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], NAMES)

    return spark.read.parquet(path).select("doc_id", "n_bytes", "data", "media_type").mapInArrow(run, OUT_DDL)


OUT_DDL = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
NAMES = [x.split()[0] for x in OUT_DDL.split(", ")]
