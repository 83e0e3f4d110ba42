import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from plumbline.llm import media
from plumbline.llm.media import UNIT, carve, sniff, sniff_bytes, text_media, wav


def png(w=3, h=2):
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1) * h)) + chunk(b"IEND", b"")


def bmp(w=3, h=2):
    data = bytes((w * 8 + 31) // 32 * 4 * h)
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(data), 0, 54, 40, w, h, 1, 8, 0, len(data), 0, 0, 0, 0) + data


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x12\xff\x00\x34\xff\xd0\x56\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nxref\n0 1\nstartxref\n24\n%%EOF"
OGG = b"OggS\x00\x06" + bytes(20) + b"\x01\x03abc"


def zipped():
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("a.txt", "hello")
    return f.getvalue()


FILES = {"image/png": png(), "image/bmp": bmp(), "image/gif": GIF, "image/jpeg": JPEG, "application/pdf": PDF, "audio/ogg": OGG, "audio/wav": wav(b"abcd"), "application/zip": zipped(), "application/gzip": gzip.compress(b"hello" * 99)}


def test_each_format_whole_damaged_and_embedded():
    for kind, b in FILES.items():
        assert sniff_bytes(b)[:2] == (kind, len(b)), kind
        assert sniff_bytes(b[:-3])[0] != kind, kind
        k, n, _, carved = sniff_bytes(b"text BM RIFF " + b + b" tail")
        assert (k, n) == (media.UNKNOWN, 0) and (kind, 13, len(b)) in carved, kind


def test_types_are_corrected_and_files_carved(spark):
    rows = [(1, FILES["image/png"], "image/jpeg"), (2, b"no media", "image/png"), (3, b"no media", "text/plain"), (4, None, "text/plain"), (5, b"", None), (6, b"xx" + GIF + b"yy" + FILES["image/bmp"], "text/plain")]
    df = spark.createDataFrame(rows, "id int, data binary, media_type string")
    got = {r.id: r for r in sniff(df).collect()}
    assert [got[i].corrected for i in range(1, 7)] == ["image/png", media.UNKNOWN, "text/plain", "text/plain", None, "text/plain"]
    cut = {r.carved_type: bytes(r.carved) for r in carve(df).collect()}
    assert cut == {"image/gif": GIF, "image/bmp": FILES["image/bmp"]}


def want(rows):
    out = []
    for i, t in rows:
        b = (t or "").encode()
        p = b + b"\xff" * ((-len(b)) % UNIT if b else UNIT)
        out.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(p) + 44, hashlib.sha256(wav(p)).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in df.collect()), key=str)


def test_payload_comes_back(spark, sf):
    rows = [(1, None), (2, ""), (3, "x" * 576), (4, "é" * 289), (5, "RIFF BM PK\x03\x04 GIF89a"), (6, "long " * 40000), (None, "n"), (3, "x" * 576)]
    df = spark.createDataFrame([(*r, b"q") for r in rows], "doc_id long, text string, data binary")
    assert rows_of(text_media(df)) == want(rows)
    t = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(text_media(t)) == want([(r.doc_id, r.text) for r in t.collect()])
    assert text_media(t.limit(0)).count() == 0


def test_many_magics_take_linear_time():
    import time

    from plumbline.llm.media import sniff_bytes

    for part in (b"%PDF- ", b"%PDF- startxref 9 %%EOF ", b"PK\x03\x04PK\x05\x06" + b"\0" * 18, b"RIFF", b"BM", b"GIF89a", b"OggS\0"):
        body = part * (1_000_000 // len(part)) + b"%%EOF " * 50_000
        t = time.time()
        sniff_bytes(body)
        assert time.time() - t < 20, part


def long_chains():
    """Values of 1 MB where every magic starts a chain that runs to the end; those of GIF and OGG are valid UTF-8 texts."""
    ogg = b"OggS" + b"\0" * 22 + b"\x01" + b"\x04" + b"text"  # a page, not the last
    gif = b"GIF89a" + b"\x01\0\x01\0\0\0\0" + b"!\x01" + b"\x0c"  # header, then an extension whose data runs over the next header
    jpeg = b"\xff\xd8\xff\xe1\0\x06\xff\xd8\xff\xe1"
    scan = b"\xff\xd8\xff\xda\0\x02" + b"\xff\0"
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + b"\0" * 13
    return {k: v * (1_000_000 // len(v)) for k, v in {"ogg": ogg, "gif": gif, "jpeg": jpeg, "scan": scan, "png": png + zlib.crc32(png[12:]).to_bytes(4, "big") + b"\0\0\0\0text" + zlib.crc32(b"text").to_bytes(4, "big")}.items()}


def test_shared_chains_take_linear_time():
    import time

    for name, body in long_chains().items():
        if name in ("ogg", "gif"):
            body.decode()
        t = time.time()
        media.sniff_bytes(body)
        assert time.time() - t < 20, name


def test_shared_chains_end_where_each_alone_would():
    """Every magic of random chains, judged with what others found and by itself."""
    import random

    rng = random.Random(8)
    parts = [GIF, FILES["image/png"], FILES["image/jpeg"], FILES["audio/ogg"], GIF[:-1], FILES["image/png"][:40], FILES["image/jpeg"][:-2], FILES["audio/ogg"][:20], b"GIF89a", b"\xff\xd8\xff", b"OggS\0", b"\0", b"!\x01", b";"]
    checks = {k: c for _, k, c in media.SIGNATURES if c in media.SHARING - {media._zip, media._pdf}}
    for _ in range(300):
        b = b"".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        shared = media.Ends(b)
        for magic, kind, check in media.SIGNATURES:
            if kind not in checks:
                continue
            for at in media._places(b, magic):
                out = []
                for ends in (shared, media.Ends(b)):
                    try:
                        out.append(check(b, at, ends))
                    except (IndexError, struct.error, zlib.error):
                        out.append(None)
                assert out[0] == out[1]
