"""Metadata of images built by hand."""

from __future__ import annotations

import struct
import zlib

from scriptorium.sources import images


def tiff():
    """A camera, an author and a place (52.5 N, 13.25 W)."""

    def entry(tag, kind, count, value):
        return struct.pack("<HHI", tag, kind, count) + value

    heap = 8 + 2 + 3 * 12 + 4
    gps = heap + 12
    rational = gps + 2 + 4 * 12 + 4
    main = struct.pack("<H", 3) + entry(271, 2, 12, struct.pack("<I", heap)) + entry(315, 2, 4, b"Ann\0") + entry(34853, 4, 1, struct.pack("<I", gps)) + struct.pack("<I", 0)
    place = struct.pack("<H", 4) + entry(1, 2, 2, b"N\0\0\0") + entry(2, 5, 3, struct.pack("<I", rational)) + entry(3, 2, 2, b"W\0\0\0") + entry(4, 5, 3, struct.pack("<I", rational + 24)) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8) + main + b"Acme Camera\0" + place + struct.pack("<6I", 52, 1, 30, 1, 0, 1) + struct.pack("<6I", 13, 1, 15, 1, 0, 1)


def segment(kind, body):
    return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def test_images(spark):
    keep, scan = segment(0xE0, b"JFIF\0") + segment(0xE2, b"ICC_PROFILE\0x"), segment(0xDA, b"hd") + b"data\xff\xd9"
    jpeg = b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + tiff()) + keep + segment(0xFE, b"note") + segment(0xE2, b"MPF\0") + scan
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x") + chunk(b"tEXt", b"a\0b") + chunk(b"eXIf", tiff()) + chunk(b"IDAT", b"d") + chunk(b"IEND", b"")
    files = spark.createDataFrame([("a.jpg", jpeg), ("b.png", png), ("c.jpg", jpeg[: len(jpeg) // 2]), ("d.png", b"none")], "path string, content binary")
    got = {r["path"]: r for r in images.stripped(files).collect()}
    assert bytes(got["a.jpg"]["content"]) == b"\xff\xd8" + keep + scan and got["a.jpg"]["removed"] == 3
    assert bytes(got["b.png"]["content"]) == b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x") + chunk(b"IDAT", b"d") + chunk(b"IEND", b"")
    assert got["c.jpg"]["error"] and got["d.png"]["error"] and got["d.png"]["content"] is None
    found = images.findings(files)
    want = {("camera", "medium", "Make: Acme Camera"), ("author", "high", "Artist: Ann"), ("gps", "high", "52.50000, -13.25000")}
    for name in ("a.jpg", "b.png"):
        assert {(r["category"], r["severity"], r["summary"]) for r in found.where(f"doc_id = '{name}'").collect()} == want
    assert found.where("error is not null").count() == 2
