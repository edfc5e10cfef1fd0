"""JPEG and PNG files: metadata findings and copies without metadata, by their containers' own parts.

A file is a list of parts (JPEG segments, PNG chunks); metadata parts are read for findings or left out
of a copy, and image data is never decoded. A file that can't be walked gives ``error`` and no copy.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# EXIF tags worth a finding (number, name, category, severity).
TAGS = [
    (271, "Make", "camera", "medium"),
    (272, "Model", "camera", "medium"),
    (42033, "BodySerialNumber", "serial-number", "high"),
    (42037, "LensSerialNumber", "serial-number", "high"),
    (305, "Software", "software", "low"),
    (315, "Artist", "author", "high"),
    (33432, "Copyright", "author", "medium"),
    (36867, "DateTimeOriginal", "timestamp", "medium"),
    (306, "DateTime", "timestamp", "low"),
    (270, "ImageDescription", "description", "low"),
    (40093, "XPAuthor", "author", "high"),
    (40092, "XPComment", "description", "medium"),
]
EXIF_IFD, GPS_IFD = 34665, 34853
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

# Containers -------------------------------------------------------------------------------------------


def _jpeg_stretch(data: bytes, at: int) -> tuple[str, int]:
    marker = data[at : at + 2]
    if len(marker) < 2 or marker[0] != 0xFF:
        raise ValueError(f"JPEG broken off at {at}")
    code = marker[1]
    if code == 0xFF:
        return "padding", at + 1
    if code == 0xDA:
        return "pixels", len(data)
    if code == 0x01 or 0xD0 <= code <= 0xD9:
        return "mark", at + 2
    return f"{code:02X}", at + 2 + max(2, int.from_bytes(data[at + 2 : at + 4], "big"))


def _png_stretch(data: bytes, at: int) -> tuple[str, int]:
    return data[at + 4 : at + 8].decode("latin-1"), at + 12 + int.from_bytes(data[at : at + 4], "big")


#: Signature -> how a stretch is measured, the kind that ends the file, a stretch's head and tail bytes.
CONTAINERS = {b"\xff\xd8": (_jpeg_stretch, "pixels", 4, 0), b"\x89PNG\r\n\x1a\n": (_png_stretch, "IEND", 8, 4)}
#: Kinds of metadata, and what their bodies begin with if they are not (a colour profile stays).
METADATA = {k: b"" for k in "E1 E3 E4 E5 E6 E7 E8 E9 EA EB EC ED EF FE tEXt zTXt iTXt eXIf tIME".split()} | {"E2": b"ICC_PROFILE\0"}
#: Kinds that may hold EXIF data, and what stands before it.
EXIF = {"E1": b"Exif\0\0", "eXIf": b""}


def outline(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the file's stretches, its signature first."""
    found = next((x for x in CONTAINERS if data.startswith(x)), None)
    if found is None:
        raise ValueError("not a JPEG or PNG file")
    measure, last, *_ = CONTAINERS[found]
    out = [("signature", 0, len(found))]
    while out[-1][0] != last:
        at = out[-1][2]
        kind, end = measure(data, at)
        if end > len(data) or end <= at:
            raise ValueError(f"{kind} at {at} is cut off")
        out.append((kind, at, end))
    return out


def _body(data: bytes, start: int, end: int) -> bytes:
    head, tail = next(x[2:] for k, x in CONTAINERS.items() if data.startswith(k))
    return data[start + head : end - tail]


def is_metadata(kind: str, body: bytes) -> bool:
    stays = METADATA.get(kind)
    return stays is not None and not (stays and body.startswith(stays))


def strip(data: bytes) -> tuple[bytes, int]:
    """The file without metadata, and how many stretches of it there were."""
    gone = [(a, b) for kind, a, b in outline(data) if is_metadata(kind, _body(data, a, b))]
    out, at = [], 0
    for a, b in [*gone, (outline(data)[-1][2], 0)]:
        out.append(data[at:a])
        at = b
    return b"".join(out), len(gone)


def exif_bodies(data: bytes) -> Iterator[bytes]:
    for kind, a, b in outline(data):
        body = _body(data, a, b)
        if kind in EXIF and body.startswith(EXIF[kind]):
            yield body[len(EXIF[kind]) :]


# EXIF -------------------------------------------------------------------------------------------------


def _directory(tiff: bytes, at: int, order: str) -> tuple[dict[int, object], int]:
    """Values of one directory by tag, and where the next one is (0: none)."""
    out: dict[int, object] = {}
    (n,) = struct.unpack_from(order + "H", tiff, at)
    for k in range(n):
        tag, kind, count, _ = struct.unpack_from(order + "HHI4s", tiff, at + 2 + 12 * k)
        size = _SIZES.get(kind, 0) * count
        if not 0 < size <= len(tiff):
            continue
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", tiff, at + 10 + 12 * k)[0]
        raw = tiff[where : where + size]
        if len(raw) < size:
            continue
        if kind in (5, 10):
            pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
            out[tag] = [a / b if b else float("nan") for a, b in zip(pairs[::2], pairs[1::2])]
        elif kind in (3, 4):
            out[tag] = struct.unpack(order + ("H" if kind == 3 else "I") * count, raw)[0]
        elif tag in (40092, 40093):
            out[tag] = raw.decode("utf-16-le", "replace").rstrip("\0").strip()
        else:
            out[tag] = raw.decode("latin-1").split("\0")[0].strip()
    after = at + 2 + 12 * n
    return out, struct.unpack_from(order + "I", tiff, after)[0] if after + 4 <= len(tiff) else 0


def position(gps: dict[int, object]) -> str | None:
    """Latitude and longitude in signed degrees, if both are whole."""
    signed = []
    for value, ref in ((gps.get(2), gps.get(1)), (gps.get(4), gps.get(3))):
        if not isinstance(value, list) or len(value) != 3:
            return None
        degrees = sum(v / 60**k for k, v in enumerate(value))
        signed.append(-degrees if str(ref).upper() in ("S", "W") else degrees)
    return ", ".join(f"{x:.5f}" for x in signed)


def exif_findings(tiff: bytes) -> Iterator[tuple[str, str, str, str]]:
    """(category, severity, summary, location)."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 8:
        return
    try:
        tags, thumbnail = _directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
        if isinstance(tags.get(EXIF_IFD), int):
            tags |= _directory(tiff, tags[EXIF_IFD], order)[0]
        if isinstance(tags.get(GPS_IFD), int):
            gps = _directory(tiff, tags[GPS_IFD], order)[0]
            if gps:
                yield "gps", "high", position(gps) or "a place, not complete", "EXIF/GPSInfo"
        for number, name, category, severity in TAGS:
            if tags.get(number):
                yield category, severity, f"{name}: {str(tags[number])[:60]}", f"EXIF/{name}"
        if thumbnail:
            yield "exif-thumbnail", "high", "Embedded EXIF thumbnail", "EXIF/IFD1"
    except struct.error:
        return


_FOUND = pa.schema([("doc_id", pa.string()), ("category", pa.string()), ("severity", pa.string()), ("summary", pa.string()), ("location", pa.string()), ("count", pa.int64()), ("removable", pa.bool_()), ("error", pa.string())])
_COPY = pa.schema([("path", pa.string()), ("content", pa.binary()), ("removed", pa.int64()), ("error", pa.string())])


def findings(files: DataFrame) -> DataFrame:
    """files: path, content -> findings of their EXIF data."""

    def run(batches):
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    for tiff in list(exif_bodies(data)):
                        for category, severity, summary, location in exif_findings(tiff):
                            rows.append({"doc_id": path, "category": category, "severity": severity, "summary": summary, "location": location, "count": 1, "removable": True})
                except ValueError as e:
                    rows.append({"doc_id": path, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)

    return files.select("path", "content").mapInArrow(run, "doc_id string, category string, severity string, summary string, location string, count bigint, removable boolean, error string")


def stripped(files: DataFrame) -> DataFrame:
    """files: path, content -> path, content without metadata, removed, error (and then no content)."""

    def run(batches):
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    copy, n = strip(data)
                    rows.append({"path": path, "content": copy, "removed": n, "error": None})
                except ValueError as e:
                    rows.append({"path": path, "content": None, "removed": 0, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=_COPY)

    return files.select("path", "content").mapInArrow(run, "path string, content binary, removed bigint, error string")


def is_image(path: str) -> bool:
    return bool(re.search(r"(?i)\.(jpe?g|png)$", path))
