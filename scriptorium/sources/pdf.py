"""PDF files to facts, findings and boxes: properties, annotations, crops, history, and text that lies
under dark rectangles.

A small reader of objects: whatever stands between ``obj`` and ``endobj`` in the file, the last definition
of a number counts, object streams are unpacked; Flate is the only filter it knows. A file it can't read
is one ``unreadable`` row.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import privacy

# Properties (category, severity), review annotations, shapes of a run of text.
INFO = [
    ("Author", "author", "high"),
    ("Creator", "software", "medium"),
    ("Producer", "software", "low"),
    ("Title", "title", "low"),
    ("Subject", "subject", "low"),
    ("Keywords", "keywords", "low"),
    ("CreationDate", "timestamp", "low"),
    ("ModDate", "timestamp", "low"),
]
MARKUP = frozenset("Text FreeText Highlight Underline Squiggly StrikeOut Caret Ink Popup FileAttachment Sound Movie Stamp".split())
RULES = [("xmp", "medium", True), ("attachment", "high", True), ("javascript", "medium", True), ("annotations", "medium", True), ("incremental-history", "high", True), ("cropbox", "high", False), ("possible-redaction", "high", False), ("unreadable", "low", False)]
ADVANCE, CAP_HEIGHT, DESCENDER = 0.5, 0.75, 0.25
LIMIT = 256 << 20
_DELIMITER = b"()<>[]{}/%"
_SPACE = b"\0\t\n\x0c\r "


class Name(str):
    """A name, without its slash."""


class Ref(int):
    """The number of an object elsewhere."""


class Operator(bytes):
    """A word of a content stream."""


class Stream:
    def __init__(self, head: dict, raw: bytes):
        self.head, self.raw = head, raw


class Reader:
    """Values from bytes, one after the other."""

    _token = re.compile(rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]+")
    _skip = re.compile(rb"(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)*")

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def space(self) -> None:
        self.at = self._skip.match(self.data, self.at).end()

    def value(self):
        """The next value; None at the end, or at a closing bracket."""
        self.space()
        d, at = self.data, self.at
        head = d[at : at + 1]
        if not head:
            return None
        if head == b"/":
            m = self._token.match(d, at + 1)
            self.at = m.end() if m else at + 1
            return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), m[0].decode("latin-1")) if m else "")
        if head == b"(":
            return self._string()
        if d.startswith(b"<<", at):
            self.at = at + 2
            out = {}
            while isinstance(k := self.value(), Name):
                out[k] = self.value()
            self._close(b">>")
            return out
        if head == b"<":
            end = d.find(b">", at)
            if end < 0:
                raise ValueError(f"string at {at} has no end")
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if head == b"[":
            self.at, out = at + 1, []
            while True:
                self.space()
                if self.data[self.at : self.at + 1] in (b"]", b""):
                    break
                before = self.at
                out.append(self.value())
                if self.at == before:
                    raise ValueError(f"array at {at} can't be read")
            self._close(b"]")
            return out
        if head in b"])}>{":
            return None
        m = self._token.match(d, at)
        if not m:
            raise ValueError(f"nothing to read at {at}")
        self.at = m.end()
        return self._word(m[0])

    def _close(self, mark: bytes) -> None:
        self.space()
        if not self.data.startswith(mark, self.at):
            raise ValueError(f"no {mark.decode()} at {self.at}")
        self.at += len(mark)

    def _word(self, word: bytes):
        if re.fullmatch(rb"[+-]?\d+", word):
            if self.refs and (m := re.compile(rb"\s+\d+\s+R(?![A-Za-z0-9])").match(self.data, self.at)):
                self.at = m.end()
                return Ref(word)
            return int(word)
        if re.fullmatch(rb"[+-]?(?:\d+\.\d*|\.\d+)", word):
            return float(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Operator(word))

    def _string(self) -> bytes:
        d, at, depth, out = self.data, self.at + 1, 1, bytearray()
        plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}
        while depth:
            c = d[at : at + 1]
            if not c:
                raise ValueError(f"string at {self.at} has no end")
            if c == b"\\":
                if m := re.compile(rb"[0-7]{1,3}").match(d, at + 1):
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                    continue
                after = d[at + 1 : at + 2]
                out += b"" if after in (b"\n", b"\r") else plain.get(after, after)
                at += 2
                continue
            depth += (c == b"(") - (c == b")")
            if depth:
                out += c
            at += 1
        self.at = at
        return bytes(out)


class File:
    """The objects of a file."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.data, self.objects, self.trailer = data, {}, {}
        for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", data):
            r = Reader(data, m.end())
            try:
                value = r.value()
            except ValueError:
                continue
            r.space()
            if isinstance(value, dict) and data.startswith(b"stream", r.at):
                begin = re.compile(rb"stream\r?\n?").match(data, r.at).end()
                size = value.get("Length")
                end = begin + size if isinstance(size, int) and not isinstance(size, Ref) and data[begin + size : begin + size + 12].lstrip().startswith(b"endstream") else data.find(b"endstream", begin)
                value = Stream(value, data[begin : end if end >= 0 else len(data)])
            self.objects[int(m[1])] = value
        for s in [o for o in self.objects.values() if isinstance(o, Stream)]:
            if s.head.get("Type") == "ObjStm":
                self._unpack(s)
            elif s.head.get("Type") == "XRef":
                self.trailer |= {k: v for k, v in s.head.items() if k in ("Root", "Info", "Encrypt")}
        for m in re.finditer(rb"\btrailer\b", data):
            try:
                more = Reader(data, m.end()).value()
            except ValueError:
                continue
            if isinstance(more, dict):
                self.trailer |= more
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted")
        self.root = self.get(self.trailer.get("Root"))
        if not isinstance(self.root, dict):
            self.root = next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
        if self.root is None:
            raise ValueError("no catalog")

    def _unpack(self, s: Stream) -> None:
        try:
            raw = self.bytes_of(s)
            r = Reader(raw)
            places = [(r.value(), r.value()) for _ in range(int(self.get(s.head.get("N")) or 0))]
            for number, at in places:
                self.objects.setdefault(int(number), Reader(raw, int(self.get(s.head["First"])) + int(at)).value())
        except (ValueError, TypeError, KeyError):
            return

    def get(self, x):
        """The value itself, through references."""
        seen = set()
        while isinstance(x, Ref) and x not in seen:
            seen.add(x)
            x = self.objects.get(int(x))
        return None if isinstance(x, Ref) else x

    def bytes_of(self, s: Stream) -> bytes:
        filters = self.get(s.head.get("Filter")) or []
        raw = s.raw
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                raise ValueError(f"filter {f} is not known")
            raw = zlib.decompressobj().decompress(raw, LIMIT)
        return raw

    def pages(self) -> Iterator[dict]:
        """Page dictionaries in order, with the boxes they inherit."""
        todo, seen = [(self.root.get("Pages"), {})], set()
        while todo:
            ref, given = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref in seen):
                continue
            seen.add(ref if isinstance(ref, Ref) else -1)
            given = given | {k: node[k] for k in ("MediaBox", "CropBox") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(k, given) for k in reversed(kids)]
            else:
                yield given | node

    def content(self, page: dict) -> bytes | None:
        """The page's content; None for none."""
        own = self.get(page.get("Contents"))
        parts = [self.get(x) for x in own] if isinstance(own, list) else [own]
        streams = [x for x in parts if isinstance(x, Stream)]
        return b"\n".join(map(self.bytes_of, streams)) if streams else None


def text_of(x) -> str:
    if not isinstance(x, bytes):
        return ""
    return x[2:].decode("utf-16-be", "replace") if x.startswith(b"\xfe\xff") else x.decode("latin-1")


# Content streams --------------------------------------------------------------------------------------

UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def then(m, n):
    """First the one matrix, then the other."""
    (a, b, c, d, e, f), (p, q, r, s, t, u) = m, n
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


def operations(data: bytes) -> Iterator[tuple[bytes, list]]:
    r, operands = Reader(data, refs=False), []
    while True:
        r.space()
        if r.at >= len(data):
            return
        before = r.at
        x = r.value()
        if isinstance(x, Operator):
            if x == b"BI":  # an image inside the text: to its end
                end = re.compile(rb"\bEI(?=[\s]|$)").search(data, r.at)
                if not end:
                    raise ValueError("inline image has no end")
                r.at = end.end()
            else:
                yield bytes(x), operands
            operands = []
        elif r.at == before:
            raise ValueError(f"content can't be read at {before}")
        else:
            operands.append(x)


def shapes(data: bytes) -> Iterator[tuple[str, tuple[float, float, float, float], list[float] | None]]:
    """('rect', box, fill) of each filled rectangle, and ('text', box, None) of each run of text, about: a
    run's width is that of its letters' average."""
    ctm, fill, kept, pending = UNIT, [0.0], [], []
    tm = line = UNIT
    size = leading = 0.0

    def numbers(xs: list, n: int) -> list[float]:
        own = xs[-n:]
        if len(own) < n or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in own):
            raise ValueError("operands are no numbers")
        return [float(x) for x in own]

    def show(text: bytes):
        nonlocal tm
        if text.strip():
            a, b, c, d, x, y = then(tm, ctm)
            wide, high = math.hypot(a, b) or 1.0, math.hypot(c, d) or 1.0
            end = x + len(text) * size * ADVANCE * wide
            low, top = y - size * DESCENDER * high, y + size * CAP_HEIGHT * high
            yield "text", (min(x, end), min(low, top), max(x, end), max(low, top)), None
        tm = then((1.0, 0.0, 0.0, 1.0, len(text) * size * ADVANCE, 0.0), tm)

    def move(x: float, y: float) -> None:
        nonlocal tm, line
        tm = line = then((1.0, 0.0, 0.0, 1.0, x, y), line)

    for op, args in operations(data):
        if op == b"q":
            kept.append((ctm, fill))
        elif op == b"Q":
            if kept:
                ctm, fill = kept.pop()
        elif op == b"cm":
            ctm = then(tuple(numbers(args, 6)), ctm)
        elif op == b"re":
            pending.append(numbers(args, 4))
        elif op in (b"g", b"rg", b"k", b"sc", b"scn"):
            fill = [float(x) for x in args] if args and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in args) else []
        elif op in (b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
            for x, y, w, h in pending:
                corners = [(ctm[0] * u + ctm[2] * v + ctm[4], ctm[1] * u + ctm[3] * v + ctm[5]) for u in (x, x + w) for v in (y, y + h)]
                xs, ys = zip(*corners)
                yield "rect", (min(xs), min(ys), max(xs), max(ys)), fill
            pending = []
        elif op in (b"n", b"S", b"s"):
            pending = []
        elif op == b"BT":
            tm = line = UNIT
        elif op == b"Tf":
            size = numbers(args, 1)[0]
        elif op == b"TL":
            leading = numbers(args, 1)[0]
        elif op == b"Tm":
            tm = line = tuple(numbers(args, 6))
        elif op in (b"Td", b"TD"):
            x, y = numbers(args, 2)
            leading = -y if op == b"TD" else leading
            move(x, y)
        elif op == b"T*":
            move(0.0, -leading)
        elif op in (b"Tj", b"'", b'"') and args and isinstance(args[-1], bytes):
            if op != b"Tj":
                move(0.0, -leading)
            yield from show(args[-1])
        elif op == b"TJ" and args and isinstance(args[-1], list):
            yield from show(b"".join(x for x in args[-1] if isinstance(x, bytes)))


_COARSE = re.compile(rb"(?:^|\s)(?:0(?:\.0+)?\s+g|(?:0(?:\.0+)?\s+){3}rg|(?:0(?:\.0+)?\s+){3}1(?:\.0+)?\s+k)\s.*\bre\s+(?:f\*?|F|b\*?|B\*?)(?:\s|$)", re.S)

# Rows -------------------------------------------------------------------------------------------------

_FACTS = pa.schema([("doc_id", pa.string()), ("category", pa.string()), ("severity", pa.string()), ("page", pa.int32()), ("value", pa.string())])
_BOXES = pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("no", pa.int32()), ("what", pa.string()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1")), ("fill", pa.list_(pa.float64()))])


def facts(content: bytes) -> Iterator[tuple[str, str | None, int | None, str | None]]:
    """(category, severity of a property, page from 1, value)."""
    f = File(content)
    info = f.get(f.trailer.get("Info"))
    for name, category, severity in INFO:
        value = text_of(f.get(info.get(name))) if isinstance(info, dict) else ""
        if value.strip():
            yield category, severity, None, f"{name}: {value}"
    if f.get(f.root.get("Metadata")) is not None:
        yield "xmp", None, None, None
    names = f.get(f.root.get("Names"))
    names = names if isinstance(names, dict) else {}
    if "JavaScript" in names or "OpenAction" in f.root:
        yield "javascript", None, None, None
    files = f.get(names.get("EmbeddedFiles"))
    todo = [files]
    while todo:
        node = f.get(todo.pop())
        if isinstance(node, dict):
            todo += f.get(node.get("Kids")) or []
            for name in (f.get(node.get("Names")) or [])[::2]:
                yield "attachment", None, None, text_of(f.get(name))
    for _ in range(max(0, content.count(b"%%EOF") - 1)):
        yield "incremental-history", None, None, None
    for no, page in enumerate(f.pages(), 1):
        for ref in f.get(page.get("Annots")) or []:
            note = f.get(ref)
            if isinstance(note, dict) and f.get(note.get("Subtype")) in MARKUP:
                yield "annotations", None, no, str(f.get(note.get("Subtype")))
        media, crop = ([float(f.get(x)) for x in f.get(page.get(k)) or []] for k in ("MediaBox", "CropBox"))
        if len(media) == len(crop) == 4 and any(abs(crop[k + 2] - crop[k]) < abs(media[k + 2] - media[k]) - 1 for k in (0, 1)):
            yield "cropbox", None, no, None


def boxes(content: bytes) -> Iterator[tuple[int, int, str, tuple[float, ...], list[float] | None]]:
    """(page, no, what, box, fill): rect and text of shapes; coarse for a page that can't be walked and has
    both a dark fill and text; unread for one that can't be read at all."""
    f = File(content)
    for page, d in enumerate(f.pages(), 1):
        raw = None
        try:
            raw = f.content(d)
            found = [] if raw is None else list(shapes(raw))
            for no, (what, box, fill) in enumerate(found):
                yield page, no, what, box, fill
        except (ValueError, zlib.error):
            coarse = raw is not None and _COARSE.search(raw) and re.search(rb"\bT[jJ]\b", raw)
            yield page, 0, "coarse" if coarse else "unread", (0.0, 0.0, 0.0, 0.0), None


def _rows(files: DataFrame, read, schema: pa.Schema, failed) -> DataFrame:
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    out = [dict(zip(schema.names, r)) for r in read(path, content or b"")]
                except (ValueError, TypeError, KeyError, zlib.error) as e:
                    out = failed(path, str(e))
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select("path", "content").mapInArrow(run, from_arrow_schema(schema))


def read_facts(files: DataFrame) -> DataFrame:
    """files: path, content -> doc_id, category, severity, page, value."""
    return _rows(files, lambda path, content: [(path, *x) for x in facts(content)], _FACTS, lambda path, e: [{"doc_id": path, "category": "unreadable", "value": e}])


def read_boxes(files: DataFrame) -> DataFrame:
    """files: path, content -> doc_id, page, no, what, x0, y0, x1, y1, fill. Unreadable files give none."""
    return _rows(files, lambda path, content: [(path, p, n, what, *box, fill) for p, n, what, box, fill in boxes(content)], _BOXES, lambda path, e: [])


def covered_text(found: DataFrame) -> DataFrame:
    """Of boxes, doc_id and page where text lies under a dark rectangle, or seems to."""
    own = found.withColumn("at", F.concat_ws("\x1f", "doc_id", F.col("page").cast("string")))
    sides = ["at", "doc_id", "page", "no", "x0", "y0", "x1", "y1"]
    rects = own.where("what = 'rect'").where(privacy.dark(F.col("fill"))).select(*sides)
    over = privacy.overlapping(own.where("what = 'text'").select(*sides), rects, "at").select("doc_id", "page")
    return over.union(own.where("what = 'coarse'").select("doc_id", "page")).distinct()


def findings(facts_: DataFrame, covered: DataFrame) -> DataFrame:
    """doc_id, category, severity, page (the first, null for the file), count, pages, removable, detail."""
    rules = facts_.sparkSession.createDataFrame(RULES, "category string, _s string, removable boolean")
    rows = facts_.unionByName(covered.select("doc_id", F.lit("possible-redaction").alias("category"), F.lit(None).cast("string").alias("severity"), "page", F.lit(None).cast("string").alias("value")))
    rows = rows.withColumn("_k", F.when(F.col("severity").isNotNull(), F.col("value")))  # properties are findings each
    sums = rows.groupBy("doc_id", "category", "severity", "_k").agg(F.min("page").alias("page"), F.count("*").alias("count"), F.countDistinct("page").alias("pages"), F.array_join(F.sort_array(F.collect_set("value")), ", ").alias("detail"))
    out = sums.join(F.broadcast(rules), "category", "left")
    return out.select("doc_id", "category", F.coalesce("severity", "_s").alias("severity"), "page", "count", "pages", F.coalesce("removable", F.lit(True)).alias("removable"), "detail")


def inspect(files: DataFrame) -> DataFrame:
    """files: path, content of .pdf files -> their findings."""
    return findings(read_facts(files), covered_text(read_boxes(files)))


def unread_pages(found: DataFrame) -> DataFrame:
    """doc_id, page: pages that could not be checked for covered text."""
    return found.where("what = 'unread'").select("doc_id", "page").distinct()
