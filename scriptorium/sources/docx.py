"""Word-processor packages (ZIP with XML parts) to rows: members, paragraphs, fields, tables.

Files are read by Spark as binary; each is opened once in an Arrow-batched function. A file that can't
be read, or breaks the archive limits, gives one row with ``error``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.privacy import MAX_MEMBER_BYTES, MAX_MEMBERS, MAX_RATIO, MAX_TOTAL_BYTES, MIN_COMPRESSED
from .references import safe_xml

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def check_archive(z: zipfile.ZipFile) -> None:
    infos, seen = z.infolist(), set()
    if len(infos) > MAX_MEMBERS:
        raise ValueError("too many members")
    for i in infos:
        name = i.filename.replace("\\", "/")
        if i.flag_bits & 1:
            raise ValueError(f"{name}: encrypted")
        if "\0" in name or name.startswith("/") or name[1:2] == ":" and name[:1].isalpha() or ".." in name.split("/"):
            raise ValueError(f"{name}: unsafe name")
        if name.lower() in seen:
            raise ValueError(f"{name}: duplicate")
        seen.add(name.lower())
        if i.file_size > MAX_MEMBER_BYTES:
            raise ValueError(f"{name}: too large")
    total, packed = sum(i.file_size for i in infos), sum(i.compress_size for i in infos)
    if total > MAX_TOTAL_BYTES or packed >= MIN_COMPRESSED and total > packed * MAX_RATIO:
        raise ValueError("expands too far")


def document(content: bytes):
    """The checked root of the main document part."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            check_archive(z)
            return safe_xml(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, OSError) as e:
        raise ValueError(f"not a valid document ({e})") from e


def paragraphs_of(root) -> Iterator[dict]:
    body = root.find(f"{W}body")
    for pos, p in enumerate(body.findall(f"{W}p") if body is not None else ()):
        style, number = p.find(f"{W}pPr/{W}pStyle"), p.find(f"{W}pPr/{W}numPr/{W}numId")
        runs = []
        for r in p.iter(f"{W}r"):
            raised = r.find(f"{W}rPr/{W}vertAlign")
            runs.append({"text": "".join(t.text or "" for t in r.iter(f"{W}t")), "superscript": raised is not None and raised.get(f"{W}val") == "superscript"})
        sizes = [int(s.get(f"{W}val")) for s in p.iter(f"{W}sz") if (s.get(f"{W}val") or "").isdigit()]
        yield {"pos": pos, "style_id": style.get(f"{W}val") if style is not None else None, "list_numbered": number is not None and number.get(f"{W}val") != "0", "font_size": max(sizes, default=None), "has_image": p.find(f".//{W}drawing") is not None, "text": "".join(r["text"] for r in runs), "segments": runs}


def fields_of(root) -> list[dict]:
    """Complex fields in the order they begin, nested ones too; one that never ends closes at the end."""
    out, open_ = [], []
    for e in root.iter():
        if e.tag == f"{W}fldChar":
            kind = e.get(f"{W}fldCharType")
            if kind == "begin":
                out.append({"order": len(out), "depth": len(open_), "instruction": "", "result_text": ""})
                open_.append([out[-1], True])
            elif kind == "separate" and open_:
                open_[-1][1] = False
            elif kind == "end" and open_:
                open_.pop()
        elif e.tag == f"{W}instrText" and open_ and open_[-1][1]:
            open_[-1][0]["instruction"] += e.text or ""
        elif e.tag == f"{W}t" and open_ and not open_[-1][1]:
            open_[-1][0]["result_text"] += e.text or ""
    return out


def cells_of(root) -> Iterator[dict]:
    for n, table in enumerate(root.iter(f"{W}tbl")):
        for r, row in enumerate(table.findall(f"{W}tr")):
            for i, c in enumerate(row.findall(f"{W}tc")):
                span, merge = c.find(f"{W}tcPr/{W}gridSpan"), c.find(f"{W}tcPr/{W}vMerge")
                yield {"table_no": n, "row": r, "i": i, "colspan": int(span.get(f"{W}val", "1")) if span is not None else 1, "v_merge": None if merge is None else merge.get(f"{W}val", "continue"), "text": "\n".join("".join(t.text or "" for t in p.iter(f"{W}t")) for p in c.iter(f"{W}p"))}


# What is found on the way down: an element, its paragraph's number and text, and the elements around it.

A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
DIAGRAM = "http://schemas.openxmlformats.org/drawingml/2006/diagram"
FULL_CROP = 100_000


def walk(root) -> Iterator[tuple]:
    """(element, ancestors from the root) in document order."""
    todo = [(root, ())]
    while todo:
        e, around = todo.pop()
        yield e, around
        todo += [(c, (*around, e)) for c in reversed(list(e))]


def _text(e) -> str:
    return "".join(t.text or "" for t in e.iter(f"{W}t"))


def signs_of(root) -> Iterator[dict]:
    """Elements that conversion can't keep, each with its nearest paragraph; those outside of any
    paragraph are left out."""
    number = {id(p): k for k, p in enumerate(root.iter(f"{W}p"))}
    for e, around in walk(root):
        kind = {f"{W}txbxContent": "text_box", f"{W}ins": "insertion", f"{W}del": "deletion", f"{WP}anchor": "floating_object"}.get(e.tag)
        if e.tag == f"{A}graphicData" and e.get("uri") == DIAGRAM:
            kind = "smartart"
        elif e.tag == f"{W}p" and e.find(f".//{W}drawing") is not None:
            kind = "image_paragraph"
        if kind:
            home = e if e.tag == f"{W}p" else next((x for x in reversed(around) if x.tag == f"{W}p"), None)
            if home is not None:
                yield {"sign": kind, "paragraph": number[id(home)], "text": _text(home), "own_text": _text(e)}


def images_of(root) -> Iterator[dict]:
    """Pictures of the main text in order, without those in text boxes or legacy fallbacks: relation, crop
    (shares cut off at left, top, right and bottom; null for none), top-level block, in a table or not."""
    body = root.find(f"{W}body")
    place = {id(x): k for k, x in enumerate(body)} if body is not None else {}
    n = 0
    for e, around in walk(root):
        tags = [x.tag.rpartition("}")[2] for x in around]
        if e.tag.rpartition("}")[2] != "blipFill" or "txbxContent" in tags or "Fallback" in tags:
            continue
        n += 1
        relation, crop = None, None
        for c in e:
            name = c.tag.rpartition("}")[2]
            if name == "blip":
                relation = c.get(f"{R}embed") or c.get(f"{R}link")
            elif name == "srcRect":
                sides = [max(0.0, int(v) / FULL_CROP) if (v := c.get(k, "0")).lstrip("-").isdigit() else 0.0 for k in "ltrb"]
                if any(sides) and sides[0] + sides[2] < 1 and sides[1] + sides[3] < 1:
                    crop = sides
        block = next((place[id(x)] for x in (*around, e) if id(x) in place), None)
        yield {"number": n, "relation": relation, "crop": crop, "block": block, "in_table": "tc" in tags}


def boxes_of(root) -> Iterator[dict]:
    for k, e in enumerate(root.iter(f"{W}txbxContent")):
        yield {"pos": k, "text": _text(e).strip()}


def blocks_of(root) -> Iterator[dict]:
    """Top-level blocks: paragraphs and tables."""
    body = root.find(f"{W}body")
    for pos, e in enumerate(body if body is not None else ()):
        kind = {f"{W}p": "para", f"{W}tbl": "table"}.get(e.tag)
        if kind:
            yield {"pos": pos, "kind": kind, "text": _text(e) if kind == "para" else None}


def equations_of(root) -> Iterator[dict]:
    """Equations in order: on their own line or not, their text, and that of the paragraph around."""
    n = 0
    for e, around in walk(root):
        if e.tag == f"{M}oMath":
            home = next((x for x in reversed(around) if x.tag == f"{W}p"), None)
            prose = "" if home is None else "".join(t.text or "" for t, up in walk(home) if t.tag == f"{W}t" and not any(x.tag in (f"{M}oMath", f"{M}oMathPara") for x in up))
            yield {"index": n, "display": bool(around) and around[-1].tag == f"{M}oMathPara", "text": "".join(t.text or "" for t in e.iter(f"{M}t")), "around": prose}
            n += 1


def styles_of(root) -> Iterator[dict]:
    for p in root.iter(f"{W}p"):
        style = p.find(f"{W}pPr/{W}pStyle")
        if style is not None and style.get(f"{W}val"):
            yield {"style_id": style.get(f"{W}val")}


_RUN = pa.list_(pa.struct([("text", pa.string()), ("superscript", pa.bool_())]))
_I, _S, _B = pa.int32(), pa.string(), pa.bool_()
_D = pa.list_(pa.float64())
KINDS: dict[str, tuple[Callable, list]] = {
    "paragraphs": (paragraphs_of, [("pos", _I), ("style_id", _S), ("list_numbered", _B), ("font_size", _I), ("has_image", _B), ("text", _S), ("segments", _RUN)]),
    "fields": (fields_of, [("order", _I), ("depth", _I), ("instruction", _S), ("result_text", _S)]),
    "signs": (signs_of, [("sign", _S), ("paragraph", _I), ("text", _S), ("own_text", _S)]),
    "images": (images_of, [("number", _I), ("relation", _S), ("crop", _D), ("block", _I), ("in_table", _B)]),
    "boxes": (boxes_of, [("pos", _I), ("text", _S)]),
    "blocks": (blocks_of, [("pos", _I), ("kind", _S), ("text", _S)]),
    "equations": (equations_of, [("index", _I), ("display", _B), ("text", _S), ("around", _S)]),
    "styles": (styles_of, [("style_id", _S)]),
    "cells": (cells_of, [("table_no", _I), ("row", _I), ("i", _I), ("colspan", _I), ("v_merge", _S), ("text", _S)]),
}


def rows(files: DataFrame, kind: str) -> DataFrame:
    """files: path, content -> doc_id (the path), the rows of the kind, error."""
    from pyspark.sql.pandas.types import from_arrow_schema

    read, fields = KINDS[kind]
    schema = pa.schema([("doc_id", _S), *fields, ("error", _S)])

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    out = [r | {"doc_id": path} for r in read(document(content))]
                except ValueError as e:
                    out = [{"doc_id": path, "error": str(e)}]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select("path", "content").mapInArrow(run, from_arrow_schema(schema))


def _part_rows(files: DataFrame, names: str, read: Callable, fields: list) -> DataFrame:
    """Rows of all members whose names match; members that can't be read give none."""
    from pyspark.sql.pandas.types import from_arrow_schema

    schema, wanted = pa.schema([("doc_id", _S), *fields]), re.compile(names)

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        check_archive(z)
                        for name in sorted(filter(wanted.fullmatch, z.namelist())):
                            try:
                                out += [r | {"doc_id": path} for r in read(safe_xml(z.read(name)))]
                            except ValueError:
                                continue
                except (ValueError, zipfile.BadZipFile, OSError):
                    pass
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select("path", "content").mapInArrow(run, from_arrow_schema(schema))


def relations(files: DataFrame) -> DataFrame:
    """doc_id, relation, kind, target of the main document part."""
    read = lambda root: [{"relation": r.get("Id"), "kind": r.get("Type"), "target": r.get("Target")} for r in root]
    return _part_rows(files, r"word/_rels/document\.xml\.rels", read, [("relation", _S), ("kind", _S), ("target", _S)])


def style_names(files: DataFrame) -> DataFrame:
    """doc_id, style_id, name (lower case) of the declared styles."""
    def read(root):
        for s in root.findall(f"{W}style"):
            name = s.find(f"{W}name")
            if s.get(f"{W}styleId") and name is not None:
                yield {"style_id": s.get(f"{W}styleId"), "name": (name.get(f"{W}val") or "").strip().lower()}

    return _part_rows(files, r"word/styles\.xml", read, [("style_id", _S), ("name", _S)])


def source_parts(files: DataFrame) -> DataFrame:
    """doc_id, text: the custom parts that may hold the word processor's bibliography, as XML."""
    from xml.etree import ElementTree

    read = lambda root: [{"text": ElementTree.tostring(root, encoding="unicode")}] if root.tag.rpartition("}")[2] == "Sources" else []
    return _part_rows(files, r"customXml/item\d+\.xml", read, [("text", _S)])


def copy_member(z: zipfile.ZipFile, out: zipfile.ZipFile, info: zipfile.ZipInfo, chunk: int = 1 << 16, most: int = MAX_MEMBER_BYTES) -> int:
    """A member copied in chunks; one that unpacks to more than ``most`` bytes is an error, whatever its
    header says. Gives the bytes copied."""
    done = 0
    with z.open(info) as source, out.open(info.filename, "w", force_zip64=True) as sink:
        while part := source.read(chunk):
            done += len(part)
            if done > most:
                raise ValueError(f"{info.filename}: too large")
            sink.write(part)
    return done


def members(files: DataFrame) -> DataFrame:
    """archive (the path), no, name, size, csize, encrypted: input of the archive guard."""
    schema = pa.schema([("archive", _S), ("no", _I), ("name", _S), ("size", pa.int64()), ("csize", pa.int64()), ("encrypted", _B)])

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out = [{"archive": path, "no": k, "name": i.filename, "size": i.file_size, "csize": i.compress_size, "encrypted": bool(i.flag_bits & 1)} for k, i in enumerate(z.infolist())]
                except (zipfile.BadZipFile, OSError):
                    continue
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    from pyspark.sql.pandas.types import from_arrow_schema

    return files.select("path", "content").mapInArrow(run, from_arrow_schema(schema))


def read(spark: SparkSession, path: str, kind: str = "paragraphs", recursive: bool = False) -> DataFrame:
    """Documents of a folder; lock files (~$...) are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", recursive).load(path)
    return rows(files.where(~F.rlike("path", F.lit(r"/~\$[^/]*$"))), kind)
