"""Cleaned copies of office packages, as binary columns.

A package is rewritten once: parts that leak are left out, and relations and content types that name
them go too, so the package stays consistent. In word-processor parts tracked changes are accepted
(deletions dropped, insertions kept, formatting changes dropped), and comment marks, hidden runs and
session identifiers removed. A package that can't be read, or whose kind isn't cleaned, gives an error
and no content.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame

from .docx import check_archive
from .references import safe_xml

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Parts that are left out, by kind.
LEAKS = {
    "docx": r"docProps/(core|app|custom)\.xml|word/(comments[^/]*|people)\.xml",
    "pptx": r"docProps/(core|app|custom)\.xml|ppt/(comments/.*|commentAuthors\.xml|notesSlides/.*|embeddings/.*)",
    "xlsx": r"docProps/(core|app|custom)\.xml|xl/((threadedComments/)?[^/]*comments[^/]*\.xml|persons\.xml|externalLinks/.*)",
}
_DROPPED = {f"{_W}{t}" for t in ("del", "moveFrom", "commentRangeStart", "commentRangeEnd", "commentReference", "rsids")}
_UNWRAPPED = {f"{_W}ins", f"{_W}moveTo"}


def _hidden(e: ET.Element) -> bool:
    mark = e.find(f"{_W}rPr/{_W}vanish") if e.tag == f"{_W}r" else None
    return mark is not None and mark.get(f"{_W}val") not in ("0", "false", "off")


def _clean_children(e: ET.Element, removed: dict[str, int]) -> None:
    out: list[ET.Element] = []
    for child in list(e):
        name = child.tag.rpartition("}")[2] if isinstance(child.tag, str) else ""
        if child.tag in _DROPPED or child.tag.startswith(_W) and name.endswith("Change") or _hidden(child):
            what = "hidden-text" if _hidden(child) else "comments" if "omment" in name else "rsids" if name == "rsids" else "tracked-changes"
            removed[what] = removed.get(what, 0) + 1
            continue
        _clean_children(child, removed)
        if child.tag in _UNWRAPPED:
            removed["tracked-changes"] = removed.get("tracked-changes", 0) + 1
            out += list(child)
        else:
            out.append(child)
    if len(out) != len(e) or any(a is not b for a, b in zip(out, e)):
        e[:] = out
    for a in [a for a in e.attrib if re.search(r"\}rsid\w*$", a)]:
        del e.attrib[a]


def _serialize(root: ET.Element, original: bytes) -> bytes:
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(original), events=["start-ns"]):
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def _rels(name: str, data: bytes, gone: set[str]) -> bytes:
    """A relations part without targets that are gone; external ones stay."""
    base = posixpath.dirname(posixpath.dirname(name))
    root = safe_xml(data)
    for r in list(root):
        target = r.get("Target", "")
        where = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(base, target))
        if r.get("TargetMode") != "External" and where in gone:
            root.remove(r)
    return _serialize(root, data)


def clean(kind: str, content: bytes) -> tuple[bytes, dict[str, int]]:
    """The cleaned package and how much of what was removed."""
    if kind not in LEAKS:
        raise ValueError(f"{kind} files aren't cleaned; save as a current format first")
    removed: dict[str, int] = {}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            check_archive(z)
            names = z.namelist()
            gone = {n for n in names if re.fullmatch(LEAKS[kind], n)}
            # relations of a part that is gone go with it
            gone |= {n for n in names if n.endswith(".rels") and posixpath.join(posixpath.dirname(posixpath.dirname(n)), posixpath.basename(n)[:-5]) in gone}
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
                for n in names:
                    if n in gone:
                        continue
                    data = z.read(n)
                    if n.endswith(".rels"):
                        data = _rels(n, data, gone)
                    elif n == "[Content_Types].xml":
                        root = safe_xml(data)
                        for e in list(root):
                            if (e.get("PartName") or "").lstrip("/") in gone:
                                root.remove(e)
                        data = _serialize(root, data)
                    elif kind == "docx" and re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes|settings)\.xml", n):
                        root = safe_xml(data)
                        _clean_children(root, removed)
                        data = _serialize(root, data)
                    new.writestr(zipfile.ZipInfo(n), data)  # no times either
    except (zipfile.BadZipFile, OSError) as e:
        raise ValueError(f"not a valid package ({e})") from e
    for n in gone:
        part = n.rpartition("/")[2]
        removed[f"part:{part}"] = removed.get(f"part:{part}", 0) + 1
    return out.getvalue(), removed


_SCHEMA = pa.schema([("path", pa.string()), ("content", pa.binary()), ("removed", pa.map_(pa.string(), pa.int64())), ("error", pa.string())])


def sanitize(files: DataFrame) -> DataFrame:
    """files: path, content -> path, cleaned content, removed (map), error."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    data, removed = clean(path.rpartition(".")[2].lower(), content)
                    row = {"path": path, "content": data, "removed": list(removed.items()), "error": None}
                except ValueError as e:
                    row = {"path": path, "content": None, "removed": [], "error": str(e)}
                yield pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    return files.select("path", "content").mapInArrow(run, "path string, content binary, removed map<string,bigint>, error string")
