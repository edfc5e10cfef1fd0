"""Office packages (.docx, .pptx, .xlsx) to findings.

One pass over each package emits facts, a row for each thing found and its place; Spark sums them up
by file and category and joins severities. A file that can't be read, or breaks the archive limits, is
one ``unreadable`` row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.privacy import PROPERTY_RULES
from .docx import check_archive
from .references import safe_xml

# Category, severity, whether cleaning can remove it.
RULES = [
    ("embedded-workbook", "high", True),
    ("speaker-notes", "high", True),
    ("hidden-slide", "high", True),
    ("comments", "medium", True),
    ("off-canvas", "medium", False),
    ("pivot-cache", "high", True),
    ("external-link", "high", True),
    ("hidden-sheet", "high", False),
    ("hidden-cells", "medium", False),
    ("defined-names", "low", True),
    ("tracked-changes", "high", True),
    ("hidden-text", "high", True),
    ("reviewers", "high", True),
    ("rsids", "low", True),
    ("custom-properties", "medium", True),
    ("unreadable", "low", False),
]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
MAIN = {"docx": "word/document.xml", "pptx": "ppt/presentation.xml", "xlsx": "xl/workbook.xml"}


def _number(e, name: str) -> int:
    return int(e.get(name, "0"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _word(names: list[str], xml) -> Iterator[tuple[str, str]]:
    for n in names:
        if re.match(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml$", n) and (root := xml(n)) is not None:
            for e in root.iter():
                if e.tag in (f"{_W}ins", f"{_W}del"):
                    yield "tracked-changes", MAIN["docx"]
                elif e.tag == f"{_W}r" and (v := e.find(f"{_W}rPr/{_W}vanish")) is not None and v.get(f"{_W}val") not in ("0", "false", "off"):
                    yield "hidden-text", MAIN["docx"]
        elif n == "word/comments.xml":
            root = xml(n)
            yield from [("comments", n)] * max(1, len(root.findall(f"{_W}comment")) if root is not None else 0)
        elif n == "word/people.xml":
            yield "reviewers", n
        elif n == "word/settings.xml" and (root := xml(n)) is not None and root.find(f"{_W}rsids") is not None:
            yield "rsids", n


def _slides(names: list[str], xml) -> Iterator[tuple[str, str]]:
    main = xml(MAIN["pptx"])
    size = main.find(f"{_P}sldSz") if main is not None else None
    wide, high = (_number(size, "cx"), _number(size, "cy")) if size is not None else (0, 0)
    for n in names:
        if re.match(r"ppt/embeddings/[^/]+$", n):
            yield "embedded-workbook", n
        elif re.match(r"ppt/comments/[^/]+\.xml$", n) or n == "ppt/commentAuthors.xml":
            yield "comments", n
        elif re.match(r"ppt/notesSlides/notesSlide\d+\.xml$", n) and (root := xml(n)) is not None:
            if "".join(t.text or "" for t in root.iter(f"{_A}t")).strip():
                yield "speaker-notes", n
        elif re.match(r"ppt/slides/slide\d+\.xml$", n) and (root := xml(n)) is not None:
            if root.get("show") == "0":
                yield "hidden-slide", n
            for box in root.iter(f"{_A}xfrm") if wide > 0 and high > 0 else ():
                off, ext = box.find(f"{_A}off"), box.find(f"{_A}ext")
                if off is not None and ext is not None:
                    x, y = _number(off, "x"), _number(off, "y")
                    if x + _number(ext, "cx") <= 0 or y + _number(ext, "cy") <= 0 or x >= wide or y >= high:
                        yield "off-canvas", n


def _sheets(names: list[str], xml) -> Iterator[tuple[str, str]]:
    book = xml(MAIN["xlsx"])
    for e in book.iter() if book is not None else ():
        if e.tag == f"{_S}sheet" and e.get("state") in ("hidden", "veryHidden"):
            yield "hidden-sheet", MAIN["xlsx"]
        elif e.tag == f"{_S}definedName":
            yield "defined-names", MAIN["xlsx"]
    for n in names:
        if re.match(r"xl/pivotCache/[^/]+$", n):
            yield "pivot-cache", n
        elif re.match(r"xl/externalLinks/(?!_rels/).+$", n):
            yield "external-link", n
        elif re.match(r"xl/(threadedComments/)?[^/]*comments[^/]*\.xml$", n) or n == "xl/persons.xml":
            yield "comments", n
        elif re.match(r"xl/worksheets/sheet\d+\.xml$", n) and (root := xml(n)) is not None:
            for e in root.iter():
                if e.tag in (f"{_S}row", f"{_S}col") and e.get("hidden") == "1":
                    yield "hidden-cells", "xl/worksheets/"


_READERS = {"docx": _word, "pptx": _slides, "xlsx": _sheets}


def facts(kind: str, content: bytes) -> Iterator[tuple[str, str, str | None]]:
    """(category, location, value) of a package; document properties are ``property:NAME`` with their
    value. An error if the package can't be read."""
    if kind not in _READERS:
        raise ValueError(f"unsupported kind {kind}")
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            check_archive(z)
            names = sorted(z.namelist())
            if MAIN[kind] not in names:
                raise ValueError(f"no {MAIN[kind]}")

            def xml(name: str):
                try:
                    return safe_xml(z.read(name)) if name in names else None
                except ValueError:
                    return None  # a part that isn't XML says nothing

            for category, location in _READERS[kind](names, xml):
                yield category, location, None
            for part in ("docProps/core.xml", "docProps/app.xml"):
                root = xml(part)
                for e in root if root is not None else ():
                    yield f"property:{_local(e.tag)}", part, (e.text or "").strip()
            root = xml("docProps/custom.xml")
            for e in root if root is not None else ():
                yield "custom-properties", "docProps/custom.xml", e.get("name")
    except (zipfile.BadZipFile, OSError) as e:
        raise ValueError(f"not a valid package ({e})") from e


_SCHEMA = pa.schema([("doc_id", pa.string()), ("category", pa.string()), ("location", pa.string()), ("value", pa.string())])


def read_facts(files: DataFrame) -> DataFrame:
    """files: path, content -> doc_id, category, location, value."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows = [{"doc_id": path, "category": c, "location": p, "value": v} for c, p, v in facts(path.rpartition(".")[2].lower(), content)]
                except ValueError as e:
                    rows = [{"doc_id": path, "category": "unreadable", "location": "", "value": str(e)}]
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return files.select("path", "content").mapInArrow(run, "doc_id string, category string, location string, value string")


def findings(found: DataFrame) -> DataFrame:
    """Facts -> doc_id, category, severity, location (the first), count, removable, detail (the distinct
    values; reports cut them when they are shown)."""
    spark = found.sparkSession
    rules = spark.createDataFrame([*RULES, *((f"property:{n}", s, True) for n, _, s in PROPERTY_RULES)], "category string, severity string, removable boolean")
    real = found.where("not startswith(category, 'property:') or coalesce(value, '') not in ('', '0') or (value = '0' and location <> 'docProps/app.xml')")
    sums = real.groupBy("doc_id", "category").agg(F.count("*").alias("count"), F.min("location").alias("location"), F.array_join(F.sort_array(F.collect_set("value")), ", ").alias("detail"))
    names = F.create_map(*(F.lit(x) for n, c, _ in PROPERTY_RULES for x in (f"property:{n}", c)))
    return sums.join(F.broadcast(rules), "category").withColumn("category", F.coalesce(names[F.col("category")], "category"))


def inspect(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Findings of the office files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return findings(read_facts(files.where(F.rlike("path", F.lit(r"(?i)\.(docx|pptx|xlsx)$")) & ~F.rlike("path", F.lit(r"/~\$[^/]*$")))))
