"""PDF files built by hand: properties, history, crops, annotations, and covered text."""

from __future__ import annotations

import zlib

from scriptorium.sources import pdf


def build(*objects: bytes, trailer: bytes = b"<</Root 1 0 R/Info 9 0 R>>", ends: int = 1) -> bytes:
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, x) for k, x in enumerate(objects, 1))
    return b"%PDF-1.4\n" + body + b"trailer " + trailer + b"\n" + b"startxref\n0\n%%EOF\n" * ends


def stream(raw: bytes, packed: bool = False) -> bytes:
    data = zlib.compress(raw) if packed else raw
    return b"<</Length %d%s>>stream\n%s\nendstream" % (len(data), b"/Filter/FlateDecode" if packed else b"", data)


COVERED = b"q 2 0 0 2 10 10 cm 0 g 0 0 50 20 re f Q BT /F1 10 Tf 1 0 0 1 20 20 Tm (hidden \\(a\\)) Tj ET"
BESIDE = b"0.1 0.1 0.1 rg 300 300 50 20 re f BT /F1 10 Tf 20 20 Td [(sh) -20 <6F77>] TJ ET 0.9 g 0 0 500 500 re f"
INFO = b"<</Author(Ann \\101)/Producer(x)/Title()/ModDate(D:2020)>>"


def document(first: bytes = COVERED, packed: bool = True) -> bytes:
    return build(
        b"<</Type/Catalog/Pages 2 0 R/OpenAction 3 0 R/Names<</EmbeddedFiles<</Names[(data.csv) 3 0 R]>>>>>>",
        b"<</Kids[3 0 R 4 0 R]/MediaBox[0 0 600 800]>>",
        b"<</Type/Page/Contents 5 0 R/CropBox[0 0 300 800]/Annots[7 0 R 8 0 R]>>",
        b"<</Type/Page/Contents[6 0 R]>>",
        stream(first, packed),
        stream(BESIDE),
        b"<</Subtype/Highlight>>",
        b"<</Subtype/Link>>",
        INFO,
        ends=3,
    )


def test_findings(spark):
    files = spark.createDataFrame([("a.pdf", document()), ("b.pdf", document(BESIDE)), ("c.pdf", b"nothing"), ("d.pdf", build(b"<</Type/Catalog>>", trailer=b"<</Root 1 0 R/Encrypt 2 0 R>>")), ("e.pdf", b"")], "path string, content binary")
    rows = pdf.inspect(files).collect()
    own = {(r["category"], r["severity"], r["page"], r["count"], r["detail"]) for r in rows if r["doc_id"] == "a.pdf"}
    assert own == {
        ("author", "high", None, 1, "Author: Ann A"), ("software", "low", None, 1, "Producer: x"), ("timestamp", "low", None, 1, "ModDate: D:2020"), ("attachment", "high", None, 1, "data.csv"), ("javascript", "medium", None, 1, ""),
        ("annotations", "medium", 1, 1, "Highlight"), ("incremental-history", "high", None, 2, ""), ("cropbox", "high", 1, 1, ""), ("possible-redaction", "high", 1, 1, ""),
    }
    assert "possible-redaction" not in {r["category"] for r in rows if r["doc_id"] == "b.pdf"}
    assert {r["doc_id"] for r in rows if r["category"] == "unreadable"} == {"c.pdf", "d.pdf", "e.pdf"}
    assert {r["removable"] for r in rows if r["category"] == "cropbox"} == {False}


def test_shapes():
    found = list(pdf.shapes(COVERED))
    assert found[0] == ("rect", (10.0, 10.0, 110.0, 50.0), [0.0])
    kind, box, _ = found[1]
    assert kind == "text" and box == (20.0, 17.5, 20 + 10 * 10 * 0.5, 27.5)
    assert [s[0] for s in pdf.shapes(b"0 0 1 1 re n 0 0 2 2 re S q 1 g Q BT 12 TL T* (a) ' ET BI /W 1 ID \x00\x01 EI 0 0 3 3 re f*")] == ["text", "rect"]


def test_coarse(spark):
    """A page whose content can't be walked is judged by its words, or reported."""
    broken, unread = b"0 g 0 0 9 9 re f BT (x) Tj ET (open", b"0 0 9 9 re f (open"
    files = spark.createDataFrame([("a.pdf", document(broken)), ("b.pdf", document(unread))], "path string, content binary")
    found = pdf.read_boxes(files)
    assert [tuple(r) for r in pdf.covered_text(found).collect()] == [("a.pdf", 1)]
    assert [tuple(r) for r in pdf.unread_pages(found).collect()] == [("b.pdf", 1)]


def test_object_streams():
    inner = b"2 0 3 24 <</Kids[3 0 R]        >> <</Type/Page/MediaBox[0 0 9 9]>>"
    first = inner.index(b"<<")
    inner = b"2 0 3 %d %s" % (inner.index(b"<</Type") - first, inner[first:])
    packed = zlib.compress(inner)
    data = build(b"<</Type/Catalog/Pages 2 0 R>>", trailer=b"<</Root 1 0 R>>") + b"7 0 obj <</Type/ObjStm/N 2/First %d/Filter/FlateDecode/Length %d>>stream\n" % (inner.index(b"<<"), len(packed)) + packed + b"\nendstream endobj"
    assert [p["MediaBox"] for p in pdf.File(data).pages()] == [[0, 0, 9, 9]]
