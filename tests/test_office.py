"""Findings of small packages with planted leaks."""

from __future__ import annotations

import io
import zipfile

from scriptorium.operators import privacy
from scriptorium.sources import office

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_x_", "."), text)
    return out.getvalue()


def test_inspect(spark, tmp_path):
    core = '<c:coreProperties xmlns:c="c" xmlns:d="d"><d:creator>Ann</d:creator><c:revision>0</c:revision><d:title> </d:title></c:coreProperties>'
    app = "<Properties><Company>Acme</Company><TotalTime>0</TotalTime></Properties>"
    word = f'<w:document xmlns:w="{W}"><w:body><w:ins/><w:del/><w:r><w:rPr><w:vanish/></w:rPr></w:r><w:r><w:rPr><w:vanish w:val="0"/></w:rPr></w:r></w:body></w:document>'
    (tmp_path / "a.docx").write_bytes(package(word__document_x_xml=word, word__people_x_xml="<p/>", word__settings_x_xml=f'<w:settings xmlns:w="{W}"><w:rsids/></w:settings>', word__comments_x_xml=f'<w:comments xmlns:w="{W}"><w:comment/><w:comment/></w:comments>', docProps__core_x_xml=core, docProps__app_x_xml=app, docProps__custom_x_xml='<P><p name="k1"/><p name="k2"/></P>'))
    box = lambda x: f'<a:xfrm xmlns:a="{A}"><a:off x="{x}" y="0"/><a:ext cx="100" cy="10"/></a:xfrm>'
    (tmp_path / "b.pptx").write_bytes(package(ppt__presentation_x_xml=f'<p:presentation xmlns:p="{P}"><p:sldSz cx="1000" cy="500"/></p:presentation>', ppt__slides__slide1_x_xml=f'<p:sld xmlns:p="{P}" show="0">{box(-100)}{box(-99)}</p:sld>', ppt__notesSlides__notesSlide1_x_xml=f'<n xmlns:a="{A}"><a:t>say this</a:t></n>', ppt__notesSlides__notesSlide2_x_xml="<n/>", ppt__embeddings__e_x_xlsx="x"))
    (tmp_path / "c.xlsx").write_bytes(package(xl__workbook_x_xml=f'<w xmlns="{S}"><sheets><sheet state="hidden"/><sheet/></sheets><definedNames><definedName/></definedNames></w>', xl__worksheets__sheet1_x_xml=f'<w xmlns="{S}"><row hidden="1"/><row/><col hidden="1"/></w>', xl__pivotCache__p_x_xml="x", xl__externalLinks__e_x_xml="x"))
    (tmp_path / "d.docx").write_bytes(b"none")
    found = office.inspect(spark, str(tmp_path))
    got = {(r["doc_id"][-6:], r["category"]): (r["severity"], r["count"], r["removable"]) for r in found.collect()}
    assert got == {
        ("a.docx", "tracked-changes"): ("high", 2, True), ("a.docx", "hidden-text"): ("high", 1, True), ("a.docx", "comments"): ("medium", 2, True), ("a.docx", "reviewers"): ("high", 1, True), ("a.docx", "rsids"): ("low", 1, True),
        ("a.docx", "author"): ("high", 1, True), ("a.docx", "revision-count"): ("low", 1, True), ("a.docx", "company"): ("high", 1, True), ("a.docx", "custom-properties"): ("medium", 2, True),
        ("b.pptx", "hidden-slide"): ("high", 1, True), ("b.pptx", "off-canvas"): ("medium", 1, False), ("b.pptx", "speaker-notes"): ("high", 1, True), ("b.pptx", "embedded-workbook"): ("high", 1, True),
        ("c.xlsx", "hidden-sheet"): ("high", 1, False), ("c.xlsx", "hidden-cells"): ("medium", 2, False), ("c.xlsx", "defined-names"): ("low", 1, True), ("c.xlsx", "pivot-cache"): ("high", 1, True), ("c.xlsx", "external-link"): ("high", 1, True),
        ("d.docx", "unreadable"): ("low", 1, False),
    }
    counts = {r["doc_id"][-6:]: (r["high"], r["medium"], r["low"], r["unremovable"]) for r in privacy.count_by_severity(found, "doc_id").collect()}
    assert counts["b.pptx"] == (3, 1, 0, 1)


def test_sanitize(spark, tmp_path):
    from scriptorium.sources import docx, sanitize

    body = '<w:p w:rsidR="00A1"><w:r><w:t>keep </w:t></w:r><w:ins><w:r><w:t>added</w:t></w:r></w:ins><w:del><w:r><w:delText>cut</w:delText></w:r></w:del><w:commentRangeStart w:id="1"/><w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r><w:r><w:rPr><w:rPrChange/></w:rPr><w:t>!</w:t></w:r></w:p>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="1" Target="comments.xml"/><Relationship Id="2" Target="styles.xml"/><Relationship Id="3" Target="comments.xml" TargetMode="External"/></Relationships>'
    types = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/word/comments.xml"/><Override PartName="/word/document.xml"/></Types>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in {"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>', "word/comments.xml": "<c/>", "word/_rels/document.xml.rels": rels, "[Content_Types].xml": types, "docProps/core.xml": "<c/>", "word/styles.xml": "<s/>"}.items():
            z.writestr(n, t)
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    (tmp_path / "b.doc").write_bytes(b"old")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r["path"][-5:]: r for r in sanitize.sanitize(files).collect()}
    assert got["b.doc"]["error"] and got["b.doc"]["content"] is None
    new = bytes(got[".docx"]["content"])
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert sorted(z.namelist()) == ["[Content_Types].xml", "word/_rels/document.xml.rels", "word/document.xml", "word/styles.xml"]
        assert z.read("word/_rels/document.xml.rels").count(b"<Relationship ") == 2 and b"comments" not in z.read("[Content_Types].xml")
        text = z.read("word/document.xml")
        assert b"<w:p>" in text and b"rsid" not in text and b"Change" not in text
    assert [p["text"] for p in docx.paragraphs_of(docx.document(new))] == ["keep added!"]
    assert dict(got[".docx"]["removed"])["tracked-changes"] == 3 and not list(office.facts("docx", new))
