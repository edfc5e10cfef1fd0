"""Packages built by hand, and document operators on small rows."""

from __future__ import annotations

import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import fuzzy
from scriptorium.operators import anchors, citations, figures, groups, markers, matching, metadata, preflight, report, tables
from scriptorium.plans.views import view
from scriptorium.sources import docx

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def package(body: str, **parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def para(*runs: str, style: str = "") -> str:
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{head}{''.join(runs)}</w:p>"


def run(text: str) -> str:
    return f"<w:r><w:t>{text}</w:t></w:r>"


def picture(relation: str, crop: str = "") -> str:
    return f'<w:r><w:drawing><pic:blipFill><a:blip r:embed="{relation}"/>{crop}</pic:blipFill></w:drawing></w:r>'


def field(code: str) -> str:
    code = code.replace("&", "&amp;").replace("<", "&lt;")
    return f'<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>{code}</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r>{run("[1]")}<w:r><w:fldChar w:fldCharType="end"/></w:r>'


def files(spark, **content: bytes):
    return spark.createDataFrame([(f"{k}.docx", v) for k, v in content.items()], "path string, content binary")


def test_figures(spark):
    box = f'<w:r><mc:AlternateContent><mc:Choice><w:txbxContent>{para(run("Fig. 3: boxed"), picture("r9"))}</w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent>{para(run("Fig. 3: boxed"))}</w:txbxContent>{picture("r1")}</mc:Fallback></mc:AlternateContent></w:r>'
    body = (
        para(picture("r1", '<a:srcRect l="25000" t="-5" r="10000"/>'))
        + para(run("Figure 1: the first"))
        + para(run("Figure 2. before"))
        + para(picture("r2", '<a:srcRect l="60000" r="50000"/>'))
        + para(run("text"))
        + para(picture("r1", '<a:srcRect b="50000"/>'), box)
        + f"<w:tbl><w:tr><w:tc>{para(picture('r3'))}</w:tc></w:tr></w:tbl>"
    )
    rel = "".join(f'<Relationship Id="r{k}" Type="x/image" Target="media/i{k}.png"/>' for k in (1, 2)) + '<Relationship Id="r3" Type="x/hyperlink" Target="i3.png"/>'
    got = figures.read(files(spark, a=package(body, **{"word___rels__document.xml.rels": RELS.format(rel)}), b=b"none")).orderBy("number").collect()
    assert [(r["number"], r["caption"], r["in_table"], r["name"], r["crop"]) for r in got] == [
        (1, "the first", False, "i1.png", [0.25, 0.0, 0.1, 0.0]),
        (2, "before", False, "i2.png", None),
        (3, "boxed", False, "i1.png", [0.0, 0.0, 0.0, 0.5]),
        (4, "", True, None, None),
    ]
    assert [r[0] for r in spark.createDataFrame([([0.0, 0.1],), ([0.0, 0.0],), (None,)], "c array<double>").select(figures.wants_crop(F.col("c"))).collect()] == [True, False, False]
    rows = spark.createDataFrame([("a", "1", "x.png"), ("a", "0", "x.png"), ("a", "two", "x.png"), ("a", "3", "gone.png"), ("a", "4", " ")], "doc_id string, number string, path string")
    listed = figures.manifest(rows, spark.createDataFrame([("x.png",)], "path string")).collect()
    assert sorted((r["number"] or 0, (r["error"] or "ok").split(" ")[-1]) for r in listed) == [(0, "integer"), (0, "integer"), (1, "ok"), (3, "exist"), (4, "path")]


def test_preflight(spark):
    body = (
        para(run("Title"), style="Title")
        + para(f'<w:ins w:id="1">{run("new")}</w:ins>', run(" word"), style="H1")
        + para('<w:r><w:drawing><wp:anchor/></w:drawing></w:r>', run("Eq. 1"))
        + para(f"<w:r><w:txbxContent>{para(run('Figure 2: kept'))}{para(run('lost'))}</w:txbxContent></w:r>", style="Caption")
        + para('<w:r><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/diagram"/></w:r>')
        + f'<w:del w:id="2">{run("no paragraph")}</w:del>'
    )
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="Heading 2"/></w:style></w:styles>'
    found, styles_used = preflight.run(files(spark, a=package(body, **{"word__styles.xml": styles}), b=b"none"))
    rows = found.where("doc_id = 'a.docx' and detector not like 'privacy%'").orderBy("order", "paragraph").collect()
    assert [(r["detector"], r["severity"], r["paragraph"]) for r in rows] == [("tracked_changes", "error", 1), ("floating_object", "warn", 2), ("smartart", "error", 6), ("equation_as_image", "warn", 2)]
    assert {r["detector"] for r in found.where("detector like 'privacy%' and doc_id = 'a.docx'").collect()} == {"privacy_tracked-changes"}
    assert {(r["detector"], r["severity"]) for r in found.where("doc_id = 'b.docx'").collect()} == {("unreadable", "error"), ("privacy_check_failed", "info")}
    assert [tuple(r) for r in styles_used.collect()] == [("a.docx", [2], True, True)]
    notes = preflight.format_notes(spark.createDataFrame([("a", "x.docx", False), ("b", "x.ODT", False), ("c", "x.md", True)], "doc_id string, path string, has_sidecar boolean"))
    assert sorted(r["doc_id"] for r in notes.collect()) == ["b", "b", "c"]


def test_citations(spark):
    work = lambda k, **more: {"itemData": {"id": k, "type": "article-journal", "title": f"Study {k}", "author": [{"family": "Smith", "given": "A"}], "issued": {"date-parts": [[2020]]}, **more}}
    code = lambda *items: field(" ADDIN ZOTERO_ITEM CSL_CITATION " + json.dumps({"citationItems": list(items)}) + " ")
    source = '<b:Sources xmlns:b="http://schemas.openxmlformats.org/officeDocument/2006/bibliography"><b:Source><b:Tag>T1</b:Tag><b:SourceType>Book</b:SourceType><b:Title>Native</b:Title><b:Year>1999</b:Year><b:Author><b:Author><b:NameList><b:Person><b:Last>Lee</b:Last></b:Person></b:NameList></b:Author></b:Author></b:Source></b:Sources>'
    body = para(code(work(1, DOI="10.1/A"), work(2))) + para(field(r" CITATION T1 \l 1033 \m Gone ")) + para(code(work(2), work(9, DOI="10.1/a "), work(2))) + para(field(" PAGE "))
    entries, cited = citations.read_fields(files(spark, a=package(body, **{"customXml__item1.xml": source}), b=package(para(code(work(3))))))
    got = {(r["doc_id"], r["index"]): (r["source"], r["keys"]) for r in cited.collect()}
    assert got == {("a.docx", 0): ("zotero", ["smith2020studya", "smith2020studyb"]), ("a.docx", 1): ("wordnative", ["lee1999native"]), ("a.docx", 2): ("zotero", ["smith2020studyb", "smith2020studya"]), ("b.docx", 0): ("zotero", ["smith2020study"])}
    assert [(r["doc_id"], r["pos"], r["key"], r["title"]) for r in entries.orderBy("doc_id", "pos").collect()] == [("a.docx", 0, "smith2020studya", "Study 1"), ("a.docx", 1, "smith2020studyb", "Study 2"), ("a.docx", 2, "lee1999native", "Native"), ("b.docx", 0, "smith2020study", "Study 3")]


def test_equations(spark):
    body = para(run("a "), "<m:oMath><m:r><m:t>x=1</m:t></m:r></m:oMath>", run(" b")) + para("<m:oMathPara><m:oMath><m:r><m:t>y</m:t></m:r></m:oMath></m:oMathPara>")
    raw = docx.rows(files(spark, a=package(body)), "equations")
    assert [(r["index"], r["display"], r["text"], r["around"]) for r in raw.collect()] == [(0, False, "x=1", "a  b"), (1, True, "y", "")]
    converted = spark.createDataFrame([("a.docx", 0, "x = 1")], "doc_id string, index int, text string")
    audit = groups.full_positional(raw, converted)
    text = report.equation_audit(audit).first()["text"]
    assert "2 equation(s), 1 to check" in text and "| 2 | `y` | _missing_ | check |" in text


def test_fold_joined(spark):
    many = "-".join("{[}%d{]}" % k for k in range(1, 201))
    rows = spark.createDataFrame([(many,), ("{[}1{]} – {[}3{]} and {[}x{]}-{[}2{]}",), (r"\textsuperscript{1}-\textsuperscript{2}--\textsuperscript{5}",)], "t string")
    got = [r[0] for r in rows.select(markers.fold_joined(F.col("t"))).collect()]
    assert got == ["{[}" + "-".join(map(str, range(1, 201))) + "{]}", "{[}1-3{]} and {[}x{]}-{[}2{]}", r"\textsuperscript{1-2-5}"]


def test_tables(spark):
    kind = "doc_id string, table int, row int, i int, colspan int, rowspan int, text string, head boolean, nested array<array<string>>, explicit string"
    one = [("a", 1, 0, 0, 2, 1, "Head", True, None, None), ("a", 1, 1, 0, 1, 2, "both", False, None, None), ("a", 1, 1, 1, 1, 1, "1", False, None, None), ("a", 1, 2, 0, 1, 1, "", False, [["p", " "], ["", ""], ["q", "r"]], None)]
    two = [("a", 2, 0, 0, 1, 1, "x & y", False, None, "c"), ("a", 2, 0, 1, 1, 1, "2", False, None, None)]
    cells = spark.createDataFrame(one + two, kind)
    assert {r["table"]: r["reason"] for r in tables.pathologies(cells).collect()} == {1: "nested table", 2: None}
    got = {r["table"]: r["text"] for r in tables.to_latex(cells, spark.createDataFrame([("a", 2, "Cap")], "doc_id string, table int, caption string")).collect()}
    assert "\\multicolumn{2}{c}{Head} \\\\\n\\midrule\nboth & 1 \\\\\nboth & p / q; r \\\\\n\\bottomrule" in got[1] and tables.DEGRADED_NOTE in got[1]
    assert got[2] == "\\begin{table}[htbp]\n\\centering\n\\caption{Cap}\n\\begin{tabular}{cr}\n\\toprule\nx \\& y & 2 \\\\\n\\bottomrule\n\\end{tabular}\n\\end{table}"
    assert spark.range(1).select(tables.slash_breaks(F.lit("a/b/"))).first()[0] == "a/\\allowbreak{}b/\\allowbreak{}"


def test_wrapped_figures(spark):
    text = "x \\begin{figure}\n%%FIGURE:1%%\n\\caption{old}\\end{figure} y %%FIGURE:2%%\n\nFig. 2: typed\nagain\n\nz %%FIGURE:3%%"
    texts = spark.createDataFrame([("a", text), ("b", None)], "doc_id string, text string")
    shown = spark.createDataFrame([("a", 1, "p1", "new", False, False), ("a", 2, "p2", "", False, True)], "doc_id string, number int, path string, caption string, wide boolean, in_table boolean")
    got = {r["doc_id"]: r["text"] for r in anchors.place_figures(texts, shown).collect()}
    assert got["b"] is None and "old" not in got["a"] and "typed" not in got["a"] and "\\caption{new}" in got["a"] and "z % WARNING: no figure 3" in got["a"]
    assert texts.select(anchors.strip_figures(F.col("text")).alias("t")).first()["t"] == "x  y \n\nz "


def test_metadata(spark):
    rows = spark.createDataFrame([("a", ["1", "z"], "1"), ("a", ["1"], "2"), ("a", [], None)], "doc_id string, markers array<string>, label string")
    lost = metadata.unreferenced_affiliations(rows.select("doc_id", "label"), rows.select("doc_id", "markers"))
    assert [tuple(r) for r in lost.collect()] == [("a", "2")]
    sides = spark.createDataFrame([("a", '{"title": "T & x", "affiliations": ["A"], "authors": [{"name": "N_1", "affiliations": [1]}]}'), ("b", "nothing")], "doc_id string, data string")
    checked = metadata.validate_sidecars(sides)
    assert {r["doc_id"]: r["error"] for r in checked.collect()} == {"a": None, "b": "root must be a mapping"}
    meta = checked.where("doc_id = 'a'").select(metadata.escape_meta(F.col("meta")).alias("m"), metadata.anonymize(F.col("meta")).alias("n"), metadata.index_error(F.col("meta")).alias("e")).first()
    assert meta["m"]["title"] == "T \\& x" and meta["m"]["authors"][0]["name"] == "N\\_1" and meta["m"]["authors"][0]["affiliations"] == [0]
    assert meta["n"]["authors"][0]["name"] == metadata.ANONYMOUS and meta["n"]["affiliations"] == [] and meta["e"] is None


def test_copy_member():
    source, out = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(source, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 100_000)
    with zipfile.ZipFile(source) as z, zipfile.ZipFile(out, "w") as to:
        assert docx.copy_member(z, to, z.getinfo("a")) == 100_000
        with pytest.raises(ValueError):
            docx.copy_member(z, to, z.getinfo("a"), most=1000)


def test_fuzzy_reconciliation(spark, sf):
    """All scores against a direct search over candidates."""
    lib = view(spark, sf, "library")
    typed = view(spark, sf, "typed")
    entries = [r.asDict() for r in lib.orderBy("pos").collect()]
    got = {r["ref_id"]: (r["pos"], r["score"]) for r in matching.best_match(typed, lib, fuzzy=True).collect()}
    words = lambda x: {w for w in re.split(r"\W+", x.lower()) if w}
    texts = {r["ref_id"]: r["text"] for r in typed.collect()}
    for ref, text in list(texts.items())[:60]:
        best = None
        for e in entries:
            year, author = e["year"] in text, bool(re.search(rf"(?i)\b{e['family']}\b", text))
            if words(e["title"]) & words(text) or (year and author):
                score = round(0.6 * fuzzy.token_set_ratio(e["title"], text) / 100 + 0.2 * year + 0.2 * author, 9)
                if best is None or score > best[1]:
                    best = (e["pos"], score)
        assert got[ref] == (best[0], pytest.approx(best[1])), text
