"""Operators and functions on small fixtures."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import fuzzy
from scriptorium.functions import names as N
from scriptorium.functions import text as T
from scriptorium.operators import groups, keys, markers, matching, privacy, render, structure, validation
from scriptorium.sources import docx, references
from scriptorium.streaming import limits


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_text(spark):
    assert one(spark, T.ascii_fold, "Müller Øst Æþß Ñé é ł") == ["Muller Ost AEthss Ne e l"]
    assert one(spark, T.slug, "O'Neil-Ångström 2", None) == ["oneilangstrom2", ""]
    assert one(spark, T.first_title_word, "On the Origin of species", "The of", "", None, "A –") == ["origin", "the", "", "", "a"]
    assert one(spark, T.escape_latex, "a\\b{c}_&%$#~^", "plain") == [r"a\textbackslash{}b\textbraceleft{}c\textbraceright{}\_\&\%\$\#\textasciitilde{}\textasciicircum{}", "plain"]
    assert one(spark, T.protect_title, "Growth of GaAs  and pH in CO2") == ["Growth of {GaAs}  and {pH} in {CO2}"]
    assert one(spark, T.format_pages, "12-19", " a1 – b2 ", "12, 14", "5") == ["12--19", "a1--b2", "12, 14", "5"]
    assert one(spark, T.normalize_doi, " https://dx.doi.org/10.1/x ", "DOI:10.1/y", None) == ["10.1/x", "10.1/y", ""]
    assert one(spark, T.expand_numeric_range, "3-5,8", "9-4", "110", "007, 2", "1--3,x", "5-1500", "1-2-3", "", "99999999999") == [[3, 4, 5, 8], [9, 4], [], [2], [1, 2, 3], [5, 1500], [], [], [None]]
    assert one(spark, T.guess_surname, "[3] L. J. Cornelissen, Nature", "Foster, G.", "40th 1 2") == ["Cornelissen", "Foster", None]
    assert one(spark, T.guess_year, "in 12020 or 1999", "none") == ["2020", None]
    assert one(spark, T.strip_markup, "a <b>x</b>&amp;lt;\n y") == ["a x&lt; y"]
    assert one(spark, T.raw_leading_surname, "J. E. Davies, O. H. (2004)", "See 3, x", "4x, y") == ["davies", "see", None]
    assert one(spark, lambda x: T.suffix(x.cast("int")), "0", "25", "26", "52") == ["a", "z", "za", "zza"]
    assert one(spark, T.snippet, "a\n b", "x" * 90) == ["a b", "x" * 79 + "…"]


def test_names(spark):
    both = lambda x: N.to_text(N.from_text(x))
    assert one(spark, both, "Smith, A. B.; Acme ;; Lee, C") == ["Smith, A. B.; Acme; Lee, C"]
    assert one(spark, lambda x: N.plain(N.from_text(x)), "Smith, Ann bo; Lee") == ["Smith, A. B., Lee"]
    assert one(spark, lambda x: N.compact(N.from_text(x)), "A; B; C; D; E", "A") == ["A, B, C, +2", "A"]


def test_fuzzy(spark):
    rng = random.Random(1)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert fuzzy.lcs(a, b) == slow(a, b)
    assert fuzzy.token_set_ratio("deep blue", "a deep blue sea") == 100 and fuzzy.token_set_ratio("", "a") == 0
    assert fuzzy.token_sort_ratio("b a", "a b") == 100 and fuzzy.ratio("", "") == 100
    assert fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a dog") == pytest.approx(78.571, abs=15)


REF = "pos int, family string, families string, title string, year string, doi string, raw_id string"


def test_keys(spark):
    rows = [(1, "Smith", "smith", "The Big idea", "2020", None, "a"), (2, "Smith", "smith", "Big Idea", "2020", " 10.1/X", "b"), (3, None, None, None, None, None, None), (4, None, None, None, None, None, None), (5, "Lee", "lee", "On it", None, None, None), (6, "Lee", "lee", "on  it!", None, None, None), (7, None, None, "Only", "1999", "", "")]
    refs = spark.createDataFrame(rows, REF).withColumn("identity", keys.dedup_identity(F.col("pos")))
    got = {r["pos"]: (r["key"], r["identity"]) for r in keys.assign_keys(refs).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["smith2020biga", "smith2020bigb", "anonnda", "anonndb", "leendita", "leenditb", "only1999"]
    assert got[2][1] == "doi:10.1/x" and got[1][1] == "id:a" and got[3][1] != got[4][1] and got[5][1] == got[6][1] == "fp:lee:None:onit"
    assert {r["pos"] for r in keys.dedup_refs(refs, "pos").collect()} == {1, 2, 3, 4, 5, 7}


def test_merge(spark):
    base = spark.createDataFrame([("i1", 1, "k"), ("i2", 2, "ka"), ("i3", 3, "m")], "identity string, pos int, key string")
    new = spark.createDataFrame([("i1", 1, "x"), ("n1", 2, "k"), ("n2", 3, "k"), ("n1", 4, "k"), ("n3", 5, "q"), ("n4", 6, "q")], "identity string, pos int, key string")
    got = [(r["final_key"], r["status"]) for r in keys.merge_refs(base, new).orderBy("pos").collect()]
    assert got == [("k", "in_base"), ("kb", "added"), ("kc", "added"), ("kb", "repeated"), ("q", "added"), ("qa", "added")]


def test_merge_beyond_600_suffixes(spark):
    """The first free suffix, however many are taken."""
    base = spark.createDataFrame([(f"i{i}", i, "k" + "z" * (i // 26) + chr(97 + i % 26)) for i in range(700)] + [("i", 700, "k")], "identity string, pos int, key string")
    new = spark.createDataFrame([("n", 1, "k")], "identity string, pos int, key string")
    assert keys.merge_refs(base, new).first()["final_key"] == "k" + "z" * 26 + "y"


def test_markers(spark):
    numbered = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (2, 3, "B"), (3, 4, "a")], "number int, pos int, key string")
    m = spark.createDataFrame([(1, "[1-3,9,1]"), (2, "[x]")], "id int, marker string")
    got = {r["id"]: (r["keys"], r["missing"]) for r in markers.resolve_numeric(m, numbered, "id").collect()}
    assert got == {1: (["a", "B"], [9])}
    texts = spark.createDataFrame([(1, r"see \cite{a, b} and \cite{c}."), (2, "none")], "id int, text string")
    remap = spark.createDataFrame([("a", "z")], "key string, final_key string")
    assert {r["id"]: r["text"] for r in markers.remap_cite_keys(texts, remap, "id").collect()} == {1: r"see \cite{z,b} and \cite{c}.", 2: "none"}
    index = spark.createDataFrame([("smith", "2020", ["k"])], "surname string, year string, keys array<string>")
    t = spark.createDataFrame([(1, "(Smith et al., 2020) (Lee & Poe 1999a)")], "id int, text string")
    assert {(r["surname"], r["year"]): r["keys"] for r in markers.author_year_markers(t, index, "id").collect()} == {("smith", "2020"): ["k"], ("lee", "1999"): None}
    short = markers.linkage(texts, spark.createDataFrame([(1, 1)] * 3, "id int, n int"), "id").collect()
    assert [(r["cites"], r["citations"]) for r in short] == [(2, 3)]


def test_reconcile(spark):
    """Every pair scored directly."""
    rng = random.Random(4)
    words = "deep sea blue red ring thin film growth spin wave".split()
    lib = [(i, " ".join(rng.sample(words, 3)), str(2000 + i % 4), rng.choice(["Smith", "Lee", "Poe"])) for i in range(40)]
    typed = [(i, f"{lib[i][3]}, A. {lib[i][1]} x ({lib[i][2]})." if i % 3 else f"Nobody {' '.join(rng.sample(words, 2))} 1900") for i in range(40)]
    own, far = [x for x in lib if x[0] % 2], [x for x in lib if not x[0] % 2]
    df = lambda rows: spark.createDataFrame(rows, "pos int, title string, year string, family string")
    got = {r["ref_id"]: (r["source"], r["matched_pos"], round(r["score"], 6)) for r in matching.reconcile(spark.createDataFrame(typed, "ref_id int, text string"), df(own), df(far), fuzzy=True).collect()}

    def best(text, rows):
        score = lambda x: round(0.6 * fuzzy.token_set_ratio(x[1], text) / 100 + 0.2 * (x[2] in text) + 0.2 * (x[3] in text), 9)
        top = max(rows, key=lambda x: (score(x), -x[0]))
        return top[0], score(top)

    for i, text in typed:
        (a, x), (b, y) = best(text, own), best(text, far)
        want = ("bibfile", a, x) if x >= 0.72 else ("crossref", b, y) if y >= 0.72 else ("raw", None, None)
        assert got[i][:2] == want[:2] and (want[2] is None or got[i][2] == round(want[2], 6))
    total = matching.report(matching.reconcile(spark.createDataFrame([], "ref_id int, text string"), df(own), df(far))).first()
    assert total["total"] == 0 and total["matched_fraction"] == 0


def test_validation(spark):
    cols = "pos int, doi string, title string, author string, year string, container string, volume string, issue string, pages string"
    entries = spark.createDataFrame([(1, "https://doi.org/10.1/A", "Big Idea", "Müller", "2020", "Phys. Rev. B", "1", None, "5–9"), (2, "10.1/b", "Big", "Lee", "2020", None, None, None, None), (3, "10.1/none", "t", "a", "1", None, None, None, None), (4, None, "t", "a", "1", None, None, None, None), (5, "10.1/c", None, None, None, None, None, None, None)], cols)
    canon = spark.createDataFrame([("10.1/a", "big  idea", "Muller", " 2020", "Physical Review B", "1 ", "3", "5"), ("10.1/b", "Other words", "Lie", "2021", "x", "1", "1", "1"), ("10.1/c", "t", "a", "1", "c", "1", "1", "1")], cols.replace("pos int, ", ""))
    got = {r["pos"]: (r["status"], {c["field"]: c["ok"] for c in r["checks"]}) for r in validation.validate(entries, canon).collect()}
    assert got[1] == ("verified", {"title": True, "authors": True, "year": True, "journal": True, "volume": True, "pages": True})
    assert got[2] == ("mismatch", {"title": False, "authors": False, "year": False})
    assert [got[i][0] for i in (3, 4, 5)] == ["dead_doi", "unverifiable", "verified"]


def test_breaker(spark):
    rows = [(1, i, k) for i, k in enumerate("FSFFSF")] + [(2, 0, "F"), (2, 1, "S"), (2, 2, "F")]
    got = validation.breaker(spark.createDataFrame(rows, "g int, i int, k string"), "g", ["i"], F.col("k") == "F").orderBy("g", "i").collect()
    assert [r["skipped"] for r in got] == [False] * 4 + [True, True] + [False] * 3
    assert [r["streak"] for r in got][:6] == [1, 0, 1, 2, 0, 1]


def test_structure(spark):
    texts = ["Intro", "II. Results", "3.1.1.1 Deep", "3. lower case", "ALL CAPS", "Not one.", "x" * 61, "1. Methods"]
    got = one(spark, structure.section_heading, *texts)
    assert [tuple(x) if x else None for x in got] == [None, ("Results", 1), ("Deep", 3), None, ("ALL CAPS", 1), None, None, ("Methods", 1)]
    p = spark.createDataFrame([(1, 0, "Abstract:", False), (1, 1, "We did", False), (1, 2, "things.", False), (1, 3, "Keywords: a; b,", False), (1, 4, "* Correspond: x@y.org", False), (1, 5, "5. References:", False), (1, 6, "[4]Giles", True), (1, 7, " ", True), (1, 8, "no number", True), (1, 9, "3.14 is pi", False), (2, 0, "text", False)], "doc_id int, pos int, text string, auto boolean")
    assert [(r["number"], r["text"]) for r in structure.reference_list(p).orderBy("pos").collect()] == [(4, "Giles"), (2, "no number"), (None, "3.14 is pi")]
    assert structure.abstract(p).first()["abstract"] == "We did things." and structure.keywords(p).first()["keywords"] == ["a", "b"]
    assert structure.corresponding_email(p).first()["email"] == "x@y.org"
    b = spark.createDataFrame([(1, 0, "table", ""), (1, 1, "para", "Table II. Values"), (1, 2, "table", "own"), (1, 3, "para", "Table 3: kept")], "doc_id int, pos int, kind string, text string")
    assert [(r["pos"], r["caption"]) for r in structure.table_captions(b).orderBy("pos").collect()] == [(0, "Values"), (2, "own"), (3, None)]


def test_grid_and_groups(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1, 2, "a"), (1, 0, 1, 2, 1, "b"), (1, 1, 0, 1, 1, "c")], "table int, row int, i int, colspan int, rowspan int, text string")
    assert sorted((r["row"], r["col"], r["text"], r["carried"]) for r in groups.grid(cells).collect()) == [(0, 0, "a", False), (0, 1, "b", False), (0, 2, "b", False), (1, 0, "a", True), (1, 1, "c", False)]
    rows = spark.createDataFrame([(1, i, k, n) for i, (k, n) in enumerate([("x", "A"), ("x", "B"), (None, "C"), (None, "D"), ("x", "E")])], "doc_id int, pos int, aff string, name string")
    assert [(r["aff"], r["names"]) for r in groups.consecutive(rows, "aff", "name").orderBy("grp").collect()] == [("x", ["A", "B"]), (None, ["C", "D"]), ("x", ["E"])]
    assert [(r["aff"], r["names"]) for r in groups.by_first_appearance(rows, "aff", "name").orderBy("grp").collect()] == [("x", ["A", "B", "E"]), (None, ["C", "D"])]


def test_privacy(spark):
    rng = random.Random(2)
    box = lambda n: [(rng.randrange(2), float(x := rng.randrange(200)), float(y := rng.randrange(200)), float(x + rng.randrange(90)), float(y + rng.randrange(90))) for _ in range(n)]
    a, b = box(40), box(25)
    form = "page int, x0 double, y0 double, x1 double, y1 double"
    got = {tuple(r) for r in privacy.overlapping(spark.createDataFrame(a, form), spark.createDataFrame(b, form), "page").collect()}
    assert got == {p for p in a if any(p[0] == q[0] and p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4] for q in b)}
    m = [("ok", 1, "a.xml", 10, 5, False), ("enc", 1, "a", 1, 1, True), ("dup", 1, "A/b", 1, 1, False), ("dup", 2, "a\\B", 1, 1, False), ("up", 1, "x/../y", 1, 1, False), ("drive", 1, "c:y", 1, 1, False), ("bomb", 1, "a", 5_000_000, 5000, False)]
    got = {r["archive"]: r["verdict"] for r in privacy.archive_guard(spark.createDataFrame(m, "archive string, no int, name string, size bigint, csize bigint, encrypted boolean")).collect()}
    assert got == {"ok": "ok", "enc": "encrypted", "dup": "duplicate", "up": "unsafe_name", "drive": "unsafe_name", "bomb": "ratio"}
    props = spark.createDataFrame([(1, "creator", "Ann"), (1, "TotalTime", "0"), (1, "other", "x")], "doc_id int, name string, value string")
    assert [r["category"] for r in privacy.property_findings(props).collect()] == ["author"]


def test_render(spark):
    form = "entry_type string, key string, source string, title string, container string, publisher string, year string, volume string, issue string, pages string, doi string, url string, isbn string"
    rows = [("article", "k", "bibfile", "The pH", "J & K", None, "2020", "1", "2", "3-4", "10.1/a_b", None, None), ("misc", "r", "raw", "Lee, A. Title, J 3 (2015).", None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, form).withColumn("authors", F.when(F.col("key") == "k", N.from_text(F.lit("Poe, Ed; Acme"))).otherwise(F.array().cast(f"array<{N.NAME}>")))
    bib, line = zip(*((r[0], r[1]) for r in df.select(render.to_bibtex(), render.reference_text()).collect()))
    assert bib[0] == "@article{k,\n  author = {Poe, Ed and Acme},\n  title = {The {pH}},\n  journal = {J \\& K},\n  year = {2020},\n  volume = {1},\n  number = {2},\n  pages = {3--4},\n  doi = {10.1/a\\_b}\n}\n"
    assert bib[1] == "@misc{r,\n  title = {{Lee, A. Title, J 3}},\n  year = {2015}\n}\n"
    assert line[0] == "Poe, E., Acme (2020) The pH. J & K, 1(2), 3-4. https://doi.org/10.1/a_b" and line[1] == rows[1][3]


def test_bibtex():
    text = '@string{np = "Nature Physics"}\n@comment{x}\n@Article{k1, title={A {B}ig, idea}, journal = np, author="Lee, A and Bo Poe and others", year = {May 2020}, doi={https://doi.org/10.1/x}, title={no}}\n@book(k2, title={T (x)}, date={1999-01})\n@misc{, title={keyless}}\n@misc{open, title={x'
    a, b = references.parse_bibtex(text)
    assert (a["key"], a["title"], a["container"], a["year"], a["doi"], a["entry_type"]) == ("k1", "A Big, idea", "Nature Physics", "2020", "10.1/x", "article")
    assert [(n["family"], n["given"], n["literal"]) for n in a["authors"]] == [("Lee", "A", ""), ("Poe", "Bo", ""), ("", "", "others")]
    assert (b["key"], b["title"], b["year"]) == ("k2", "T (x)", "1999") and references.parse_bibtex("nothing") == []


def test_other_formats(spark):
    (r,) = references.parse_nbib("PMID- 12\nTI  - A long\n      title\nAU  - Van Lee AB\nDP  - 2019 Jan\nAID - x [pii]\nAID - 10.1/z [doi]\nTA  - J\n\nTI  - without id\n")
    assert (r["title"], r["doi"], r["year"], r["container"], r["authors"][0]["family"]) == ("A long title", "10.1/z", "2019", "J", "Van Lee")
    with pytest.raises(ValueError):
        references.parse_nbib("no tags here")
    with pytest.raises(ValueError):
        references.parse_endnote_xml('<!DOCTYPE x [<!ENTITY a "b">]><x/>')
    field = "ADDIN EN.CITE &lt;EndNote&gt;&lt;Cite&gt;&lt;record&gt;&lt;rec-number&gt;7&lt;/rec-number&gt;&lt;titles&gt;&lt;title&gt;T&lt;/title&gt;&lt;/titles&gt;&lt;/record&gt;&lt;/Cite&gt;&lt;/EndNote&gt;"
    assert [x["raw_id"] for x in references.parse_endnote_field(field)] == ["7"] and references.parse_endnote_field("ADDIN EN.CITE <EndNote><x></EndNote>") == []
    b = "http://schemas.openxmlformats.org/officeDocument/2006/bibliography"
    src = f'<b:Sources xmlns:b="{b}"><b:Source><b:Tag>T1</b:Tag><b:SourceType>Book</b:SourceType><b:Title>X</b:Title><b:Author><b:Author><b:NameList><b:Person><b:Last>Lee</b:Last><b:First>A</b:First></b:Person></b:NameList></b:Author></b:Author></b:Source><b:Source><b:Title>no tag</b:Title></b:Source></b:Sources>'
    assert [(x["raw_id"], x["entry_type"], x["authors"][0]["given"]) for x in references.parse_word_sources(src)] == [("T1", "book", "A")]
    assert one(spark, references.word_tags, r"CITATION A \l 1033 \m B \p 4 \m C", r"CITATION \l 1 \m Z", "OTHER x") == [["A", "B", "C"], ["Z"], []]
    assert one(spark, references.classify_marker, "ADDIN ZOTERO_ITEM CSL_CITATION {}", "ADDIN CSL_CITATION {}", "citation x", "PAGE") == ["zotero", "mendeley", "wordnative", None]


def test_read_references(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@misc{k, title={T}}")
    (tmp_path / "b.json").write_text('[{"id": 5, "type": "book", "title": "J", "author": [{"family": "Lee"}], "issued": {"date-parts": [[2001, 2]]}}, 3]')
    (tmp_path / "c.xml").write_text("<broken")
    (tmp_path / "d.ris").write_text("TY  - JOUR")
    got = {(r["doc_id"].rsplit("/", 1)[1], r["key"], r["title"], r["year"], r["error"] is not None) for r in references.read_references(spark, str(tmp_path)).collect()}
    assert got == {("a.bib", "k", "T", None, False), ("b.json", "5", "J", "2001", False), ("c.xml", None, None, None, True)}


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    field = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
    body = f'<w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:rPr><w:sz w:val="32"/></w:rPr><w:t>Hello</w:t></w:r><w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>1</w:t></w:r></w:p><w:p>{field("begin")}<w:r><w:instrText>OUT </w:instrText></w:r>{field("begin")}<w:r><w:instrText>IN</w:instrText></w:r>{field("separate")}<w:r><w:t>x</w:t></w:r>{field("end")}{field("separate")}<w:r><w:t>res</w:t></w:r>{field("end")}</w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    rows = docx.read(spark, str(tmp_path)).collect()
    good = [r for r in rows if r["error"] is None]
    assert len(rows) == 3 and (good[0]["style_id"], good[0]["text"], good[0]["font_size"], good[0]["segments"][1]["superscript"]) == ("Title", "Hello1", 32, True)
    fields = [(r["instruction"], r["result_text"], r["depth"]) for r in docx.read(spark, str(tmp_path), "fields").where("error is null").collect()]
    assert fields == [("OUT ", "res", 0), ("IN", "x", 1)]
    assert [(r["colspan"], r["text"]) for r in docx.read(spark, str(tmp_path), "cells").where("error is null").collect()] == [(2, "c")]
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.docx"))
    assert privacy.archive_guard(docx.members(files)).first()["verdict"] == "ok"


def replay(rows, limit, window):
    hits, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        own = [h for h in hits.get(k, []) if h > t - window]
        out[i] = len(own) < limit
        hits[k] = own + [t] * out[i]
    return out


def test_rate_limit(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(4), float(rng.randrange(300))) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id bigint, key bigint, t double").select("event_id", "key", F.timestamp_seconds("t").alias("ts"))
    got = limits.rate_limit(df, 3, 60.0).collect()
    assert {r["event_id"]: r["allowed"] for r in got} == replay(rows, 3, 60.0)
    assert all((r["retry_after"] == 0) == r["allowed"] for r in got)


def test_streams(spark, tmp_path):
    """The stream's decisions and sessions are those of the batch form."""
    rows = [(i, i % 2, 1e6 + i * 7) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, key bigint, t double").select("event_id", "key", F.timestamp_seconds("t").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("limited", limits.rate_limit_stream(read(), 3, 60.0), "append"), ("sessions", limits.sessions_stream(read(), 10), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    assert {r["event_id"]: r["allowed"] for r in spark.table("limited").collect()} == replay(rows, 3, 60.0)
    form = lambda x: sorted((r["key"], r["n"], r["begin"]) for r in x.collect())
    assert form(spark.table("sessions")) == form(limits.sessions(df, 10).select("key", "n", "begin"))


def test_sessions_boundary(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 1, 120.0), (3, 1, 240.5)], "event_id int, key int, t double").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r["n"] for r in limits.sessions(df, 120).collect()) == [1, 2]
