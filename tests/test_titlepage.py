"""Title pages, body markers and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium import queries
from scriptorium.functions import names as N
from scriptorium.functions import text as T
from scriptorium.operators import markers, render, titlepage


def pages(spark, *docs):
    rows = []
    for d, paragraphs in enumerate(docs):
        for pos, p in enumerate(paragraphs):
            style, size, *segments = p
            rows.append((d, pos, style, size, "".join(t for t, _ in segments), segments))
    return spark.createDataFrame(rows, "doc_id int, pos int, style_id string, font_size int, text string, segments array<struct<text:string,superscript:boolean>>")


def test_title_page(spark):
    n = lambda t: (None, 20, (t, False))
    one = [("Title", 30, ("My paper", False)), n(" "), (None, 20, ("Ann Lee", False), ("1,*", True), (", Bo Poe", False), ("2", True), (" and Cy", False), ("1,2", True)), (None, 20, ("2", True), ("Second place", False)), (None, 20, ("1", True), (" First place", False)), n("* Correspond: a@b.org"), n("Abstract"), n("text")]
    two = [n("small"), (None, 40, ("Large one", False)), (None, 20, ("Dee", False), ("2", True), ("; Eve", False), ("1", True)), n("Place A"), n("Place B"), n("Keywords: x")]
    three = [n("T"), (None, 20, ("Al", False), ("b", True), (" & Bea", False), ("a", True)), n("P"), n("Q")]
    p = pages(spark, one, two, three)
    t = titlepage.titles(p)
    assert {r["doc_id"]: (r["title"], r["guessed"]) for r in t.collect()} == {0: ("My paper", False), 1: ("Large one", True), 2: ("T", True)}
    a = titlepage.authors(p, t)
    places = titlepage.affiliations(p, a)
    assert [(r["marker"], r["text"]) for r in places.where("doc_id = 0").orderBy("i").collect()] == [("2", "Second place"), ("1", "First place")]
    got = {(r["doc_id"], r["name"]): (r["affiliations"], r["corresponding"]) for r in titlepage.link(a, places).collect()}
    assert got == {(0, "Ann Lee"): ([1], True), (0, "Bo Poe"): ([0], False), (0, "Cy"): ([1, 0], False), (1, "Dee"): ([1], False), (1, "Eve"): ([0], False), (2, "Al"): ([0], False), (2, "Bea"): ([1], False)}


def test_title_page_broadcasts_nothing(spark, sf):
    """All its sides grow with the documents, and the planner guesses exploded rows far too small."""
    plan = queries.q52_title_page(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_link_numeric(spark):
    numbered = spark.createDataFrame([(i, i, f"k{i}") for i in range(1, 5)], "number int, pos int, key string")
    texts = [(1, r"A\textsuperscript{1} \section{I} see {[}1{]}--{[}3{]}, {[}9{]} and {[}110{]}.\textsuperscript{2}--\textsuperscript{4}"), (2, "none"), (3, r"no section\textsuperscript{2, 2}{[}4{]}")]
    got = {r["id"]: r["text"] for r in markers.link_numeric(spark.createDataFrame(texts, "id int, text string"), numbered, "id").collect()}
    assert got == {1: r"A\textsuperscript{1} \section{I} see \cite{k1,k2,k3}, {[}9{]} and {[}110{]}.\cite{k2,k3,k4}", 2: "none", 3: r"no section\cite{k2}\cite{k4}"}


def test_strip(spark):
    text = "\\section{One}\nbody\n\\section*{Acknowledgements}\nthanks\nall\n\\section{Two}\nx \\begin{acknowledgments}y\\end{acknowledgments}\n\\section{References}\n[1] z\n\\appendix"
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(markers.strip_acknowledgements(F.col("t")), markers.strip_reference_section(F.col("t"), "|".join(T.HEADING_KEYWORDS))).first()
    assert r[0] == "\\section{One}\nbody\n\\section{Two}\nx\\section{References}\n[1] z\n\\appendix"
    assert r[1].endswith("\\end{acknowledgments}\n") and "[1]" not in r[1]


def test_reports(spark):
    records = spark.createDataFrame([(1, "verified"), (1, "dead_doi"), (1, "verified")], "doc_id int, status string")
    assert render.validation_summary(records).first()["line"] == "Checked 3 reference(s): 2 verified, 1 dead DOI."
    form = "doc_id int, pos int, entry_type string, key string, source string, title string, container string, publisher string, year string, volume string, issue string, pages string, doi string, url string, isbn string"
    rows = [(1, p, "misc", k, "bibfile", t, *[None] * 8, None) for p, k, t in ((2, "b", "B <x>"), (1, "a", "A"))]
    refs = spark.createDataFrame([r[:15] for r in rows], form).withColumn("authors", F.array().cast(f"array<{N.NAME}>"))
    assert render.bibliography(refs).first()["bib"] == "@misc{a,\n  title = {A}\n}\n\n@misc{b,\n  title = {B <x>}\n}\n"
    assert render.reference_list(refs).first()["text"] == "## References\n\n1. A.\n2. B <x>.\n"
    assert render.reference_list(refs, "html").first()["text"] == '<section id="references"><h2>References</h2><ol><li id="ref-1">A.</li><li id="ref-2">B &lt;x&gt;.</li></ol></section>'


def test_link_author_year(spark):
    index = spark.createDataFrame([("smith", "2020", ["k1", "k2"]), ("lee", "2004", ["k3"])], "surname string, year string, keys array<string>")
    texts = [(1, r"(Smith et al., 2020) (Poe, 1999) \{Lee, 2004 \#78\}\{Smith, 2020 \#9\} \{Lee, 2004 \#78\}\{Lee, 2004 \#78\}"), (2, "none")]
    got = {r["id"]: r["text"] for r in markers.link_author_year(spark.createDataFrame(texts, "id int, text string"), index, "id").collect()}
    assert got == {1: r"\cite{k1,k2} (Poe, 1999) \cite{k3,k1,k2} \cite{k3}", 2: "none"}
