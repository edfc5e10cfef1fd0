"""BibTeX records and readable reference lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T

CONTAINER_FIELD = {"article": "journal", "inproceedings": "booktitle", "incollection": "booktitle", "inbook": "booktitle"}


def _has(x: Column) -> Column:
    return F.coalesce(F.length(x) > 0, F.lit(False))


def to_bibtex() -> Column:
    """From columns entry_type, key, source, authors, title, container, publisher, year, volume, issue,
    pages, doi, url, isbn. A raw record is its whole text in double braces, a year at its end lifted."""
    c = F.col
    line = lambda name, x, has=None: F.when(_has(x) if has is None else has, F.concat(F.lit("  "), name if isinstance(name, Column) else F.lit(name), F.lit(" = {"), x, F.lit("}")))
    container = T.lookup(c("entry_type"), CONTAINER_FIELD)
    fields = F.array(
        line("author", N.to_bibtex(c("authors")), F.coalesce(F.size("authors") > 0, F.lit(False))),
        line("title", T.protect_title(c("title"))),
        line(container, T.escape_latex(c("container")), _has(c("container")) & container.isNotNull()),
        line("publisher", T.escape_latex(c("publisher"))),
        line("year", T.escape_latex(c("year"))),
        line("volume", T.escape_latex(c("volume"))),
        line("number", T.escape_latex(c("issue"))),
        line("pages", T.format_pages(c("pages"))),
        line("doi", T.escape_doi(c("doi"))),
        line("url", c("url")),
        line("isbn", T.escape_latex(c("isbn"))),
    )
    pattern = r"[\s,]*\(?\s*((?:18|19|20)\d{2})[a-z]?\s*\)?\.?\s*$"
    whole = F.trim(F.coalesce(c("title"), F.lit("")))
    year = F.nullif(F.regexp_extract(whole, pattern, 1), F.lit(""))
    text = F.when(year.isNotNull(), F.rtrim(F.regexp_replace(whole, pattern, ""))).otherwise(whole)
    raw = F.array(F.when(whole != "", F.concat(F.lit("  title = {{"), T.escape_latex(text), F.lit("}}"))), line("year", year))
    body = F.array_join(F.array_compact(F.when(c("source") == "raw", raw).otherwise(fields)), ",\n")
    return F.concat(F.lit("@"), c("entry_type"), F.lit("{"), c("key"), F.lit(",\n"), body, F.lit("\n}\n"))


def reference_text() -> Column:
    """One readable line: authors (year) title. container, volume(issue), pages. doi or url."""
    c = F.col
    volume = F.when(_has(c("issue")), F.concat(F.coalesce("volume", F.lit("")), F.lit("("), c("issue"), F.lit(")"))).otherwise(c("volume"))
    tail = F.array_join(F.filter(F.array("container", volume, "pages"), lambda x: F.length(x) > 0), ", ")
    parts = F.array(
        F.when(F.size("authors") > 0, N.plain(c("authors"))),
        F.when(_has(c("year")), F.concat(F.lit("("), c("year"), F.lit(")"))),
        F.when(_has(c("title")), F.concat(F.regexp_replace("title", r"\.+$", ""), F.lit("."))),
        F.when(tail != "", F.concat(tail, F.lit("."))),
        F.when(_has(c("doi")), F.concat(F.lit("https://doi.org/"), c("doi"))).when(_has(c("url")), c("url")),
    )
    whole = F.trim(F.array_join(F.filter(F.array_compact(parts), lambda x: x != ""), " "))
    return F.coalesce(F.nullif(F.when(c("source") == "raw", F.trim(F.coalesce(c("title"), F.lit("")))).otherwise(whole), F.lit("")), c("key"))


#: How reports name a status, in their order.
STATUS_LABELS = {"verified": "verified", "mismatch": "field mismatch", "dead_doi": "dead DOI", "doi_suggested": "DOI suggested", "unverifiable": "unverifiable", "unchecked": "unchecked (offline)"}


def validation_summary(records: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, line: how many references have which status, without empty ones."""
    counts = records.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUS_LABELS))
    parts = F.array_compact(F.array(*(F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {label}"))) for s, label in STATUS_LABELS.items())))
    return counts.select(by, F.concat(F.lit("Checked "), F.col("n").cast("string"), F.lit(" reference(s): "), F.array_join(parts, ", "), F.lit(".")).alias("line"))


def bibliography(refs: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, bib: the records of each document in order of position, joined by line breaks."""
    each = refs.select(by, "pos", to_bibtex().alias("b"))
    return each.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "\n").alias("bib"))


def reference_list(refs: DataFrame, form: str = "markdown", by: str = "doc_id") -> DataFrame:
    """by, text: a numbered list of readable references, as Markdown or HTML."""
    escape = lambda x: F.replace(F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    each = refs.select(by, "pos", reference_text().alias("t"))
    lines = each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]).alias("t"))
    no = lambda i: (i + 1).cast("string")
    if form == "markdown":
        body = F.concat(F.lit("## References\n\n"), F.array_join(F.transform("t", lambda t, i: F.concat(no(i), F.lit(". "), t)), "\n"), F.lit("\n"))
    else:
        body = F.concat(F.lit('<section id="references"><h2>References</h2><ol>'), F.array_join(F.transform("t", lambda t, i: F.concat(F.lit('<li id="ref-'), no(i), F.lit('">'), escape(t), F.lit("</li>"))), ""), F.lit("</ol></section>"))
    return lines.select(by, body.alias("text"))
