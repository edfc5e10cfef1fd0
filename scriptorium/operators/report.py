"""Reports: sections of findings, references, figures, compilation and warnings, as Markdown.

Each section is a table of lines (doc_id, section, line_no, line); a report is their union, so a document
with very many findings is one ordered aggregation at the end and nothing before it is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import render

#: The sections in their order, and how severities and statuses are ranked.
SECTIONS = ("Preflight Findings", "Citation Extraction", "Reference Validation", "Figures", "Compilation", "Warnings", "Supplement")
SEVERITY_RANK = {"error": 0, "warn": 1, "info": 2}
STATUS_RANK = {"dead_doi": 0, "mismatch": 1, "doi_suggested": 2, "unverifiable": 3}
NO_NUMBER, RAW_TAIL = 999_999, 20
STATUS_MARKS = {"mismatch": "field mismatch", "dead_doi": "DOI not found", "doi_suggested": "DOI suggested", "unverifiable": "no DOI and no sure match"}


def flatten(x: Column) -> Column:
    """Line breaks as one space each, so that a record stays one line."""
    return F.regexp_replace(x, r"\r\n|\r|\n", " ")


def _rank(x: Column, ranks: dict[str, int], other: int = 9) -> Column:
    return F.coalesce(F.create_map(*(F.lit(y) for kv in ranks.items() for y in kv))[x], F.lit(other))


def _section(rows: DataFrame, section: str, line: Column, *order) -> DataFrame:
    """The rows as lines of a section, in the order given."""
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return rows.select("doc_id", F.lit(SECTIONS.index(section)).alias("section"), no.alias("line_no"), line.alias("line"))


def preflight(findings: DataFrame) -> DataFrame:
    """findings: doc_id, severity (error, warn, info), detector, paragraph (-1: of the whole document),
    snippet, message; worst first, then by paragraph."""
    place = F.when(F.col("paragraph") >= 0, F.concat(F.lit("paragraph "), F.col("paragraph").cast("string"))).otherwise("document")
    line = F.concat(F.lit("**["), F.upper("severity"), F.lit("]** ("), "detector", F.lit(", "), place, F.lit("): "), flatten(F.col("message")), F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit("\n> "), flatten(F.col("snippet")))).otherwise(""))
    return _section(findings, "Preflight Findings", line, _rank(F.col("severity"), SEVERITY_RANK), "paragraph", "detector", "message")


def reconciliation(records: DataFrame) -> DataFrame:
    """records: doc_id, key, number, source, score, doi, title, verify; those to be verified first, then by
    number (without one last), then by key."""
    score = F.when(F.col("source") == "crossref", F.concat(F.lit("score="), F.format_number("score", 2)))
    more = F.array_join(F.array_compact(F.array(score, F.when(F.coalesce("doi", F.lit("")) != "", F.concat(F.lit("doi="), "doi")))), " ")
    line = F.concat(F.lit("- `"), "key", F.lit("` ("), "source", F.when(more != "", F.concat(F.lit(", "), more)).otherwise(""), F.lit(")"), F.when(F.col("verify"), " VERIFY").otherwise(""), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("\n  Title: "), flatten(F.col("title")))).otherwise(""))
    return _section(records, "Citation Extraction", line, ~F.col("verify"), F.coalesce("number", F.lit(NO_NUMBER)), "key")


def validation(records: DataFrame) -> DataFrame:
    """records: doc_id, key, status, doi, suggested_doi, checks (array of field, ours, canonical, ok): a
    summary, then the flagged ones, worst first, then by key. Nothing checked is said so."""
    summary = render.validation_summary(records).join(records.groupBy("doc_id").agg(F.bool_or(F.col("status") != "unchecked").alias("any"), F.bool_or(F.col("status").isin(*STATUS_RANK)).alias("bad")), "doc_id")
    first = F.when(~F.col("any"), F.lit("_Not reachable_: no reference was checked.")).when(F.col("bad"), F.col("line")).otherwise(F.concat("line", F.lit("\nAll references are as registered.")))
    head = summary.select("doc_id", F.lit(2).alias("section"), F.lit(0).alias("line_no"), first.alias("line"))
    bad = F.filter("checks", lambda x: F.coalesce(~x["ok"], F.lit(False)))
    details = F.array_join(F.transform(bad, lambda x: F.concat(F.lit("\n  - "), x["field"], F.lit(': ours "'), flatten(F.coalesce(x["ours"], F.lit(""))), F.lit('", registered "'), flatten(F.coalesce(x["canonical"], F.lit(""))), F.lit('"'))), "")
    label = F.create_map(*(F.lit(y) for kv in STATUS_MARKS.items() for y in kv))[F.col("status")]
    more = F.when((F.col("status") == "dead_doi") & (F.coalesce("doi", F.lit("")) != ""), F.concat(F.lit(" (`"), "doi", F.lit("`)"))).when((F.col("status") == "doi_suggested") & (F.coalesce("suggested_doi", F.lit("")) != ""), F.concat(F.lit(": add `"), "suggested_doi", F.lit("`"))).otherwise("")
    flagged = _section(records.where(F.col("status").isin(*STATUS_RANK)), "Reference Validation", F.concat(F.lit("- `"), "key", F.lit("`: "), label, more, F.coalesce(details, F.lit(""))), _rank(F.col("status"), STATUS_RANK), "key")
    return head.unionByName(flagged)


def figures(rows: DataFrame) -> DataFrame:
    """rows: doc_id, number, source, note, caption; by number."""
    line = F.concat(F.lit("**Fig "), F.col("number").cast("string"), F.lit("** ("), F.upper("source"), F.lit(")"), F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(": "), flatten(F.col("note")))).otherwise(""), F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit("\n> "), flatten(F.col("caption")))).otherwise(""))
    return _section(rows, "Figures", line, "number")


def compilation(results: DataFrame, diagnostics: DataFrame, logs: DataFrame, section: str = "Compilation") -> DataFrame:
    """results: doc_id, label, success; diagnostics: doc_id, severity, file, line, message; logs: doc_id,
    line_no, text. The outcome; then diagnostics, errors first, by file and line; a failure without any
    shows the last lines of the log."""
    at = SECTIONS.index(section)
    head = results.select("doc_id", F.lit(at).alias("section"), F.lit(0).alias("line_no"), F.concat(F.lit("**"), "label", F.lit(":** "), F.when(F.col("success"), "compiled without errors").otherwise("failed")).alias("line"))
    place = F.when(F.coalesce("file", F.lit("")) != "", F.concat(F.lit(" ("), "file", F.when(F.col("line") > 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""), F.lit(")"))).otherwise("")
    text = F.concat(F.lit("**["), F.upper("severity"), F.lit("]"), place, F.lit(":** "), flatten(F.col("message")))
    found = _section(diagnostics, section, text, F.when(F.col("severity") == "error", 0).otherwise(1), F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), "message")
    silent = results.where("not success").join(diagnostics.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id")
    back = Window.partitionBy("doc_id").orderBy(F.desc("line_no"))
    tail = logs.join(silent, "doc_id", "left_semi").where("trim(text) <> ''").withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= RAW_TAIL)
    raw = tail.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("t"))
    said = silent.join(raw, "doc_id", "left").select("doc_id", F.lit(at).alias("section"), F.lit(1).alias("line_no"), F.coalesce(F.concat(F.lit("```text\n"), "t", F.lit("\n```")), F.lit("No diagnostics.")).alias("line"))
    return head.unionByName(found).unionByName(said)


def warnings(rows: DataFrame, section: str = "Warnings") -> DataFrame:
    """rows: doc_id, message; in the order of their texts."""
    return _section(rows.withColumn("_m", flatten(F.col("message"))), section, F.concat(F.lit("- "), "_m"), "_m")


def whole(docs: DataFrame, *sections: DataFrame) -> DataFrame:
    """doc_id, text: a report of all sections for each document; a section without lines says so."""
    lines = sections[0]
    for more in sections[1:]:
        lines = lines.unionByName(more)
    each = lines.groupBy("doc_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    names = F.array(*map(F.lit, SECTIONS))
    all_ = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(len(SECTIONS) - 1))).alias("section")).join(each, ["doc_id", "section"], "left")
    part = F.concat(F.lit("## "), F.get(names, F.col("section")), F.lit("\n\n"), F.coalesce("body", F.lit("_None_")), F.lit("\n"))
    return all_.groupBy("doc_id").agg(F.concat(F.lit("# Conversion Report\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", part.alias("p")))), lambda x: x["p"]), "\n")).alias("text"))


def check_warnings(records: DataFrame) -> DataFrame:
    """doc_id, message: of validation records (doc_id, status), whether all or some went unchecked."""
    n = records.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "unchecked").alias("k")).where("k > 0")
    some = F.concat(F.col("k").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" references were not checked"))
    return n.select("doc_id", F.when(F.col("k") == F.col("n"), "no reference could be checked").otherwise(some).alias("message"))


def verify_warnings(records: DataFrame) -> DataFrame:
    """doc_id, message: one for each reconciled record that is to be verified, with its score."""
    return records.where("verify").select("doc_id", F.concat(F.lit("reference "), "key", F.lit(" has no sure match (best "), F.format_string("%.2f", F.col("score").cast("double")), F.lit(")")).alias("message"))


def unchecked_reason(note: Column, most: int = 120) -> Column:
    """A note of at most ``most`` characters, its cut marked."""
    return F.when(F.length(note) > most, F.concat(F.left(note, F.lit(most - 3)), F.lit("..."))).otherwise(note)


def equation_audit(audit: DataFrame) -> DataFrame:
    """audit: doc_id, index, raw, converted, mismatch (of a positional join) -> doc_id, text: counts and a
    line for each equation, as Markdown."""
    side = lambda c: F.when(F.col(c).isNull(), "_missing_").otherwise(F.concat(F.lit("`"), flatten(F.col(c)), F.lit("`")))
    line = F.concat(F.lit("| "), (F.col("index") + 1).cast("string"), F.lit(" | "), side("raw"), F.lit(" | "), side("converted"), F.lit(" | "), F.when(F.col("mismatch"), "check").otherwise("ok"), F.lit(" |"))
    each = audit.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("mismatch").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    head = F.concat(F.lit("# Equations\n\n"), F.col("n").cast("string"), F.lit(" equation(s), "), F.col("k").cast("string"), F.lit(" to check.\n\n| # | source | converted | state |\n|-|-|-|-|\n"))
    return each.select("doc_id", F.concat(head, "lines", F.lit("\n")).alias("text"))


def status_of(errors: Column, warnings_: Column, compiled: Column) -> Column:
    """Of a converted document: error, warning (any warning, or a failed compilation) or ok."""
    return F.when(errors.isNotNull(), "error").when((warnings_ > 0) | ~F.coalesce(compiled, F.lit(True)), "warning").otherwise("ok")
