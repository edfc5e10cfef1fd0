"""Anchors in converted text: figures and citations put in their places, for LaTeX, HTML and Markdown.

Texts are rows (ids, text). Each marker becomes a row, is joined with what it stands for, and put back;
so a text with very many markers is spread by the joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# How converted text marks figures and citations.
WRAPPED_FIGURE = r"(?s)\\begin\{figure\*?\}.*?%%FIGURE:(\d+)%%.*?\\end\{figure\*?\}"
BARE_FIGURE = r"(?is)%%FIGURE:(\d+)%%(?:[ \t]*\n[ \t]*\n[ \t]*(?:Figure|Fig\.?)\s*\1\s*[.:]?.*?(?=\n[ \t]*\n|\z))?"
HTML_FIGURE = r"(?is)(?:<p>\s*)?%%FIGURE:(\d+)%%(?:\s*</p>)?(?:\s*<p>\s*(?:Figure|Fig\.?)\s*\1\s*[.:]?.*?</p>)?"
CITATION = r"%%CITE:(\d+)%%"
SENTINEL = r"ZZLTXCITE(\d+)ZZ"
IN_TABLE_WIDTH = "3cm"
WEB_IMAGES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml"}


def substitute(texts: DataFrame, pattern: str, shown: Callable[[DataFrame], DataFrame], by: str) -> DataFrame:
    """Every match of the pattern through ``shown``, which adds ``new`` to rows of (by, c, plain, raw,
    number); null stays as it was. A text is cut into pieces once and put together once. -> by, text."""
    piece = F.arrays_zip(F.split("text", pattern).alias("plain"), F.regexp_extract_all("text", F.lit(pattern), 0).alias("raw"), F.regexp_extract_all("text", F.lit(pattern), 1).alias("number"))
    rows = texts.select(by, F.posexplode_outer(piece).alias("c", "p"))
    each = rows.select(by, "c", F.col("p.plain").alias("plain"), F.col("p.raw").alias("raw"), F.col("p.number").try_cast("int").alias("number"))
    put = F.concat("plain", F.when(F.col("raw").isNull(), "").otherwise(F.coalesce("new", "raw")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", put.alias("t")))), lambda x: x["t"]), "")
    return shown(each).groupBy(by).agg(F.when(F.max("c").isNotNull(), whole).alias("text"))


def figure_block(path: Column, caption: Column, env: Column) -> Column:
    label = F.when(F.coalesce(F.length(caption), F.lit(0)) > 0, F.concat(F.lit("\\caption{"), T.escape_latex(caption), F.lit("}\n"))).otherwise("")
    return F.concat(F.lit("\\begin{"), env, F.lit("}\n\\centering\n\\includegraphics[width=\\linewidth]{"), path, F.lit("}\n"), label, F.lit("\\end{"), env, F.lit("}"))


def place_figures(texts: DataFrame, figures: DataFrame, single: str = "figure", wide: str = "figure*", *, by: str = "doc_id") -> DataFrame:
    """figures: doc_id, number, path, caption, wide, in_table. An anchor with its own environment is
    replaced whole, a bare one with the caption paragraph that repeats its number. In a table cell there
    is no float; an anchor without a figure leaves a visible note."""

    def shown(each: DataFrame) -> DataFrame:
        one = F.when(F.col("in_table"), F.concat(F.lit(f"\\includegraphics[width={IN_TABLE_WIDTH}]{{"), "path", F.lit("}"))).otherwise(figure_block(F.col("path"), F.col("caption"), F.when(F.col("wide"), wide).otherwise(single)))
        number = F.col("number").cast("string")
        lost = F.concat(F.lit("% WARNING: no figure "), number, F.lit("\n\\textbf{[UNRESOLVED FIGURE "), number, F.lit("]}"))
        return each.join(figures, [by, "number"], "left").withColumn("new", F.when(F.col("path").isNull(), lost).otherwise(one))

    for pattern in (WRAPPED_FIGURE, BARE_FIGURE):
        texts = substitute(texts, pattern, shown, by)
    return texts


def strip_figures(text: Column) -> Column:
    """For a text without figures: their anchors and captions go, citations stay."""
    return F.regexp_replace(F.regexp_replace(text, WRAPPED_FIGURE, ""), BARE_FIGURE, "")


def place_citations(texts: DataFrame, citations: DataFrame, *, by: str = "doc_id") -> DataFrame:
    r"""citations: doc_id, index (from 0), keys -> \cite commands. A portable anchor counts from 1, a
    sentinel from 0; one without keys leaves a visible note."""
    known = citations.where(F.size("keys") > 0).select(by, F.col("index").cast("int").alias("number"), F.array_join("keys", ",").alias("keys"))

    def shown(shift: int):
        def put(each: DataFrame) -> DataFrame:
            found = each.withColumn("number", F.col("number") - shift).join(known, [by, "number"], "left")
            lost = F.concat(F.lit("% WARNING: no citation "), (F.col("number") + shift).cast("string"), F.lit("\n\\textbf{[UNRESOLVED CITATION]}"))
            return found.withColumn("new", F.coalesce(F.concat(F.lit("\\cite{"), "keys", F.lit("}")), lost))

        return put

    return substitute(substitute(texts, CITATION, shown(1), by), SENTINEL, shown(0), by)


def resolve(texts: DataFrame, figures: DataFrame | None, citations: DataFrame, *, by: str = "doc_id") -> DataFrame:
    """All anchors of LaTeX texts; without figures theirs are removed."""
    own = texts.select(by, strip_figures(F.col("text")).alias("text")) if figures is None else place_figures(texts, figures, by=by)
    return place_citations(own, citations, by=by)


def unresolved(texts: DataFrame, figures: DataFrame, citations: DataFrame, *, by: str = "doc_id") -> DataFrame:
    """doc_id, what (figure, citation), number: the anchors that nothing stands for, once each."""
    all_of = lambda pattern, what, shift: texts.select(by, F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("n")).select(by, F.lit(what).alias("what"), F.col("n").try_cast("int").alias("number"), (F.col("n").try_cast("int") - shift).alias("_at"))
    lost_figures = all_of(r"%%FIGURE:(\d+)%%", "figure", 0).join(figures.select(by, F.col("number").alias("_at")), [by, "_at"], "left_anti")
    known = citations.where(F.size("keys") > 0).select(by, F.col("index").cast("int").alias("_at"))
    lost_citations = all_of(CITATION, "citation", 1).union(all_of(SENTINEL, "citation", 0)).join(known, [by, "_at"], "left_anti")
    return lost_figures.unionByName(lost_citations).select(by, "what", "number").distinct()


# Portable forms ---------------------------------------------------------------------------------------


def cited_numbers(citations: DataFrame, references: DataFrame, *, by: str = "doc_id") -> DataFrame:
    """citations: doc_id, index, keys; references: doc_id, key, number -> doc_id, index, numbers: those of
    the keys in their order, once each, keys without a reference left out."""
    each = citations.select(by, "index", F.posexplode("keys").alias("_i", "key")).join(references.select(by, "key", "number"), [by, "key"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_i", "number"))), lambda x: x["number"])
    return each.groupBy(by, "index").agg(F.array_distinct(ordered).alias("numbers"))


def citation_mark(numbers: Column, form: str) -> Column:
    one = (lambda n: F.concat(F.lit('<a href="#ref-'), n, F.lit('">'), n, F.lit("</a>"))) if form == "html" else (lambda n: n)
    return F.concat(F.lit("["), F.array_join(F.transform(numbers, lambda n: one(n.cast("string"))), ","), F.lit("]"))


def escape_html(x: Column) -> Column:
    for c, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(c), F.lit(ref))
    return x


def data_uri(path: Column, content: Column) -> Column:
    """The bytes of an image that browsers show, as a data URI; null for other formats."""
    kind = T.lookup(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), WEB_IMAGES)
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def figure_mark(form: str) -> Column:
    """From number, caption, path, and uri (HTML: null if it can't be embedded)."""
    number, caption = F.col("number").cast("string"), F.coalesce("caption", F.lit(""))
    if form == "markdown":
        label = F.when(caption != "", caption).otherwise(F.concat(F.lit("Figure "), number))
        return F.when(F.col("path").isNull(), F.concat(F.lit("*[figure "), number, F.lit(" is not included: "), label, F.lit("]*"))).otherwise(F.concat(F.lit("!["), label, F.lit("]("), "path", F.lit(")")))
    ext = F.coalesce(F.nullif(F.regexp_extract("path", r"(\.[^./]+)$", 1), F.lit("")), F.lit("unknown format"))
    body = F.when(F.col("uri").isNull(), F.concat(F.lit("<p><em>[figure "), number, F.lit(" ("), ext, F.lit(") is not embedded]</em></p>"))).otherwise(F.concat(F.lit('<img src="'), "uri", F.lit('" alt="Figure '), number, F.lit('" />')))
    below = F.when(caption != "", F.concat(F.lit("<figcaption>"), escape_html(caption), F.lit("</figcaption>"))).otherwise("")
    return F.concat(F.lit('<figure id="fig-'), number, F.lit('">'), body, below, F.lit("</figure>"))


def place_portable(texts: DataFrame, figures: DataFrame, numbers: DataFrame, form: str, *, by: str = "doc_id") -> DataFrame:
    """HTML or Markdown texts with their markers resolved. figures: doc_id, number, path, caption, uri;
    numbers: as of cited_numbers. A citation without a reference reads [?]."""

    def cite(shift: int):
        def put(each: DataFrame) -> DataFrame:
            found = each.withColumn("index", F.col("number") - shift).join(numbers.withColumn("index", F.col("index").cast("int")), [by, "index"], "left")
            return found.withColumn("new", F.when(F.coalesce(F.size("numbers"), F.lit(0)) > 0, citation_mark(F.col("numbers"), form)).otherwise("[?]"))

        return put

    def figure(each: DataFrame) -> DataFrame:
        found = each.join(figures.withColumn("_known", F.lit(True)), [by, "number"], "left")
        lost = F.concat(F.lit("[UNRESOLVED FIGURE "), F.col("number").cast("string"), F.lit("]"))
        return found.withColumn("new", F.when(F.col("_known"), figure_mark(form)).otherwise(lost))

    texts = substitute(substitute(texts, SENTINEL, cite(0), by), CITATION, cite(1), by)
    return substitute(texts, HTML_FIGURE if form == "html" else BARE_FIGURE, figure, by)


def assemble(body: Column, references: Column, form: str) -> Column:
    """A document and its reference list (null or empty: none): before </body> in HTML, at the end else."""
    own = F.coalesce(references, F.lit(""))
    if form == "markdown":
        return F.when(own == "", body).otherwise(F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit("\n\n"), own))
    at = F.locate("</body>", body)
    inside = F.concat(F.substring(body, F.lit(1), at - 1), own, F.lit("\n"), F.substring(body, at, F.length(body)))
    return F.when(own == "", body).when(at > 0, inside).otherwise(F.concat(body, F.lit("\n"), own))


#: Exporters by name: form and ending of the written files.
EXPORTERS = {"html": ".html", "markdown": ".md"}


def export(texts: DataFrame, figures: DataFrame, citations: DataFrame, references: DataFrame, form: str, *, by: str = "doc_id") -> DataFrame:
    """doc_id, text: whole documents with figures, citations and their reference lists. references:
    doc_id, pos, key and what reference_text reads."""
    from pyspark.sql import Window

    from .render import reference_list

    if form not in EXPORTERS:
        raise ValueError(f"unknown form {form}")
    numbered = references.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy("pos")))
    placed = place_portable(texts, figures, cited_numbers(citations, numbered, by=by), form, by=by)
    lists = reference_list(references, form, by).withColumnRenamed("text", "_refs")
    return placed.join(lists, by, "left").select(by, assemble(F.col("text"), F.col("_refs"), form).alias("text"))
