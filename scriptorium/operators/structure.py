"""Headings, reference lists, captions, title pages and other document structure, over paragraph rows
(doc_id, pos, text and flags)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Limits and patterns of headings and captions.
MAX_HEADING_TEXT, MAX_HEADING_LEVEL = 60, 3
REFERENCE_HEADING = r"(?i)^\s*(?:\d+\.?\s+)?(" + "|".join(T.HEADING_KEYWORDS) + r")\s*:?\s*$"
LIST_NUMBER = r"^\s*(?:\[(\d+)\]\s*|\((\d+)\)\s*|(\d+)[.)\]]\s+)"
FIGURE_LABEL = r"(?i)^(?:Supp(?:lement(?:al|ary)?|l)?\.?\s+)?(?:Figure|Fig\.?)\s*S?\s*(\d+)\s*[.:]?\s*(.*)$"
TABLE_LABEL = r"(?is)^Table\s+(?:[IVXLC]+|\d+)(?=[\s.:])\s*[.:]?\s*(.+)$"
ABSTRACT_HEADING = r"(?i)^abstract\s*[:.–—-]?\s*$"
KEYWORDS = r"(?i)^(?:keywords|key\s*words)\s*[:.]\s*(.*)$"


def section_heading(text: Column) -> Column:
    """struct(title, level), or null if the text doesn't read as a heading: roman or arabic numbering,
    or all capitals; up to 60 characters, no sentence or label mark at the end."""
    t = F.trim(text)
    roman, numbered = r"(?s)^[IVXLC]+\.\s+(\S.*)$", r"(?s)^(\d+(?:\.\d+)*)\.?\s+(\S.*)$"
    number, rest = F.regexp_extract(t, numbered, 1), F.regexp_extract(t, numbered, 2)
    level = F.least(F.length(number) - F.length(F.replace(number, F.lit("."))) + 1, F.lit(MAX_HEADING_LEVEL))
    made = lambda title, n: F.struct(F.trim(title).alias("title"), n.cast("int").alias("level"))
    shape = (
        F.when(F.rlike(t, F.lit(roman)), made(F.regexp_extract(t, roman, 1), F.lit(1)))
        .when(F.rlike(t, F.lit(numbered)) & F.rlike(rest, F.lit(r"^\p{Lu}")), made(rest, level))
        .when(F.rlike(t, F.lit(r"\p{Lu}")) & ~F.rlike(t, F.lit(r"[\p{L}&&[^\p{Lu}]]")), made(t, F.lit(1)))
    )
    return F.when((F.length(t) > 0) & (F.length(t) <= MAX_HEADING_TEXT) & ~F.rlike(t, F.lit(r"[.!?:;,]$")), shape)


def normalize_levels(headings: DataFrame) -> DataFrame:
    """The smallest level of a document becomes 1, others move with it and end at 3. Adds new_level and
    clamped."""
    shifted = F.col("level") - F.min("level").over(Window.partitionBy("doc_id")) + 1
    return headings.withColumn("new_level", F.least(F.greatest(shifted, F.lit(1)), F.lit(MAX_HEADING_LEVEL))).withColumn("clamped", shifted > MAX_HEADING_LEVEL)


def is_reference_heading(text: Column) -> Column:
    return F.rlike(text, F.lit(REFERENCE_HEADING)) & (F.length(F.trim(text)) <= 40)


def reference_list(paragraphs: DataFrame) -> DataFrame:
    """doc_id, pos, text, and auto (the word processor numbers it) -> the non-empty paragraphs after
    each document's first reference heading: doc_id, pos, number, text. A number typed at the start
    counts and is cut off; else the running count of numbered paragraphs, else null."""
    own = Window.partitionBy("doc_id")
    start = F.min(F.when(is_reference_heading(F.col("text")), F.col("pos"))).over(own)
    rows = paragraphs.withColumn("_start", start).where("pos > _start and trim(text) <> ''")
    typed = F.coalesce(*(F.nullif(F.regexp_extract("text", LIST_NUMBER, k), F.lit("")) for k in (1, 2, 3))).try_cast("int")
    running = F.sum(F.when(F.col("auto"), 1).otherwise(0)).over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("doc_id", "pos", F.coalesce(typed, F.when(F.col("auto"), running).cast("int")).alias("number"), F.trim(F.regexp_replace("text", LIST_NUMBER, "")).alias("text"))


def table_captions(blocks: DataFrame) -> DataFrame:
    """blocks: doc_id, pos, kind, text. A table without a caption takes the next block if that reads
    'Table N: ...'; the block goes. -> tables with their captions and the other blocks."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    label = lambda x: F.nullif(F.regexp_extract(x, TABLE_LABEL, 1), F.lit(""))
    taken = F.when((F.col("kind") == "table") & (F.coalesce("text", F.lit("")) == "") & (F.lead("kind").over(by) == "para"), label(F.lead("text").over(by)))
    rows = blocks.withColumn("caption", F.when(F.col("kind") == "table", F.coalesce(T.clean(F.col("text")), taken))).withColumn("_took", taken.isNotNull())
    return rows.withColumn("_gone", F.coalesce(F.lag("_took").over(by), F.lit(False))).where("not _gone").drop("_took", "_gone")


def sibling_captions(blocks: DataFrame) -> DataFrame:
    """Of each image: the caption of the next block, else of the one before, without its label."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    caption = lambda x: F.when(F.rlike(x, F.lit(FIGURE_LABEL)), x)
    found = F.coalesce(caption(F.lead("text").over(by)), caption(F.lag("text").over(by)))
    numbered = blocks.withColumn("found", found).where("kind = 'image'").withColumn("number", F.row_number().over(by))
    return numbered.select("doc_id", "pos", "number", F.regexp_extract("found", FIGURE_LABEL, 2).alias("caption"))


def caption_gaps(paragraphs: DataFrame, images: DataFrame) -> DataFrame:
    """paragraphs: doc_id, pos, text, has_image; images: doc_id, n. Documents whose captions are
    numbered exactly 1..k with k over their images: the numbers without an image beside their caption."""
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-1, 1)
    rows = paragraphs.withColumn("near", F.max(F.col("has_image").cast("int")).over(by) == 1)
    stated = rows.withColumn("number", F.nullif(F.regexp_extract("text", FIGURE_LABEL, 1), F.lit("")).try_cast("int")).where("number is not null")
    each = stated.groupBy("doc_id", "number").agg(F.max("near").alias("near"))
    whole = each.groupBy("doc_id").agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.count("*").alias("k"), F.sort_array(F.collect_list(F.when(~F.col("near"), F.col("number")))).alias("gaps"))
    return whole.where("lo = 1 and hi = k").join(images, "doc_id").where("k > n").select("doc_id", "gaps")


def keywords(paragraphs: DataFrame) -> DataFrame:
    """doc_id, keywords of each document's first keywords line."""
    found = paragraphs.where(F.rlike("text", F.lit(KEYWORDS))).groupBy("doc_id").agg(F.min_by("text", "pos").alias("t"))
    return found.select("doc_id", T.split_list(F.regexp_extract("t", KEYWORDS, 1)).alias("keywords"))


def abstract(paragraphs: DataFrame) -> DataFrame:
    """doc_id, abstract: what stands between the abstract heading and the keywords line or the next
    section heading."""
    own = Window.partitionBy("doc_id")
    rows = paragraphs.withColumn("_a", F.min(F.when(F.rlike("text", F.lit(ABSTRACT_HEADING)), F.col("pos"))).over(own))
    ends = F.rlike("text", F.lit(KEYWORDS)) | section_heading(F.col("text")).isNotNull()
    rows = rows.withColumn("_e", F.min(F.when(ends & (F.col("pos") > F.col("_a")), F.col("pos"))).over(own)).where("pos > _a and (_e is null or pos < _e) and trim(text) <> ''")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("abstract"))


def corresponding_email(paragraphs: DataFrame) -> DataFrame:
    """The first address in a paragraph that says 'correspond' or begins with a star."""
    rows = paragraphs.where(F.rlike("text", F.lit(r"(?i)correspond|^\s*\*"))).withColumn("email", F.nullif(F.regexp_extract("text", T.EMAIL, 0), F.lit(""))).where("email is not null")
    return rows.groupBy("doc_id").agg(F.min_by("email", "pos").alias("email"))


def emails(texts: DataFrame, *ids: str) -> DataFrame:
    """Distinct addresses in texts, with how often each occurs."""
    found = texts.select(*ids, F.explode(F.regexp_extract_all("text", F.lit(T.EMAIL), 0)).alias("email"))
    return found.groupBy(*ids, "email").count()


def log_diagnostics(lines: DataFrame, ahead: int = 15) -> DataFrame:
    """doc_id, line_no, text of compiler logs -> severity, message, line: '! ...' errors with the line
    number that follows within ``ahead`` lines; warnings with the line they name."""
    by = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, ahead)
    number = F.nullif(F.regexp_extract("text", r"^l\.(\d+)\b", 1), F.lit(""))
    error = F.nullif(F.regexp_extract("text", r"^! (.+)$", 1), F.lit(""))
    warn = r"^(?:Package (\S+) |LaTeX )Warning: (.+?)(?: on input line (\d+))?\.$"
    package, note, at = (F.regexp_extract("text", warn, k) for k in (1, 2, 3))
    rows = lines.withColumn("_n", number).withColumn("_next", F.first("_n", ignorenulls=True).over(by))
    message = F.when(package != "", F.concat(F.lit("["), package, F.lit("] "), F.trim(note))).otherwise(F.trim(note))
    out = rows.select("doc_id", "line_no", F.when(error.isNotNull(), "error").when(note != "", "warning").alias("severity"), F.when(error.isNotNull(), F.trim(error)).otherwise(message).alias("message"), F.when(error.isNotNull(), F.col("_next")).otherwise(F.nullif(at, F.lit(""))).try_cast("int").alias("line"))
    return out.where("severity is not null")
