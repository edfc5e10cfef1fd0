"""Checks before conversion: what a package holds that conversion can't keep, and which styles it uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import docx, office
from . import structure

# Severities of what is found, and how an equation's label begins.
EQUATION_LABEL = r"(?i)^\s*(?:Eq|Equation)\b"
HEADING_STYLE = r"^heading\s*(\d+)$"
ALT_FORMATS = ("odt", "rtf", "md")
DOCUMENT = -1


def _finding(signs: DataFrame, detector: str, severity: str, message: Column | str) -> DataFrame:
    message = F.lit(message) if isinstance(message, str) else message
    return signs.select("doc_id", F.lit(severity).alias("severity"), F.lit(detector).alias("detector"), "paragraph", T.snippet(F.col("text")).alias("snippet"), message.alias("message"))


def text_boxes(signs: DataFrame) -> DataFrame:
    """Text boxes are lost, but for figure captions, which are read from them."""
    caption = F.rlike(F.trim("own_text"), F.lit(structure.FIGURE_LABEL))
    return _finding(signs.where(F.col("sign") == "text_box").where(~caption), "text_box", "error", "text in a box is lost; move it into the text")


def tracked_changes(signs: DataFrame) -> DataFrame:
    return _finding(signs.where(F.col("sign").isin("insertion", "deletion")), "tracked_changes", "error", F.concat(F.lit("open tracked "), "sign", F.lit("; accept or reject all changes")))


def floating_objects(signs: DataFrame) -> DataFrame:
    return _finding(signs.where(F.col("sign") == "floating_object"), "floating_object", "warn", "a floating image loses its place beside the text")


def smartart(signs: DataFrame) -> DataFrame:
    return _finding(signs.where(F.col("sign") == "smartart"), "smartart", "error", "a diagram is lost; replace it with an image")


def equation_images(signs: DataFrame) -> DataFrame:
    return _finding(signs.where((F.col("sign") == "image_paragraph") & F.rlike("text", F.lit(EQUATION_LABEL))), "equation_as_image", "warn", "an image stands where an equation seems to be")


#: Detectors in their order: signs -> findings.
DETECTORS: tuple[Callable[[DataFrame], DataFrame], ...] = (text_boxes, tracked_changes, floating_objects, smartart, equation_images)


def detect(signs: DataFrame, detectors: tuple[Callable[[DataFrame], DataFrame], ...] = DETECTORS) -> DataFrame:
    """doc_id, severity, detector, paragraph, snippet, message, order (the detector's place)."""
    out = None
    for k, f in enumerate(detectors):
        found = f(signs).withColumn("order", F.lit(k))
        out = found if out is None else out.unionByName(found)
    return out


def from_privacy(findings: DataFrame, order: int = len(DETECTORS)) -> DataFrame:
    """Privacy findings (doc_id, category, severity, location, detail) as preflight findings of whole
    documents; one that could not be read is a note."""
    failed = F.col("category") == "unreadable"
    severity = F.when(failed, "info").when(F.col("severity").isin("high", "medium"), "warn").otherwise("info")
    detector = F.when(failed, "privacy_check_failed").otherwise(F.concat(F.lit("privacy_"), "category"))
    message = F.concat("category", F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(": "), "detail")).otherwise(""))
    return findings.select("doc_id", severity.alias("severity"), detector.alias("detector"), F.lit(DOCUMENT).alias("paragraph"), F.when(failed, "").otherwise(F.col("location")).alias("snippet"), message.alias("message"), F.lit(order).alias("order"))


def style_inventory(used: DataFrame, names: DataFrame) -> DataFrame:
    """used: doc_id, style_id of paragraphs; names: doc_id, style_id, name -> doc_id, heading_levels,
    title_used, caption_used. A style without a declared name goes by its id."""
    found = used.groupBy("doc_id", "style_id").count().join(names.groupBy("doc_id", "style_id").agg(F.max("name").alias("name")), ["doc_id", "style_id"], "left")
    name = F.coalesce("name", F.lower("style_id"))
    level = F.nullif(F.regexp_extract(name, HEADING_STYLE, 1), F.lit("")).try_cast("int")
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set(level)).alias("heading_levels"), F.bool_or(name == "title").alias("title_used"), F.bool_or(name == "caption").alias("caption_used"))


def format_of(path: Column) -> Column:
    """The ending of a path in lower case, without its dot; empty for none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def format_notes(paths: DataFrame) -> DataFrame:
    """paths: doc_id, path, has_sidecar -> doc_id, message: what other formats than .docx go without."""
    other = paths.where(F.col("path").isNotNull() & (format_of(F.col("path")) != "docx"))
    notes = F.array_compact(F.array(F.lit("no structural checks and no captions from text boxes for this format"), F.when(~F.col("has_sidecar"), "no title page could be read; a placeholder was written, to be filled in")))
    return other.select("doc_id", F.explode(notes).alias("message"))


def run(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files: path, content -> findings in the detectors' order, and style inventories. Files that can't be
    read are one finding; formats other than .docx have neither."""
    words = files.where(format_of(F.col("path")) == "docx")
    signs = docx.rows(words, "signs")
    unread = signs.where("error is not null").select("doc_id", F.lit("error").alias("severity"), F.lit("unreadable").alias("detector"), F.lit(DOCUMENT).alias("paragraph"), F.lit("").alias("snippet"), F.col("error").alias("message"), F.lit(-1).alias("order"))
    found = detect(signs.where("error is null")).unionByName(unread).unionByName(from_privacy(office.findings(office.read_facts(words))))
    return found, style_inventory(docx.rows(words, "styles").where("error is null"), docx.style_names(words))
