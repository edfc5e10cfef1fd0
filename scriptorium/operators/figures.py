"""Figures of packages: numbers, captions, crops, replacements, and the files they end in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import docx
from . import groups, structure

#: Fixed value: from this ratio of width to height on, a figure spans the page.
WIDE_RATIO = 1.3


def wants_crop(crop: Column) -> Column:
    """A crop (left, top, right, bottom) that cuts something off."""
    return F.coalesce(F.exists(crop, lambda x: x > 0), F.lit(False))


def is_wide(width: Column, height: Column) -> Column:
    return F.coalesce((height > 0) & (width / F.nullif(height, F.lit(0)) >= WIDE_RATIO), F.lit(False))


def file_name(path: Column) -> Column:
    """The last part of a path, whatever the slashes; null for '', '.' and '..'."""
    name = F.trim(F.regexp_extract(path, r"([^/\\]*)$", 1))
    return F.when(~name.isin("", ".", ".."), name)


def box_captions(boxes: DataFrame) -> DataFrame:
    """doc_id, number, caption: captions that stand in text boxes; the first of a number counts."""
    number = F.nullif(F.regexp_extract("text", structure.FIGURE_LABEL, 1), F.lit("")).try_cast("int")
    body = F.trim(F.regexp_extract("text", structure.FIGURE_LABEL, 2))
    named = boxes.select("doc_id", "pos", number.alias("number"), body.alias("caption")).where("number is not null and caption <> ''")
    return named.groupBy("doc_id", "number").agg(F.min_by("caption", "pos").alias("caption"))


def extract(images: DataFrame, blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """images: doc_id, number, block, in_table; blocks: doc_id, pos, kind, text -> doc_id, number, caption,
    in_table. The caption is the next block's, else that of the one before, else that of a text box with the
    figure's number; a figure in a table has none."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    label = lambda x: F.when(F.rlike(F.trim(x), F.lit(structure.FIGURE_LABEL)), F.regexp_extract(F.trim(x), structure.FIGURE_LABEL, 2))
    beside = blocks.select("doc_id", F.col("pos").alias("block"), F.coalesce(label(F.lead("text").over(order)), label(F.lag("text").over(order))).alias("beside"))
    out = images.join(beside, ["doc_id", "block"], "left").join(box_captions(boxes), ["doc_id", "number"], "left")
    caption = F.coalesce(F.nullif(F.trim("beside"), F.lit("")), "caption", F.lit(""))
    return out.select("doc_id", "number", F.when(F.col("in_table"), "").otherwise(caption).alias("caption"), "in_table")


def crops(images: DataFrame, relations: DataFrame) -> DataFrame:
    """doc_id, pos, name (of the media file, null if the relation is no image), crop: pictures in order."""
    media = relations.where(F.contains(F.lower("kind"), F.lit("image"))).groupBy("doc_id", "relation").agg(file_name(F.max("target")).alias("name"))
    return images.join(media, ["doc_id", "relation"], "left").select("doc_id", F.col("number").alias("pos"), "name", "crop")


def read(files: DataFrame) -> DataFrame:
    """files: path, content -> doc_id, number, caption, in_table, name, crop, how: the figures of packages,
    their crops joined by position or name."""
    part = lambda kind: docx.rows(files, kind).where("error is null")
    images = part("images")
    found = crops(images, docx.relations(files))
    figures = extract(images, part("blocks"), part("boxes"))
    placed = groups.zip_crops(found.select("doc_id", "pos", "name"), found.withColumn("crop", F.to_json("crop")))
    return figures.join(placed.select("doc_id", F.col("pos").alias("number"), "name", F.from_json("crop", "array<double>").alias("crop"), "how"), ["doc_id", "number"], "left")


def manifest(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows: doc_id, number, path (texts as a sidecar has them); files: path that exist -> doc_id, number,
    path, error: a number must be a positive whole one, a path must exist."""
    known = files.select(F.col("path").alias("_f")).distinct()
    n = F.trim("number")
    own = rows.withColumn("_n", F.when(F.rlike(n, F.lit(r"^\d+$")), n.try_cast("int"))).join(known, rows["path"] == known["_f"], "left")
    error = F.when(F.coalesce("_n", F.lit(0)) < 1, F.concat(F.lit("figure number "), F.coalesce("number", F.lit("null")), F.lit(" must be a positive integer"))).when(F.trim(F.coalesce("path", F.lit(""))) == "", F.concat(F.lit("figure "), n, F.lit(" has no path"))).when(F.col("_f").isNull(), F.concat(F.lit("figure "), n, F.lit(" names a file that does not exist")))
    return own.select("doc_id", F.col("_n").alias("number"), "path", error.alias("error"))


def output_files(figures: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """figures: doc_id, pos, number, path -> (doc_id, number, path, file) with the last path of each number,
    and (doc_id, message) for numbers that several figures have."""
    last = figures.groupBy("doc_id", "number").agg(F.max_by("path", "pos").alias("path"), F.count("*").alias("n"))
    no = F.col("number").cast("string")
    ext = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    files = last.select("doc_id", "number", "path", F.concat(F.lit(f"figures/fig{prefix}"), no, ext).alias("file"))
    twice = last.where("n > 1").select("doc_id", F.concat(F.lit("figure number "), no, F.lit(" is used by "), F.col("n").cast("string"), F.lit(" figures; only the last is kept")).alias("message"))
    return files, twice


def stale_files(existing: DataFrame, kept: DataFrame, prefix: str = "") -> DataFrame:
    """doc_id, file: files of an earlier run that this one did not write; files of other names stay.
    existing and kept: doc_id, file."""
    owned = F.rlike("file", F.lit(rf"^figures/fig{prefix}\d+\."))
    return existing.where(owned).join(kept.select("doc_id", "file"), ["doc_id", "file"], "left_anti")


def describe_source(figure: Column, source: Column, path: Column) -> Column:
    return F.concat(F.lit("Figure "), figure.cast("string"), F.lit(": "), source, F.lit(" ("), F.coalesce(file_name(path), F.lit("")), F.lit(")"))


def gap_message(gaps: Column) -> Column:
    """For the numbers of captions without an image."""
    return F.concat(F.lit("no image beside the caption of figure "), F.array_join(F.transform(gaps, lambda x: x.cast("string")), ", "))


def conversion(ext: Column) -> Column:
    """What a file needs before LaTeX can include it: copy, to_pdf, to_png or unsupported."""
    return F.when(ext.isin("pdf", "png", "jpg", "jpeg"), "copy").when(ext.isin("svg", "eps", "emf", "wmf"), "to_pdf").when(ext.isin("tif", "tiff", "gif", "bmp", "webp"), "to_png").otherwise("unsupported")
