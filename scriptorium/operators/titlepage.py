"""Title, authors and affiliations from the first paragraphs of documents (doc_id, pos, style_id,
font_size, text, segments: array<struct<text, superscript>>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .structure import ABSTRACT_HEADING, KEYWORDS

#: How many paragraphs are looked at, and what parts names.
FIRST_PARAGRAPHS, TITLE_PARAGRAPHS = 20, 5
NAME_SEPARATOR = r"(?i)\s*(?:,|;|\band\b|&)\s*"
MARKER_TOKEN = r"[0-9A-Za-z]+|[^0-9A-Za-z\s,;]"


def joined_by_document(left: DataFrame, right: DataFrame, by: str | list[str], how: str = "inner") -> DataFrame:
    """Both sides have rows of every document, so none is broadcast, whatever the planner guesses: of
    exploded rows it knows no number, and its guesses are too small."""
    return left.join(right.hint("merge"), by, how)


def titles(paragraphs: DataFrame) -> DataFrame:
    """doc_id, title, pos, guessed: the first paragraph in the title style, else the one in the largest
    font among the first five (the earliest of equals)."""
    rows = paragraphs.where((F.col("pos") < FIRST_PARAGRAPHS) & (F.trim("text") != ""))
    styled = F.when(F.lower("style_id") == "title", F.col("pos"))
    early = F.when(F.col("pos") < TITLE_PARAGRAPHS, F.struct(F.coalesce("font_size", F.lit(0)).alias("size"), (-F.col("pos")).alias("p")))
    best = rows.groupBy("doc_id").agg(F.min(styled).alias("styled"), F.max(early).alias("early"))
    at = best.select("doc_id", F.coalesce("styled", -F.col("early.p")).alias("pos"), F.col("styled").isNull().alias("guessed"))
    return joined_by_document(rows, at, ["doc_id", "pos"]).select("doc_id", F.trim("text").alias("title"), "pos", "guessed")


def _author_parts(segments: Column) -> Column:
    """Names parted, each with its superscripts between control characters."""
    marked = F.transform(segments, lambda s: F.when(s["superscript"], F.concat(F.lit("\1"), s["text"], F.lit("\2"))).otherwise(F.regexp_replace(s["text"], NAME_SEPARATOR, "\3")))
    return F.split(F.array_join(marked, ""), "\3")


def authors(paragraphs: DataFrame, title: DataFrame) -> DataFrame:
    """The first non-empty paragraph after the title, as authors: doc_id, line (its position), no, name,
    markers, corresponding (a mark that is no letter or digit)."""
    rows = paragraphs.where((F.col("pos") < FIRST_PARAGRAPHS) & (F.trim("text") != ""))
    rows = joined_by_document(rows, title.select("doc_id", F.col("pos").alias("_t")), "doc_id").where("pos > _t")
    line = rows.groupBy("doc_id").agg(F.min_by("segments", "pos").alias("segments"), F.min("pos").alias("line"))
    each = line.select("doc_id", "line", F.posexplode(_author_parts(F.col("segments"))).alias("_i", "part"))
    each = each.withColumn("name", F.regexp_replace(F.regexp_replace("part", "\1[^\2]*\2", ""), r"^[ ,;]+|[ ,;]+$", "")).where("name <> ''")
    marks = F.regexp_extract_all(F.array_join(F.regexp_extract_all("part", F.lit("\1([^\2]*)\2"), 1), " "), F.lit(MARKER_TOKEN), 0)
    word = lambda m: F.rlike(m, F.lit("^[0-9A-Za-z]"))
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("_i"))
    return each.select("doc_id", "line", no.alias("no"), "name", F.filter(marks, word).alias("markers"), F.exists(marks, lambda m: ~word(m)).alias("corresponding"))


def affiliations(paragraphs: DataFrame, people: DataFrame) -> DataFrame:
    """doc_id, i (from 0), marker (its own leading superscript), text: the paragraphs after the author
    line up to the abstract or keywords, as many as the authors have markers (all if none)."""
    wanted = people.select("doc_id", "line", F.explode_outer("markers").alias("m")).groupBy("doc_id").agg(F.max("line").alias("line"), F.countDistinct("m").alias("n"))
    rows = paragraphs.where((F.col("pos") < FIRST_PARAGRAPHS) & (F.trim("text") != ""))
    rows = joined_by_document(rows, wanted, "doc_id").where("pos > line")
    stop = F.rlike(F.trim("text"), F.lit(ABSTRACT_HEADING)) | F.rlike(F.trim("text"), F.lit(KEYWORDS))
    rows = rows.withColumn("_stop", F.min(F.when(stop, F.col("pos"))).over(Window.partitionBy("doc_id"))).where("_stop is null or pos < _stop")
    rows = rows.where(~(F.rlike("text", F.lit(T.EMAIL)) & F.rlike("text", F.lit("(?i)correspond"))))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).where("n = 0 or i < n")
    head = F.get("segments", F.lit(0))
    own = F.coalesce(head["superscript"] & F.rlike(F.trim(head["text"]), F.lit("^[0-9a-zA-Z]{1,3}$")), F.lit(False))
    rest = F.trim(F.array_join(F.transform(F.slice("segments", F.lit(2), F.greatest(F.size("segments") - 1, F.lit(0))), lambda s: s["text"]), ""))
    return rows.select("doc_id", "i", F.when(own, F.trim(head["text"])).alias("marker"), F.when(own, rest).otherwise(F.trim("text")).alias("text"))


def link(people: DataFrame, places: DataFrame) -> DataFrame:
    """people with ``affiliations`` (indices). Markers meet affiliations by label if any is labelled;
    else, if all markers are numbers, by number; else in the order markers are first seen."""
    seen = people.select("doc_id", "no", F.posexplode("markers").alias("k", "marker"))
    first = seen.groupBy("doc_id", "marker").agg(F.min(F.struct("no", "k")).alias("f")).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("f")) - 1)
    first = first.withColumn("numbers", F.min(F.rlike("marker", F.lit("^[0-9]+$"))).over(Window.partitionBy("doc_id")))
    labels = places.where("marker is not null").groupBy("doc_id", "marker").agg(F.max("i").alias("label"))
    count = places.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("marker").isNotNull()).alias("labelled"))
    found = joined_by_document(joined_by_document(first, count, "doc_id"), labels, ["doc_id", "marker"], "left")
    place = F.when(F.col("labelled"), F.col("label")).when(F.col("numbers"), F.col("marker").try_cast("int") - 1).otherwise(F.col("rank"))
    found = found.select("doc_id", "marker", place.alias("at"), "n").where("at >= 0 and at < n")
    own = joined_by_document(seen, found, ["doc_id", "marker"]).groupBy("doc_id", "no").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "at"))), lambda x: x["at"].cast("int")).alias("affiliations"))
    return joined_by_document(people, own, ["doc_id", "no"], "left").withColumn("affiliations", F.coalesce("affiliations", F.array().cast("array<int>")))
