"""Typed references against a library: best match, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fuzzy import similarity

THRESHOLD = 0.72
W_TITLE, W_YEAR, W_AUTHOR = 0.6, 0.2, 0.2


def containment(title: Column, text: Column) -> Column:
    """The share (0 to 100) of the title's distinct words that the text has."""
    words = F.array_distinct(F.split(F.trim(title), r"\s+"))
    return 100.0 * F.size(F.array_intersect(words, F.split(text, r"\s+"))) / F.size(words)


def score(title_similarity: Column) -> Column:
    """title_similarity from 0 to 100, with columns text, year and family."""
    year, author = T.year_in_text(F.col("year"), F.col("text")), T.surname_in_text(F.col("family"), F.col("text"))
    return W_TITLE * F.coalesce(title_similarity, F.lit(0.0)) / 100 + F.when(year, W_YEAR).otherwise(0.0) + F.when(author, W_AUTHOR).otherwise(0.0)


def best_match(typed: DataFrame, library: DataFrame, fuzzy: bool = False) -> DataFrame:
    """typed: ref_id, text; library: pos, title, year, family -> ref_id, pos, score of the best entry
    (ties: the first), for references that have a candidate.

    Candidates share a title word with the text (of letters, in lower case), or the first word of the
    surname and a four-digit year: a score at the threshold needs a similar title, or both of those and
    half a title. With the containment score nothing at the threshold is missed, and what is under it is
    right if it is not 0.2 or less; with the fuzzy one, titles without an equal word count if surname and
    year agree, as they must to reach the threshold. Library entries that are equal in all that is scored
    count once, as their first. Words are joined, so a word of very many titles is split by skew handling,
    and candidates are told apart before any score is computed. Equal texts are matched once.
    """
    texts = typed.groupBy("text").agg(F.min("ref_id").alias("_rep"))
    members, typed = typed.select("ref_id", "text").join(texts, "text").select("ref_id", "_rep"), texts.select(F.col("_rep").alias("ref_id"), "text")
    entries = library.groupBy("title", "year", "family").agg(F.min("pos").alias("pos"))
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"(?U)\W+"), lambda w: w != ""))
    said = typed.select("ref_id", words(F.col("text")).alias("words"), F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?=(\d{4}))"), 1)).alias("years"))
    left = said.select("ref_id", F.explode("words").alias("_w"))
    right = entries.select("pos", F.explode(words(F.col("title"))).alias("_w"))
    by_title = left.join(right, "_w").select("ref_id", "pos")
    named = entries.select("pos", F.get(words(F.col("family")), F.lit(0)).alias("_w"), F.col("year").alias("_y"))
    by_author = said.select("ref_id", "words", F.explode("years").alias("_y")).select("ref_id", "_y", F.explode("words").alias("_w")).join(named, ["_w", "_y"]).select("ref_id", "pos")
    pairs = by_title.union(by_author).distinct()
    pairs = pairs.join(typed, "ref_id").join(entries, "pos")
    title = similarity("token_set", F.col("title"), F.col("text")) if fuzzy else containment(F.col("title"), F.col("text"))
    scored = pairs.select("ref_id", "pos", F.round(score(title), 9).alias("score"))
    best = F.max(F.struct("score", (-F.col("pos")).alias("p"))).alias("b")
    found = scored.groupBy(F.col("ref_id").alias("_rep")).agg(best)
    return members.join(found, "_rep").select("ref_id", (-F.col("b.p")).alias("pos"), F.col("b.score").alias("score"))


def reconcile(typed: DataFrame, library: DataFrame, remote: DataFrame, threshold: float = THRESHOLD, fuzzy: bool = False) -> DataFrame:
    """Library at or above the threshold, else remote, else raw (with the best remote score, to be
    verified): ref_id, source, matched_pos, score, verify."""
    own = best_match(typed, library, fuzzy).select("ref_id", F.col("pos").alias("own_pos"), F.col("score").alias("own"))
    far = best_match(typed, remote, fuzzy).select("ref_id", F.col("pos").alias("far_pos"), F.col("score").alias("far"))
    both = typed.select("ref_id").join(own, "ref_id", "left").join(far, "ref_id", "left")
    in_own, in_far = F.coalesce(F.col("own") >= threshold, F.lit(False)), F.coalesce(F.col("far") >= threshold, F.lit(False))
    source = F.when(in_own, "bibfile").when(in_far, "crossref").otherwise("raw")
    return both.select("ref_id", source.alias("source"), F.when(in_own, F.col("own_pos")).when(in_far, F.col("far_pos")).alias("matched_pos"), F.when(in_own, F.col("own")).otherwise(F.coalesce("far", F.lit(0.0))).alias("score"), (~in_own & ~in_far).alias("verify"))


def report(reconciled: DataFrame) -> DataFrame:
    """total, matched, flagged and the matched share (0 for none)."""
    n = F.count("*")
    return reconciled.agg(n.alias("total"), F.count_if(~F.col("verify")).alias("matched"), F.count_if("verify").alias("flagged"), F.round(F.when(n > 0, F.count_if(~F.col("verify")) / n).otherwise(0.0), 9).alias("matched_fraction"))


def raw_entries(typed: DataFrame) -> DataFrame:
    """Entries for references without a match: the whole text as title, guessed surname and year."""
    return typed.select("ref_id", F.lit("misc").alias("entry_type"), F.col("text").alias("title"), T.guess_surname(F.col("text")).alias("family"), T.guess_year(F.col("text")).alias("year"), F.lit("raw").alias("source"))


def first_per_group(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_no = 1").drop("_no")
