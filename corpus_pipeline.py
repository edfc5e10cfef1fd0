"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, language, near_dedup, packing, substring
from scriptorium.llm._spark import bounded, table, written
from scriptorium.llm.queries import tokenizer

#: Words a repeated passage must have at least to be removed.
PASSAGE_WORDS = 50
#: Score of a language prediction (1 - bits of the best / bits of the second) under which it tells nothing.
LEAST_SCORE = 0.03


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents at hand. Documents whose language can't be told go: those
    without any letter (``und``), and those whose best language needs hardly fewer bits than the second
    (score under LEAST_SCORE: a few odd words, or languages mixed). A null ``lang`` becomes the one
    predicted. A null or empty text goes; without any labelled document nothing can be told, and all
    stay; repeated rows are judged each."""
    bounded(spark)
    samples = language.fit(docs)
    if not samples:
        return docs
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = language.predict(docs, samples, {f"_c{k}": F.col(c) for k, c in enumerate(names)}, with_text=True)
    back = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(f"_c{k}").alias(c) for k, c in enumerate(names)}
    if "lang" in names:
        back["lang"] = F.coalesce(F.col(f"_c{names.index('lang')}"), "lang_pred").alias("lang")
    return found.where(f"lang_pred <> 'und' and score >= {LEAST_SCORE}").select(*(back[c] for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest id stays,
    once; rows with a null id stay. Texts that are null, empty or without words are like nothing and stay;
    of rows that repeat an id the text that sorts first stays, nulls first; an empty table stays empty."""
    bounded(spark)
    found = near_dedup.near_duplicates(docs, shingle=5, percent=80)
    gone = written(found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    left = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    twice = written(found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_twice")).count().where("count > 1").select("_twice"))
    if not twice.limit(1).count():
        return left
    same = left.join(twice, left["doc_id"] == twice["_twice"], "left_semi").withColumn("_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return left.join(twice, left["doc_id"] == twice["_twice"], "left_anti").unionByName(same.where("_no = 1").drop("_no"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of at least PASSAGE_WORDS words that a document with a smaller id holds are cut out;
    a document of nothing else goes. n_chars follows the text. A null text becomes an empty one and stays;
    rows with a null id stay whole, rows that repeat an id are one document; an empty table stays empty."""
    bounded(spark)
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = substring.remove(docs, window=PASSAGE_WORDS, keep="text", carry=tuple(names)).where("n_removed = 0 or n_removed < n_words")
    back = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text": F.col("text")} | {c: F.col(f"_c{k}").alias(c) for k, c in enumerate(names)}
    if "n_chars" in names:
        k = names.index("n_chars")
        back["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(f"_c{k}")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return cut.select(*(back[c] for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (0.8 of its five-word shingles) go, row by row, whatever their
    ids. Null and empty texts hold none; an empty benchmark removes nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 1024 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null
    or empty text is its end token; repeated rows are packed each; an empty table gives no rows."""
    bounded(spark)
    return packing.pack_documents(docs, tokenizer(), capacity=1024, end_id=2)


STAGES = [("language_id", language_id), ("near_dedup", near_duplicates), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing_stage)]

#: Candidate search, components and packing aren't expressible in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
