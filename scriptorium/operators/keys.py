"""Identities and citation keys of reference records.

Record columns: doc_id, pos, family, given, literal (of the first author), authors, title, year,
container, volume, issue, pages, doi, url, raw_id, source, key, as far as they are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def dedup_identity(row_id: Column) -> Column:
    """doi > raw id > authors, year and title; a record with none of these is itself only (row_id)."""
    families = F.lower(F.coalesce(F.col("families"), F.lit("")))
    title = F.lower(F.regexp_replace(F.coalesce("title", F.lit("")), r"(?U)\W+", ""))
    nothing = (families == "") & (title == "") & (F.coalesce("year", F.lit("")) == "")
    return (
        F.when(F.length("doi") > 0, F.concat(F.lit("doi:"), F.lower(F.trim("doi"))))
        .when(F.length("raw_id") > 0, F.concat(F.lit("id:"), F.col("raw_id")))
        .when(nothing, F.concat(F.lit("fp:unidentified:"), row_id.cast("string")))
        .otherwise(F.concat(F.lit("fp:"), families, F.lit(":"), F.coalesce("year", F.lit("None")), F.lit(":"), title))
    )


def with_base_key(refs: DataFrame) -> DataFrame:
    literal = F.col("literal") if "literal" in refs.columns else F.lit("")
    return refs.withColumn("base", T.base_key(T.author_token(literal, F.col("family")), F.col("year"), F.col("title")))


def assign_keys(refs: DataFrame, *scope: str) -> DataFrame:
    """A base key that is alone stays; otherwise every record of it, the first too, gets a suffix in
    order of appearance. A suffixed key may equal another base key; that is kept.

    Base keys are counted with partial aggregation and joined back; the ranks are a window by base key, dealt
    out as the join is.
    """
    keyed, by = with_base_key(refs), [*scope, "base"]
    sized = keyed.join(keyed.groupBy(*by).agg(F.count("*").alias("group_size")), by)
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("pos")) - 1)
    return ranked.withColumn("key", F.when(F.col("group_size") == 1, F.col("base")).otherwise(F.concat("base", T.suffix(F.col("rank")))))


def dedup_refs(refs: DataFrame, *order: str) -> DataFrame:
    """The first record of each identity in the order, whole."""
    by = Window.partitionBy("identity").orderBy(*order)
    return refs.withColumn("_no", F.row_number().over(by)).where("_no = 1").drop("_no")


def merge_refs(base: DataFrame, new: DataFrame) -> DataFrame:
    """base and new: identity, pos, key. -> of new: pos, key, final_key, status.

    A new record whose identity base has takes base's key (the last one's, if there are several);
    one whose identity an earlier new record has takes that one's final key; others keep their key,
    or, if it is taken, get the first free suffix. Free suffixes are dealt out in order of position;
    a key counts as taken if any base or new record has it.
    """
    last = base.groupBy("identity").agg(F.max_by("key", "pos").alias("base_key"))
    firsts = new.groupBy("identity").agg(F.min_by(F.struct("pos", "key"), "pos").alias("f")).select("identity", F.col("f.pos").alias("first_pos"), F.col("f.key").alias("first_key"))
    fresh = firsts.join(last, "identity", "left_anti")
    taken = base.select("key").distinct()
    order = Window.partitionBy("first_key").orderBy("first_pos")
    fresh = fresh.withColumn("_n", F.row_number().over(order)).join(taken.withColumn("_taken", F.lit(1)), F.col("first_key") == taken["key"], "left").drop("key")
    # the first keeps its key unless base has it; the others need a suffix each
    fresh = fresh.withColumn("_need", F.col("_n") - F.when(F.col("_taken").isNull(), 1).otherwise(0))
    need = fresh.groupBy("first_key").agg(F.max("_need").alias("most")).where("most > 0")
    used = taken.union(new.select("key")).distinct()
    # every way to read a taken key as another key and a suffix: at most that many suffixes are gone
    tail = F.length(F.regexp_extract("key", "(z*)[a-z]$", 1))
    stems = used.where(F.rlike("key", F.lit("[a-z]$"))).select(F.explode(F.transform(F.sequence(F.lit(0), tail), lambda i: F.left("key", F.length("key") - 1 - i))).alias("_stem")).groupBy("_stem").count()
    spare = need.join(stems, need["first_key"] == stems["_stem"], "left").select("first_key", "most", F.coalesce("count", F.lit(0)).cast("int").alias("_near"))
    free = spare.select("first_key", "most", F.explode(F.sequence(F.lit(0), F.col("most") + F.col("_near"))).alias("_i"))
    free = free.withColumn("_free", F.concat("first_key", T.suffix(F.col("_i")))).join(used, F.col("_free") == used["key"], "left_anti")
    free = free.withColumn("_need", F.row_number().over(Window.partitionBy("first_key").orderBy("_i"))).where("_need <= most").select(F.col("first_key").alias("_fk"), "_need", "_free")
    final = fresh.join(free, (fresh["first_key"] == free["_fk"]) & (fresh["_need"] == free["_need"]), "left").select("identity", F.coalesce("_free", "first_key").alias("new_key"), "first_pos")
    out = new.join(last, "identity", "left").join(final, "identity", "left")
    status = F.when(F.col("base_key").isNotNull(), "in_base").when(F.col("pos") > F.col("first_pos"), "repeated").otherwise("added")
    return out.select("pos", "key", F.coalesce("base_key", "new_key").alias("final_key"), status.alias("status"))


def author_year_index(refs: DataFrame, *scope: str) -> DataFrame:
    """scope, surname (lower case), year -> keys in order of position. A record without an author is found
    by the surname its title begins with; one without a year isn't listed."""
    surname = F.lower(F.trim(F.coalesce(T.clean(F.col("family")), T.raw_leading_surname(F.col("title")))))
    own = refs.withColumn("surname", surname).where("year is not null and surname <> ''")
    keys = F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"])
    return own.groupBy(*scope, "surname", "year").agg(keys.alias("keys"))
