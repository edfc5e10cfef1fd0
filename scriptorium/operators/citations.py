"""Citations end to end: from field codes, or from a typed list, to references with keys and an ordered
list of citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import docx, references
from . import keys, markers, matching, structure


def native_citations(fields: DataFrame, sources: DataFrame) -> DataFrame:
    """fields: doc_id, order, instruction; sources: records with raw_id as their tag -> the records that the
    tags of each field name, in their order: doc_id, order, pos and the record. Tags without a source
    are left out; of sources with one tag the last counts."""
    each = fields.select("doc_id", "order", F.posexplode(references.word_tags(F.col("instruction"))).alias("pos", "raw_id"))
    last = sources.withColumn("_no", F.row_number().over(Window.partitionBy("doc_id", "raw_id").orderBy(F.desc("pos")))).where("_no = 1").drop("_no", "pos", "error")
    return each.join(last, ["doc_id", "raw_id"])


def parsed_citations(fields: DataFrame) -> DataFrame:
    """Records inside field codes that carry them: doc_id, order, pos and the record."""
    kind = references.classify_marker(F.col("instruction"))
    own = fields.withColumn("kind", kind).where("kind in ('zotero', 'mendeley', 'endnote')")
    named = own.select(F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.col("order").cast("string")).alias("doc_id"), F.col("instruction").alias("text"), "kind")
    got = references.parse(named, F.col("kind")).where("error is null").drop("error")
    at = F.split("doc_id", "\x1f")
    return got.withColumn("order", F.get(at, F.lit(1)).cast("int")).withColumn("doc_id", F.get(at, F.lit(0)))


def from_fields(fields: DataFrame, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """fields: doc_id, order, instruction of all complex fields -> (entries, citations).

    entries: doc_id, pos, key and the record: each reference once, as it is first cited, with keys by
    order of appearance. citations: doc_id, index (from 0), source, keys (ordered, once each); one that
    names nothing has none."""
    fields = fields.select(F.col("doc_id").cast("string").alias("doc_id"), "order", "instruction")
    kind = references.classify_marker(F.col("instruction"))
    marked = fields.withColumn("source", kind).where("source is not null")
    marked = marked.withColumn("index", F.row_number().over(Window.partitionBy("doc_id").orderBy("order")) - 1)
    cited = parsed_citations(fields)
    if sources is not None:
        native = native_citations(fields.where(kind == "wordnative"), sources)
        cited = cited.unionByName(native, allowMissingColumns=True)
    families = F.array_join(F.transform("authors", lambda a: F.coalesce(F.nullif(a["family"], F.lit("")), a["literal"], F.lit(""))), "|")
    place = F.concat_ws(":", "doc_id", F.col("order").cast("string"), F.col("pos").cast("string"))
    cited = cited.drop("key").withColumn("families", families).withColumn("identity", keys.dedup_identity(place))
    first = Window.partitionBy("doc_id", "identity").orderBy("order", "pos")
    unique = cited.withColumn("_no", F.row_number().over(first)).where("_no = 1").drop("_no")
    unique = unique.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("order", "pos")) - 1)
    unique = unique.withColumn("family", F.get("authors", F.lit(0))["family"]).withColumn("literal", F.get("authors", F.lit(0))["literal"])
    entries = keys.assign_keys(unique, "doc_id").drop("base", "group_size", "rank")
    named = cited.select("doc_id", "order", "pos", "identity").join(entries.select("doc_id", "identity", "key"), ["doc_id", "identity"])
    lists = named.groupBy("doc_id", "order").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"])).alias("keys"))
    citations = marked.join(lists, ["doc_id", "order"], "left").select("doc_id", "index", "source", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))
    return entries, citations


def read_fields(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from packages (path, content), with the word processor's own bibliography."""
    fields = docx.rows(files, "fields").where("error is null")
    sources = references.parse(docx.source_parts(files), "word").where("error is null")
    return from_fields(fields, sources)


def reconstruct(paragraphs: DataFrame, library: DataFrame, remote: DataFrame, threshold: float = matching.THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """paragraphs: doc_id, pos, text, auto -> (entries, numbered, records) of each document's typed
    reference list, matched with the library first, then with remote candidates. library and remote: pos,
    title, year, family, doi and other fields of records.

    entries: doc_id, pos, key, source and the record, raw text where nothing matches. numbered: doc_id,
    number, pos, key (of a number that repeats, the last counts). records: doc_id, key, number, source, score,
    verify. A document without a reference list has none of them. The entries are persisted, as all three
    and their callers read them; whoever is done with them may unpersist."""
    listed = structure.reference_list(paragraphs)
    typed = listed.select(F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("ref_id"), "doc_id", "pos", "number", "text")
    found = matching.reconcile(typed.select("ref_id", "text"), library, remote, threshold)
    raw = matching.raw_entries(typed.select("ref_id", "text")).select("ref_id", F.col("title").alias("_title"), F.col("family").alias("_family"), F.col("year").alias("_year"))
    side = lambda df, name: df.select(F.col("pos").alias("matched_pos"), F.lit(name).alias("source"), "title", "year", "family", *(F.col(c) for c in ("doi",) if c in df.columns))
    known = side(library, "bibfile").unionByName(side(remote, "crossref"), allowMissingColumns=True)
    rows = typed.join(found, "ref_id").join(raw, "ref_id").join(known, ["source", "matched_pos"], "left")
    rows = rows.withColumn("title", F.coalesce("title", "_title")).withColumn("year", F.when(F.col("source") == "raw", F.col("_year")).otherwise(F.col("year"))).withColumn("family", F.when(F.col("source") == "raw", F.col("_family")).otherwise(F.col("family"))).drop("_title", "_family", "_year", "ref_id")
    entries = keys.assign_keys(rows, "doc_id").drop("base", "group_size", "rank").persist()
    numbered = entries.where("number is not null").select("doc_id", "number", "pos", "key")
    records = entries.select("doc_id", "key", "number", "source", "score", "verify")
    return entries, numbered, records


def link_typed(bodies: DataFrame, entries: DataFrame, numbered: DataFrame) -> DataFrame:
    r"""doc_id, text: bodies without their reference sections, their markers as \cite commands of their own
    document's references: numbers first, then authors and years."""
    own = bodies.withColumn("text", markers.strip_reference_section(F.col("text"), "references and notes|reference list|references|reference|bibliography|works cited|literature cited"))
    linked = markers.link_numeric(own, numbered, "doc_id")
    index = keys.author_year_index(entries, "doc_id")
    return markers.link_author_year(linked, index, "doc_id")


def typed_or_coded(entries_coded: DataFrame, entries_typed: DataFrame) -> DataFrame:
    """The references of a document: those of its field codes if it has any, else the reconstructed ones."""
    coded = entries_coded.select("doc_id").distinct()
    return entries_coded.unionByName(entries_typed.join(coded, "doc_id", "left_anti"), allowMissingColumns=True)
