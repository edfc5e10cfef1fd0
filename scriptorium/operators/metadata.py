"""Title-page metadata: sidecar files, their validation and rendering, guesses, and front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from . import structure

AUTHOR = "struct<name:string,affiliations:array<int>,email:string,corresponding:boolean>"
META = f"struct<title:string,authors:array<{AUTHOR}>,affiliations:array<string>,abstract:string,keywords:array<string>>"
#: The fields a reviewer may edit, in their order.
EDITABLE = ("title", "authors", "year", "container", "volume", "issue", "pages", "doi")
ANONYMOUS, UNKNOWN_AUTHOR = "Anonymous Author(s)", "Unknown Author"
FIELDS = ("title", "authors", "affiliations", "abstract", "keywords")


def _first(*found: Column) -> Column:
    return F.coalesce(*found)


def _kind(x: Column) -> Column:
    """Of a JSON value as text: object, array, string, number, boolean or null (absent too)."""
    t = F.trim(x)
    head = F.left(t, F.lit(1))
    return F.when(x.isNull() | (t == "null"), "null").when(head == "{", "object").when(head == "[", "array").when(head == '"', "string").when(t.isin("true", "false"), "boolean").otherwise("number")


def _string(x: Column) -> Column:
    """The text of a JSON string."""
    return F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0))


def _blank(x: Column) -> Column:
    return (_kind(x) != "string") | (F.trim(F.coalesce(_string(x), F.lit(""))) == "")


def _at(errors: Column) -> Column:
    """The first message of an array that holds nulls where all is well."""
    return F.get(F.array_compact(errors), F.lit(0))


def validate_sidecars(sidecars: DataFrame) -> DataFrame:
    """sidecars: doc_id, data (the parsed file as JSON) -> doc_id, meta (null if not valid), error (the
    first fault, naming its field). Affiliation numbers count from 1 in files and from 0 in meta."""
    fields = "map<string,string>"
    rows = sidecars.withColumn("_d", F.when(_kind(F.col("data")) == "object", F.from_json("data", fields)))
    d = lambda name: F.element_at("_d", name)
    has = lambda name: F.map_contains_key("_d", name)
    listed = lambda name: F.from_json(d(name), "array<string>")
    raw = rows.withColumn("_affs", F.when(_kind(d("affiliations")) == "array", listed("affiliations"))).withColumn("_authors", F.when(_kind(d("authors")) == "array", listed("authors"))).withColumn("_keys", F.when(_kind(d("keywords")) == "array", listed("keywords")))

    # from_json to strings unquotes them, so the kind of each element is read from the array's own text
    def elements(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(f"_{name}") - 1, F.lit(0))), lambda k: F.get(F.col(f"_{name}"), k))

    def blanks(name: str, field: str) -> Column:
        return F.when(F.size(f"_{name}") > 0, _at(F.transform(elements(name), lambda x, k: F.when(F.trim(F.coalesce(x, F.lit(""))) == "", F.concat(F.lit(f"field '{field}["), k.cast("string"), F.lit("]' must be a non-empty string"))))))

    count = F.size("_affs")

    def author(x: Column, k: Column) -> Column:
        at = F.concat(F.lit("authors["), k.cast("string"), F.lit("]"))
        own = F.from_json(x, fields)
        one = lambda name: F.element_at(own, name)
        numbers = F.from_json(one("affiliations"), "array<string>")
        wrong = _at(F.transform(numbers, lambda v, j: F.when(v.try_cast("int").isNull() | ~F.rlike(v, F.lit(r"^-?\d+$")), F.concat(F.lit("field '"), at, F.lit(".affiliations["), j.cast("string"), F.lit("]' must be an integer"))).when((v.try_cast("int") < 1) | (v.try_cast("int") > count), F.concat(F.lit("field '"), at, F.lit(".affiliations["), j.cast("string"), F.lit("]' names affiliation "), v, F.lit(" of "), count.cast("string")))))
        return (
            F.when(own.isNull() | ~F.startswith(F.trim(x), F.lit("{")), F.concat(F.lit("field '"), at, F.lit("' must be a mapping")))
            .when(~F.map_contains_key(own, "name"), F.concat(F.lit("missing required field '"), at, F.lit(".name'")))
            .when(F.trim(F.coalesce(one("name"), F.lit(""))) == "", F.concat(F.lit("field '"), at, F.lit(".name' must be a non-empty string")))
            .when(F.coalesce(F.map_contains_key(own, "affiliations") & numbers.isNull(), F.lit(False)), F.concat(F.lit("field '"), at, F.lit(".affiliations' must be a list of integers")))
            .when(wrong.isNotNull(), wrong)
            .when(F.map_contains_key(own, "corresponding") & ~F.coalesce(one("corresponding").isin("true", "false"), F.lit(False)), F.concat(F.lit("field '"), at, F.lit(".corresponding' must be a boolean")))
        )

    error = _first(
        F.when(F.col("_d").isNull(), "root must be a mapping"),
        F.when(~has("title"), "missing required field 'title'"),
        F.when(F.trim(F.coalesce(d("title"), F.lit(""))) == "", "field 'title' must be a non-empty string"),
        F.when(~has("affiliations"), "missing required field 'affiliations'"),
        F.when(F.col("_affs").isNull(), "field 'affiliations' must be a list of strings"),
        blanks("affs", "affiliations"),
        F.when(~has("authors"), "missing required field 'authors'"),
        F.when(F.col("_authors").isNull() | (F.size("_authors") == 0), "field 'authors' must be a non-empty list"),
        _at(F.transform("_authors", author)),
        F.when(has("keywords") & F.col("_keys").isNull(), "field 'keywords' must be a list of strings"),
        blanks("keys", "keywords"),
    )
    people = F.transform("_authors", lambda x: F.from_json(x, AUTHOR))
    people = F.transform(people, lambda a: F.struct(a["name"].alias("name"), F.transform(F.coalesce(a["affiliations"], F.array().cast("array<int>")), lambda n: n - 1).alias("affiliations"), a["email"].alias("email"), F.coalesce(a["corresponding"], F.lit(False)).alias("corresponding")))
    meta = F.struct(d("title").alias("title"), people.alias("authors"), F.col("_affs").alias("affiliations"), F.coalesce(d("abstract"), F.lit("")).alias("abstract"), F.coalesce(F.col("_keys"), F.array().cast("array<string>")).alias("keywords"))
    return raw.withColumn("error", error).select("doc_id", F.when(F.col("error").isNull(), meta).alias("meta"), "error")


def sidecar_or_guess(guesses: DataFrame, sidecars: DataFrame) -> DataFrame:
    """guesses: doc_id, meta; sidecars: as validated -> doc_id, meta, source (sidecar, guess), error. A
    sidecar that is not valid is an error, not a reason to guess."""
    side = sidecars.select("doc_id", F.col("meta").alias("_m"), F.col("error").alias("error"), F.lit(True).alias("_s"))
    out = guesses.join(side, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("_s"), F.col("_m")).otherwise(F.col("meta")).alias("meta"), F.when(F.col("_s"), "sidecar").otherwise("guess").alias("source"), "error")


def minimal_guess(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """For sources without title-page styles. blocks: doc_id, pos, kind, text; paths: doc_id, path ->
    doc_id, title (the first header, else the file's name without its ending), author (a placeholder)."""
    first = blocks.where("kind = 'header' and trim(text) <> ''").groupBy("doc_id").agg(F.min_by(F.trim("text"), "pos").alias("h"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    return paths.join(first, "doc_id", "left").select("doc_id", F.coalesce("h", stem).alias("title"), F.lit(UNKNOWN_AUTHOR).alias("author"))


def escape_meta(meta: Column) -> Column:
    """Every text of it escaped for LaTeX; numbers and flags stay."""
    e = T.escape_latex
    people = F.transform(meta["authors"], lambda a: F.struct(e(a["name"]).alias("name"), a["affiliations"].alias("affiliations"), e(a["email"]).alias("email"), a["corresponding"].alias("corresponding")))
    return F.struct(e(meta["title"]).alias("title"), people.alias("authors"), F.transform(meta["affiliations"], e).alias("affiliations"), e(meta["abstract"]).alias("abstract"), F.transform(meta["keywords"], e).alias("keywords"))


def index_error(meta: Column) -> Column:
    """The first author whose affiliation number is out of range, or null."""
    n = F.size(meta["affiliations"])
    bad = F.filter(meta["authors"], lambda a: F.exists(a["affiliations"], lambda i: (i < 0) | (i >= n)))
    return F.when(F.size(bad) > 0, F.concat(F.lit("author "), F.get(bad, F.lit(0))["name"], F.lit(" names an affiliation that is not defined")))


def anonymize(meta: Column) -> Column:
    """For blind review: a placeholder author and no affiliations; title, abstract and keywords stay."""
    nobody = F.array(F.struct(F.lit(ANONYMOUS).alias("name"), F.array().cast("array<int>").alias("affiliations"), F.lit(None).cast("string").alias("email"), F.lit(False).alias("corresponding")))
    return F.struct(meta["title"].alias("title"), nobody.alias("authors"), F.array().cast("array<string>").alias("affiliations"), meta["abstract"].alias("abstract"), meta["keywords"].alias("keywords"))


def _quoted(x: Column) -> Column:
    """A YAML scalar in double quotes."""
    x = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit('"'))


def to_yaml(meta: Column, checks: Column) -> Column:
    """meta as a sidecar file; checks: map of a field to messages, as comments before it. Affiliation
    numbers count from 1."""
    lines = lambda x: F.array_join(x, "")
    person = lambda a: F.concat(F.lit("- name: "), _quoted(a["name"]), F.lit("\n  affiliations: ["), F.array_join(F.transform(a["affiliations"], lambda i: (i + 1).cast("string")), ", "), F.lit("]\n"), F.coalesce(F.concat(F.lit("  email: "), _quoted(F.nullif(a["email"], F.lit(""))), F.lit("\n")), F.lit("")), F.when(a["corresponding"], "  corresponding: true\n").otherwise(""))
    items = lambda x: F.when(F.size(x) > 0, F.concat(F.lit("\n"), lines(F.transform(x, lambda v: F.concat(F.lit("- "), _quoted(v), F.lit("\n")))))).otherwise(" []\n")
    body = {
        "title": F.concat(F.lit(" "), _quoted(meta["title"]), F.lit("\n")),
        "authors": F.concat(F.lit("\n"), lines(F.transform(meta["authors"], person))),
        "affiliations": items(meta["affiliations"]),
        "abstract": F.concat(F.lit(" "), _quoted(F.coalesce(meta["abstract"], F.lit(""))), F.lit("\n")),
        "keywords": items(meta["keywords"]),
    }
    notes = lambda f: F.coalesce(lines(F.transform(F.element_at(checks, f), lambda m: F.concat(F.lit("# CHECK: "), F.regexp_replace(m, r"[\r\n]+", " "), F.lit("\n")))), F.lit(""))
    return F.concat(*(F.concat(notes(f), F.lit(f"{f}:"), body[f]) for f in FIELDS))


def front_matter(paragraphs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, start, stop: the paragraphs of the title page. spans: doc_id, title (position, null: none),
    n_authors, markers, authors_end, affiliations_end (positions after them). Only with affiliation
    markers, or an abstract heading after them; else null. The end is the furthest that is read."""
    own = Window.partitionBy("doc_id")
    rows = paragraphs.join(spans, "doc_id").where("title is not null")
    rows = rows.withColumn("_a", F.min(F.when(F.rlike("text", F.lit(structure.ABSTRACT_HEADING)) & (F.col("pos") >= F.col("affiliations_end")), F.col("pos"))).over(own))
    keys, head = F.rlike("text", F.lit(structure.KEYWORDS)), structure.section_heading(F.col("text")).isNotNull()
    rows = rows.withColumn("_e", F.min(F.when((keys | head) & (F.col("pos") > F.col("_a")), F.col("pos"))).over(own)).withColumn("_last", F.max("pos").over(own) + 1)
    rows = rows.withColumn("_abs", F.when(F.col("_a").isNull(), F.col("affiliations_end")).otherwise(F.coalesce("_e", "_last")))
    rows = rows.withColumn("_k", F.min(F.when(keys & (F.col("pos") >= F.col("_abs")), F.col("pos"))).over(own))
    once = rows.groupBy("doc_id").agg(*(F.first(c).alias(c) for c in ("title", "n_authors", "markers", "authors_end", "affiliations_end", "_a", "_abs", "_k")))
    none = F.lit(None).cast("int")
    stop = F.greatest(F.col("title") + 1, F.when(F.col("n_authors") > 0, F.greatest("authors_end", "affiliations_end")), F.when(F.col("_a").isNotNull() | (F.col("n_authors") > 0), F.col("_abs")), F.col("_k") + 1)
    told = (F.col("markers") > 0) | F.col("_a").isNotNull()
    return once.select("doc_id", F.when(told, F.col("title")).otherwise(none).alias("start"), F.when(told, stop).otherwise(none).alias("stop"))


def strip_front_matter(paragraphs: DataFrame, spans: DataFrame) -> DataFrame:
    """Without the paragraphs from start to before stop."""
    own = paragraphs.join(spans.select("doc_id", "start", "stop"), "doc_id", "left")
    return own.where("start is null or pos < start or pos >= stop").drop("start", "stop")


def unreferenced_affiliations(affiliations: DataFrame, authors: DataFrame) -> DataFrame:
    """doc_id, label: labelled affiliations that no author's markers name. affiliations: doc_id, label;
    authors: doc_id, markers (array)."""
    used = authors.select("doc_id", F.explode("markers").alias("label"))
    return affiliations.where("label is not null").select("doc_id", "label").join(used, ["doc_id", "label"], "left_anti")


def editable(refs: DataFrame, *ids: str) -> DataFrame:
    """The fields a reviewer edits, as texts; null is empty. authors as 'Family, Given; ...'."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in EDITABLE if c != "authors"} | {"authors": F.coalesce(N.to_text(F.col("authors")), F.lit(""))}
    return refs.select(*ids, *(text[c].alias(c) for c in EDITABLE))


def from_editable(rows: DataFrame, *ids: str) -> DataFrame:
    """The way back: blank is null, authors are read as names."""
    fields = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in EDITABLE if c != "authors"} | {"authors": N.from_text(F.col("authors"))}
    return rows.select(*ids, *(fields[c].alias(c) for c in EDITABLE))
