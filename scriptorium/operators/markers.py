"""Citation markers in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


# How body text writes markers.
_NUMBERS = r"[0-9][0-9\s,‒–—-]*"
NUMERIC = rf"\{{\[\}}({_NUMBERS})\{{\]\}}"
SUPERSCRIPT = rf"\\textsuperscript\{{({_NUMBERS})\}}"
SECTION = r"\\(?:sub)*section\*?\{[^}]*\}"
AUTHOR_YEAR = r"(\([A-Z][A-Za-zÀ-ɏ.'`-]*(?:\s+et\s+al\.?|\s+(?:and|&)\s+[A-Z][A-Za-zÀ-ɏ.'`-]*)?\s*,?\s+(?:18|19|20)\d{2}[a-z]?\))"
TEMPORARY = r"((?:\\\{[^{}]*?\\#[0-9]+[^{}]*?\\\})+)"
_PAIR = r"([A-Z][A-Za-zÀ-ɏ.'`-]*)[^0-9]*?((?:18|19|20)\d{2})"


def _shared(df: DataFrame, ids: tuple[str, ...]) -> list[str]:
    """The ids that a table of references has: those of its own document, else it is for all documents."""
    return [c for c in ids if c in df.columns]


def resolve_numeric(markers: DataFrame, numbered: DataFrame, *ids: str) -> DataFrame:
    """markers: ids and marker ('[3-5,8]'); numbered: number, key (a number's last key counts), and ids
    where numbers are those of a document -> ids, keys (ordered, once each), missing (numbers without a
    key)."""
    own = _shared(numbered, ids)
    lookup = numbered.groupBy(*own, "number").agg(F.max_by("key", "pos").alias("key"))
    inner = F.regexp_replace("marker", r"^\[|\]$", "")
    each = markers.select(*ids, F.posexplode(T.ordered_distinct_numbers(inner)).alias("_i", "number"))
    found = each.join(lookup, [*own, "number"], "left")
    pick = lambda keep, field: F.array_distinct(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("_i", "number", "key"))), keep), lambda x: x[field]))
    return found.groupBy(*ids).agg(pick(lambda x: x["key"].isNotNull(), "key").alias("keys"), pick(lambda x: x["key"].isNull(), "number").alias("missing"))


def author_year_markers(texts: DataFrame, index: DataFrame, *ids: str) -> DataFrame:
    """'(Smith et al., 2020)' in text -> ids, surname, year, keys (null: not in the index)."""
    found = texts.select(*ids, F.posexplode(F.regexp_extract_all("text", F.lit(AUTHOR_YEAR), 1)).alias("at", "m"))
    name, year = F.regexp_extract("m", r"^\(([A-Z][A-Za-zÀ-ɏ.'`-]*)", 1), F.regexp_extract("m", r"((?:18|19|20)\d{2})[a-z]?\)$", 1)
    found = found.select(*ids, "at", F.lower(name).alias("surname"), year.alias("year"))
    return found.join(index, [*_shared(index, ids), "surname", "year"], "left")


def remap_cite_keys(texts: DataFrame, remap: DataFrame, *ids: str) -> DataFrame:
    r"""Keys inside \cite{a,b} through remap (key, final_key); others stay.

    Each command is a row, so a text with very many of them is spread by the join."""
    pattern = r"\\cite\{([^}]*)\}"
    parts = texts.select(*ids, F.split("text", pattern).alias("plain"), F.regexp_extract_all("text", F.lit(pattern), 1).alias("cites"))
    keys = parts.select(*ids, F.posexplode("cites").alias("c", "body")).select(*ids, "c", F.posexplode(F.split("body", ",")).alias("k", "key")).withColumn("key", F.trim("key"))
    keys = keys.join(remap.select("key", "final_key"), "key", "left").withColumn("key", F.coalesce("final_key", "key"))
    keys = keys.groupBy(*ids, "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "key"))), lambda x: x["key"]), ",").alias("body"))
    bodies = keys.groupBy(*ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "body"))), lambda x: x["body"]).alias("bodies"))
    out = parts.join(bodies, list(ids), "left")
    whole = F.array_join(F.zip_with("plain", F.coalesce("bodies", F.array().cast("array<string>")), lambda p, b: F.concat(p, F.when(b.isNull(), "").otherwise(F.concat(F.lit("\\cite{"), b, F.lit("}"))))), "")
    return out.select(*ids, whole.alias("text"))


def linkage(texts: DataFrame, citations: DataFrame, *ids: str) -> DataFrame:
    r"""Documents with fewer \cite commands than citations: ids, cites, citations."""
    cites = texts.select(*ids, F.regexp_count("text", F.lit(r"\\cite\{")).alias("cites"))
    wanted = citations.groupBy(*ids).agg(F.count("*").alias("citations"))
    return cites.join(wanted, list(ids)).where("cites < citations")


def fold_joined(text: Column) -> Column:
    """Markers of one kind joined by dashes, however many, become one marker: what stands between two of
    them becomes a dash, in one pass."""
    dash = r"\s*[‒–—-]+\s*"
    for head, tail in ((r"\{\[\}", r"\{\]\}"), (r"\\textsuperscript\{", r"\}")):
        before = rf"(?<={head}[0-9][0-9\s,‒–—-]{{0,400}})"
        text = F.regexp_replace(text, f"{before}{tail}{dash}{head}(?={_NUMBERS}{tail})", "-")
    return text


def _rewrite(texts: DataFrame, pattern: str, items, names: tuple[str, ...], lookup: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    r"""Matches of the pattern (one group) as \cite{keys} where ``lookup`` (names, keys, and ids where it is
    of one document) gives keys for what ``items`` reads in the group, an array of structs with the names;
    others stay. texts: ids, head (kept as it is), text. A text is cut into pieces once and put together
    once."""
    piece = F.arrays_zip(F.split("text", pattern).alias("plain"), F.regexp_extract_all("text", F.lit(pattern), 0).alias("raw"), F.regexp_extract_all("text", F.lit(pattern), 1).alias("body"))
    rows = texts.select(*ids, "head", F.posexplode_outer(piece).alias("c", "p"))
    each = rows.select(*ids, "head", "c", F.col("p.plain").alias("plain"), F.col("p.raw").alias("raw"), F.posexplode_outer(items(F.col("p.body"))).alias("k", "m"))
    each = each.select(*ids, "head", "c", "plain", "raw", "k", *(F.col("m")[n].alias(n) for n in names))
    found = each.join(lookup, [*_shared(lookup, ids), *names], "left")
    listed = F.filter(F.array_sort(F.collect_list(F.struct("k", "keys"))), lambda x: x["keys"].isNotNull())
    back = found.groupBy(*ids, "c").agg(F.first("head").alias("head"), F.first("plain").alias("plain"), F.first("raw").alias("raw"), F.array_distinct(F.flatten(F.transform(listed, lambda x: x["keys"]))).alias("keys"))
    put = F.concat("plain", F.when(F.col("raw").isNull(), "").when(F.size("keys") > 0, F.concat(F.lit("\\cite{"), F.array_join("keys", ","), F.lit("}"))).otherwise(F.col("raw")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", put.alias("t")))), lambda x: x["t"]), "")
    return back.groupBy(*ids).agg(F.first("head").alias("head"), F.when(F.max("c").isNotNull(), whole).alias("text"))


def link_numeric(texts: DataFrame, numbered: DataFrame, *ids: str) -> DataFrame:
    r"""Body text with its numeric markers, and its superscript ones from the first section on, as
    \cite commands; what no reference has a number for stays as typed. ids, text."""
    lookup = numbered.groupBy(*_shared(numbered, ids), "number").agg(F.array(F.max_by("key", "pos")).alias("keys"))
    items = lambda body: F.transform(T.ordered_distinct_numbers(body), lambda n: F.struct(n.alias("number")))
    own = texts.select(*ids, F.lit("").alias("head"), fold_joined(F.col("text")).alias("text"))
    own = _rewrite(own, NUMERIC, items, ("number",), lookup, ids)
    start = F.when(F.rlike("text", F.lit(SECTION)), F.regexp_instr("text", F.lit(SECTION)) - 1).otherwise(0)
    own = own.select(*ids, F.substring("text", F.lit(1), start).alias("head"), F.substring("text", start + 1, F.length("text")).alias("text"))
    own = _rewrite(own, SUPERSCRIPT, items, ("number",), lookup, ids)
    return own.select(*ids, F.concat("head", "text").alias("text"))


def strip_acknowledgements(text: Column) -> Column:
    """Without the environment and without the section up to the next structural command."""
    text = F.regexp_replace(text, r"(?s)[ \t]*\\begin\{acknowledgments?\}.*?\\end\{acknowledgments?\}\n?", "")
    return F.regexp_replace(text, r"(?ms)^\\section\*?\{Acknowledg[^}]*\}\s*?\n.*?(?=^\\(?:section|subsection|appendix|input|bibliography)|\z)", "")


def strip_reference_section(text: Column, headings: str) -> Column:
    """Without the reference section, from its heading to the end."""
    at = F.regexp_instr(text, F.lit(rf"(?i)\\(?:sub)*section\*?\{{\s*(?:\d+\.?\s+)?(?:{headings})\s*:?\s*\}}"))
    return F.when(at > 0, F.concat(F.rtrim(F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"\s+$", "")), F.lit("\n"))).otherwise(text)


def link_author_year(texts: DataFrame, index: DataFrame, *ids: str) -> DataFrame:
    r"""Body text with '(Smith et al., 2020)' and runs of temporary citations ('\{Lee, 2004 \#78\}') as
    \cite commands of the keys the index (surname, year, keys) has; what it lacks stays as typed."""

    def items(body: Column) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(_PAIR), 1).alias("s"), F.regexp_extract_all(body, F.lit(_PAIR), 2).alias("y"))
        return F.transform(pairs, lambda p: F.struct(F.lower(F.regexp_replace(p["s"], r"^[.,'`-]+|[.,'`-]+$", "")).alias("surname"), p["y"].alias("year")))

    own = texts.select(*ids, F.lit("").alias("head"), "text")
    for pattern in (AUTHOR_YEAR, TEMPORARY):
        own = _rewrite(own, pattern, items, ("surname", "year"), index, ids)
    return own.select(*ids, "text")
