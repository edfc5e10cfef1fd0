"""Bibliography exports to reference records.

CSL JSON is parsed by Spark itself. The formats that aren't regular (BibTeX, MEDLINE, XML) go through
Arrow-batched parsers, one text at a time; a text that can't be parsed gives one row with ``error``.
"""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T

FIELDS = ("key", "entry_type", "title", "year", "container", "publisher", "volume", "issue", "pages", "doi", "url", "isbn", "source", "raw_id")
SCHEMA = f"doc_id string, pos int, {', '.join(f'{f} string' for f in FIELDS)}, authors array<{N.NAME}>, error string"
_NAME = pa.struct([("family", pa.string()), ("given", pa.string()), ("literal", pa.string())])
_ARROW = pa.schema([("doc_id", pa.string()), ("pos", pa.int32()), *((f, pa.string()) for f in FIELDS), ("authors", pa.list_(_NAME)), ("error", pa.string())])

# Source types of the formats.
ENDNOTE_TYPES = {
    "journal article": "article-journal",
    "electronic article": "article-journal",
    "magazine article": "article-magazine",
    "newspaper article": "article-newspaper",
    "book": "book",
    "book section": "chapter",
    "conference paper": "paper-conference",
    "conference proceedings": "paper-conference",
    "thesis": "thesis",
    "report": "report",
    "web page": "webpage",
    "manuscript": "manuscript",
    "patent": "patent",
}
WORD_TYPES = {
    "JournalArticle": "article-journal",
    "ArticleInAPeriodical": "article-magazine",
    "Book": "book",
    "BookSection": "chapter",
    "ConferenceProceedings": "paper-conference",
    "Report": "report",
    "InternetSite": "webpage",
    "DocumentFromInternetSite": "webpage",
    "Patent": "patent",
    "Misc": "misc",
}
CONTAINERS = ("journal", "journaltitle", "booktitle", "series")
_YEAR = re.compile(r"(?:18|19|20)\d{2}")


def _name(family: str = "", given: str = "", literal: str = "") -> dict:
    return {"family": family, "given": given, "literal": literal}


def _bibtex_type(csl: str) -> str:
    return T.CSL_TO_BIBTEX.get(csl, "misc")


# BibTeX ---------------------------------------------------------------------------------------------

_ENTRY = re.compile(r"@\s*(\w+)\s*([{(])")
_PIECE = re.compile(r'[{}(),"]|[^{}(),"]+')


def _entries(text: str) -> Iterator[tuple[str, list[str]]]:
    """Type and top-level comma parts of each entry; an entry that never closes is left out."""
    at = 0
    while m := _ENTRY.search(text, at):
        close = "}" if m[2] == "{" else ")"
        depth, quoted, parts, now, at, done = 0, False, [], [], m.end(), False
        for p in _PIECE.finditer(text, m.end()):
            c = p[0]
            if c == close and not depth:
                at, done = p.end(), True
                break
            if c == "," and not depth and not quoted:
                parts.append("".join(now))
                now = []
                continue
            depth += (c == "{") - (c == "}")
            quoted ^= c == '"' and not depth
            now.append(c)
        if done:
            yield m[1].lower(), [*parts, "".join(now)]


def _value(raw: str, macros: dict[str, str]) -> str:
    raw = raw.strip()
    if len(raw) > 1 and raw[0] + raw[-1] in ("{}", '""'):
        raw = raw[1:-1]
    else:
        raw = macros.get(raw.lower(), raw)
    return " ".join(raw.replace("{", "").replace("}", "").split())


def bibtex_authors(raw: str) -> list[dict]:
    out = []
    for who in filter(None, (x.strip() for x in re.split(r"\s+and\s+", raw))):
        family, comma, given = who.partition(",")
        if who.lower() == "others":
            out.append(_name(literal="others"))
        elif comma:
            out.append(_name(family.strip(), given.strip()))
        else:
            *first, last = who.split()
            out.append(_name(last, " ".join(first)))
    return out


def parse_bibtex(text: str) -> list[dict]:
    """Records with a key; @string macros are resolved; the first of a field's values counts."""
    found = list(_entries(text))
    macros: dict[str, str] = {}
    for kind, parts in found:
        name, is_, raw = parts[0].partition("=")
        if kind == "string" and is_:
            macros[name.strip().lower()] = _value(raw, {})
    out = []
    for kind, (key, *parts) in found:
        if kind in ("string", "comment", "preamble") or not key.strip():
            continue
        f: dict[str, str] = {}
        for part in parts:
            name, is_, raw = part.partition("=")
            if is_ and (value := _value(raw, macros)):
                f.setdefault(name.strip().lower(), value)
        year = _YEAR.search(f.get("year") or f.get("date") or "")
        doi = re.sub(r"(?i)^https?://(dx\.)?doi\.org/", "", f.get("doi", "")).strip()
        out.append(
            {k: f.get(k) for k in ("title", "publisher", "volume", "pages", "url", "isbn")}
            | {"key": key.strip(), "raw_id": key.strip(), "entry_type": kind, "source": "bibfile", "doi": doi or None, "issue": f.get("number") or f.get("issue"), "year": year[0] if year else f.get("year")}
            | {"container": next((f[c] for c in CONTAINERS if c in f), None), "authors": bibtex_authors(f.get("author", ""))}
        )
    return out


# MEDLINE --------------------------------------------------------------------------------------------

_TAG = re.compile(r"^([A-Za-z]{2,4})\s*-\s?(.*)$")


def parse_nbib(text: str) -> list[dict]:
    """A record ends at a blank line or the next PMID; records without one are left out."""
    if not text.strip():
        return []
    records: list[dict[str, list[str]]] = [{}]
    tag, any_tag = None, False
    for line in text.splitlines():
        m = _TAG.match(line)
        if not line.strip() or m and m[1].upper() == "PMID" and records[-1]:
            records.append({})
            tag = None
        if m:
            any_tag, tag = True, m[1].upper()
            records[-1].setdefault(tag, []).append(m[2].strip())
        elif tag and line[:1].isspace() and line.strip():
            records[-1][tag][-1] = f"{records[-1][tag][-1]} {line.strip()}".strip()
    if not any_tag:
        raise ValueError("no MEDLINE tag lines")
    out = []
    for r in records:
        first = lambda *tags: next((v for t in tags for v in r.get(t, ()) if v), None)  # noqa: E731, B023
        if not (pmid := first("PMID")):
            continue
        doi = next((m[1].strip() for t in ("LID", "AID") for v in r.get(t, ()) if (m := re.match(r"(?i)(.*?)\s*\[doi\]\s*$", v))), None)
        authors = [_name(" ".join(w[:-1]), w[-1]) if len(w) > 1 else _name(literal=a) for a in r.get("AU", ()) if (w := a.split())]
        year = _YEAR.search(first("DP") or "")
        out.append({"key": pmid, "raw_id": pmid, "entry_type": "article", "source": "nbib", "title": first("TI"), "container": first("JT", "TA"), "volume": first("VI"), "issue": first("IP"), "pages": first("PG"), "doi": doi, "year": year[0] if year else None, "authors": authors})
    return out


# XML ------------------------------------------------------------------------------------------------


def safe_xml(data: str | bytes) -> ET.Element:
    """Refuses documents with a type declaration (entities, external files)."""
    head = data if isinstance(data, str) else data.decode("latin-1")
    if re.search(r"<!DOCTYPE|<!ENTITY", head, re.I):
        raise ValueError("XML with a type declaration")
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise ValueError(f"not valid XML ({e})") from e


def _leaf(e: ET.Element | None) -> str | None:
    if e is None:
        return None
    style = e.find("style")
    return ((e if style is None else style).text or "").strip() or None


def endnote_record(record: ET.Element, source: str) -> dict:
    authors = []
    for raw in filter(None, (_leaf(a) for a in record.findall("contributors/authors/author"))):
        family, comma, given = raw.partition(",")
        if not comma:
            authors.append(_name(literal=raw))
        elif raw.endswith(","):
            authors.append(_name(literal=raw.rstrip(",").strip()))
        else:
            authors.append(_name(family.strip(), given.strip()))
    get = lambda *paths: next((x for p in paths if (x := _leaf(record.find(p)))), None)
    kind = record.find("ref-type")
    csl = ENDNOTE_TYPES.get((kind.get("name") or "").strip().lower(), "") if kind is not None else ""
    return {"key": "", "raw_id": get("rec-number"), "entry_type": _bibtex_type(csl), "source": source, "title": get("titles/title"), "container": get("periodical/full-title", "periodical/abbr-1", "titles/secondary-title"), "year": get("dates/year"), "volume": get("volume"), "pages": get("pages"), "doi": get("electronic-resource-num"), "authors": authors}


def parse_endnote_xml(text: str) -> list[dict]:
    records = [endnote_record(r, "endnote-xml") for r in safe_xml(text).iter("record")]
    if not records:
        raise ValueError("no <record> elements")
    return [r | {"key": r["raw_id"] or ""} for r in records]


def parse_endnote_field(instruction: str) -> list[dict]:
    """The XML in a field's instruction, plain or with its markup encoded; none if it can't be read."""
    for text in (instruction, html.unescape(instruction)):
        if m := re.search(r"<EndNote>.*</EndNote>", text, re.S):
            try:
                return [endnote_record(r, "endnote") for c in safe_xml(m[0]).iter("Cite") if (r := c.find("record")) is not None]
            except ValueError:
                continue
    return []


def csl_record(item: dict, source: str) -> dict:
    text = lambda *names: next((s for n in names if item.get(n) is not None and (s := str(item[n]).strip())), None)
    issued = item.get("issued") if isinstance(item.get("issued"), dict) else {}
    parts = issued.get("date-parts")
    dates = [parts[0][0]] if isinstance(parts, list) and parts and isinstance(parts[0], list) and parts[0] else []
    year = next((m[0] for x in [*dates, issued.get("raw"), issued.get("literal")] if x and (m := re.search(r"\d{4}", str(x)))), None)
    who = [a for a in item.get("author") or [] if isinstance(a, dict)] if isinstance(item.get("author"), list) else []
    authors = [n for a in who if any((n := _name(*(str(a.get(k, "")).strip() for k in ("family", "given", "literal")))).values())]
    return {"key": "", "raw_id": text("id"), "entry_type": _bibtex_type(str(item.get("type", "")).strip()), "source": source, "title": text("title"), "container": text("container-title"), "publisher": text("publisher"), "volume": text("volume"), "issue": text("issue"), "pages": text("page"), "doi": text("DOI", "doi"), "url": text("URL", "url"), "isbn": text("ISBN", "isbn"), "year": year, "authors": authors}


def parse_csl_field(instruction: str, source: str = "zotero") -> list[dict]:
    """The JSON from the first brace on; what follows it is ignored."""
    at = instruction.find("{")
    if at < 0:
        return []
    try:
        payload, _ = json.JSONDecoder().raw_decode(instruction[at:])
    except ValueError:
        return []
    items = payload.get("citationItems") if isinstance(payload, dict) else None
    return [csl_record(i["itemData"], source) for i in items or [] if isinstance(i, dict) and isinstance(i.get("itemData"), dict)]


def parse_word_sources(text: str) -> list[dict]:
    """A word processor's source list; the last of a tag counts; sources without one are left out."""
    b = "{http://schemas.openxmlformats.org/officeDocument/2006/bibliography}"
    root = safe_xml(text)
    if root.tag != f"{b}Sources":
        raise ValueError("no source list")
    out: dict[str, dict] = {}
    for s in root.findall(f"{b}Source"):
        get = lambda *names: next((x for n in names if (x := (s.findtext(f"{b}{n}") or "").strip())), None)  # noqa: E731, B023
        if not (tag := get("Tag")):
            continue
        authors = []
        for role in s.findall(f"{b}Author/{b}Author"):
            for p in role.iter(f"{b}Person"):
                part = {k: (p.findtext(f"{b}{k}") or "").strip() for k in ("Last", "First", "Middle")}
                authors.append(_name(part["Last"], " ".join(filter(None, (part["First"], part["Middle"])))))
            authors += [_name(literal=c.text.strip()) for c in role.iter(f"{b}Corporate") if c.text and c.text.strip()]
        out.pop(tag, None)
        out[tag] = {"key": "", "raw_id": tag, "entry_type": _bibtex_type(WORD_TYPES.get(get("SourceType") or "", "")), "source": "wordnative", "title": get("Title"), "container": get("JournalName", "ConferenceName", "BookTitle"), "year": get("Year"), "volume": get("Volume"), "issue": get("Issue"), "pages": get("Pages"), "publisher": get("Publisher"), "doi": get("DOI"), "url": get("URL"), "authors": authors}
    return list(out.values())


# Dispatch -------------------------------------------------------------------------------------------

PARSERS: dict[str, Callable[[str], list[dict]]] = {"bib": parse_bibtex, "ris": parse_bibtex, "nbib": parse_nbib, "xml": parse_endnote_xml, "word": parse_word_sources, "endnote": parse_endnote_field, "zotero": parse_csl_field, "mendeley": lambda x: parse_csl_field(x, "mendeley")}


def parse(texts: DataFrame, kind: Column | str) -> DataFrame:
    """texts: doc_id, text; kind: a format's name, or a column with it -> records."""
    own = texts.select(F.col("doc_id").cast("string"), "text", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))

    def run(batches):
        for b in batches:
            rows = []
            for doc, text, k in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    if k not in PARSERS:
                        raise ValueError(f"unknown format {k}")
                    rows += [r | {"doc_id": doc, "pos": i, "error": None} for i, r in enumerate(PARSERS[k](text or ""))]
                except ValueError as e:
                    rows.append({"doc_id": doc, "pos": 0, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return own.mapInArrow(run, SCHEMA)


_ITEM = "id string, type string, title string, `container-title` string, publisher string, volume string, issue string, page string, DOI string, URL string, ISBN string, author array<struct<family:string,given:string,literal:string>>, issued struct<`date-parts`:array<array<string>>,raw:string,literal:string>"


def parse_csl_json(texts: DataFrame) -> DataFrame:
    """doc_id, text (an array of items, or an object with ``items``) -> records, by built-in functions.
    The key is the item's id."""
    item = f"struct<{', '.join(_as_struct(_ITEM))}>"
    text = F.trim("text")
    body = F.when(F.startswith(text, F.lit("[")), text).otherwise(F.get_json_object(text, "$.items"))
    each = texts.select("doc_id", F.posexplode(F.from_json(body, "array<string>")).alias("pos", "raw"))  # an item that is no object is left out
    rows = each.where(F.startswith(F.ltrim("raw"), F.lit("{"))).select("doc_id", "pos", F.from_json("raw", item).alias("i"))
    i = F.col("i")
    year = F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), r"\d{4}", 0), F.lit("")) for x in (F.get(F.get(i["issued"]["date-parts"], F.lit(0)), F.lit(0)), i["issued"]["raw"], i["issued"]["literal"])))
    clean = lambda c: T.clean(i[c])
    authors = F.filter(F.transform(F.coalesce(i["author"], F.array().cast(f"array<{N.NAME}>")), lambda a: N.name(F.trim(a["family"]), F.trim(a["given"]), F.trim(a["literal"]))), lambda n: F.concat(n["family"], n["given"], n["literal"]) != "")
    return rows.where("i is not null").select(
        F.col("doc_id").cast("string"), "pos", clean("id").alias("key"), T.csl_type_to_bibtex(i["type"]).alias("entry_type"), clean("title").alias("title"), year.alias("year"), clean("container-title").alias("container"), clean("publisher").alias("publisher"),
        clean("volume").alias("volume"), clean("issue").alias("issue"), clean("page").alias("pages"), clean("DOI").alias("doi"), clean("URL").alias("url"), clean("ISBN").alias("isbn"), F.lit("csl-json").alias("source"), clean("id").alias("raw_id"), authors.alias("authors"), F.lit(None).cast("string").alias("error"),
    )


def _as_struct(fields: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in fields + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            name, _, kind = now.strip().partition(" ")
            out.append(f"{name}:{kind}")
            now = ""
        else:
            now += c
    return out


def classify_marker(instruction: Column) -> Column:
    """zotero > mendeley > endnote > wordnative, else null."""
    t = F.trim(instruction)
    has = lambda x: F.contains(instruction, F.lit(x))
    return F.when(has("ADDIN ZOTERO_ITEM"), "zotero").when(has("ADDIN CSL_CITATION"), "mendeley").when(has("ADDIN EN.CITE"), "endnote").when((t == "CITATION") | F.startswith(F.upper(t), F.lit("CITATION ")), "wordnative")


def word_tags(instruction: Column) -> Column:
    r"""'CITATION A \l 1033 \m B' -> [A, B]: the first word, and those after \m; the arguments of other
    switches aren't tags."""
    body = F.trim(F.regexp_replace(F.trim(instruction), r"(?i)^CITATION", ""))
    body = F.regexp_replace(F.concat(body, F.lit(" ")), r"\\[lpvfs]\s+\S+\s", "")
    body = F.regexp_replace(F.concat(F.lit(r"\m "), body), r"\\(?!m\s)\S*", "")
    return F.when(F.rlike(F.trim(instruction), F.lit("(?i)^CITATION")), F.transform(F.regexp_extract_all(body, F.lit(r"\\m\s+([^\s\\]+)"), 1), lambda x: x)).otherwise(F.array().cast("array<string>"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder or glob (.bib, .ris, .nbib, .xml, .json) -> records; doc_id is the path."""
    files = spark.read.format("binaryFile").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    texts = files.select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"), kind.alias("kind"))
    return parse(texts.where("kind <> 'json'"), F.col("kind")).unionByName(parse_csl_json(texts.where("kind = 'json'")))


_DATES = ("issued", "published-print", "published-online", "published", "created")
_WORK = "title array<string>, `container-title` array<string>, `short-container-title` array<string>, author array<struct<family:string,given:string,name:string>>, publisher string, volume string, issue string, page string, DOI string, URL string, type string, " + ", ".join(f"`{d}` struct<`date-parts`:array<array<string>>>" for d in _DATES)


def parse_works(texts: DataFrame) -> DataFrame:
    """doc_id, text (one work of a registry as JSON) -> a candidate record, by built-in functions: the
    first of each list, markup stripped; the year of the first date that has one; null for no object."""
    w = F.from_json("text", f"struct<{', '.join(_as_struct(_WORK))}>")
    rows = texts.where(F.startswith(F.ltrim("text"), F.lit("{"))).select("doc_id", w.alias("w"))
    c = F.col("w")
    first = lambda name: F.nullif(T.strip_markup(F.get(c[name], F.lit(0))), F.lit(""))
    year = F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(F.get(F.get(c[d]["date-parts"], F.lit(0)), F.lit(0)), F.lit("")), r"\d{4}", 0), F.lit("")) for d in _DATES))
    authors = F.filter(F.transform(F.coalesce(c["author"], F.array().cast("array<struct<family:string,given:string,name:string>>")), lambda a: N.name(F.trim(a["family"]), F.trim(a["given"]), F.trim(a["name"]))), lambda n: F.concat(n["family"], n["given"], n["literal"]) != "")
    plain = lambda name: T.clean(c[name])
    return rows.select(F.col("doc_id").cast("string"), first("title").alias("title"), authors.alias("authors"), year.alias("year"), T.normalize_doi(c["DOI"]).alias("doi"), first("container-title").alias("container"), first("short-container-title").alias("short"), plain("publisher").alias("publisher"), plain("volume").alias("volume"), plain("issue").alias("issue"), plain("page").alias("pages"), plain("URL").alias("url"), T.crossref_type_to_bibtex(c["type"]).alias("entry_type"))
