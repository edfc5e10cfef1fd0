"""Text functions on columns, all built-in expressions (no Python on the executors)."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What must equal the published behaviour.
CSL_TO_BIBTEX = {
    "article-journal": "article",
    "article": "article",
    "article-magazine": "article",
    "article-newspaper": "article",
    "paper-conference": "inproceedings",
    "book": "book",
    "chapter": "incollection",
    "entry-encyclopedia": "incollection",
    "report": "techreport",
    "thesis": "phdthesis",
    "manuscript": "unpublished",
    "webpage": "misc",
    "dataset": "misc",
    "patent": "misc",
}
CROSSREF_TO_BIBTEX = {
    "journal-article": "article",
    "proceedings-article": "inproceedings",
    "book-chapter": "incollection",
    "reference-entry": "incollection",
    "book": "book",
    "monograph": "book",
    "book-section": "incollection",
    "report": "techreport",
    "dissertation": "phdthesis",
    "posted-content": "misc",
    "dataset": "misc",
}
FOLD = {"ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h", "ĸ": "k", "ŉ": "n"}
TITLE_STOPWORDS = ("the", "a", "an", "on", "of", "in", "and", "for", "to", "with", "from", "at", "by", "as", "into", "over", "via", "using", "toward", "towards")
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\textbraceleft{}", "}": r"\textbraceright{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
DOI_LATEX = {"_": r"\_", "&": r"\&", "%": r"\%", "#": r"\#", "{": r"\textbraceleft{}", "}": r"\textbraceright{}"}
MILLER_TRIADS = ("110", "101", "011", "111")
HEADING_KEYWORDS = ("references and notes", "reference list", "references", "reference", "bibliography", "works cited", "literature cited")
EMAIL = r"[\w.+-]+@(?:[\w-]+\.)+[\w-]+"
NUMERIC_CELL = r"^[+-]?(\d{1,3}(,\d{3})*|\d+)(\.\d+)?([eE][+-]?\d+)?%?$"
DASHES = "‒–—-"

_accents = None


def _accent_map() -> tuple[str, str]:
    """Letters of the basic plane that decompose to one character and marks, from Unicode's own data."""
    global _accents
    if _accents is None:
        a, b = [], []
        for code in range(0xC0, 0xFFFF):
            c = chr(code)
            if 0xD800 <= code <= 0xDFFF or c in FOLD:
                continue
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(plain) == 1 and plain != c and plain.isascii():
                a.append(c)
                b.append(plain)
        _accents = "".join(a), "".join(b)
    return _accents


def ascii_fold(x: Column) -> Column:
    """Accents off, special Latin letters spelled out. Characters that decompose to several letters
    (ligatures, fractions) stay as they are."""
    one = {k: v for k, v in FOLD.items() if len(v) == 1}
    a, b = _accent_map()
    x = F.translate(x, "".join(one) + a, "".join(one.values()) + b)
    x = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), [(k, v) for k, v in FOLD.items() if len(v) > 1], x)
    return F.regexp_replace(x, r"\p{M}+", "")


def lookup(x: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(y) for kv in table.items() for y in kv))[x]


def csl_type_to_bibtex(x: Column) -> Column:
    return F.coalesce(lookup(F.trim(F.coalesce(x, F.lit(""))), CSL_TO_BIBTEX), F.lit("misc"))


def crossref_type_to_bibtex(x: Column) -> Column:
    return F.coalesce(lookup(F.coalesce(x, F.lit("")), CROSSREF_TO_BIBTEX), csl_type_to_bibtex(x))


def clean(x: Column) -> Column:
    """Trimmed; empty is null."""
    return F.nullif(F.trim(x), F.lit(""))


def slug(x: Column) -> Column:
    return F.lower(F.regexp_replace(ascii_fold(F.coalesce(x, F.lit(""))), "[^A-Za-z0-9]", ""))


def first_title_word(title: Column) -> Column:
    words = F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), r"\s+"), slug), lambda w: w != "")
    good = F.filter(words, lambda w: ~w.isin(*TITLE_STOPWORDS))
    return F.coalesce(F.get(good, F.lit(0)), F.get(words, F.lit(0)), F.lit(""))


def author_token(literal: Column, family: Column) -> Column:
    """Of the first author: the first word of a literal name, else the family name."""
    return F.when(clean(literal).isNotNull() & clean(family).isNull(), slug(F.get(F.split(F.trim(literal), r"\s+"), F.lit(0)))).otherwise(slug(family))


def base_key(author: Column, year: Column, title: Column) -> Column:
    word, year = first_title_word(title), F.coalesce(clean(year), F.lit("nd"))
    return F.when(author != "", F.concat(author, year, word)).when(word != "", F.concat(word, year)).otherwise(F.concat(F.lit("anon"), year))


def suffix(n: Column) -> Column:
    """0, 1, ... -> a, b, ..., z, za, zb, ..."""
    return F.concat(F.repeat(F.lit("z"), (n / 26).cast("int")), F.char((n % 26 + 97).cast("int")))


def _each(x: Column, table: dict[str, str]) -> Column:
    """Every character through the table once."""
    return F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(lookup(c, table), c)), "")


def escape_latex(x: Column) -> Column:
    return F.when(F.rlike(x, F.lit(r"[\\&%$#_{}~^]")), _each(x, LATEX)).otherwise(x)


def escape_doi(x: Column) -> Column:
    return F.when(F.rlike(x, F.lit(r"[_&%#{}]")), _each(x, DOI_LATEX)).otherwise(x)


def protect_title(x: Column) -> Column:
    """Escaped; words with a capital after their first letter get braces. White space stays."""
    parts = F.regexp_extract_all(x, F.lit(r"(?U)(\s+|\S+)"), 1)
    inner = r"(?U)^\P{L}*\p{L}.*\p{Lu}"
    return F.array_join(F.transform(parts, lambda w: F.when(F.rlike(w, F.lit(inner)), F.concat(F.lit("{"), escape_latex(w), F.lit("}"))).otherwise(escape_latex(w))), "")


def format_pages(x: Column) -> Column:
    pattern = rf"^\s*([A-Za-z0-9]+)\s*[-{DASHES[:-1]}]\s*([A-Za-z0-9]+)\s*$"
    return F.when(F.rlike(x, F.lit(pattern)), F.regexp_replace(x, pattern, "$1--$2")).otherwise(escape_latex(x))


def norm_pages(x: Column) -> Column:
    return clean(F.regexp_replace(F.regexp_replace(x, "[‐-―−]", "-"), " ", ""))


def normalize_doi(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", ""))


def guess_year(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(?:18|19|20)\d{2}", 0), F.lit(""))


def guess_surname(x: Column) -> Column:
    """Of the first six words, the first that isn't an initial and begins with two letters of a name."""
    letters = "A-Za-zÀ-ɏ"
    words = F.slice(F.filter(F.split(F.regexp_replace(x, r"^\s*\[\d+\]\s*", ""), r"\s+"), lambda w: w != ""), 1, 6)
    cores = F.transform(words, lambda w: F.regexp_replace(w, "^[,;:]+|[,;:]+$", ""))
    names = F.filter(cores, lambda w: ~F.rlike(w, F.lit(rf"^[{letters}]\.?$")) & F.rlike(w, F.lit(rf"^[{letters}][{letters}'`-]+")))
    return F.nullif(F.regexp_extract(F.get(names, F.lit(0)), rf"^[{letters}][{letters}'`-]+", 0), F.lit(""))


def year_in_text(year: Column, text: Column) -> Column:
    return F.coalesce((F.length(year) > 0) & F.contains(text, year), F.lit(False))


def surname_in_text(surname: Column, text: Column) -> Column:
    quoted = F.regexp_replace(surname, r"([\\\[\](){}.*+?^$|-])", r"\\$1")
    return F.coalesce((F.length(surname) > 0) & F.rlike(text, F.concat(F.lit(r"(?iU)\b"), quoted, F.lit(r"\b"))), F.lit(False))


def strip_markup(x: Column) -> Column:
    """Tags off, the five XML entities and no-break spaces decoded (the ampersand last), white space
    as one space."""
    x = F.regexp_replace(x, "<[^>]+>", "")
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(c))
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def snippet(x: Column, most: int = 80) -> Column:
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.left(x, F.lit(most - 1))), F.lit("…")))


def is_plain_number(x: Column) -> Column:
    return F.rlike(x, F.lit("^([0-9]|[1-9][0-9]+)$")) & ~x.isin(*MILLER_TRIADS)


def expand_numeric_range(x: Column) -> Column:
    """'3-5,8' -> [3, 4, 5, 8]; reversed ranges and those of 1000 or more give their ends; what isn't
    a number is left out."""

    def one(chunk: Column) -> Column:
        chunk = F.trim(chunk)
        parts = F.split(chunk, f"[{DASHES}]+")
        a, b = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
        x, y = F.expr("1"), F.expr("1")
        x, y = a.try_cast("int"), b.try_cast("int")
        ranged = (F.size(parts) == 2) & is_plain_number(a) & is_plain_number(b)
        return F.when(ranged, F.when((x <= y) & (y - x < 1000), F.sequence(F.least(x, y), F.least(F.greatest(x, y), F.least(x, y) + 999))).otherwise(F.array(x, y))).when(is_plain_number(chunk), F.array(chunk.try_cast("int"))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.split(x, ","), one))


def raw_leading_surname(title: Column) -> Column:
    head = F.trim(F.get(F.split(title, ","), F.lit(0)))
    head = F.trim(F.regexp_replace(head, r"(?U)^(?:\p{L}\.[\s-]*)+", ""))
    first = F.lower(F.regexp_replace(F.get(F.split(head, r"\s+"), F.lit(0)), "^[.'`-]+|[.'`-]+$", ""))
    return F.when(F.rlike(first, F.lit(r"^\p{L}{2,}$")), first)


def split_list(x: Column, at: str = "[;,]") -> Column:
    return F.filter(F.transform(F.split(x, at), lambda k: F.trim(k)), lambda k: k != "")


def ordered_distinct_numbers(x: Column) -> Column:
    return F.array_distinct(expand_numeric_range(x))
