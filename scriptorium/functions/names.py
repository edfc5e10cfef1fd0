"""Author lists: array<struct<family, given, literal>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escape_latex

NAME = "struct<family:string,given:string,literal:string>"


def name(family: Column, given: Column | None = None, literal: Column | None = None) -> Column:
    empty = F.lit("")
    return F.struct(F.coalesce(family, empty).alias("family"), (empty if given is None else F.coalesce(given, empty)).alias("given"), (empty if literal is None else F.coalesce(literal, empty)).alias("literal"))


def is_literal(n: Column) -> Column:
    return (n["literal"] != "") & (n["family"] == "")


def surnames(authors: Column) -> Column:
    return F.filter(F.transform(authors, lambda n: F.trim(F.when(n["family"] != "", n["family"]).otherwise(n["literal"]))), lambda s: s != "")


def compact(authors: Column) -> Column:
    """Up to three surnames, and how many more."""
    s = surnames(authors)
    return F.when(F.size(s) <= 3, F.array_join(s, ", ")).otherwise(F.concat(F.array_join(F.slice(s, 1, 3), ", "), F.lit(", +"), (F.size(s) - 3).cast("string")))


def to_bibtex(authors: Column) -> Column:
    def one(n):
        return F.when(is_literal(n), F.concat(F.lit("{"), escape_latex(n["literal"]), F.lit("}"))).when(n["given"] != "", F.concat(escape_latex(n["family"]), F.lit(", "), escape_latex(n["given"]))).otherwise(escape_latex(F.when(n["family"] != "", n["family"]).otherwise(n["literal"])))

    return F.array_join(F.transform(authors, one), " and ")


def to_text(authors: Column) -> Column:
    """'Family, Given; Family'."""

    def one(n):
        return F.when(is_literal(n), n["literal"]).when(n["given"] != "", F.concat(n["family"], F.lit(", "), n["given"])).otherwise(n["family"])

    return F.array_join(F.filter(F.transform(authors, one), lambda s: s != ""), "; ")


def from_text(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, ";"), lambda s: F.trim(s)), lambda s: s != "")

    def one(s):
        at = F.instr(s, ",")
        return F.when(at > 0, name(F.trim(F.substring(s, F.lit(1), at - 1)), F.trim(F.substring(s, at + 1, F.length(s))))).otherwise(name(s))

    return F.transform(parts, one)


def plain(authors: Column) -> Column:
    """'Family, G. N., Family'."""

    def initials(g):
        return F.array_join(F.transform(F.filter(F.split(g, r"\s+"), lambda p: p != ""), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lit("."))), " ")

    def one(n):
        return F.when(is_literal(n), n["literal"]).when(n["given"] != "", F.concat(n["family"], F.lit(", "), initials(n["given"]))).otherwise(F.when(n["family"] != "", n["family"]).otherwise(n["literal"]))

    return F.array_join(F.transform(authors, one), ", ")
