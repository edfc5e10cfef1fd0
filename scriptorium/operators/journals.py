"""Journal manifests and preambles: validation, class options, layouts and templates, as expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What classes call their options, and the lines that preambles get.
MODES = ("numeric", "authoryear")
ONE_COLUMN, TWO_COLUMNS = "onecolumn", "twocolumn"
LINE_NUMBERS = {"revtex4-2": "linenumbers"}
FLOATS_AT_END = {"revtex4-2": "endfloats"}
HYPERREF, RAGGED = "\\usepackage{hyperref}\n", "\\raggedbottom\n"
LINENO, SPACING, ENDFLOAT = "\\usepackage{lineno}\n\\linenumbers\n", "\\usepackage{setspace}\n\\doublespacing\n", "\\usepackage[nolists,tablesfirst]{endfloat}\n"
CLASS_LINE = r"\\documentclass(?:\[([^\]]*)\])?\{([^}]+)\}"


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def class_options(preamble: Column, add: Column, remove: Column) -> Column:
    """The options of the first class line without ``remove`` and with ``add`` at the end, others in their
    order. add and remove: arrays."""
    return bound(preamble, lambda p: _class_options(p, add, remove))


def _class_options(preamble: Column, add: Column, remove: Column) -> Column:
    at = F.regexp_instr(preamble, F.lit(CLASS_LINE))
    line = F.regexp_extract(preamble, CLASS_LINE, 0)
    old = F.filter(F.transform(F.split(F.regexp_extract(preamble, CLASS_LINE, 1), ","), lambda o: F.trim(o)), lambda o: (o != "") & ~F.array_contains(remove, o) & ~F.array_contains(add, o))
    new = F.concat(old, add)
    made = F.concat(F.lit("\\documentclass"), F.when(F.size(new) > 0, F.concat(F.lit("["), F.array_join(new, ","), F.lit("]"))).otherwise(""), F.lit("{"), F.regexp_extract(preamble, CLASS_LINE, 2), F.lit("}"))
    return F.when(at > 0, F.concat(F.substring(preamble, F.lit(1), at - 1), made, F.substring(preamble, at + F.length(line), F.length(preamble)))).otherwise(preamble)


def append(preamble: Column, block: str | Column) -> Column:
    block = F.lit(block) if isinstance(block, str) else block
    return F.concat(F.regexp_replace(preamble, r"([^\n])\z", "$1\n"), block)


def ensure(preamble: Column, pattern: str, block: str) -> Column:
    """The block at the end, unless something matches the pattern."""
    return bound(preamble, lambda p: F.when(F.rlike(p, F.lit(pattern)), p).otherwise(append(p, block)))


def layout_error(columns: Column) -> Column:
    return F.when(~F.coalesce(columns.isin("default", "one", "two"), F.lit(False)), F.lit("columns must be 'default', 'one' or 'two'"))


def _native(document_class: Column, table: dict[str, str]) -> Column:
    return F.array_compact(F.array(F.create_map(*(F.lit(y) for kv in table.items() for y in kv))[document_class]))


def apply_layout(preamble: Column, document_class: Column, columns: Column, line_numbers: Column, double_spacing: Column) -> Column:
    """columns: default, one or two. What the class has an option for is an option, else a package."""
    want = F.when(columns == "one", F.lit(ONE_COLUMN)).when(columns == "two", F.lit(TWO_COLUMNS))
    other = F.when(columns == "one", F.lit(TWO_COLUMNS)).otherwise(F.lit(ONE_COLUMN))
    option, none = _native(document_class, LINE_NUMBERS), F.array().cast("array<string>")
    out = bound(preamble, lambda p: F.when(want.isNotNull(), class_options(p, F.array(want), F.array(other))).otherwise(p))
    out = bound(out, lambda p: F.when(~line_numbers, p).when(F.size(option) > 0, class_options(p, option, none)).otherwise(append(p, LINENO)))
    return bound(out, lambda p: F.when(double_spacing, append(p, SPACING)).otherwise(p))


def main_preamble(preamble: Column, document_class: Column, columns: Column, line_numbers: Column, double_spacing: Column, figures_at_end: Column) -> Column:
    """A journal's preamble as the document gets it: links, layout, floats, ragged bottom; what it already
    says stays."""
    out = apply_layout(ensure(preamble, r"\\usepackage(?:\[[^\]]*\])?\{[^}]*\bhyperref\b", HYPERREF), document_class, columns, line_numbers, double_spacing)
    option, none = _native(document_class, FLOATS_AT_END), F.array().cast("array<string>")
    out = bound(out, lambda p: F.when(~figures_at_end, p).when(F.size(option) > 0, class_options(p, option, none)).otherwise(append(p, ENDFLOAT)))
    return ensure(out, r"\\(?:raggedbottom|flushbottom)\b", RAGGED)


def legacy_bibliography(main_text: Column) -> Column:
    """Advice for an old main file that names its bibliography itself, else null."""
    direct = F.rlike(main_text, F.lit(r"(?m)^[^%\n]*\\bibliography\{")) & ~F.contains(main_text, F.lit("\\input{generated/bibliography}"))
    return F.when(direct, F.lit("the main file calls \\bibliography itself; input generated/bibliography instead, so that a text without citations compiles"))


# Manifests --------------------------------------------------------------------------------------------

MANIFEST = "struct<display_name:string,document_class:string,class_options:array<string>,packages:array<struct<name:string,options:array<string>>>,bib:struct<modes:map<string,struct<bibstyle:string,natbib_options:array<string>>>,default_mode:string>,figure_env:struct<single:string,wide:string>>"


def validate_manifests(manifests: DataFrame) -> DataFrame:
    """manifests: name, data (JSON) -> name, manifest (null if not valid), error (its first fault)."""
    m = F.from_json("data", MANIFEST)
    rows = manifests.withColumn("_m", m)
    c = F.col("_m")
    full = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    required = [F.when(~full(c[k]), f"{k} must be a non-empty string") for k in ("display_name", "document_class")]
    package = F.get(F.filter(F.transform(c["packages"], lambda p, i: F.when(~full(p["name"]), F.concat(F.lit("packages["), i.cast("string"), F.lit("] has no name")))), lambda e: e.isNotNull()), F.lit(0))
    modes = F.map_keys(c["bib"]["modes"])
    unknown = F.get(F.filter(modes, lambda k: ~k.isin(*MODES)), F.lit(0))
    bare = F.get(F.filter(modes, lambda k: ~full(F.element_at(c["bib"]["modes"], k)["bibstyle"])), F.lit(0))
    error = F.coalesce(
        F.when(c.isNull() | ~F.startswith(F.ltrim("data"), F.lit("{")), "manifest must be a mapping"),
        *required,
        package,
        F.when(c["bib"].isNull(), "bib is missing"),
        F.when(F.coalesce(F.size(modes), F.lit(0)) < 1, "bib.modes must have a mode"),
        F.concat(F.lit("bib.modes has an unknown mode "), unknown),
        F.concat(F.lit("bib.modes."), bare, F.lit(" has no bibstyle")),
        F.when(c["bib"]["default_mode"].isNull(), "bib.default_mode is missing"),
        F.when(~F.array_contains(modes, c["bib"]["default_mode"]), F.concat(F.lit("bib.default_mode "), c["bib"]["default_mode"], F.lit(" is no mode of it"))),
    )
    env = F.struct(F.coalesce(c["figure_env"]["single"], F.lit("figure")).alias("single"), F.coalesce(c["figure_env"]["wide"], F.lit("figure*")).alias("wide"))
    return rows.withColumn("error", error).select("name", F.when(F.col("error").isNull(), c.withField("figure_env", env)).alias("manifest"), "error")


def resolve_mode(manifest: Column, mode: Column) -> Column:
    """The mode asked for, or the default; null if the journal has no such mode."""
    chosen = F.coalesce(mode, manifest["bib"]["default_mode"])
    return F.when(F.map_contains_key(manifest["bib"]["modes"], chosen), chosen)


#: Functions that templates may call on an array of affiliation numbers.
HELPERS: dict[str, Callable[[Column], Column]] = {
    "format_affil_refs": lambda x: F.array_join(F.transform(x, lambda i: (i + 1).cast("string")), ","),
    "format_superscript": lambda x: F.when(F.size(x) > 0, F.concat(F.lit("$^{"), F.array_join(F.transform(x, lambda i: (i + 1).cast("string")), ","), F.lit("}$"))).otherwise(""),
}


def render(template: str, values: dict[str, Column]) -> Column:
    r"""A template's text with \VAR{name} and \VAR{helper(name)} replaced; an unknown name is an error."""
    out, at = [], 0
    for m in re.finditer(r"\\VAR\{\s*(?:(\w+)\(\s*(\w+)\s*\)|(\w+))\s*\}", template):
        helper, name = m[1], m[2] or m[3]
        if name not in values or (helper and helper not in HELPERS):
            raise ValueError(f"unknown name {helper or name}")
        out += [F.lit(template[at : m.start()]), F.coalesce(HELPERS[helper](values[name]) if helper else values[name].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def preamble_of(manifest: Column, mode: Column) -> Column:
    """A manifest's preamble: class line, packages, bibliography style of the mode."""
    bracket = lambda x: F.when(F.coalesce(F.size(x), F.lit(0)) > 0, F.concat(F.lit("["), F.array_join(x, ","), F.lit("]"))).otherwise("")
    style = F.element_at(manifest["bib"]["modes"], resolve_mode(manifest, mode))
    uses = F.array_join(F.transform(F.coalesce(manifest["packages"], F.array().cast("array<struct<name:string,options:array<string>>>")), lambda p: F.concat(F.lit("\\usepackage"), bracket(p["options"]), F.lit("{"), p["name"], F.lit("}\n"))), "")
    natbib = F.concat(F.lit("\\usepackage"), bracket(style["natbib_options"]), F.lit("{natbib}\n"))
    return F.concat(F.lit("\\documentclass"), bracket(manifest["class_options"]), F.lit("{"), manifest["document_class"], F.lit("}\n"), uses, natbib, F.lit("\\bibliographystyle{"), style["bibstyle"], F.lit("}\n"))
