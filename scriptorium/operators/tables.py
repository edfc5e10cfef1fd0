"""Blocks and tables of documents as rows: the filters that clean them, and LaTeX tables.

blocks: doc_id, pos, kind (para, header, list, table, image, raw), text, level, and flags as far as used.
cells: doc_id, table (number in the document), row, i, colspan, rowspan, text, head (a header row),
nested (rows of a table inside the cell: array of arrays of texts, else null)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import groups, structure

# When a table spans the page, and how it is made to fit.
WIDE_COLUMNS = 4
FIT = r"\ifdim\width>\linewidth\linewidth\else\width\fi"
BREAK = r"\allowbreak{}"
DEGRADED_NOTE = "Simplified table: merged or nested cells were repeated as text; compare it with the source."


def promote_headings(blocks: DataFrame) -> DataFrame:
    """Top-level paragraphs that read as headings become headers, and lists all of whose items do become
    one header an item. A list is a block of kind list with ``items``. Adds ``part`` (place in a list)."""
    title = structure.section_heading(F.col("text"))
    items = F.transform("items", lambda x: structure.section_heading(x))
    all_heads = (F.col("kind") == "list") & F.coalesce((F.size("items") > 0) & F.forall(items, lambda h: h.isNotNull()), F.lit(False))
    rows = blocks.withColumn("_h", F.when(F.col("kind") == "para", F.array(title)).when(all_heads, items))
    rows = rows.withColumn("_h", F.when(F.exists("_h", lambda h: h.isNull()), None).otherwise(F.col("_h")))
    each = rows.select("*", F.posexplode_outer("_h").alias("part", "_one"))
    head = F.col("_one").isNotNull()
    return each.withColumn("kind", F.when(head, "header").otherwise(F.col("kind"))).withColumn("text", F.when(head, F.col("_one.title")).otherwise(F.col("text"))).withColumn("level", F.when(head, F.col("_one.level")).otherwise(F.col("level"))).withColumn("promoted", head).withColumn("part", F.coalesce("part", F.lit(0))).drop("_h", "_one")


def strip_blank(blocks: DataFrame) -> DataFrame:
    """Without paragraphs of nothing but white space, unless they carry something (``carries``: an image, a
    citation, math, raw text, a note or a link)."""
    blank = (F.col("kind") == "para") & (F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "") == "")
    return blocks.where(~(blank & ~F.coalesce(F.col("carries"), F.lit(False))))


def slash_breaks(text: Column) -> Column:
    """A line may break after each slash of running text."""
    return F.replace(text, F.lit("/"), F.lit("/" + BREAK))


def strip_references(blocks: DataFrame) -> DataFrame:
    """Without the reference list: what follows the first header that names it, to the end."""
    named = (F.col("kind") == "header") & structure.is_reference_heading(F.col("text"))
    start = F.min(F.when(named, F.col("pos"))).over(Window.partitionBy("doc_id"))
    return blocks.withColumn("_s", start).where("_s is null or pos < _s").drop("_s")


def header_reference_list(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, number, text: the reference list of sources other than the word processor's; its
    heading must be a header, and only typed numbers count."""
    start = F.min(F.when((F.col("kind") == "header") & structure.is_reference_heading(F.col("text")), F.col("pos"))).over(Window.partitionBy("doc_id"))
    rows = blocks.withColumn("_s", start).where("pos > _s and kind in ('para', 'list') and trim(text) <> ''")
    number = F.coalesce(*(F.nullif(F.regexp_extract("text", structure.LIST_NUMBER, k), F.lit("")) for k in (1, 2, 3))).try_cast("int")
    return rows.select("doc_id", "pos", number.alias("number"), F.trim(F.regexp_replace("text", structure.LIST_NUMBER, "")).alias("text"))


def plant_anchors(blocks: DataFrame) -> DataFrame:
    """Images and citations of a document are numbered from 1, each kind by itself: adds anchor."""
    by = Window.partitionBy("doc_id", "kind").orderBy("pos")
    no = F.row_number().over(by).cast("string")
    return blocks.withColumn("anchor", F.when(F.col("kind") == "image", F.concat(F.lit("%%FIGURE:"), no, F.lit("%%"))).when(F.col("kind") == "cite", F.concat(F.lit("%%CITE:"), no, F.lit("%%"))))


#: The filters of a block table, in their fixed order.
FILTERS: tuple[Callable[[DataFrame], DataFrame], ...] = (promote_headings, strip_blank, plant_anchors)


def apply_all(blocks: DataFrame, filters: tuple[Callable[[DataFrame], DataFrame], ...] = FILTERS) -> DataFrame:
    for f in filters:
        blocks = blocks.transform(f)
    return blocks


# Tables -----------------------------------------------------------------------------------------------


def flatten_nested(nested: Column) -> Column:
    """The rows of a table inside a cell as text: cells by '; ', rows by ' / ', empty ones left out."""
    rows = F.transform(nested, lambda r: F.array_join(F.filter(F.transform(r, lambda c: F.trim(c)), lambda c: c != ""), "; "))
    return F.array_join(F.filter(rows, lambda r: r != ""), " / ")


def pathologies(cells: DataFrame) -> DataFrame:
    """doc_id, table, reason: why a table can't be rendered as it is, or null. A nested table comes before
    merged rows."""
    found = cells.groupBy("doc_id", "table").agg(F.bool_or(F.col("nested").isNotNull()).alias("n"), F.bool_or(F.col("rowspan") > 1).alias("r"))
    return found.select("doc_id", "table", F.when(F.col("n"), "nested table").when(F.col("r"), "merged rows").alias("reason"))


def to_latex(cells: DataFrame, captions: DataFrame) -> DataFrame:
    """doc_id, table, text: a float with a ruled tabular for each table. captions: doc_id, table, caption.
    Tables with merged rows or nested tables repeat the merged text and flatten the nested one, and say
    so in a note. Alignment: explicit (column ``explicit``, null for none), else right for numbers."""
    flat = cells.withColumn("text", F.when(F.col("nested").isNotNull(), flatten_nested(F.col("nested"))).otherwise(F.col("text")))
    named = flat.withColumn("_t", F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.col("table").cast("string")))
    starts = groups.column_starts(named.select("_t", "doc_id", "table", "row", "i", "colspan", "rowspan", "text", "head", "explicit").withColumn("no", F.col("table")).withColumn("table", F.col("_t")))
    merged = starts.groupBy("table").agg(F.max("rowspan").alias("most")).where("most > 1").select("table")
    one = F.struct("text", "colspan").alias("c")
    plain = starts.join(merged, "table", "left_anti").select("table", "row", F.col("i").cast("int").alias("col"), one)
    # row spans are carried on by a state for each table; only tables that have any go there
    slots = groups.grid(starts.join(merged, "table", "left_semi").select("table", "row", "i", F.lit(1).alias("colspan"), "rowspan", F.to_json(one).alias("text")))
    shown = plain.unionByName(slots.select("table", "row", "col", F.from_json("text", plain.schema["c"].dataType).alias("c")))
    span, body = F.col("c.colspan"), T.escape_latex(F.trim(F.coalesce(F.col("c.text"), F.lit(""))))
    cell = F.when(span > 1, F.concat(F.lit("\\multicolumn{"), span.cast("string"), F.lit("}{c}{"), body, F.lit("}"))).otherwise(body)
    line = shown.groupBy("table", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", cell.alias("x")))), lambda x: x["x"]), " & ").alias("line"))
    heads = named.groupBy(F.col("_t").alias("table"), "row").agg(F.bool_or("head").alias("head"))
    lines = line.join(heads, ["table", "row"]).select("table", "row", "head", F.concat("line", F.lit(" \\\\")).alias("line"))
    ordered = lambda head: F.transform(F.filter(F.array_sort(F.collect_list(F.struct("row", "head", "line"))), lambda x: x["head"] == head), lambda x: x["line"])
    whole = lines.groupBy("table").agg(ordered(True).alias("top"), ordered(False).alias("rest"))
    data = starts.where("not head").select("table", "row", F.col("start").alias("col"), "colspan", "text", "explicit")
    letters = groups.column_alignment(data)
    width = starts.groupBy("table").agg(F.max(F.col("start") + F.col("colspan")).cast("int").alias("width"), F.first("doc_id").alias("doc_id"), F.first("no").alias("no"))
    aligned = letters.groupBy("table").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), "letter"))).alias("letters"))
    made = whole.join(width, "table").join(aligned, "table", "left").withColumn("letters", F.coalesce("letters", F.create_map().cast("map<int,string>")))
    made = made.withColumn("spec", F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.coalesce(F.element_at("letters", k.cast("int")), F.lit("l"))), ""))
    made = made.select("doc_id", F.col("no").alias("table"), "top", "rest", "width", "spec").join(captions, ["doc_id", "table"], "left").join(pathologies(cells), ["doc_id", "table"])
    tabular = F.concat(F.array(F.concat(F.lit("\\begin{tabular}{"), "spec", F.lit("}")), F.lit("\\toprule")), "top", F.when(F.size("top") > 0, F.array(F.lit("\\midrule"))).otherwise(F.array().cast("array<string>")), "rest", F.array(F.lit("\\bottomrule"), F.lit("\\end{tabular}")))
    wide, none = F.col("width") >= WIDE_COLUMNS, F.array().cast("array<string>")
    env = F.when(wide, "table*").otherwise("table")
    caption = F.when(F.coalesce(F.length("caption"), F.lit(0)) > 0, F.array(F.concat(F.lit("\\caption{"), T.escape_latex(F.col("caption")), F.lit("}")))).otherwise(none)
    inside = F.when(wide, F.concat(F.array(F.lit(f"\\resizebox{{{FIT}}}{{!}}{{%")), tabular, F.array(F.lit("}")))).otherwise(tabular)
    note = F.when(F.col("reason").isNotNull(), F.array(F.lit(""), F.lit(f"\\noindent\\textbf{{{DEGRADED_NOTE}}}"))).otherwise(none)
    out = F.concat(F.array(F.concat(F.lit("\\begin{"), env, F.lit("}[htbp]")), F.lit("\\centering")), caption, inside, F.array(F.concat(F.lit("\\end{"), env, F.lit("}"))), note)
    return made.select("doc_id", "table", F.array_join(out, "\n").alias("text"))


def body(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, text: the LaTeX body of each document, its blocks in order with empty lines between. tables:
    doc_id, table, text, for the blocks of kind table in their order."""
    by = Window.partitionBy("doc_id", "kind").orderBy("pos", "part")
    numbered = blocks.withColumn("table", F.when(F.col("kind") == "table", F.row_number().over(by))).join(tables.withColumnRenamed("text", "_tex"), ["doc_id", "table"], "left")
    subs = F.repeat(F.lit("sub"), F.coalesce("level", F.lit(1)) - 1)
    own = slash_breaks(T.escape_latex(F.col("text")))
    tex = F.when(F.col("kind") == "header", F.concat(F.lit("\\"), subs, F.lit("section{"), own, F.lit("}"))).when(F.col("kind") == "table", F.col("_tex")).when(F.col("kind") == "raw", F.col("text")).when(F.col("anchor").isNotNull(), F.col("anchor")).otherwise(own)
    each = numbered.select("doc_id", "pos", "part", tex.alias("tex")).where("tex <> ''")
    return each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part", "tex"))), lambda x: x["tex"]), "\n\n").alias("text"))
