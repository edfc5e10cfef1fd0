"""Authors by affiliation, table columns, figures and positional joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

IMAGE_PRIORITY = ("pdf", "eps", "svg", "png", "jpg")


def _names(x: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", x.alias("name")))), lambda y: y["name"])


def consecutive(rows: DataFrame, key: str, name: str) -> DataFrame:
    """doc_id, pos, key -> runs of equal keys: doc_id, grp (from 1), key, names, start."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    new = F.when(F.lag(key).over(by).eqNullSafe(F.col(key)) & (F.row_number().over(by) > 1), 0).otherwise(1)
    runs = rows.withColumn("grp", F.sum(F.col("_new")).over(by.rowsBetween(Window.unboundedPreceding, 0))) if "_new" in rows.columns else rows.withColumn("_new", new).withColumn("grp", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "grp", key).agg(_names(F.col(name)).alias("names"), F.min("pos").alias("start"))


def by_first_appearance(rows: DataFrame, key: str, name: str) -> DataFrame:
    """All rows of a key together, groups in the order of their first row."""
    groups = rows.groupBy("doc_id", key).agg(_names(F.col(name)).alias("names"), F.min("pos").alias("start"))
    return groups.withColumn("grp", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")))


def affiliation_refs(indices: Column) -> Column:
    """[0, 1] -> '1,2'."""
    return F.array_join(F.transform(indices, lambda i: (i + 1).cast("string")), ",")


def column_alignment(cells: DataFrame) -> DataFrame:
    """cells: table, row, col, colspan, text, and explicit (l, c, r or null) -> letter of each column:
    the explicit one, else r if more than half of the non-empty single cells are numbers, else l."""
    full = (F.trim("text") != "") & (F.col("colspan") == 1)
    numeric = full & F.rlike(F.trim("text"), F.lit(T.NUMERIC_CELL))
    cols = cells.groupBy("table", "col").agg(F.count_if(full).alias("n"), F.count_if(numeric).alias("k"), F.max("explicit").alias("e"))
    return cols.select("table", "col", F.coalesce("e", F.when(F.col("k") * 2 > F.col("n"), "r").otherwise("l")).alias("letter"))


def column_starts(cells: DataFrame) -> DataFrame:
    """table, row, i, colspan -> adds start: the sum of the spans before."""
    by = Window.partitionBy("table", "row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("start", F.coalesce(F.sum("colspan").over(by), F.lit(0)))


def grid(cells: DataFrame) -> DataFrame:
    """table, row, i, colspan, rowspan, text -> slots with carried row spans: table, row, col, text,
    carried. A cell takes the first free column; spans go right and down. One table is one state, so a
    task holds a table at a time."""

    def fill(key, rows):
        import pandas as pd

        open_, out = {}, []  # column -> rows left, text
        for row, own in rows.sort_values(["row", "i"]).groupby("row"):
            fresh, col = {}, 0
            for r in own.itertuples():
                while col in open_:
                    col += 1
                for k in range(int(r.colspan)):
                    out.append((key[0], int(row), col, r.text, False))
                    if r.rowspan > 1:
                        fresh[col] = [int(r.rowspan) - 1, r.text]
                    col += 1
            for c, (left, text) in list(open_.items()):
                out.append((key[0], int(row), c, text, True))
                open_[c][0] = left - 1
                if left == 1:
                    del open_[c]
            open_.update(fresh)
        return pd.DataFrame(out, columns=["table", "row", "col", "text", "carried"])

    kind = cells.schema["table"].dataType.simpleString()
    return cells.groupBy("table").applyInPandas(fill, f"table {kind}, row int, col int, text string, carried boolean")


def full_positional(left: DataFrame, right: DataFrame) -> DataFrame:
    """Raw and converted rows of a document by index; ``mismatch`` if a side lacks the index."""
    a = left.select("doc_id", "index", F.col("text").alias("raw"))
    b = right.select("doc_id", "index", F.col("text").alias("converted"))
    return a.join(b, ["doc_id", "index"], "full").withColumn("mismatch", F.col("raw").isNull() | F.col("converted").isNull())


def zip_crops(figures: DataFrame, crops: DataFrame) -> DataFrame:
    """figures: doc_id, pos, name; crops: doc_id, pos, name, crop. By position where both lists of the
    document are equally long and all names agree; else by name, where a name has just one distinct
    crop. Adds crop and how ('position', 'name' or null)."""
    own = figures.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("a"))
    theirs = crops.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("b"))
    names = lambda x: F.transform(x, lambda y: y["name"])
    fit = own.join(theirs, "doc_id").select("doc_id", (names(F.col("a")) == names(F.col("b"))).alias("fit"))
    rank = Window.partitionBy("doc_id").orderBy("pos")
    at = crops.withColumn("i", F.row_number().over(rank)).select("doc_id", "i", F.col("crop").alias("by_pos"))
    single = crops.where("crop is not null").groupBy("doc_id", "name").agg(F.min("crop").alias("by_name"), F.countDistinct("crop").alias("k")).where("k = 1").drop("k")
    out = figures.withColumn("i", F.row_number().over(rank)).join(fit, "doc_id", "left").join(at, ["doc_id", "i"], "left").join(single, ["doc_id", "name"], "left")
    by_pos = F.coalesce("fit", F.lit(False))
    return out.select("doc_id", "pos", "name", F.when(by_pos, F.col("by_pos")).otherwise(F.col("by_name")).alias("crop"), F.when(by_pos, "position").when(F.col("by_name").isNotNull(), "name").alias("how"))


def resolve_overrides(figures: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """figures: doc_id, number, path, is_main; manifest: doc_id, number, path; files: doc_id, number,
    ext, path. manifest (main documents only) > file by extension > embedded."""
    listed = manifest.groupBy("doc_id", "number").agg(F.max("path").alias("m"))
    rank = F.array_position(F.array(*map(F.lit, IMAGE_PRIORITY)), F.col("ext"))
    folder = files.where(F.col("ext").isin(*IMAGE_PRIORITY)).groupBy("doc_id", "number").agg(F.min_by("path", rank).alias("f"))
    out = figures.join(listed, ["doc_id", "number"], "left").join(folder, ["doc_id", "number"], "left")
    main = F.when(F.col("is_main"), F.col("m"))
    return out.select("doc_id", "number", F.coalesce(main, "f", "path").alias("path"), F.when(main.isNotNull(), "manifest").when(F.col("f").isNotNull(), "override").otherwise("embedded").alias("source"))


def overlay(manifests: DataFrame) -> DataFrame:
    """name, extends and fields: a variant's own fields win, others come from what it extends (one
    level)."""
    fields = [c for c in manifests.columns if c not in ("name", "extends")]
    base = manifests.select(F.col("name").alias("_b"), *(F.col(c).alias(f"_{c}") for c in fields))
    return manifests.join(base, manifests["extends"] == base["_b"], "left").select("name", *(F.coalesce(c, f"_{c}").alias(c) for c in fields))
