"""Findings on files: archives, relations, overlaps and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Archive limits, severities, and rules of document properties.
MAX_MEMBERS, MAX_MEMBER_BYTES, MAX_TOTAL_BYTES, MAX_RATIO, MIN_COMPRESSED = 2048, 256 << 20, 1 << 30, 200.0, 4096
SEVERITIES = ("high", "medium", "low")
PROPERTY_RULES = [
    ("creator", "author", "high"),
    ("lastModifiedBy", "last-modified-by", "high"),
    ("title", "title", "low"),
    ("subject", "subject", "low"),
    ("description", "description", "medium"),
    ("keywords", "keywords", "low"),
    ("category", "category", "low"),
    ("revision", "revision-count", "low"),
    ("created", "created-date", "low"),
    ("modified", "modified-date", "low"),
    ("Company", "company", "high"),
    ("Manager", "manager", "medium"),
    ("Template", "template", "medium"),
    ("TotalTime", "editing-time", "medium"),
]


def severity_rank(x: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), x)


def property_findings(props: DataFrame) -> DataFrame:
    """props: doc_id, name, value -> a finding for each non-empty one that has a rule ('0' is none)."""
    rules = props.sparkSession.createDataFrame(PROPERTY_RULES, "name string, category string, severity string")
    return props.where("trim(value) not in ('', '0')").join(F.broadcast(rules), "name").select("doc_id", "category", "severity", "value")


def count_by_severity(findings: DataFrame, *by: str) -> DataFrame:
    """high, medium, low (0 if none), unremovable, total (the sum of the findings' counts)."""
    return findings.groupBy(*by).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES), F.count_if(~F.col("removable")).alias("unremovable"), F.sum("count").alias("total"))


def sorted_findings(findings: DataFrame, by: str) -> DataFrame:
    """Adds ``place``: by severity, category, location, position."""
    order = Window.partitionBy(by).orderBy(severity_rank(F.col("severity")), "category", "location", "pos")
    return findings.withColumn("place", F.row_number().over(order))


def should_fail(findings: DataFrame, threshold: str, *by: str) -> DataFrame:
    """Whether the worst severity reaches the threshold."""
    worst = F.min(severity_rank(F.col("severity")))
    return findings.groupBy(*by).agg((worst <= SEVERITIES.index(threshold) + 1).alias("fails"))


def unsafe_name(name: Column) -> Column:
    plain = F.replace(name, F.lit("\\"), F.lit("/"))
    return F.contains(name, F.lit("\0")) | F.startswith(plain, F.lit("/")) | F.rlike(plain, F.lit("^[A-Za-z]:")) | F.array_contains(F.split(plain, "/"), "..")


def archive_guard(members: DataFrame, max_members: int = MAX_MEMBERS, max_member: int = MAX_MEMBER_BYTES, max_total: int = MAX_TOTAL_BYTES, max_ratio: float = MAX_RATIO) -> DataFrame:
    """members: archive, no, name, size, csize, encrypted -> archive, verdict: 'ok' or the first bound
    that breaks: too many members; the first bad member's fault (encrypted, unsafe, duplicate, too
    large); the total; the ratio."""
    key = F.lower(F.replace("name", F.lit("\\"), F.lit("/")))
    again = F.row_number().over(Window.partitionBy("archive", key).orderBy("no")) > 1
    fault = F.when(F.col("encrypted"), "encrypted").when(unsafe_name(F.col("name")), "unsafe_name").when(again, "duplicate").when(F.col("size") > max_member, "member_size")
    each = members.withColumn("fault", fault)
    agg = each.groupBy("archive").agg(F.count("*").alias("n"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("no"))).alias("fault"), F.sum("size").alias("total"), F.sum("csize").alias("packed"))
    verdict = F.when(F.col("n") > max_members, "member_count").when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("total") > max_total, "total_size").when((F.col("packed") >= MIN_COMPRESSED) & (F.col("total") > F.col("packed") * max_ratio), "ratio").otherwise("ok")
    return agg.select("archive", verdict.alias("verdict"))


def kept_relations(rels: DataFrame, removed: DataFrame) -> DataFrame:
    """rels: doc_id, part, target, external; removed: doc_id, part. Relations neither of whose ends is
    removed; external targets stay."""
    own = removed.select("doc_id", "part")
    out = rels.join(own, ["doc_id", "part"], "left_anti")
    gone = own.select(F.col("doc_id").alias("_d"), F.col("part").alias("_t"))
    return out.join(gone, (out["doc_id"] == gone["_d"]) & (out["target"] == gone["_t"]) & ~out["external"], "left_anti")


def overlapping(boxes: DataFrame, others: DataFrame, on: str, tile: float = 64.0) -> DataFrame:
    """Boxes (x0, y0, x1, y1) that overlap any of the others on the same page; touching isn't overlap.

    Boxes are cut into tiles and meet by (page, tile), so a page with very many boxes is no nested
    loop."""

    def tiles(df, p):
        cover = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile))
        return df.withColumn(f"{p}x", F.explode(cover("x0", "x1"))).withColumn(f"{p}y", F.explode(cover("y0", "y1")))

    a = tiles(boxes, "_t")
    b = tiles(others, "_u").select(F.col(on).alias("_on"), *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")), "_ux", "_uy")
    hit = a.join(b, (a[on] == b["_on"]) & (a["_tx"] == b["_ux"]) & (a["_ty"] == b["_uy"]) & (a["x0"] < b["_x1"]) & (b["_x0"] < a["x1"]) & (a["y0"] < b["_y1"]) & (b["_y0"] < a["y1"]), "left_semi")
    return hit.select(*boxes.columns).distinct()


def dark(fill: Column, limit: float = 0.2) -> Column:
    """Whether a gray, RGB or CMYK fill is dark."""
    g = lambda k: F.get(fill, F.lit(k))
    rgb = 0.299 * g(0) + 0.587 * g(1) + 0.114 * g(2)
    cmyk = 0.299 * (1 - g(0)) * (1 - g(3)) + 0.587 * (1 - g(1)) * (1 - g(3)) + 0.114 * (1 - g(2)) * (1 - g(3))
    return F.when(F.size(fill) == 1, g(0) <= limit).when(F.size(fill) == 3, rgb <= limit).when(F.size(fill) == 4, cmyk <= limit).otherwise(F.lit(False))
