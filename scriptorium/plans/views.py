"""A bibliography corpus derived from the star schema by fixed arithmetic, for Spark and as SQL text.

library: a record for each part. typed: free-text references to parts, with faults. citations: line
items cite parts. paragraphs: line items as a document's paragraphs. events as client accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIBRARY = """
SELECT p_partkey AS pos, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey AS {string}) END AS raw_id,
  p_name AS title, p_type AS family, p_brand AS given, p_type AS families, CAST(1990 + p_size % 5 AS {string}) AS year, p_brand AS container,
  CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 11 <> 0 THEN '10.' || CAST(1000 + p_size AS {string}) || '/' || CAST(p_partkey AS {string}) END AS doi,
  CAST(p_size AS {string}) AS volume, CAST(p_partkey % 12 + 1 AS {string}) AS issue,
  CAST(p_partkey AS {string}) || '-' || CAST(p_partkey + 9 AS {string}) AS pages
FROM part"""

TYPED = """
SELECT p_partkey AS ref_id, CASE WHEN p_partkey % 4 = 1 THEN 'Nobody' ELSE p_type END || ', B. ' || CASE WHEN p_partkey % 6 = 2 THEN upper(p_name) ELSE p_name END
  || ' ' || p_brand || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ' (' || CAST(1990 + p_size % 5 AS {string}) || ').' END AS text
FROM part"""

#: The total order of a document's line items.
ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"

CITATIONS = f"""
SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS place, l_partkey AS part FROM lineitem"""

PARAGRAPHS = f"""
SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS pos, l_linenumber AS line, l_partkey AS part, l_returnflag AS flag,
  CASE l_partkey % 12 WHEN 0 THEN 'I. Introduction' WHEN 1 THEN '1. Methods' WHEN 2 THEN '2.1 Data sources' WHEN 3 THEN 'RESULTS AND ' || upper(l_linestatus)
    WHEN 4 THEN 'References' WHEN 5 THEN '[' || CAST(l_linenumber AS {{string}}) || '] Smith, B. part ' || CAST(l_partkey AS {{string}}) WHEN 6 THEN 'Figure ' || CAST(l_linenumber AS {{string}}) || ': A plot of ' || l_linestatus
    WHEN 7 THEN 'Keywords: alpha; beta , ' || l_returnflag || ';' WHEN 8 THEN '1.2.3.4 Deep heading' WHEN 9 THEN 'Plain text, about ' || CAST(l_suppkey AS {{string}}) || ' items.'
    WHEN 10 THEN 'Table ' || CAST(l_linenumber AS {{string}}) || '. Values for ' || l_returnflag ELSE '3. Jones (' || CAST(1990 + l_suppkey % 30 AS {{string}}) || ')' END AS text
FROM lineitem"""

FINDINGS = """
SELECT event_id AS pos, user_id AS doc_id, CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' WHEN 'signup' THEN 'medium' ELSE 'low' END AS severity,
  event_type AS category, 'page ' || CAST(event_id % 17 AS {string}) AS location, event_id % 3 + 1 AS count, event_id % 5 <> 0 AS removable FROM events"""

MEMBERS = f"""
SELECT l_orderkey AS archive, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS no,
  CASE WHEN l_partkey % 97 = 0 THEN '../x' WHEN l_partkey % 89 = 0 THEN '/etc/x' WHEN l_partkey % 83 = 0 THEN 'C:x' ELSE 'word/Media' || CAST(l_suppkey % 40 AS {{string}}) || '.xml' END AS name,
  CAST(l_extendedprice * 1000 AS BIGINT) AS size, CAST(l_extendedprice * CASE WHEN l_partkey % 13 = 0 THEN 4 ELSE 50 END AS BIGINT) AS csize, l_suppkey % 61 = 0 AS encrypted FROM lineitem"""

BOXES = f"""
SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS no, CAST(l_partkey % 300 AS DOUBLE) AS x0, CAST(l_suppkey % 300 AS DOUBLE) AS y0,
  CAST(l_partkey % 300 + l_quantity * 4 AS DOUBLE) AS x1, CAST(l_suppkey % 300 + l_linenumber * 20 AS DOUBLE) AS y1, l_returnflag = 'R' AS dark FROM lineitem"""

VIEWS = {"library": (LIBRARY, ["part"]), "typed": (TYPED, ["part"]), "citations": (CITATIONS, ["lineitem"]), "paragraphs": (PARAGRAPHS, ["lineitem"]), "findings": (FINDINGS, ["events"]), "members": (MEMBERS, ["lineitem"]), "boxes": (BOXES, ["lineitem"])}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, tables = VIEWS[name]
    text = text.format(string="STRING")
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def sql(*names: str) -> str:
    """The views as common table expressions (DuckDB)."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][0].format(string='VARCHAR')})" for n in names)


def joined(x, sep: str = ",") -> F.Column:
    """An array as one string, so that results compare across engines."""
    return F.array_join(F.transform(x, lambda y: y.cast("string")), sep)
