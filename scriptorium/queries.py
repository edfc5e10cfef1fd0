"""Queries over the corpus operators, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names as N
from .functions import text as T
from .operators import groups, keys, markers, matching, privacy, render, structure, titlepage, validation
from .plans.views import joined, sql, view
from .sources import references
from .streaming import limits

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.assign_keys(view(spark, sf_dir, "library"))


_STOP = ", ".join(f"'{w}'" for w in T.TITLE_STOPWORDS)
_SLUG = "lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"
_BASE = f"""based AS (SELECT *, {_SLUG.format('family')} || year || coalesce(list_filter(w, lambda x: x NOT IN ({_STOP}))[1], w[1], '') AS base
  FROM (SELECT *, list_filter(list_transform(string_split_regex(title, '\\s+'), lambda x: {_SLUG.format('x')}), lambda x: x <> '') AS w FROM library)),
keyed AS (SELECT *, count(*) OVER (PARTITION BY base) AS group_size, row_number() OVER (PARTITION BY base ORDER BY pos) - 1 AS rank FROM based),
lib AS (SELECT *, CASE WHEN group_size = 1 THEN base ELSE base || repeat('z', (rank // 26)::INT) || chr((97 + rank % 26)::INT) END AS key,
  CASE WHEN doi <> '' THEN 'doi:' || lower(trim(doi)) WHEN raw_id <> '' THEN 'id:' || raw_id ELSE 'fp:' || lower(families) || ':' || year || ':' || lower(regexp_replace(title, '\\W+', '', 'g')) END AS identity FROM keyed)"""


@query(sql("library") + f",\n{_BASE} SELECT pos, base, key, group_size FROM lib")
def q01_assign_keys(spark, sf_dir):
    return keyed_library(spark, sf_dir).select("pos", "base", "key", "group_size")


@query(sql("library") + f",\n{_BASE} SELECT group_size, count(DISTINCT base) AS bases, count(*) AS refs FROM lib GROUP BY group_size")
def q02_key_collisions(spark, sf_dir):
    bases = keys.with_base_key(view(spark, sf_dir, "library")).groupBy("base").agg(F.count("*").alias("group_size"))
    return bases.groupBy("group_size").agg(F.count("*").alias("bases"), F.sum("group_size").alias("refs"))


@query(sql("library", "citations") + f""",\n{_BASE}, cited AS (SELECT doc_id, place, identity, title, year FROM citations JOIN lib ON part = pos)
SELECT identity, doc_id, place, title, year FROM cited QUALIFY row_number() OVER (PARTITION BY identity ORDER BY doc_id, place) = 1""")
def q03_dedup_refs(spark, sf_dir):
    lib = view(spark, sf_dir, "library")
    lib = lib.withColumn("identity", keys.dedup_identity(F.col("pos")))
    cited = view(spark, sf_dir, "citations").join(lib, F.col("part") == lib["pos"])
    return keys.dedup_refs(cited, "doc_id", "place").select("identity", "doc_id", "place", "title", "year")


def _merge_sides(spark, sf_dir):
    lib = view(spark, sf_dir, "library").withColumn("identity", keys.dedup_identity(F.col("pos")))
    return keys.assign_keys(lib.where("pos % 2 = 0")), keys.assign_keys(lib.where("pos % 2 = 1 or pos % 10 = 0"))


_KEY = "CASE WHEN count(*) OVER (PARTITION BY base) = 1 THEN base ELSE base || repeat('z', ((row_number() OVER (PARTITION BY base ORDER BY pos) - 1) // 26)::INT) || chr((97 + (row_number() OVER (PARTITION BY base ORDER BY pos) - 1) % 26)::INT) END AS key"


@query(sql("library") + f""",\n{_BASE},
a AS (SELECT pos, identity, {_KEY} FROM (SELECT pos, identity, base FROM lib WHERE pos % 2 = 0)),
b AS (SELECT pos, identity, {_KEY} FROM (SELECT pos, identity, base FROM lib WHERE pos % 2 = 1 OR pos % 10 = 0)),
last AS (SELECT identity, arg_max(key, pos) AS base_key FROM a GROUP BY identity),
firsts AS (SELECT identity, min(pos) AS first_pos, arg_min(key, pos) AS k FROM b GROUP BY identity),
fresh AS (SELECT f.*, row_number() OVER (PARTITION BY k ORDER BY first_pos) AS n FROM firsts f ANTI JOIN last USING (identity)),
needs AS (SELECT *, n - CASE WHEN k IN (SELECT key FROM a) THEN 0 ELSE 1 END AS need FROM fresh),
used AS (SELECT key FROM a UNION SELECT key FROM b),
spare AS (SELECT k, i, k || repeat('z', (i // 26)::INT) || chr((97 + i % 26)::INT) AS s FROM (SELECT k, max(need) AS most FROM needs GROUP BY k HAVING max(need) > 0), range(0, 600) r(i)),
free AS (SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY i) AS need FROM spare WHERE s NOT IN (SELECT key FROM used)),
final AS (SELECT identity, first_pos, coalesce(s, k) AS new_key FROM needs LEFT JOIN free USING (k, need))
SELECT b.pos, b.key, coalesce(base_key, new_key) AS final_key, CASE WHEN base_key IS NOT NULL THEN 'in_base' WHEN b.pos > first_pos THEN 'repeated' ELSE 'added' END AS status
FROM b LEFT JOIN last USING (identity) LEFT JOIN final USING (identity)""")
def q04_merge_remap(spark, sf_dir):
    return keys.merge_refs(*_merge_sides(spark, sf_dir))


@query(sql("library") + f",\n{_BASE} SELECT lower(trim(family)) AS surname, year, string_agg(key, ',' ORDER BY pos) AS keys FROM lib GROUP BY 1, 2")
def q05_author_year_index(spark, sf_dir):
    return keys.author_year_index(keyed_library(spark, sf_dir)).select("surname", "year", joined(F.col("keys")).alias("keys"))


_MARKERS = """markers AS (SELECT doc_id, place, '[' || CASE part % 9 WHEN 0 THEN '110' WHEN 1 THEN '007' WHEN 2 THEN '9-4' WHEN 3 THEN part % 30 || '–' || (part % 30 + 4) WHEN 4 THEN ' ' || part % 50 || ' , x, 3' WHEN 5 THEN '2--5,4'
  WHEN 6 THEN '5-1500' WHEN 7 THEN '1-2-3' ELSE part % 60 || ',' || place END || ']' AS marker FROM citations)"""


def _markers(spark, sf_dir):
    m = view(spark, sf_dir, "citations")
    return spark.sql("WITH " + _MARKERS.replace("FROM citations", "FROM {c}") + " SELECT * FROM markers", c=m)


_DASH = "[‒–—-]+"
_PLAIN = "(regexp_full_match({0}, '[0-9]|[1-9][0-9]+') AND {0} NOT IN ('110', '101', '011', '111'))"
_EXPAND = f"""chunks AS (SELECT doc_id, place, marker, j, c, string_split_regex(c, '{_DASH}') AS p FROM
  (SELECT doc_id, place, marker, j, trim(string_split(marker[2:-2], ',')[j]) AS c FROM (SELECT *, unnest(range(1, len(string_split(marker[2:-2], ',')) + 1)) AS j FROM markers))),
nums AS (SELECT doc_id, place, marker, j, CASE WHEN len(p) = 2 AND {_PLAIN.format('p[1]')} AND {_PLAIN.format('p[2]')} THEN
  CASE WHEN p[1]::INT <= p[2]::INT AND p[2]::INT - p[1]::INT < 1000 THEN range(p[1]::INT, p[2]::INT + 1) ELSE [p[1]::INT, p[2]::INT] END
  WHEN {_PLAIN.format('c')} THEN [TRY_CAST(c AS INT)] ELSE [] END AS ns FROM chunks)"""


@query(sql("citations") + f",\n{_MARKERS},\n{_EXPAND} SELECT doc_id, place, marker, coalesce(string_agg(array_to_string(ns, ','), ',' ORDER BY j) FILTER (len(ns) > 0), '') AS numbers FROM nums GROUP BY ALL")
def q06_expand_ranges(spark, sf_dir):
    return _markers(spark, sf_dir).select("doc_id", "place", "marker", joined(T.expand_numeric_range(F.regexp_replace("marker", r"^\[|\]$", ""))).alias("numbers"))


@query(sql("citations", "library") + f""",\n{_BASE},\n{_MARKERS},\n{_EXPAND},
each AS (SELECT doc_id, place, n, min(j * 100000 + k) AS o FROM (SELECT doc_id, place, j, unnest(ns) AS n, unnest(range(0, len(ns))) AS k FROM nums WHERE len(ns) > 0) GROUP BY ALL),
found AS (SELECT e.*, key FROM each e LEFT JOIN (SELECT pos AS n, key FROM lib) USING (n))
SELECT doc_id, place, coalesce(string_agg(key, ',' ORDER BY o) FILTER (key IS NOT NULL), '') AS keys, count(*) FILTER (key IS NULL) AS missing FROM found GROUP BY ALL""")
def q07_resolve_numeric(spark, sf_dir):
    numbered = keyed_library(spark, sf_dir).select(F.col("pos").cast("int").alias("number"), "pos", "key")
    out = markers.resolve_numeric(_markers(spark, sf_dir), numbered, "doc_id", "place")
    return out.select("doc_id", "place", joined(F.col("keys")).alias("keys"), F.size("missing").cast("long").alias("missing"))


_SCORE = """entries AS (SELECT title, year, family, min(pos) AS pos FROM {lib} GROUP BY ALL),
scored{n} AS (SELECT ref_id, e.pos, round(0.6 * len(list_intersect(list_distinct(string_split(e.title, ' ')), string_split_regex(t.text, '\\s+'))) / len(list_distinct(string_split(e.title, ' ')))
  + CASE WHEN contains(t.text, e.year) THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(t.text, '(?i)\\b' || e.family || '\\b') THEN 0.2 ELSE 0 END, 9) AS score
  FROM typed t, entries e WHERE len(list_intersect(string_split(lower(e.title), ' '), string_split_regex(lower(t.text), '\\W+'))) > 0
    OR (contains(t.text, e.year) AND list_contains(string_split_regex(lower(t.text), '\\W+'), string_split(lower(e.family), ' ')[1]))),
best{n} AS (SELECT ref_id, arg_max(pos, (score, -pos)) AS pos, max(score) AS score FROM scored{n} GROUP BY ref_id)"""


@query(sql("library", "typed") + ",\n" + _SCORE.format(lib="library", n="") + " SELECT ref_id, pos, score FROM best")
def q08_best_match(spark, sf_dir):
    return matching.best_match(view(spark, sf_dir, "typed"), view(spark, sf_dir, "library"))


@query(sql("library", "typed") + ",\n" + _SCORE.format(lib="(SELECT * FROM library WHERE pos % 5 < 2)", n="1") + ",\n" + _SCORE.format(lib="(SELECT * FROM library WHERE pos % 2 = 0)", n="2").replace("entries AS", "entries2 AS").replace("entries e", "entries2 e") + """
SELECT ref_id, CASE WHEN b.score >= 0.72 THEN 'bibfile' WHEN c.score >= 0.72 THEN 'crossref' ELSE 'raw' END AS source, CASE WHEN b.score >= 0.72 THEN b.pos WHEN c.score >= 0.72 THEN c.pos END AS matched_pos,
  CASE WHEN b.score >= 0.72 THEN b.score ELSE coalesce(c.score, 0.0) END AS score, coalesce(b.score, 0) < 0.72 AND coalesce(c.score, 0) < 0.72 AS verify
FROM typed LEFT JOIN best1 b USING (ref_id) LEFT JOIN best2 c USING (ref_id)""")
def q09_reconcile_status(spark, sf_dir):
    lib = view(spark, sf_dir, "library")
    return matching.reconcile(view(spark, sf_dir, "typed"), lib.where("pos % 5 < 2"), lib.where("pos % 2 = 0"))


@query()
def q09b_reconcile_fuzzy(spark, sf_dir):
    """With the fuzzy title similarity, which SQL lacks (tests compare it with a direct search)."""
    lib = view(spark, sf_dir, "library")
    return matching.reconcile(view(spark, sf_dir, "typed"), lib.where("pos % 5 < 2"), lib.where("pos % 2 = 0"), fuzzy=True)


#: Titles get a last word of z's and surnames a tail of q's, from too short to matter to long enough: their
#: ratios are 200 * shared / both lengths, on either side of the thresholds 90 and 85.
_CANON = """
SELECT doi, CASE WHEN pos % 13 = 0 THEN 'entirely other words' WHEN pos % 3 = 1 THEN upper(title) || ' ' || repeat('z', CAST(pos % 23 AS INT) + 1) ELSE upper(title) END AS title,
  CASE WHEN pos % 17 = 0 THEN 'Zzyzx' WHEN pos % 3 = 2 THEN family || repeat('q', CAST(pos % 11 AS INT) + 1) ELSE family END AS author, CASE WHEN pos % 5 = 0 THEN '1900' ELSE ' ' || year END AS year,
  container, CASE WHEN pos % 7 = 3 THEN NULL ELSE volume END AS volume, CASE WHEN pos % 19 = 0 THEN '99' ELSE issue END AS issue, CASE WHEN pos % 4 = 0 THEN CAST(pos AS {string}) || '–' || CAST(pos + 50 AS {string}) WHEN pos % 4 = 1 THEN 'e1' ELSE pages END AS pages
FROM {library} WHERE doi IS NOT NULL AND pos % 8 <> 0"""


def _validated(spark, sf_dir):
    lib = view(spark, sf_dir, "library").withColumn("author", F.col("family"))
    canonical = spark.sql(_CANON.replace("{string}", "STRING"), library=lib)
    return validation.validate(lib, canonical)


_VALID = f"""canon AS ({_CANON.replace('{string}', 'VARCHAR').replace('{library}', 'library')}),
pairs AS (SELECT l.*, c.doi AS c_doi, pos % 13 = 0 OR pos % 3 = 1 AND 200.0 * length(l.title) / (2 * length(l.title) + 2 + pos % 23) < 90 AS bad_title, pos % 17 = 0 OR pos % 3 = 2 AND 200.0 * length(l.family) / (2 * length(l.family) + 1 + pos % 11) < 85 AS bad_author, pos % 5 = 0 AS bad_year, false AS bad_journal, false AS bad_volume, pos % 19 = 0 AND l.issue <> '99' AS bad_issue, pos % 4 = 1 AS bad_pages FROM library l LEFT JOIN canon c ON lower(l.doi) = lower(c.doi)),
valid AS (SELECT *, CASE WHEN c_doi IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN bad_title THEN 'title' END, CASE WHEN bad_author THEN 'authors' END, CASE WHEN bad_year THEN 'year' END, CASE WHEN bad_issue THEN 'issue' END, CASE WHEN bad_pages THEN 'pages' END], lambda x: x IS NOT NULL), ',') END AS bad FROM pairs),
records AS (SELECT *, CASE WHEN doi IS NULL THEN 'unverifiable' WHEN c_doi IS NULL THEN 'dead_doi' WHEN bad = '' THEN 'verified' ELSE 'mismatch' END AS status FROM valid)"""


@query(sql("library") + f",\n{_VALID} SELECT pos, status, bad FROM records")
def q10_validate_fields(spark, sf_dir):
    bad = F.transform(F.filter("checks", lambda x: ~x["ok"]), lambda x: x["field"])
    return _validated(spark, sf_dir).select("pos", "status", F.when(F.col("status").isin("verified", "mismatch"), joined(bad)).otherwise("").alias("bad"))


@query(sql("library") + f",\n{_VALID} SELECT status, count(*) AS n, count(*) FILTER (status IN ('dead_doi', 'mismatch', 'doi_suggested', 'unverifiable')) AS flagged FROM records GROUP BY status")
def q11_status_counts(spark, sf_dir):
    return validation.by_status(_validated(spark, sf_dir).select("status"))


@query(sql("library") + f""",\n{_VALID}, done AS (SELECT r.*, c.title AS c_title, c.year AS c_year, c.issue AS c_issue, c.pages AS c_pages, CASE WHEN pos % 4 = 0 THEN 'approve' WHEN pos % 4 = 1 THEN CASE WHEN pos % 3 = 0 THEN 'deny' ELSE 'approve' END WHEN pos % 4 = 2 THEN 'edit' END AS action FROM records r LEFT JOIN canon c ON lower(r.doi) = lower(c.doi))
SELECT pos, CASE WHEN action = 'edit' THEN 'Edited ' || title WHEN action = 'approve' AND contains(bad, 'title') THEN c_title ELSE title END AS title, CASE WHEN action = 'edit' THEN NULL WHEN action = 'approve' AND contains(bad, 'year') THEN c_year ELSE year END AS year,
  CASE WHEN action = 'approve' AND contains(bad, 'issue') THEN c_issue ELSE issue END AS issue, CASE WHEN action = 'approve' AND contains(bad, 'pages') THEN c_pages ELSE pages END AS pages FROM done""")
def q12_apply_corrections(spark, sf_dir):
    lib = view(spark, sf_dir, "library").withColumn("key", F.col("pos"))
    v = _validated(spark, sf_dir)
    bad = F.transform(F.filter("checks", lambda x: ~x["ok"]), lambda x: x["field"])
    records = v.select(F.col("pos").alias("key"), bad.alias("bad"), F.lit(None).cast("string").alias("suggested_doi"), "c_title", "c_year", "c_issue", "c_pages")
    base = lib.select("key", F.concat(F.lit("Edited "), "title").alias("e_title"), F.lit(" ").alias("e_year"), F.col("issue").alias("e_issue"), F.col("pages").alias("e_pages"))
    one = base.withColumn("no", F.lit(1)).withColumn("action", F.expr("CASE WHEN key % 4 < 2 THEN 'approve' WHEN key % 4 = 2 THEN 'edit' END")).where("action is not null")
    two = base.withColumn("no", F.lit(2)).withColumn("action", F.lit("deny")).where("key % 4 = 1 and key % 3 = 0")
    out = validation.apply_corrections(lib.select("key", "title", "year", "issue", "pages"), records, one.unionByName(two))
    return out.withColumnRenamed("key", "pos")


_AUTHORS = "SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, o_orderstatus AS aff, CAST(o_orderkey AS {string}) AS name FROM {orders}"


def _authors(spark, sf_dir):
    return spark.sql(_AUTHORS.replace("{string}", "STRING"), orders=table(spark, sf_dir, "orders"))


_AUTHORS_SQL = "WITH authors AS (" + _AUTHORS.replace("{string}", "VARCHAR").replace("{orders}", "orders") + ")"


@query(_AUTHORS_SQL + """, runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM (SELECT *, CASE WHEN lag(aff) OVER (PARTITION BY doc_id ORDER BY pos) = aff THEN 0 ELSE 1 END AS new FROM authors))
SELECT doc_id, grp::BIGINT AS grp, aff, string_agg(name, ',' ORDER BY pos) AS names FROM runs GROUP BY doc_id, grp, aff""")
def q13_consecutive_groups(spark, sf_dir):
    return groups.consecutive(_authors(spark, sf_dir), "aff", "name").select("doc_id", "grp", "aff", joined(F.col("names")).alias("names"))


@query(_AUTHORS_SQL + """, g AS (SELECT doc_id, aff, string_agg(name, ',' ORDER BY pos) AS names, min(pos) AS start FROM authors GROUP BY doc_id, aff)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS grp, aff, names FROM g""")
def q14_global_groups(spark, sf_dir):
    return groups.by_first_appearance(_authors(spark, sf_dir), "aff", "name").select("doc_id", "grp", "aff", joined(F.col("names")).alias("names"))


_CELLS = """SELECT doc_id AS tbl, pos AS row, c.col AS col, CASE WHEN part % 23 = 0 THEN 2 ELSE 1 END AS colspan, CASE c.col WHEN 0 THEN flag WHEN 1 THEN CASE WHEN line % 3 = 0 THEN ' ' ELSE part || '.5%' END WHEN 2 THEN CASE WHEN pos % 2 = 0 THEN flag ELSE '1,234' END ELSE '-1e5' END AS text,
  CASE WHEN c.col = 3 AND part % 2 = 0 THEN 'c' END AS explicit FROM {p} CROSS JOIN (VALUES (0), (1), (2), (3)) AS c(col)"""
_NUMERIC = r"[+-]?(\d{1,3}(,\d{3})*|\d+)(\.\d+)?([eE][+-]?\d+)?%?"


@query(sql("paragraphs") + ", cells AS (" + _CELLS.replace("{p}", "paragraphs") + f""")
SELECT tbl AS "table", col, coalesce(max(explicit), CASE WHEN 2 * count(*) FILTER (colspan = 1 AND regexp_full_match(trim(text), '{_NUMERIC}')) > count(*) FILTER (colspan = 1 AND trim(text) <> '') THEN 'r' ELSE 'l' END) AS letter FROM cells GROUP BY tbl, col""")
def q15_column_alignment(spark, sf_dir):
    p = view(spark, sf_dir, "paragraphs")
    cells = spark.sql(_CELLS.replace("CROSS JOIN (VALUES (0), (1), (2), (3)) AS c(col)", "LATERAL VIEW explode(array(0, 1, 2, 3)) c AS col"), p=p).withColumnRenamed("tbl", "table")
    return groups.column_alignment(cells)


_HEAD = """heads AS (SELECT doc_id, pos, CASE WHEN r[1] <> '' THEN trim(r[1]) WHEN n[1] <> '' AND regexp_matches(n[2], '^[A-Z]') THEN trim(n[2]) WHEN caps THEN text END AS title,
  CASE WHEN r[1] <> '' THEN 1 WHEN n[1] <> '' AND regexp_matches(n[2], '^[A-Z]') THEN least(length(n[1]) - length(replace(n[1], '.', '')) + 1, 3) WHEN caps THEN 1 END AS level
  FROM (SELECT *, regexp_extract(text, '^[IVXLC]+\\.\\s+(\\S.*)$', ['a']) AS r0, [regexp_extract(text, '^[IVXLC]+\\.\\s+(\\S.*)$', 1)] AS r, [regexp_extract(text, '^(\\d+(?:\\.\\d+)*)\\.?\\s+(\\S.*)$', 1), regexp_extract(text, '^(\\d+(?:\\.\\d+)*)\\.?\\s+(\\S.*)$', 2)] AS n,
    regexp_matches(text, '[A-Z]') AND NOT regexp_matches(text, '[a-z]') AS caps FROM paragraphs) WHERE length(text) <= 60 AND NOT regexp_matches(text, '[.!?:;,]$'))""".replace("regexp_extract(text, '^[IVXLC]+\\.\\s+(\\S.*)$', ['a']) AS r0, ", "")


@query(sql("paragraphs") + f",\n{_HEAD} SELECT doc_id, pos, title, level::INT AS level, least(level - min(level) OVER (PARTITION BY doc_id) + 1, 3)::INT AS new_level, level - min(level) OVER (PARTITION BY doc_id) + 1 > 3 AS clamped FROM heads WHERE level IS NOT NULL")
def q16_heading_levels(spark, sf_dir):
    p = view(spark, sf_dir, "paragraphs").withColumn("h", structure.section_heading(F.col("text"))).where("h is not null")
    return structure.normalize_levels(p.select("doc_id", "pos", "h.title", "h.level"))


@query(sql("paragraphs") + """, s AS (SELECT *, flag = 'A' AS auto, min(CASE WHEN text = 'References' THEN pos END) OVER (PARTITION BY doc_id) AS start FROM paragraphs),
n AS (SELECT doc_id, pos, text, auto, nullif(regexp_extract(text, '^\\s*(?:\\[(\\d+)\\]\\s*|(\\d+)[.)\\]]\\s+)', 1) || regexp_extract(text, '^\\s*(?:\\[(\\d+)\\]\\s*|(\\d+)[.)\\]]\\s+)', 2), '') AS typed, sum(auto::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS running FROM s WHERE pos > start)
SELECT doc_id, pos, coalesce(typed::INT, CASE WHEN auto THEN running END)::INT AS number, trim(regexp_replace(text, '^\\s*(?:\\[(\\d+)\\]\\s*|(\\d+)[.)\\]]\\s+)', '')) AS text FROM n""")
def q17_segment_after_heading(spark, sf_dir):
    return structure.reference_list(view(spark, sf_dir, "paragraphs").withColumn("auto", F.col("flag") == "A"))


_TITLE = "regexp_extract(html, '<h1>(.*?)</h1>', 1)"


@query(f"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({_TITLE}, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages""")
def q18_strip_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_markup(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("title"))


_SPECIAL = "p_name || ' _&%$#{}~^' || chr(92) || ' ' || p_brand"
_CHAIN = "x"
for _c, _to in [("\\", "\x01"), ("{", "\x02"), ("}", "\x03")]:
    _CHAIN = f"replace({_CHAIN}, {'chr(92)' if _c == chr(92) else repr(_c)}, chr({ord(_to)}))"
for _c in "&%$#_":
    _CHAIN = f"replace({_CHAIN}, '{_c}', chr(92) || '{_c}')"
for _c, _to in [("~", "textasciitilde{}"), ("^", "textasciicircum{}"), ("\x01", "textbackslash{}"), ("\x02", "textbraceleft{}"), ("\x03", "textbraceright{}")]:
    _CHAIN = f"replace({_CHAIN}, {f'chr({ord(_c)})' if _c < ' ' else repr(_c)}, chr(92) || '{_to}')"


@query(f"SELECT p_partkey, {_CHAIN} AS escaped FROM (SELECT p_partkey, {_SPECIAL} AS x FROM part)")
def q19_escape_latex(spark, sf_dir):
    special = F.concat("p_name", F.lit(" _&%$#{}~^\\ "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", T.escape_latex(special).alias("escaped"))


@query(sql("findings") + " SELECT doc_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (NOT removable) AS unremovable, sum(count)::BIGINT AS total FROM findings GROUP BY doc_id")
def q20_findings_by_severity(spark, sf_dir):
    return privacy.count_by_severity(view(spark, sf_dir, "findings"), "doc_id")


@query(sql("findings") + " SELECT doc_id, pos, severity, category, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, category, location, pos) AS place FROM findings")
def q21_sorted_findings(spark, sf_dir):
    return privacy.sorted_findings(view(spark, sf_dir, "findings"), "doc_id").select("doc_id", "pos", "severity", "category", "place")


@query(sql("members") + """, f AS (SELECT *, CASE WHEN encrypted THEN 'encrypted' WHEN name LIKE '/%' OR regexp_matches(name, '^[A-Za-z]:') OR list_contains(string_split(name, '/'), '..') THEN 'unsafe_name'
  WHEN row_number() OVER (PARTITION BY archive, lower(name) ORDER BY no) > 1 THEN 'duplicate' WHEN size > 90000000 THEN 'member_size' END AS fault FROM members)
SELECT archive, CASE WHEN count(*) > 7 THEN 'member_count' WHEN count(fault) > 0 THEN arg_min(fault, no) FILTER (fault IS NOT NULL) WHEN sum(size) > 200000000 THEN 'total_size' WHEN sum(csize) >= 4096 AND sum(size) > sum(csize) * 200.0 THEN 'ratio' ELSE 'ok' END AS verdict FROM f GROUP BY archive""")
def q22_archive_guard(spark, sf_dir):
    return privacy.archive_guard(view(spark, sf_dir, "members"), max_members=7, max_member=90_000_000, max_total=200_000_000)


_RELS = "SELECT doc_id, place AS rel, CAST(part % 20 AS {string}) AS part, CAST((part + 7) % 20 AS {string}) AS target, part % 9 = 0 AS external FROM {c}"


@query(sql("citations") + ", rels AS (" + _RELS.replace("{string}", "VARCHAR").replace("{c}", "citations") + """), gone AS (SELECT DISTINCT doc_id, part FROM rels WHERE part::INT % 4 = 0)
SELECT r.doc_id, rel, r.part, target FROM rels r WHERE NOT EXISTS (FROM gone g WHERE g.doc_id = r.doc_id AND g.part = r.part) AND (external OR NOT EXISTS (FROM gone g WHERE g.doc_id = r.doc_id AND g.part = r.target))""")
def q23_kept_relations(spark, sf_dir):
    rels = spark.sql(_RELS.replace("{string}", "STRING"), c=view(spark, sf_dir, "citations"))
    removed = rels.where(F.col("part").cast("int") % 4 == 0).select("doc_id", "part").distinct()
    return privacy.kept_relations(rels, removed).select("doc_id", "rel", "part", "target")


@query(sql("boxes") + " SELECT page, no, x0, y0 FROM boxes a WHERE NOT dark AND EXISTS (FROM boxes b WHERE b.dark AND a.page = b.page AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)")
def q24_overlap_join(spark, sf_dir):
    boxes = view(spark, sf_dir, "boxes")
    return privacy.overlapping(boxes.where("not dark"), boxes.where("dark"), "page").select("page", "no", "x0", "y0")


@query(sql("citations") + """, a AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i, part FROM citations WHERE part % 3 > 0), b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i, part FROM citations WHERE part % 4 > 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.i, b.i) AS index, a.part AS raw, b.part AS converted, a.part IS NULL OR b.part IS NULL AS mismatch FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.i = b.i""")
def q25_full_outer_positional(spark, sf_dir):
    c = view(spark, sf_dir, "citations")
    side = lambda cond: c.where(cond).selectExpr("doc_id", "row_number() over (partition by doc_id order by place) as index", "part as text")
    return groups.full_positional(side("part % 3 > 0"), side("part % 4 > 0"))


@query(sql("citations") + """, f AS (SELECT doc_id, place AS pos, 'img' || part % 6 AS name FROM citations), c AS (SELECT doc_id, pos, CASE WHEN doc_id % 3 = 0 AND pos = 1 THEN 'other' ELSE name END AS name, pos % 2 AS crop FROM f WHERE doc_id % 5 > 0),
x AS (SELECT doc_id, string_agg(name, '|' ORDER BY pos) AS n FROM f GROUP BY 1), y AS (SELECT doc_id, string_agg(name, '|' ORDER BY pos) AS n FROM c GROUP BY 1), s AS (SELECT doc_id, name, min(crop) AS crop FROM c GROUP BY 1, 2 HAVING count(DISTINCT crop) = 1)
SELECT f.doc_id, f.pos, f.name, CASE WHEN x.n = y.n THEN c.crop ELSE s.crop END AS crop, CASE WHEN x.n = y.n THEN 'position' WHEN s.crop IS NOT NULL THEN 'name' END AS how
FROM f JOIN x USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN c ON c.doc_id = f.doc_id AND c.pos = f.pos LEFT JOIN s ON s.doc_id = f.doc_id AND s.name = f.name""")
def q26_positional_zip(spark, sf_dir):
    f = view(spark, sf_dir, "citations").selectExpr("doc_id", "place as pos", "'img' || part % 6 as name")
    c = f.where("doc_id % 5 > 0").selectExpr("doc_id", "pos", "case when doc_id % 3 = 0 and pos = 1 then 'other' else name end as name", "pos % 2 as crop")
    return groups.zip_crops(f, c)


_FILES = "SELECT l_orderkey AS doc_id, l_linenumber AS number, CASE l_partkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'eps' WHEN 2 THEN 'svg' WHEN 3 THEN 'png' WHEN 4 THEN 'jpg' ELSE 'bmp' END AS ext, l_partkey % 10 AS d FROM {lineitem}"
_FIGURES = "SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS number, 'embedded' AS path, l_orderkey % 2 = 0 AS is_main FROM {lineitem}"


@query(f"""WITH fig AS ({_FIGURES.format(lineitem='lineitem')}), files AS (SELECT *, 'dir/' || number || '.' || ext AS path FROM ({_FILES.format(lineitem='lineitem')})),
man AS (SELECT DISTINCT doc_id, number, 'listed/' || number AS m FROM files WHERE d = 7), dir AS (SELECT doc_id, number, arg_min(path, list_position(['pdf', 'eps', 'svg', 'png', 'jpg'], ext)) AS f FROM files WHERE ext <> 'bmp' AND d < 5 GROUP BY 1, 2)
SELECT doc_id, number, coalesce(CASE WHEN is_main THEN m END, f, path) AS path, CASE WHEN is_main AND m IS NOT NULL THEN 'manifest' WHEN f IS NOT NULL THEN 'override' ELSE 'embedded' END AS source FROM fig LEFT JOIN man USING (doc_id, number) LEFT JOIN dir USING (doc_id, number)""")
def q27_override_priority(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    files = spark.sql(_FILES, lineitem=line).withColumn("path", F.concat(F.lit("dir/"), F.col("number").cast("string"), F.lit("."), "ext"))
    manifest = files.where("d = 7").select("doc_id", "number", F.concat(F.lit("listed/"), F.col("number").cast("string")).alias("path")).distinct()
    return groups.resolve_overrides(spark.sql(_FIGURES, lineitem=line), manifest, files.where("d < 5"))


@query(sql("paragraphs") + """, p AS (SELECT *, max((part % 5 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS near, CASE WHEN regexp_matches(text, '^Figure \\d') THEN regexp_extract(text, 'Figure (\\d+)', 1)::INT END AS number FROM paragraphs),
e AS (SELECT doc_id, number, bool_or(near) AS near FROM p WHERE number IS NOT NULL GROUP BY 1, 2), w AS (SELECT doc_id, min(number) AS lo, max(number) AS hi, count(*) AS k, coalesce(string_agg(number::VARCHAR, ',' ORDER BY number) FILTER (NOT near), '') AS gaps FROM e GROUP BY 1)
SELECT doc_id, gaps FROM w WHERE lo = 1 AND hi = k AND k > 0""")
def q28_caption_gaps(spark, sf_dir):
    p = view(spark, sf_dir, "paragraphs").withColumn("has_image", F.col("part") % 5 == 0)
    images = p.select("doc_id").distinct().withColumn("n", F.lit(0))
    return structure.caption_gaps(p, images).select("doc_id", joined(F.col("gaps")).alias("gaps"))


@query(sql("paragraphs") + """, b AS (SELECT doc_id, pos, CASE WHEN part % 4 = 0 THEN 'image' ELSE 'para' END AS kind, text FROM paragraphs), c AS (SELECT *, CASE WHEN lead(text) OVER w LIKE 'Figure %' THEN lead(text) OVER w WHEN lag(text) OVER w LIKE 'Figure %' THEN lag(text) OVER w END AS t FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS number, nullif(regexp_extract(t, '^Figure \\d+: (.*)$', 1), '') AS caption FROM c WHERE kind = 'image'""")
def q29_sibling_caption(spark, sf_dir):
    b = view(spark, sf_dir, "paragraphs").withColumn("kind", F.when(F.col("part") % 4 == 0, "image").otherwise("para"))
    return structure.sibling_captions(b)


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type = 'error' AS failed FROM events), r AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
s AS (SELECT *, sum(failed::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS streak FROM r)
SELECT event_id, user_id, streak::BIGINT AS streak, coalesce(max((streak >= 2)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS skipped FROM s""")
def q30_failure_breaker(spark, sf_dir):
    return validation.breaker(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "streak", "skipped")


def _accesses(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts")


_LIMITED = """WITH RECURSIVE e AS (SELECT event_id, user_id AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT 0::BIGINT AS event_id, key, 0::BIGINT AS t, 0::BIGINT AS n, []::BIGINT[] AS log, true AS allowed, 0::BIGINT AS wait FROM (SELECT DISTINCT key FROM e)
  UNION ALL SELECT event_id, key, t, n, CASE WHEN len(kept) < 3 THEN list_append(kept, t) ELSE kept END, len(kept) < 3, CASE WHEN len(kept) < 3 THEN 0 ELSE kept[1] + 86400000000 - t END
  FROM (SELECT e.*, list_filter(r.log, lambda x: x > e.t - 86400000000) AS kept FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1))
SELECT event_id, key, t / 1e6 AS t, allowed, wait / 1e6 AS retry_after FROM r WHERE n > 0"""


@query(_LIMITED)
def q31_rate_limit(spark, sf_dir):
    """Sequential: each decision depends on the ones before."""
    out = limits.rate_limit(_accesses(spark, sf_dir), limit=3, window=86_400.0)
    return out.withColumn("retry_after", F.round("retry_after", 6))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 43200000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id AS key, session::BIGINT AS session, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us FROM s GROUP BY 1, 2""")
def q32_session_gap(spark, sf_dir):
    out = limits.sessions(_accesses(spark, sf_dir), gap_s=43_200)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("key", "session", "n", (micros("end") - micros("begin")).alias("span_us"))


@query("SELECT user_id AS key, epoch_us(max(ts)) AS last_us, epoch_us(TIMESTAMP '2024-01-30') - epoch_us(max(ts)) > 3600000000 AS expired FROM events GROUP BY 1")
def q33_session_ttl(spark, sf_dir):
    import datetime

    out = limits.expired(_accesses(spark, sf_dir), datetime.datetime(2024, 1, 30))
    return out.select("key", F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"), "expired")


@query("SELECT doc_id, email, count(*) AS count FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\w.+-]+@(?:[\\w-]+\\.)+[\\w-]+')) AS email FROM documents) GROUP BY 1, 2")
def q34_email_findings(spark, sf_dir):
    return structure.emails(table(spark, sf_dir, "documents"), "doc_id")


@query(sql("paragraphs") + """, k AS (SELECT doc_id, arg_min(text, pos) AS t FROM paragraphs WHERE text LIKE 'Keywords:%' GROUP BY 1)
SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(t[10:], '[;,]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords FROM k""")
def q35_keywords_split(spark, sf_dir):
    return structure.keywords(view(spark, sf_dir, "paragraphs")).select("doc_id", joined(F.col("keywords"), "|").alias("keywords"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<li>')) AS items, regexp_extract(html, '<html lang=\"(\\w+)\"', 1) AS lang FROM pages")
def q36_html_title_blocks(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("items"), F.regexp_extract("html", r'<html lang="(\w+)"', 1).alias("lang"))


_LOG = "SELECT doc_id, pos AS line_no, CASE part % 5 WHEN 0 THEN '! Undefined ' || flag || '.' WHEN 1 THEN 'l.' || part || ' x' WHEN 2 THEN 'Package hyper Warning: odd ' || flag || ' on input line ' || line || '.' WHEN 3 THEN 'LaTeX Warning: None.' ELSE 'text' END AS text FROM {p}"


@query(sql("paragraphs") + ", logs AS (" + _LOG.replace("{p}", "paragraphs") + """), r AS (SELECT *, first_value(nullif(regexp_extract(text, '^l\\.(\\d+)', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS nxt FROM logs)
SELECT doc_id, line_no, CASE WHEN text[1] = '!' THEN 'error' ELSE 'warning' END AS severity, CASE WHEN text[1] = '!' THEN text[3:] WHEN text LIKE 'Package%' THEN '[hyper] ' || regexp_extract(text, 'Warning: (.+) on input', 1) ELSE 'None' END AS message,
  CASE WHEN text[1] = '!' THEN nxt::INT WHEN text LIKE 'Package%' THEN regexp_extract(text, 'line (\\d+)', 1)::INT END AS line FROM r WHERE text[1] = '!' OR text LIKE '%Warning:%'""")
def q37_log_lookahead(spark, sf_dir):
    return structure.log_diagnostics(spark.sql(_LOG, p=view(spark, sf_dir, "paragraphs")))


def rendered_library(spark, sf_dir) -> DataFrame:
    lib = keyed_library(spark, sf_dir)
    none = F.lit(None).cast("string")
    return lib.withColumn("entry_type", F.lit("article")).withColumn("source", F.lit("bibfile")).withColumn("authors", F.array(N.name(F.col("family"), F.col("given")))).withColumn("publisher", none).withColumn("url", none).withColumn("isbn", none)


@query(sql("library") + f""",\n{_BASE} SELECT pos, '@article{{' || key || ',' || chr(10) || '  author = {{' || family || ', ' || replace(given, '#', chr(92) || '#') || '}},' || chr(10) || '  title = {{' || title || '}},' || chr(10) || '  journal = {{' || replace(container, '#', chr(92) || '#') || '}},' || chr(10)
 || '  year = {{' || year || '}},' || chr(10) || '  volume = {{' || volume || '}},' || chr(10) || '  number = {{' || issue || '}},' || chr(10) || '  pages = {{' || replace(pages, '-', '--') || '}}' || coalesce(',' || chr(10) || '  doi = {{' || doi || '}}', '') || chr(10) || '}}' || chr(10) AS bibtex FROM lib""")
def q38_bib_render(spark, sf_dir):
    return rendered_library(spark, sf_dir).select("pos", render.to_bibtex().alias("bibtex"))


@query(sql("library") + " SELECT pos, family || ', ' || given[1] || '. (' || year || ') ' || title || '. ' || container || ', ' || volume || '(' || issue || '), ' || pages || '.' || coalesce(' https://doi.org/' || doi, '') AS text FROM library")
def q39_reference_text(spark, sf_dir):
    return rendered_library(spark, sf_dir).select("pos", render.reference_text().alias("text"))


_MANIFESTS = "SELECT n_name AS name, CASE WHEN n_nationkey % 3 > 0 THEN 'NATION_' || (n_nationkey - n_nationkey % 3) END AS extends, CASE WHEN n_nationkey % 2 = 0 THEN 'class' || n_nationkey END AS class, CASE WHEN n_nationkey % 3 = 0 THEN 'style' || n_regionkey END AS style FROM {nation}"


@query(f"WITH m AS ({_MANIFESTS.format(nation='nation')}) SELECT a.name, coalesce(a.class, b.class) AS class, coalesce(a.style, b.style) AS style FROM m a LEFT JOIN m b ON a.extends = b.name")
def q40_manifest_overlay(spark, sf_dir):
    return groups.overlay(spark.sql(_MANIFESTS, nation=table(spark, sf_dir, "nation")))


@query(sql("library") + f",\n{_BASE} SELECT pos, key, title, year, container, volume, issue, replace(pages, '-', '--') AS pages, doi, family, replace(given, '#', chr(92) || '#') AS given FROM lib")
def q41_parse_bibtex(spark, sf_dir):
    """The library written as BibTeX and read back."""
    texts = rendered_library(spark, sf_dir).select(F.col("pos").cast("string").alias("doc_id"), render.to_bibtex().alias("text"))
    got = references.parse(texts, "bib")
    return got.select(F.col("doc_id").cast("long").alias("pos"), "key", "title", "year", F.replace(F.col("container"), F.lit("\\#"), F.lit("#")).alias("container"), "volume", "issue", "pages", "doi", F.col("authors")[0]["family"].alias("family"), F.col("authors")[0]["given"].alias("given"))


@query(sql("library") + " SELECT pos, CAST(pos AS VARCHAR) AS key, 'article' AS entry_type, title, year, container, doi, family, given FROM library")
def q42_parse_csl_json(spark, sf_dir):
    lib = view(spark, sf_dir, "library")
    author = F.array(F.struct("family", "given"))
    item = F.struct(F.col("pos").alias("id"), F.lit("article-journal").alias("type"), "title", F.col("container").alias("container-title"), F.col("doi").alias("DOI"), author.alias("author"), F.struct(F.array(F.array(F.col("year").cast("int"))).alias("date-parts")).alias("issued"))
    texts = lib.select(F.col("pos").alias("doc_id"), F.concat(F.lit('{"items": ['), F.to_json(item), F.lit("]}")).alias("text"))
    got = references.parse_csl_json(texts)
    return got.select(F.col("doc_id").cast("long").alias("pos"), "key", "entry_type", "title", "year", "container", "doi", F.col("authors")[0]["family"].alias("family"), F.col("authors")[0]["given"].alias("given"))


@query(sql("library") + " SELECT pos, title, year, container, doi, family FROM library")
def q43_parse_nbib(spark, sf_dir):
    lib = view(spark, sf_dir, "library")
    line = lambda tag, x: F.concat(F.lit(f"{tag.ljust(4)}- "), x, F.lit("\n"))
    text = F.concat(line("PMID", F.col("pos").cast("string")), line("TI", F.regexp_replace("title", " ", "\n      ")), line("AU", F.concat("family", F.lit(" AB"))), line("DP", F.concat("year", F.lit(" Jan 3"))), line("JT", F.col("container")), F.coalesce(line("LID", F.concat("doi", F.lit(" [doi]"))), F.lit("")))
    got = references.parse(lib.select(F.col("pos").alias("doc_id"), text.alias("text")), "nbib")
    return got.select(F.col("doc_id").cast("long").alias("pos"), "title", "year", "container", "doi", F.col("authors")[0]["family"].alias("family"))


@query(sql("library") + " SELECT pos, CAST(pos AS VARCHAR) AS raw_id, 'incollection' AS entry_type, title, year, doi, family, given FROM library")
def q44_parse_endnote_xml(spark, sf_dir):
    lib = view(spark, sf_dir, "library")
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    style = lambda x: F.concat(F.lit("<style>"), x, F.lit("</style>"))
    text = F.concat(F.lit('<xml><records><record><ref-type name="Book Section">5</ref-type>'), tag("rec-number", F.col("pos").cast("string")), tag("contributors", tag("authors", tag("author", style(F.concat("family", F.lit(", "), "given"))))), tag("titles", tag("title", style(F.col("title")))), tag("dates", tag("year", F.col("year"))), F.coalesce(tag("electronic-resource-num", F.col("doi")), F.lit("")), F.lit("</record></records></xml>"))
    got = references.parse(lib.select(F.col("pos").alias("doc_id"), text.alias("text")), "xml")
    return got.select(F.col("doc_id").cast("long").alias("pos"), "raw_id", "entry_type", "title", "year", "doi", F.col("authors")[0]["family"].alias("family"), F.col("authors")[0]["given"].alias("given"))


@query(sql("citations") + " SELECT doc_id, place, 'T' || part || ',' || 'U' || place AS tags, 'wordnative' AS kind FROM citations")
def q45_word_field_tags(spark, sf_dir):
    c = view(spark, sf_dir, "citations")
    field = F.concat(F.lit(" CITATION T"), F.col("part").cast("string"), F.lit(r" \l 1033 \p 3 \m U"), F.col("place").cast("string"), F.lit(r" \t "))
    return c.select("doc_id", "place", joined(references.word_tags(field)).alias("tags"), references.classify_marker(field).alias("kind"))


@query(sql("library") + " SELECT pos, CAST(pos AS VARCHAR) AS raw_id, title, year, family FROM library")
def q46_parse_csl_fields(spark, sf_dir):
    lib = view(spark, sf_dir, "library")
    item = F.struct(F.array(F.struct(F.struct(F.col("pos").alias("id"), "title", F.array(F.struct("family")).alias("author"), F.struct(F.col("year").alias("raw")).alias("issued")).alias("itemData"))).alias("citationItems"))
    got = references.parse(lib.select(F.col("pos").alias("doc_id"), F.concat(F.lit("ADDIN ZOTERO_ITEM CSL_CITATION "), F.to_json(item), F.lit(" trailing")).alias("text")), "zotero")
    return got.select(F.col("doc_id").cast("long").alias("pos"), "raw_id", "title", "year", F.col("authors")[0]["family"].alias("family"))


@query(sql("citations", "library") + f""",\n{_BASE} SELECT doc_id, '\\cite{{' || string_agg(CASE WHEN part % 2 = 0 THEN 'new' || part ELSE 'k' || part END, ',' ORDER BY place) || '}} and \\cite{{x}}' AS text FROM citations GROUP BY doc_id""")
def q47_remap_cites(spark, sf_dir):
    c = view(spark, sf_dir, "citations")
    keys_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: F.concat(F.lit("k"), x["part"].cast("string"))), ", ")
    texts = c.groupBy("doc_id").agg(F.concat(F.lit("\\cite{"), keys_, F.lit("} and \\cite{x}")).alias("text"))
    remap = c.where("part % 2 = 0").select(F.concat(F.lit("k"), F.col("part").cast("string")).alias("key"), F.concat(F.lit("new"), F.col("part").cast("string")).alias("final_key")).distinct()
    return markers.remap_cite_keys(texts, remap, "doc_id")


@query(sql("library") + " SELECT pos, family || ', ' || given || '; ' || container AS line, family || '|' || given || '/' || container || '|' AS back FROM library")
def q48_author_text_round_trip(spark, sf_dir):
    lib = view(spark, sf_dir, "library")
    line = N.to_text(F.array(N.name(F.col("family"), F.col("given")), N.name(F.lit(""), F.lit(""), F.col("container"))))
    back = F.array_join(F.transform(N.from_text(line), lambda n: F.concat(n["family"], F.lit("|"), n["given"])), "/")
    return lib.select("pos", line.alias("line"), back.alias("back"))


@query(sql("findings") + " SELECT doc_id, bool_or(severity IN ('high', 'medium')) AS fails FROM findings GROUP BY 1")
def q49_severity_gate(spark, sf_dir):
    return privacy.should_fail(view(spark, sf_dir, "findings"), "medium", "doc_id")


@query("SELECT user_id AS key, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 32")
def q50_recent_sessions(spark, sf_dir):
    """A top-k report: the 32 clients seen last."""
    out = limits.least_recent_out(_accesses(spark, sf_dir), 32)
    return out.select("key", F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"))


@query(sql("citations", "library") + f""",\n{_BASE}, m AS (SELECT doc_id, place, part % 60 AS n FROM citations)
SELECT doc_id, string_agg(coalesce('\\cite{{' || key || '}}', '{{[}}' || n || '{{]}}'), ' and ' ORDER BY place) AS text FROM m LEFT JOIN (SELECT pos AS n, key FROM lib) USING (n) GROUP BY doc_id""")
def q51_link_body(spark, sf_dir):
    c = view(spark, sf_dir, "citations")
    each = F.transform(F.array_sort(F.collect_list(F.struct("place", (F.col("part") % 60).alias("n")))), lambda x: F.concat(F.lit("{[}"), x["n"].cast("string"), F.lit("{]}")))
    texts = c.groupBy("doc_id").agg(F.array_join(each, " and ").alias("text"))
    numbered = keyed_library(spark, sf_dir).select(F.col("pos").cast("int").alias("number"), "pos", "key")
    return markers.link_numeric(texts, numbered, "doc_id")


_PAGES = """SELECT c_custkey AS doc_id, pos, IF(pos = 1, 'Title', 'Normal') AS style_id, 20 AS font_size,
  CASE pos WHEN 0 THEN array(named_struct('text', ' ', 'superscript', false)) WHEN 1 THEN array(named_struct('text', c_name, 'superscript', false))
  WHEN 2 THEN array(named_struct('text', 'Ann ' || c_mktsegment, 'superscript', false), named_struct('text', CAST(c_custkey % 2 + 1 AS STRING) || ',*', 'superscript', true), named_struct('text', ' and Bo', 'superscript', false), named_struct('text', CAST(c_nationkey % 3 + 1 AS STRING), 'superscript', true))
  ELSE array(named_struct('text', 'Place ' || CAST(pos AS STRING), 'superscript', false)) END AS segments FROM {customer} LATERAL VIEW explode(array(0, 1, 2, 3, 4, 5)) p AS pos"""


@query("""WITH a AS (SELECT c_custkey AS doc_id, c_name AS title, [c_custkey % 2 + 1, c_nationkey % 3 + 1] AS m, c_mktsegment FROM customer), n AS (SELECT *, len(list_distinct(m)) AS n FROM a)
SELECT doc_id, title, 'Ann ' || c_mktsegment AS name, true AS corresponding, CASE WHEN m[1] <= n THEN CAST(m[1] - 1 AS VARCHAR) ELSE '' END AS affiliations FROM n
UNION ALL SELECT doc_id, title, 'Bo', false, CASE WHEN m[2] <= n THEN CAST(m[2] - 1 AS VARCHAR) ELSE '' END FROM n""")
def q52_title_page(spark, sf_dir):
    p = spark.sql(_PAGES, customer=table(spark, sf_dir, "customer"))
    p = p.withColumn("text", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    titles = titlepage.titles(p)
    people = titlepage.authors(p, titles)
    linked = titlepage.link(people, titlepage.affiliations(p, people))
    return titlepage.joined_by_document(linked, titles.select("doc_id", "title"), "doc_id").select("doc_id", "title", "name", "corresponding", joined(F.col("affiliations")).alias("affiliations"))


@query(sql("library") + f",\n{_VALID} SELECT 'Checked ' || count(*) || ' reference(s): ' || count(*) FILTER (status = 'verified') || ' verified, ' || count(*) FILTER (status = 'mismatch') || ' field mismatch, ' || count(*) FILTER (status = 'dead_doi') || ' dead DOI, ' || count(*) FILTER (status = 'unverifiable') || ' unverifiable.' AS line FROM records")
def q53_validation_summary(spark, sf_dir):
    return render.validation_summary(_validated(spark, sf_dir).select("status", F.lit(1).alias("doc_id"))).select("line")


@query(sql("library") + f""",\n{_BASE} SELECT pos % 50 AS doc_id, '## References' || chr(10) || chr(10) || string_agg(CAST(r AS VARCHAR) || '. ' || t, chr(10) ORDER BY pos) || chr(10) AS text FROM
  (SELECT pos, row_number() OVER (PARTITION BY pos % 50 ORDER BY pos) AS r, family || ', ' || given[1] || '. (' || year || ') ' || title || '. ' || container || ', ' || volume || '(' || issue || '), ' || pages || '.' || coalesce(' https://doi.org/' || doi, '') AS t FROM lib) GROUP BY 1""")
def q54_reference_list(spark, sf_dir):
    return render.reference_list(rendered_library(spark, sf_dir).withColumn("doc_id", F.col("pos") % 50))


@query(sql("library") + " SELECT pos, title, year, container, coalesce(doi, '') AS doi, family, CASE WHEN pos % 2 = 0 THEN 'incollection' ELSE 'article' END AS entry_type FROM library")
def q55_parse_works(spark, sf_dir):
    lib = view(spark, sf_dir, "library")
    date = F.struct(F.array(F.array(F.col("year").cast("int"), F.lit(3))).alias("date-parts"))
    kind = F.when(F.col("pos") % 2 == 0, "book-chapter").otherwise("journal-article")
    work = F.struct(F.array(F.concat(F.lit("<i>"), "title", F.lit("</i>  "))).alias("title"), F.array("container").alias("container-title"), F.array(F.struct("family", "given")).alias("author"), F.col("doi").alias("DOI"), kind.alias("type"), F.when(F.col("pos") % 3 == 0, date).alias("issued"), date.alias("created"))
    got = references.parse_works(lib.select(F.col("pos").alias("doc_id"), F.to_json(work).alias("text")))
    return got.select(F.col("doc_id").cast("long").alias("pos"), "title", "year", "container", "doi", F.col("authors")[0]["family"].alias("family"), "entry_type")
