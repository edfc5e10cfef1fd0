"""Queries over whole documents: citation extraction, anchors, tables, reports, metadata and manifests,
on rows derived from the star schema, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names as N
from .operators import anchors, citations, figures, journals, metadata, preflight, report, tables
from .plans.views import joined, sql, view
from .queries import _SCORE

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


#: A document for each supplier: its line items are citations, some of two works; all works are by Smith.
_CITED = """SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS ord, l_partkey AS part FROM {lineitem}"""
_KEY = "'smith' || year || 'study' || CASE WHEN n = 1 THEN '' ELSE repeat('z', (r // 26)::INT) || chr((97 + r % 26)::INT) END"


@query(f"""WITH cited AS ({_CITED.format(lineitem='lineitem')}),
each AS (SELECT doc_id, ord, 0 AS i, part FROM cited UNION ALL SELECT doc_id, ord, 1, part % 40 + 1 FROM cited WHERE ord % 7 = 0),
firsts AS (SELECT doc_id, part, min(ord * 2 + i) AS f, CAST(2000 + part % 3 AS VARCHAR) AS year FROM each GROUP BY doc_id, part),
keyed AS (SELECT *, count(*) OVER (PARTITION BY doc_id, year) AS n, row_number() OVER (PARTITION BY doc_id, year ORDER BY f) - 1 AS r FROM firsts),
named AS (SELECT doc_id, part, {_KEY} AS key FROM keyed)
SELECT CAST(e.doc_id AS VARCHAR) AS doc_id, ord AS index, string_agg(key, ',' ORDER BY i) AS keys FROM (SELECT doc_id, ord, part, min(i) AS i FROM each GROUP BY 1, 2, 3) e JOIN named USING (doc_id, part) GROUP BY e.doc_id, ord""")
def q56_extract_citations(spark, sf_dir):
    """Hundreds of works by one author in a document, from field codes to keys."""
    cited = spark.sql(_CITED, lineitem=table(spark, sf_dir, "lineitem"))

    def work(part):
        return F.struct(F.struct(F.concat(F.lit("p"), part.cast("string")).alias("id"), F.lit("article-journal").alias("type"), F.concat(F.lit("Study of item "), part.cast("string")).alias("title"), F.array(F.struct(F.lit("Smith").alias("family"), F.lit("A").alias("given"))).alias("author"), F.struct(F.array(F.array((2000 + part % 3).cast("int"))).alias("date-parts")).alias("issued"), F.when(part % 2 == 0, F.concat(F.lit("10.1000/"), part.cast("string"))).alias("DOI")).alias("itemData"))

    items = F.when(F.col("ord") % 7 == 0, F.array(work(F.col("part")), work(F.col("part") % 40 + 1))).otherwise(F.array(work(F.col("part"))))
    code = F.concat(F.lit(" ADDIN ZOTERO_ITEM CSL_CITATION "), F.to_json(F.struct(items.alias("citationItems"))), F.lit(" "))
    fields = cited.select("doc_id", F.col("ord").cast("int").alias("order"), code.alias("instruction"))
    _, out = citations.from_fields(fields)
    return out.select("doc_id", F.col("index").cast("long").alias("index"), joined(F.col("keys")).alias("keys"))


_BODY = """'A' || CASE WHEN part % 4 = 0 THEN '%%CITE:' || CAST(place AS {string}) || '%%' WHEN part % 4 = 1 THEN 'ZZLTXCITE' || CAST(place AS {string}) || 'ZZ' WHEN part % 4 = 2 THEN '%%FIGURE:' || CAST(place AS {string}) || '%%' ELSE 'x' END"""
_LATEX = """CASE WHEN part % 4 = 0 THEN CASE WHEN cited THEN '\\cite{k' || place || '}' ELSE '% WARNING: no citation ' || place || chr(10) || '\\textbf{[UNRESOLVED CITATION]}' END
  WHEN part % 4 = 1 THEN CASE WHEN cited1 THEN '\\cite{k' || (place + 1) || '}' ELSE '% WARNING: no citation ' || place || chr(10) || '\\textbf{[UNRESOLVED CITATION]}' END
  WHEN part % 4 = 2 THEN CASE WHEN place % 3 = 0 THEN '% WARNING: no figure ' || place || chr(10) || '\\textbf{[UNRESOLVED FIGURE ' || place || ']}' WHEN place % 3 = 1 THEN '\\includegraphics[width=3cm]{f' || place || '.png}'
    ELSE '\\begin{figure*}' || chr(10) || '\\centering' || chr(10) || '\\includegraphics[width=\\linewidth]{f' || place || '.png}' || chr(10) || '\\caption{50\\% of ' || place || '}' || chr(10) || '\\end{figure*}' END ELSE 'x' END"""


def _bodies(spark, sf_dir, between: str = " "):
    """Documents of anchors; citations of even index have keys; two of three figures are there."""
    c = view(spark, sf_dir, "citations")
    one = F.expr(_BODY.format(string="STRING"))
    texts = c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", one.alias("t")))), lambda x: x["t"]), between).alias("text"))
    cited = c.select("doc_id", (F.col("place") - 1).cast("int").alias("index"), F.when(F.col("place") % 2 == 1, F.array(F.concat(F.lit("k"), F.col("place").cast("string")))).otherwise(F.array().cast("array<string>")).alias("keys"))
    number = F.col("place").cast("int")
    shown = c.where("place % 3 > 0").select("doc_id", number.alias("number"), F.concat(F.lit("f"), number.cast("string"), F.lit(".png")).alias("path"), F.concat(F.lit("50% of "), number.cast("string")).alias("caption"), F.lit(True).alias("wide"), (number % 3 == 1).alias("in_table"))
    return texts, shown, cited


@query(sql("citations") + f""", m AS (SELECT *, place % 2 = 1 AS cited, place % 2 = 0 AND place + 1 <= max(place) OVER (PARTITION BY doc_id) AS cited1 FROM citations)
SELECT doc_id, string_agg('A' || {_LATEX}, ' ' ORDER BY place) AS text FROM m GROUP BY doc_id""")
def q57_place_anchors(spark, sf_dir):
    return anchors.resolve(*_bodies(spark, sf_dir))


@query(sql("citations") + """, m AS (SELECT *, max(place) OVER (PARTITION BY doc_id) AS most FROM citations)
SELECT doc_id, CASE WHEN part % 4 = 2 THEN 'figure' ELSE 'citation' END AS what, place::INT AS number FROM m
WHERE part % 4 = 2 AND place % 3 = 0 OR part % 4 = 0 AND place % 2 = 0 OR part % 4 = 1 AND (place % 2 = 1 OR place + 1 > most) GROUP BY ALL""")
def q58_unresolved_anchors(spark, sf_dir):
    return anchors.unresolved(*_bodies(spark, sf_dir))


_REFS = "SELECT DISTINCT doc_id, place AS pos, 'k' || place AS key, place AS number FROM citations WHERE place % 2 = 1"


@query(sql("citations") + """, m AS (SELECT *, max(place) OVER (PARTITION BY doc_id) AS most FROM citations),
n AS (SELECT *, CASE WHEN part % 4 = 0 AND place % 2 = 1 THEN (place + 1) // 2 WHEN part % 4 = 1 AND place % 2 = 0 AND place + 1 <= most THEN (place + 2) // 2 END AS no FROM m),
t AS (SELECT doc_id, '<body>' || string_agg('A' || CASE WHEN part % 4 < 2 THEN coalesce('[<a href="#ref-' || no || '">' || no || '</a>]', '[?]')
  WHEN part % 4 = 2 THEN CASE WHEN place % 3 = 0 THEN '[UNRESOLVED FIGURE ' || place || ']' ELSE '<figure id="fig-' || place || '">' || CASE WHEN place % 3 = 1 THEN '<p><em>[figure ' || place || ' (.png) is not embedded]</em></p>' ELSE '<img src="data:image/png;base64,eA==" alt="Figure ' || place || '" />' END || '<figcaption>50% of ' || place || '</figcaption></figure>' END ELSE 'x' END, ' ' ORDER BY place) AS text FROM n GROUP BY doc_id),
r AS (SELECT doc_id, '<section id="references"><h2>References</h2><ol>' || string_agg('<li id="ref-' || (place + 1) // 2 || '">T&amp;' || place || '.</li>', '' ORDER BY place) || '</ol></section>' AS refs FROM citations WHERE place % 2 = 1 GROUP BY doc_id)
SELECT doc_id, text || coalesce(refs || chr(10), '') || '</body>' AS text FROM t LEFT JOIN r USING (doc_id)""")
def q59_export_html(spark, sf_dir):
    texts, shown, cited = _bodies(spark, sf_dir)
    uri = F.when(F.col("number") % 3 == 2, anchors.data_uri(F.col("path"), F.lit("x").cast("binary")))
    none = F.lit(None).cast("string")
    refs = view(spark, sf_dir, "citations").where("place % 2 = 1").select("doc_id", F.col("place").alias("pos"), F.concat(F.lit("k"), F.col("place").cast("string")).alias("key"), F.concat(F.lit("T&"), F.col("place").cast("string")).alias("title"), F.lit("bibfile").alias("source"), F.array().cast(f"array<{N.NAME}>").alias("authors"), *(none.alias(c) for c in ("year", "container", "volume", "issue", "pages", "doi", "url")))
    body = texts.select("doc_id", F.concat(F.lit("<body>"), "text", F.lit("</body>")).alias("text"))
    return anchors.export(body, shown.withColumn("uri", uri), cited, refs, "html")


_CELL = "SELECT doc_id, 1 AS tbl, pos AS row, c.i AS i, CASE c.i WHEN 0 THEN 'r' || pos WHEN 1 THEN CAST(part AS {string}) ELSE flag || '_' END AS text FROM {p} CROSS JOIN (VALUES (0), (1), (2)) AS c(i)"


@query(sql("paragraphs") + f""", cells AS ({_CELL.format(string='VARCHAR', p='paragraphs')}), lines AS (SELECT doc_id, row, string_agg(replace(text, '_', '\\_'), ' & ' ORDER BY i) || ' \\\\' AS line FROM cells GROUP BY 1, 2)
SELECT doc_id, 1 AS "table", '\\begin{{table}}[htbp]' || chr(10) || '\\centering' || chr(10) || '\\caption{{Doc ' || doc_id || '}}' || chr(10) || '\\begin{{tabular}}{{l' || CASE WHEN count(*) FILTER (row > 1) > 0 THEN 'r' ELSE 'l' END || 'l}}' || chr(10) || '\\toprule' || chr(10) || max(line) FILTER (row = 1) || chr(10) || '\\midrule' || chr(10)
  || coalesce(string_agg(line, chr(10) ORDER BY row) FILTER (row > 1) || chr(10), '') || '\\bottomrule' || chr(10) || '\\end{{tabular}}' || chr(10) || '\\end{{table}}' AS text FROM lines GROUP BY doc_id""")
def q60_table_latex(spark, sf_dir):
    p = view(spark, sf_dir, "paragraphs")
    cells = spark.sql(_CELL.format(string="STRING", p="{p}").replace("CROSS JOIN (VALUES (0), (1), (2)) AS c(i)", "LATERAL VIEW explode(array(0, 1, 2)) c AS i"), p=p)
    none = F.lit(None)
    cells = cells.select("doc_id", F.col("tbl").alias("table"), F.col("row").cast("int").alias("row"), "i", F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"), "text", (F.col("row") == 1).alias("head"), none.cast("array<array<string>>").alias("nested"), none.cast("string").alias("explicit"))
    captions = p.select("doc_id").distinct().select("doc_id", F.lit(1).alias("table"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("caption"))
    return tables.to_latex(cells, captions)


@query(sql("findings") + """, f AS (SELECT *, CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warn' ELSE 'info' END AS sev, (pos % 7)::INT - 1 AS par FROM findings),
l AS (SELECT doc_id, '**[' || upper(sev) || ']** (' || category || ', ' || CASE WHEN par >= 0 THEN 'paragraph ' || par ELSE 'document' END || '): in ' || location || ' x' || pos AS line, CASE sev WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS r, par, category, 'in ' || location || ' x' || pos AS m FROM f)
SELECT doc_id, '# Conversion Report' || chr(10) || chr(10) || '## Preflight Findings' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY r, par, category, m) || chr(10) || chr(10)
  || array_to_string(list_transform(['Citation Extraction', 'Reference Validation', 'Figures', 'Compilation'], lambda x: '## ' || x || chr(10) || chr(10) || '_None_' || chr(10) || chr(10)), '')
  || '## Warnings' || chr(10) || chr(10) || string_agg('- w ' || m, chr(10) ORDER BY 'w ' || m) || chr(10) || chr(10) || '## Supplement' || chr(10) || chr(10) || '_None_' || chr(10) AS text FROM l GROUP BY doc_id""")
def q61_report(spark, sf_dir):
    f = view(spark, sf_dir, "findings")
    severity = F.when(F.col("severity") == "high", "error").when(F.col("severity") == "medium", "warn").otherwise("info")
    message = F.concat(F.lit("in\n"), "location", F.lit(" x"), F.col("pos").cast("string"))
    rows = f.select("doc_id", severity.alias("severity"), F.col("category").alias("detector"), (F.col("pos") % 7 - 1).cast("int").alias("paragraph"), F.lit("").alias("snippet"), report.flatten(message).alias("message"))
    notes = f.select("doc_id", F.concat(F.lit("w\r\n"), message).alias("message"))
    return report.whole(f.select("doc_id").distinct(), report.preflight(rows), report.warnings(notes))


_SIDE = """CASE c_custkey % 13 WHEN 0 THEN '[1]' WHEN 1 THEN '{"authors": [], "affiliations": []}' WHEN 2 THEN '{"title": " ", "affiliations": ["A"], "authors": [{"name": "B"}]}' WHEN 3 THEN '{"title": "T", "authors": [{"name": "B"}]}'
  WHEN 4 THEN '{"title": "T", "affiliations": ["A", " "], "authors": [{"name": "B"}]}' WHEN 5 THEN '{"title": "T", "affiliations": ["A"], "authors": []}' WHEN 6 THEN '{"title": "T", "affiliations": ["A"], "authors": [{"name": "B"}, {"x": 1}]}' WHEN 7 THEN '{"title": "T", "affiliations": ["A"], "authors": [{"name": "B", "affiliations": [1, 2]}]}'
  WHEN 8 THEN '{"title": "T", "affiliations": ["A"], "authors": [{"name": "B", "affiliations": ["x"]}]}' WHEN 9 THEN '{"title": "T", "affiliations": ["A"], "authors": [{"name": "B"}], "keywords": ["k", ""]}' ELSE '{"title": "T' || CAST(c_custkey AS VARCHAR(20)) || '", "affiliations": ["A", "B"], "authors": [{"name": "N", "affiliations": [2, 1], "corresponding": true}], "keywords": ["k"]}' END"""


@query(f"""WITH k AS (SELECT c_custkey AS doc_id, {_SIDE} AS data, c_custkey % 13 AS k FROM customer)
SELECT doc_id, replace(CASE k WHEN 0 THEN 'root must be a mapping' WHEN 1 THEN 'missing required field `title`' WHEN 2 THEN 'field `title` must be a non-empty string' WHEN 3 THEN 'missing required field `affiliations`' WHEN 4 THEN 'field `affiliations[1]` must be a non-empty string' WHEN 5 THEN 'field `authors` must be a non-empty list'
  WHEN 6 THEN 'missing required field `authors[1].name`' WHEN 7 THEN 'field `authors[0].affiliations[1]` names affiliation 2 of 1' WHEN 8 THEN 'field `authors[0].affiliations[0]` must be an integer' WHEN 9 THEN 'field `keywords[1]` must be a non-empty string' END, '`', chr(39)) AS error,
  CASE WHEN k > 9 THEN data ->> '$.title' END AS title, CASE WHEN k > 9 THEN '1,0' END AS affiliations FROM k""")
def q62_validate_sidecars(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_SIDE).alias("data"))
    out = metadata.validate_sidecars(rows)
    return out.select("doc_id", "error", F.col("meta.title").alias("title"), joined(F.get("meta.authors", F.lit(0))["affiliations"]).alias("affiliations"))


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN '# CHECK: guessed' || chr(10) ELSE '' END || 'title: "T \\"' || c_name || '\\" \\\\x"' || chr(10) || 'authors:' || chr(10) || '- name: "Ann"' || chr(10) || '  affiliations: [' || (c_nationkey + 1) || ', 1]' || chr(10) || '  email: "a@b.org"' || chr(10) || '  corresponding: true' || chr(10) || '- name: "Bo"' || chr(10) || '  affiliations: []' || chr(10)
 || 'affiliations:' || chr(10) || '- "' || c_mktsegment || '"' || chr(10) || 'abstract: "one\\ntwo"' || chr(10) || 'keywords: []' || chr(10) AS text FROM customer""")
def q63_sidecar_yaml(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    person = lambda name, at, mail, first: F.struct(F.lit(name).alias("name"), at.alias("affiliations"), F.lit(mail).cast("string").alias("email"), F.lit(first).alias("corresponding"))
    people = F.array(person("Ann", F.array(F.col("c_nationkey").cast("int"), F.lit(0)), "a@b.org", True), person("Bo", F.array().cast("array<int>"), None, False))
    title = F.concat(F.lit('T "'), "c_name", F.lit('" \\x'))
    meta = F.struct(title.alias("title"), people.alias("authors"), F.array("c_mktsegment").alias("affiliations"), F.lit("one\ntwo").alias("abstract"), F.array().cast("array<string>").alias("keywords"))
    checks = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("title"), F.array(F.lit("guessed")))).otherwise(F.create_map().cast("map<string,array<string>>"))
    return c.select(F.col("c_custkey").alias("doc_id"), meta.alias("m"), checks.alias("c")).select("doc_id", metadata.to_yaml(F.col("m"), F.col("c")).alias("text"))


_CLASS = "CASE n_nationkey % 3 WHEN 0 THEN 'revtex4-2' WHEN 1 THEN 'article' ELSE 'IEEEtran' END"


@query(f"""WITH o AS (SELECT n_nationkey AS k, {_CLASS} AS cls, CASE WHEN n_nationkey % 4 = 0 THEN []::VARCHAR[] WHEN n_nationkey % 4 = 1 THEN ['twocolumn', '10pt'] ELSE ['aps', 'onecolumn'] END AS opts FROM nation),
c AS (SELECT *, CASE k % 3 WHEN 1 THEN list_append(list_filter(opts, lambda x: x NOT IN ('onecolumn', 'twocolumn')), 'onecolumn') WHEN 2 THEN list_append(list_filter(opts, lambda x: x NOT IN ('onecolumn', 'twocolumn')), 'twocolumn') ELSE opts END AS o1 FROM o),
l AS (SELECT *, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN list_append(o1, 'linenumbers') ELSE o1 END AS o2 FROM c),
f AS (SELECT *, CASE WHEN k % 7 = 0 AND k % 3 = 0 THEN list_append(o2, 'endfloats') ELSE o2 END AS o3 FROM l)
SELECT k AS n, '\\documentclass' || CASE WHEN len(o3) > 0 THEN '[' || CASE WHEN k % 3 = 0 AND k % 4 = 1 AND k % 7 > 0 THEN array_to_string(o3, ', ') ELSE array_to_string(o3, ',') END || ']' ELSE '' END || '{{' || cls || '}}' || chr(10) || CASE k % 5 WHEN 0 THEN '\\usepackage[x]{{url,hyperref}}' || chr(10) WHEN 1 THEN '\\flushbottom' || chr(10) ELSE '' END
  || CASE WHEN k % 5 = 0 THEN '' ELSE '\\usepackage{{hyperref}}' || chr(10) END || CASE WHEN k % 2 = 0 AND k % 3 > 0 THEN '\\usepackage{{lineno}}' || chr(10) || '\\linenumbers' || chr(10) ELSE '' END || CASE WHEN k % 5 = 3 THEN '\\usepackage{{setspace}}' || chr(10) || '\\doublespacing' || chr(10) ELSE '' END
  || CASE WHEN k % 7 = 0 AND k % 3 > 0 THEN '\\usepackage[nolists,tablesfirst]{{endfloat}}' || chr(10) ELSE '' END || CASE WHEN k % 5 = 1 THEN '' ELSE '\\raggedbottom' || chr(10) END AS preamble FROM f""")
def q64_main_preamble(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    cls = F.when(k % 3 == 0, "revtex4-2").when(k % 3 == 1, "article").otherwise("IEEEtran")
    options = F.when(k % 4 == 0, "").when(k % 4 == 1, "[twocolumn, 10pt]").otherwise("[aps,onecolumn]")
    more = F.when(k % 5 == 0, "\\usepackage[x]{url,hyperref}\n").when(k % 5 == 1, "\\flushbottom").otherwise("")
    text = F.concat(F.lit("\\documentclass"), options, F.lit("{"), cls, F.lit("}\n"), more)
    columns = F.when(k % 3 == 1, "one").when(k % 3 == 2, "two").otherwise("default")
    return n.select(k.alias("n"), journals.main_preamble(text, cls, columns, k % 2 == 0, k % 5 == 3, k % 7 == 0).alias("preamble"))


_MANIFEST = """CASE n_nationkey % 8 WHEN 0 THEN '[]' WHEN 1 THEN '{"display_name": "J"}' WHEN 2 THEN '{"display_name": "J", "document_class": "c", "packages": [{"name": "a"}, {"options": ["x"]}]}' WHEN 3 THEN '{"display_name": "J", "document_class": "c"}' WHEN 4 THEN '{"display_name": "J", "document_class": "c", "bib": {"modes": {"odd": {"bibstyle": "s"}}, "default_mode": "odd"}}'
 WHEN 5 THEN '{"display_name": "J", "document_class": "c", "bib": {"modes": {"numeric": {"bibstyle": ""}}, "default_mode": "numeric"}}' WHEN 6 THEN '{"display_name": "J", "document_class": "c", "bib": {"modes": {"numeric": {"bibstyle": "s"}}, "default_mode": "authoryear"}}'
 ELSE '{"display_name": "J", "document_class": "c", "class_options": ["a", "b"], "packages": [{"name": "p", "options": ["o"]}, {"name": "q"}], "bib": {"modes": {"numeric": {"bibstyle": "s", "natbib_options": ["numbers"]}}, "default_mode": "numeric"}}' END"""


@query("""SELECT n_name AS name, CASE n_nationkey % 8 WHEN 0 THEN 'manifest must be a mapping' WHEN 1 THEN 'document_class must be a non-empty string' WHEN 2 THEN 'packages[1] has no name' WHEN 3 THEN 'bib is missing' WHEN 4 THEN 'bib.modes has an unknown mode odd' WHEN 5 THEN 'bib.modes.numeric has no bibstyle' WHEN 6 THEN 'bib.default_mode authoryear is no mode of it' END AS error,
 CASE WHEN n_nationkey % 8 = 7 THEN '\\documentclass[a,b]{c}' || chr(10) || '\\usepackage[o]{p}' || chr(10) || '\\usepackage{q}' || chr(10) || '\\usepackage[numbers]{natbib}' || chr(10) || '\\bibliographystyle{s}' || chr(10) END AS preamble FROM nation""")
def q65_manifests(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.expr(_MANIFEST).alias("data"))
    out = journals.validate_manifests(rows)
    return out.select("name", "error", F.when(F.col("error").isNull(), journals.preamble_of(F.col("manifest"), F.lit(None).cast("string"))).alias("preamble"))


@query(sql("citations") + """, f AS (SELECT doc_id, place AS pos, part % 4 AS number, 'img' || place || CASE WHEN part % 3 = 0 THEN '.png' ELSE '.pdf' END AS path FROM citations),
k AS (SELECT doc_id, number, arg_max(path, pos) AS path, count(*) AS n FROM f GROUP BY 1, 2), w AS (SELECT doc_id, 'figures/fig' || number || regexp_extract(path, '\\.[a-z]+$') AS file FROM k),
old AS (SELECT DISTINCT doc_id, CASE WHEN x = 5 THEN 'figures/mine1.pdf' ELSE 'figures/fig' || x || '.pdf' END AS file FROM citations, range(0, 6) r(x))
SELECT doc_id, file, 'written' AS state FROM w UNION ALL SELECT doc_id, file, 'stale' FROM old ANTI JOIN w USING (doc_id, file) WHERE file LIKE 'figures/fig%'
UNION ALL SELECT doc_id, 'figure number ' || number || ' is used by ' || n || ' figures; only the last is kept', 'twice' FROM k WHERE n > 1""")
def q66_figure_files(spark, sf_dir):
    c = view(spark, sf_dir, "citations")
    path = F.concat(F.lit("img"), F.col("place").cast("string"), F.when(F.col("part") % 3 == 0, ".png").otherwise(".pdf"))
    files, twice = figures.output_files(c.select("doc_id", F.col("place").alias("pos"), (F.col("part") % 4).alias("number"), path.alias("path")))
    old = c.select("doc_id").distinct().select("doc_id", F.explode(F.array(*(F.lit(f"figures/fig{x}.pdf") for x in range(5)), F.lit("figures/mine1.pdf"))).alias("file"))
    return files.select("doc_id", "file", F.lit("written").alias("state")).union(figures.stale_files(old, files).select("doc_id", "file", F.lit("stale"))).union(twice.select("doc_id", "message", F.lit("twice")))


@query(sql("paragraphs") + """, b AS (SELECT doc_id, pos, part % 12 AS k, flag, line, text FROM paragraphs),
h AS (SELECT *, CASE WHEN k IN (0, 1, 2, 3, 4, 8) THEN 'header' WHEN k = 11 THEN 'list' WHEN k = 9 AND flag = 'N' THEN 'image' ELSE 'para' END AS kind,
  CASE k WHEN 0 THEN 'Introduction' WHEN 1 THEN 'Methods' WHEN 2 THEN 'Data sources' WHEN 8 THEN 'Deep heading' ELSE text END AS t FROM b WHERE NOT (k = 5 AND flag = 'A'))
SELECT doc_id, pos, 0 AS part, kind, t AS text, CASE WHEN kind = 'image' THEN '%%FIGURE:' || row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) || '%%' END AS anchor FROM h WHERE NOT (k = 6 AND flag = 'R')
UNION ALL SELECT doc_id, pos, x, 'header', CASE x WHEN 0 THEN 'FIRST' ELSE 'Second' END, NULL FROM b, range(0, 2) r(x) WHERE k = 6 AND flag = 'R'""")
def q67_block_filters(spark, sf_dir):
    """Paragraphs as blocks: some blank, some lists of headings, some images."""
    p = view(spark, sf_dir, "paragraphs")
    k = F.col("part") % 12
    heads = (k == 6) & (F.col("flag") == "R")
    text = F.when((k == 5) & (F.col("flag") == "A"), F.lit("  \n")).otherwise(F.col("text"))
    kind = F.when(k == 4, "header").when(heads | (k == 11), "list").when((k == 9) & (F.col("flag") == "N"), "image").otherwise("para")
    items = F.when(heads, F.array(F.lit("FIRST"), F.lit("2. Second"))).when(k == 11, F.array(F.lit("FIRST"), F.lit("not a heading.")))
    blocks = p.select("doc_id", "pos", kind.alias("kind"), text.alias("text"), F.lit(None).cast("int").alias("level"), items.alias("items"), F.lit(False).alias("carries"))
    return tables.apply_all(blocks).select("doc_id", "pos", "part", "kind", "text", "anchor")


@query(sql("paragraphs") + """, u AS (SELECT doc_id, CASE part % 5 WHEN 0 THEN 'S' || line WHEN 1 THEN 'Title' WHEN 2 THEN 'x' ELSE 'Heading' || line END AS style FROM paragraphs),
n AS (SELECT doc_id, style, CASE WHEN style LIKE 'S%' THEN 'heading ' || style[2:] WHEN style = 'x' AND doc_id % 2 = 0 THEN 'caption' ELSE lower(style) END AS name FROM u)
SELECT doc_id, coalesce(string_agg(DISTINCT regexp_extract(name, '^heading\\s*(\\d+)$', 1), ',' ORDER BY regexp_extract(name, '^heading\\s*(\\d+)$', 1)) FILTER (regexp_matches(name, '^heading\\s*\\d+$')), '') AS levels, bool_or(name = 'title') AS title_used, bool_or(name = 'caption') AS caption_used FROM n GROUP BY doc_id""")
def q68_style_inventory(spark, sf_dir):
    p = view(spark, sf_dir, "paragraphs")
    style = F.when(F.col("part") % 5 == 0, F.concat(F.lit("S"), F.col("line").cast("string"))).when(F.col("part") % 5 == 1, "Title").when(F.col("part") % 5 == 2, "x").otherwise(F.concat(F.lit("Heading"), F.col("line").cast("string")))
    used = p.select("doc_id", style.alias("style_id"))
    docs = p.select("doc_id").distinct()
    names = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k")).select("doc_id", F.concat(F.lit("S"), F.col("k").cast("string")).alias("style_id"), F.concat(F.lit("heading "), F.col("k").cast("string")).alias("name"))
    names = names.union(docs.where("doc_id % 2 = 0").select("doc_id", F.lit("x"), F.lit("caption")))
    return preflight.style_inventory(used, names).select("doc_id", joined(F.col("heading_levels")).alias("levels"), "title_used", "caption_used")


@query(sql("paragraphs") + """, s AS (SELECT doc_id, pos, text, CASE part % 6 WHEN 0 THEN 'text_box' WHEN 1 THEN 'insertion' WHEN 2 THEN 'deletion' WHEN 3 THEN 'floating_object' WHEN 4 THEN 'smartart' ELSE 'image_paragraph' END AS sign, CASE WHEN flag = 'R' THEN 'Equation 1 ' || text ELSE text END AS t FROM paragraphs)
SELECT doc_id, pos::INT AS paragraph, CASE WHEN sign IN ('insertion', 'deletion') THEN 'tracked_changes' WHEN sign = 'image_paragraph' THEN 'equation_as_image' ELSE sign END AS detector, CASE WHEN sign IN ('floating_object', 'image_paragraph') THEN 'warn' ELSE 'error' END AS severity, t AS snippet
FROM s WHERE NOT (sign = 'text_box' AND text LIKE 'Figure %') AND NOT (sign = 'image_paragraph' AND t NOT LIKE 'Equation%')""")
def q69_preflight(spark, sf_dir):
    p = view(spark, sf_dir, "paragraphs")
    signs = F.get(F.array(*map(F.lit, ("text_box", "insertion", "deletion", "floating_object", "smartart", "image_paragraph"))), (F.col("part") % 6).cast("int"))
    rows = p.select("doc_id", signs.alias("sign"), F.col("pos").cast("int").alias("paragraph"), F.when(F.col("flag") == "R", F.concat(F.lit("Equation 1 "), "text")).otherwise(F.col("text")).alias("text"), F.col("text").alias("own_text"))
    return preflight.detect(rows).select("doc_id", "paragraph", "detector", "severity", "snippet")


@query("""WITH d AS (SELECT c_custkey AS doc_id, c_custkey % 4 AS k FROM customer)
SELECT doc_id, CASE WHEN k = 3 THEN NULL ELSE 0 END AS start, CASE k WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 3 END AS stop, CASE k WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 8 END AS left FROM d""")
def q70_front_matter(spark, sf_dir):
    """Title, authors, place; then (0) abstract and keywords, (1) an abstract up to a heading, (2) plain text;
    (3) plain text without markers."""
    k = F.col("c_custkey") % 4
    body = [F.lit("Title"), F.lit("Ann and Bo"), F.lit("Place"), F.when(k < 2, "Abstract").otherwise("Some text."), F.lit("It says this."), F.when(k == 0, "Keywords: a").when(k == 1, "INTRODUCTION").otherwise("More text."), F.lit("And so on."), F.lit("The end.")]
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(F.array(*body)).alias("pos", "text"))
    spans = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("title"), F.lit(2).alias("n_authors"), F.when(k == 3, 0).otherwise(1).alias("markers"), F.lit(2).alias("authors_end"), F.lit(3).alias("affiliations_end"))
    found = metadata.front_matter(c, spans)
    rest = metadata.strip_front_matter(c, found).groupBy("doc_id").agg(F.count("*").alias("left"))
    return found.join(rest, "doc_id").select("doc_id", "start", "stop", "left")


_LISTED = """SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS no, l_partkey AS part FROM {lineitem}"""


@query(sql("library") + f""", listed AS ({_LISTED.format(lineitem='lineitem')}),
typed AS (SELECT pos AS ref_id, family || ', B. (' || year || '). ' || title || ' .' AS text FROM library WHERE pos % 5 > 0),
{_SCORE.format(lib='library', n='')},
t AS (SELECT doc_id, no, m.title AS own, m.year, m.family, part % 5 = 0 AS odd FROM listed LEFT JOIN best b ON part = b.ref_id LEFT JOIN library m ON m.pos = b.pos),
k AS (SELECT *, CASE WHEN odd THEN 'zed1888zed' ELSE lower(regexp_replace(family, '[^A-Za-z0-9]', '', 'g')) || year || lower(string_split(own, ' ')[1]) END AS base FROM t),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, base) AS n, row_number() OVER (PARTITION BY doc_id, base ORDER BY no) - 1 AS r FROM k)
SELECT doc_id, string_agg('\\cite{{' || base || CASE WHEN n = 1 THEN '' ELSE repeat('z', (r // 26)::INT) || chr((97 + r % 26)::INT) END || '}}', ' ' ORDER BY no) || ' {{[}}99{{]}}' || chr(10) AS text FROM g GROUP BY doc_id""")
def q71_link_typed_list(spark, sf_dir):
    """Documents with a typed list of references after their body, whose numbers the body cites."""
    lib = view(spark, sf_dir, "library")
    rows = spark.sql(_LISTED, lineitem=table(spark, sf_dir, "lineitem")).join(lib.select(F.col("pos").alias("part"), "title", "year", "family"), "part")
    line = F.when(F.col("part") % 5 == 0, "Zed, Q. (1888). Qqq zzz www vvv.").otherwise(F.concat("family", F.lit(", B. ("), "year", F.lit("). "), "title", F.lit(" .")))
    items = rows.select("doc_id", F.col("no").alias("pos"), F.concat(F.lit("["), F.col("no").cast("string"), F.lit("] "), line).alias("text"), F.lit(False).alias("auto"))
    heads = items.select("doc_id").distinct().select("doc_id", F.lit(0).cast("bigint").alias("pos"), F.lit("References").alias("text"), F.lit(False).alias("auto"))
    marks = F.array_join(F.transform(F.array_sort(F.collect_list("no")), lambda n: F.concat(F.lit("{[}"), n.cast("string"), F.lit("{]}"))), " ")
    bodies = rows.groupBy("doc_id").agg(F.concat(marks, F.lit(" {[}99{]}\n\\section{References}\n[1] whatever")).alias("text"))
    entries, numbered, _ = citations.reconstruct(heads.unionByName(items), lib, lib.limit(0))
    return citations.link_typed(bodies, entries, numbered)
