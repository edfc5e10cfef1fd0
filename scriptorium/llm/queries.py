"""The thin queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, ctw, decontaminate, html, language, near_dedup, packing, quality, substring, urls
from ._spark import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer(), capacity=1024, end_id=2)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove(table(spark, sf_dir, "documents"), window=13)


def unescaped(text) -> F.Column:
    """The five character references that plain text needs, decoded."""
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(char))
    return text


#: Fixed values of the query's contract.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


#: Characters of a document that a page's headline repeats, and shares of a headline that many pages have.
HEADLINE, SALTS = 60, 8


def page_labels(pages: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """url, bad: a page shows the documents that its headline begins; one of them of low quality or
    toxic makes it bad. Pages without a labelled document are left out."""
    bad = labels.select(F.col("doc_id").alias("_id"), F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)).alias("bad"))
    told = documents.select("doc_id", F.left("text", F.lit(HEADLINE)).alias("headline")).join(bad, F.col("doc_id") == F.col("_id"))
    told = told.where("headline <> ''").groupBy("headline").agg(F.max("bad").alias("bad")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shown = pages.select("url", unescaped(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)).alias("headline"), F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int").alias("salt"))
    return shown.join(told, ["headline", "salt"]).select("url", "bad")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled urls: those the explicit rules decide, and for the others the labels of what they show."""
    pages = table(spark, sf_dir, "pages")
    told = page_labels(pages.where(urls.explicit(urls.host_of(F.col("url")), urls.path_of(F.col("url")), URL_RULES)[1].isNull()), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return urls.judge(pages, urls.verdicts(pages, URL_RULES).unionByName(told), URL_RULES)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", same), (-7, 1, "assistant", same)], rows.schema)
    log = rows.unionByName(more).withColumn("seq", F.col("turn")).withColumn("kind", F.lit("message"))
    return chat.digests(chat.conversations(log))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = language.fit(docs.where(language.fold() != 0))
    return language.predict(docs, samples, {"held_out": F.coalesce(language.fold() == 0, F.lit(False))})


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(language.fold() == 1, F.lit(False))
    out = ctw.score(table(spark, sf_dir, "documents"), ~held_out, {"held_out": held_out})
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_packing, op3_html_extraction, op4_decontamination, op5_substring_dedup, op6_url_filter, op7_chat_format, op8_near_dedup, op9_language_id, op10_lm_score)}

_WORD = r"[^\x20\x09-\x0D]"
_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _escaped(x: str, more: tuple[str, ...] = ()) -> str:
    """SQL for the length of an escaped string: one more for each control string in it."""
    return f"length({x})" + "".join(f" + (length({x}) - length(replace({x}, {c}, ''))) // length({c})" for c in ("chr(92)", "'<turn'", "'</turn'", *more))


SQL = {
    "op1_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}+') AS ws FROM d),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY rid),
win AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
again AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, x) > 1),
cover AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM again) GROUP BY rid),
m AS (SELECT rid, doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN cover USING (rid)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 2 * n_words OR 10 * n_upper > 3 * word_chars OR 2 * n_dup_lines > n_lines AS failed FROM m),
h AS (SELECT host, count(*) AS n, sum(failed::INT)::DOUBLE AS f FROM j GROUP BY host),
s AS (SELECT count(*)::DOUBLE AS hosts, sum(n)::DOUBLE AS n, sum(f) AS f, sum(n::DOUBLE * n) AS n2, sum(f * f / n) AS ff FROM h),
r AS (SELECT *, f / n AS mean, CASE WHEN f > 0 AND f < n AND hosts > 1 AND n - n2 / n - (hosts - 1) > 0
  THEN ((ff - f * f / n) / (f / n * (1 - f / n)) - (hosts - 1)) / (n - n2 / n - (hosts - 1)) ELSE 0.0001 END AS rho FROM s),
k AS (SELECT mean, 1 / least(greatest(rho, 0.0001), 0.9999) - 1 AS k FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT failed AND (h.f + k.mean * k.k) / (h.n + k.k) <= 0.5 AS kept, failed
FROM j JOIN h USING (host) CROSS JOIN k""",
    "op4_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_AZ.format('text')}, '{_WORD}+') AS ws FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS bid, item_id, regexp_extract_all({_AZ.format('text')}, '{_WORD}+') AS ws FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT DISTINCT bid, item_id, array_to_string(ws[i:i+least(len(ws), 5)-1], ' ') AS x, least(len(ws), 5) AS k
  FROM (SELECT bid, item_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
ds AS (SELECT DISTINCT rid, doc_id, k, array_to_string(ws[i:i+k-1], ' ') AS x
  FROM (SELECT rid, doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bs) WHERE len(ws) >= k)),
n AS (SELECT bid, count(*) AS n FROM bs GROUP BY bid)
SELECT doc_id, item_id, count(*)::DOUBLE / n AS containment
FROM bs JOIN ds USING (k, x) JOIN n USING (bid) GROUP BY rid, doc_id, bid, item_id, n HAVING count(*) >= 0.8 * n - 1e-9""",
    "op5_substring_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(ws[i:i+12], ' ') AS x FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
hit AS (SELECT rid, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY x) < doc_id),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM hit),
words AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid)""",
    "op7_chat_format": """
WITH x AS (SELECT chr(92) || '### Assistant: </turn> ok' AS x),
c AS (SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', x, 'user', x FROM x UNION ALL SELECT -7, 1, 'assistant', x, 'assistant', x FROM x),
e AS (SELECT *, {added_text} AS body, {added_role} AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(6 + head + 2 + body + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""".format(added_text=_escaped("text"), added_role=_escaped("role", ("'>'", "chr(10)"))),
    "op8_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '{_WORD}+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+least(len(ws), 3)-1], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS id, doc_id AS far FROM d UNION SELECT id, b FROM reach JOIN links ON far = a),
lowest AS (SELECT id, min(far) AS component_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM d JOIN lowest ON id = doc_id LEFT JOIN n USING (doc_id)""",
}
