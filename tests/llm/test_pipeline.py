"""The pipeline's stages on the smallest driver tables, against brute force."""

from __future__ import annotations

import pytest

import corpus_pipeline as pipeline
from scriptorium.llm._spark import written

from .test_operators import brute_components, check_packing, low, words


@pytest.fixture(scope="module")
def stages(spark, sf):
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf)))
    return [[r.asDict() for r in df.collect()] for df in out], [df.columns for df in out]


def test_columns(stages):
    _, columns = stages
    assert all(c == columns[0] for c in columns[:-1])


def test_language(stages):
    rows, _ = stages
    letters = [r["doc_id"] for r in rows[0] if any(map(str.isalpha, r["text"] or ""))]
    kept = {r["doc_id"]: r for r in rows[1]}
    assert set(kept) <= set(letters) and len(kept) >= 0.99 * len(letters)
    assert all(r == kept[r["doc_id"]] for r in rows[0] if r["doc_id"] in kept)


def test_language_decides(spark, sf):
    """A prediction drops rows, and fills a null lang."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").where("length(text) > 300 and lang in ('en', 'de')")
    some = {r["lang"]: r["text"] for r in docs.collect()}
    more = spark.createDataFrame([(-1, some["en"], None), (-2, some["de"], None), (-3, "x", None), (-4, "1 2 3", "en")], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang"] for r in pipeline.language_id(spark, docs.unionByName(more), sf).collect()}
    assert (got.get(-1), got.get(-2)) == ("en", "de") and -3 not in got and -4 not in got
    unlabelled = more.where("lang is null").union(more.where("lang is not null").selectExpr("doc_id", "text", "cast(null as string)"))
    assert pipeline.language_id(spark, unlabelled, sf).count() == 4


def test_near_dedup(stages):
    rows, _ = stages
    want = brute_components([(r["doc_id"], r["text"]) for r in rows[1]], 5, 80)
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(i for i, (_, c) in want.items() if i == c)


def test_substring(stages):
    rows, _ = stages
    n, first = pipeline.PASSAGE_WORDS, {}
    for r in sorted(rows[2], key=lambda r: r["doc_id"]):
        w = words(r["text"])
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), r["doc_id"])
    after = {r["doc_id"]: r for r in rows[3]}
    for r in rows[2]:
        w = words(r["text"])
        gone = {p for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < r["doc_id"] for p in range(k, k + n)}
        if w and len(gone) == len(w):
            assert r["doc_id"] not in after
        else:
            assert words(after[r["doc_id"]]["text"]) == [x for p, x in enumerate(w) if p not in gone]
            assert gone or after[r["doc_id"]] == r


def test_decontamination(stages, spark, sf):
    rows, _ = stages
    items = []
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        v = words(low(r["text"]))
        items.append({tuple(v[j : j + 5]) for j in range(len(v) - 4)})
    want = []
    for r in rows[3]:
        w = words(low(r["text"]))
        have = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        if not any(len(x & have) >= 0.8 * len(x) for x in items if x):
            want.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in rows[4]) == sorted(want)


def test_packing(stages):
    rows, _ = stages
    assert {r["doc_id"] for r in rows[5]} == {r["doc_id"] for r in rows[4]}
    used = check_packing(rows[5], 1024)
    assert used <= 1.05 * sum(r["length"] for r in rows[5]) / 1024 + 1


def test_odd_input(spark, sf):
    """Nulls in any column, empty and repeated rows, clashing extra columns, and an empty table."""
    from pyspark.sql import functions as F

    from .test_operators import DOCS, texts

    rows = [(i, t, None if i % 4 else "en", None, None) for i, t in enumerate(texts())] + [(None, "a b c", "en", "s", 1), (None, None, None, None, None), (2, texts()[2], "en", "s", 1), (2, texts()[2], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("score", "lang_pred", "rep", "kept", "starts", "grp", "n_words", "_gone", "length", "piece", "_id"):
        docs = docs.withColumn(name, F.lit("x"))
    columns = docs.columns
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = written(stage(spark, docs, sf))
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
            ids = [r[0] for r in docs.select("doc_id").collect()]
            assert ids.count(None) <= 1  # the other has no letter
            if k:
                assert len(set(ids)) == len(ids)
    assert {r["doc_id"] for r in docs.collect()} == set(ids)
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        none = written(stage(spark, none, sf))
        assert none.count() == 0
