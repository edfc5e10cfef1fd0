"""Words, hashes and exact numbers of words; long words and texts longer than a block."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import ctw, decontaminate, near_dedup, quality, substring
from scriptorium.llm._words import BLOCK_BYTES, Words, exact_sets

from .test_near_dedup import thue_morse


def block(*texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 1024, 65_536])
def test_hashes(n):
    some = [thue_morse(n), thue_morse(n, "b", "a"), "a" * n, "a" * (n + 1), "a" * n + "b", "B" * n]
    w = Words(*block(" ".join([*some, *some])))
    assert len(set(w.hash)) == len(set(some)) and (w.hash[: len(some)] == w.hash[len(some) :]).all()
    code, words = w.codes()
    assert [words[c].decode() for c in code] == [*some, *some]
    low = Words(*block(f"{'B' * n} {'b' * n}"), lower=True)
    assert low.hash[0] == low.hash[1] and len(low.codes(True)[1]) == 1


def test_equal_hashes_are_no_equal_words(monkeypatch):
    """With a hash that tells nothing the numbers are still exact."""
    monkeypatch.setattr(Words, "spans", lambda self, a, b, lower=False: np.zeros(len(a), np.uint64))
    code, words = Words(*block("x yy x zz yy")).codes()
    assert [words[c] for c in code] == [b"x", b"yy", b"x", b"zz", b"yy"]
    row, number = exact_sets(*block("a b c d", "b c d e", "a"), 3)
    sets = [set(number[row == r]) for r in range(3)]
    assert [len(s) for s in sets] == [2, 2, 1] and len(sets[0] & sets[1]) == 1 and not sets[2] & (sets[0] | sets[1])


def test_long_words_in_operators(spark):
    a, b = thue_morse(1024), thue_morse(1024, "b", "a")
    rest = " ".join(f"r{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"x\n{a}\n{b}")], "doc_id bigint, text string").withColumn("source", F.lit("s"))
    assert {r["doc_id"]: r["n_removed"] for r in substring.remove(docs, 13).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality.judge(docs).collect()}[3] == 0
    items = spark.createDataFrame([(7, f"{a} r0 r1 r2 r3")], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.search(docs, items).collect()] == [(1, 7)]
    got = {r["doc_id"]: r["n_known"] for r in ctw.score(docs, F.col("doc_id") == 1).collect()}
    assert got == {1: 14, 2: 13, 3: 2}


def test_text_longer_than_a_block(spark):
    """One text of several blocks' bytes is read whole by every operator on texts."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(60_000)}" for _ in range(600_000)]
    long = " ".join(words)
    assert len(long) > 2 * BLOCK_BYTES
    last = " ".join(words[-40:])
    docs = spark.createDataFrame([(1, last), (2, long), (3, long)], "doc_id bigint, text string").withColumn("source", F.lit("s"))
    q = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert q[2]["n_words"] == len(words) and q[2]["word_chars"] == sum(map(len, words))
    n = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert n[2]["n_shingles"] == len({tuple(words[i : i + 3]) for i in range(len(words) - 2)})
    assert {i: r["component_id"] for i, r in n.items()} == {1: 1, 2: 2, 3: 2}
    s = {r["doc_id"]: r for r in substring.remove(docs, 13).collect()}
    assert {i: r["n_removed"] for i, r in s.items()} == {1: 0, 2: 40, 3: len(words)}
    assert s[2]["kept_sha256"] == hashlib.sha256(" ".join(words[:-40]).encode()).hexdigest()
    items = spark.createDataFrame([(9, last)], "item_id bigint, text string")
    assert sorted(r["doc_id"] for r in decontaminate.search(docs, items).collect()) == [1, 2, 3]
    c = {r["doc_id"]: r for r in ctw.score(docs, F.col("doc_id") < 3).collect()}
    count = Counter(words[-40:]) + Counter(words)
    assert c[2]["n_tokens"] == c[2]["n_known"] == len(words) + 1 and c[2]["train_tokens"] == sum(count.values()) + 2
    assert c[2]["score"] == pytest.approx(c[3]["score"]) and c[2]["score"] < 0
