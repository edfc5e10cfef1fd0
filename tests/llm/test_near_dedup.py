"""No link is lost, and nothing but the texts decides the result."""

from __future__ import annotations

import random

import pytest

from scriptorium.llm import near_dedup

from . import brute


def families(sizes, seed, words=150, spread=6):
    """Pairs of clusters: the base texts differ in spread words, members in one word of their own; one
    member of each, no hub, takes over a word of the other side: the one link between the two."""
    rng, rows = random.Random(seed), []
    places = [int((k + 0.5) * words / spread) for k in range(spread)]
    free = [p for p in range(words) if all(abs(p - q) > 4 for q in places)]
    for f, (left, right) in enumerate(sizes):
        base = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 8))) for _ in range(words)]
        other = [f"alt{f}x{p}" if p in places else w for p, w in enumerate(base)]
        for side, (n, own) in enumerate(((left, base), (right, other))):
            for k in range(n):
                text = list(own)
                if k == n // 2:
                    text[places[side]] = (other, base)[side][places[side]]
                else:
                    text[rng.choice(free)] = f"own{f}s{side}k{k}"
                rows.append(" ".join(text))
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


def found(spark, rows, parts, batch=10_000):
    names = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        return {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, 3, 85).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("size, n, seed", [(120, 6, 1), (150, 3, 2), (400, 2, 3)])
def test_bridges(spark, size, n, seed):
    rows = families([(size, size)] * n, seed)
    want = brute.components(rows, 3, 85)
    assert len(set(want.values())) == n
    assert found(spark, rows, 4) == want


@pytest.mark.parametrize("parts, batch", [(1, 100), (7, 300), (64, 10_000)])
def test_same_by_any_partition(spark, parts, batch, monkeypatch):
    """Also where regions are dealt out in blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 64 if parts == 7 else 4096)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 5_000 if parts == 7 else 1 << 20)
    rows = families([(100, 60), (150, 150)], 5)
    want = brute.components(rows, 3, 85)
    assert len(set(want.values())) == 2
    assert found(spark, rows, parts, batch) == want


def test_marked_rows(spark, monkeypatch):
    """Lists too short for anything: all is left to the third round."""
    monkeypatch.setattr(near_dedup, "LIST", 1)
    rows = families([(60, 80)], 9)
    assert found(spark, rows, 4) == brute.components(rows, 3, 85)


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096, 65_536])
def test_words_of_equal_sums(spark, n):
    """Words whose letters cancel out in polynomial hashes are still different words."""
    tail = " ".join(f"w{i}" for i in range(6))
    rows = [(1, f"{thue_morse(n)} {tail}"), (2, f"{thue_morse(n, 'b', 'a')} {tail}")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 70).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2}
