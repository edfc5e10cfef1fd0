"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents may be long, so the Jaccard similarity of the two says nothing;
what counts is the share of the item's shingles that the document holds. Items are partitioned by
their number of shingles n (powers of two). An item that a document holds to the share t lacks at
most floor((1 - t) * n) of its shingles, so of the floor((1 - t) * n) + 1 shingles with its smallest
hash values -- its bottom-k MinHash signature -- the document holds at least one. The signature's
length follows the partition's largest size, so no item at or above the threshold is missed.
Documents probe the index of signatures shingle by shingle; candidates are then counted on hashes of
their shingles, and those at the threshold verified on the words themselves.

Memory: the index holds the signatures of one block of items (``block_items``); a larger benchmark
is searched block by block, each in one pass over the documents. Documents are never shuffled.

Edge cases: null or empty texts match nothing; an item of 1 to 4 words is one shingle of all its
words and is found as such in documents; repeated items are reported each; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import Words, blocks, cached

SHINGLE = 5


def shingle_set(text: bytes, shingle: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a text's words, A-Z lower-cased; of fewer words, all of them as one."""
    words = text.lower().split()
    n = min(len(words), shingle)
    return set(zip(*(words[i:] for i in range(n)))) if n else set()


class Index:
    """Signatures of a block of items. Lengths below the shingle's are those of short items."""

    def __init__(self, items: list[tuple[int, str]], share: float, shingle: int):
        self.share, self.shingle, self.sets, owner, sign, kind = share, shingle, [], [], [], []
        self.ids, self.items = [i for i, _ in items], [(text or "").encode() for _, text in items]
        lengths = []
        for k, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            w = Words(raw, np.array([0, len(raw)]), lower=True)
            h, _, _ = w.shingles(shingle, whole_if_short=True)
            h = np.unique(h)
            lengths.append(min(w.n, shingle))
            self.sets.append(h)
        for k, h in enumerate(self.sets):
            if len(h):
                size = 1 << (len(h) - 1).bit_length()  # the partition: up to this many shingles
                n = min(len(h), int((1 - share) * size + 1e-9) + 1)
                sign.append(h[:n])  # np.unique has sorted them by hash value
                owner.append(np.full(n, k))
                kind.append(lengths[k])
        self.lengths = sorted(set(kind))
        self.sign = np.concatenate(sign) if sign else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(self.sign, kind="stable")
        self.sign, self.owner = self.sign[order], self.owner[order]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.sign >> np.uint64(48)).astype(np.int64)] = True

    def search(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float]]:
        """(row, place of the item, containment) at or above the share."""
        if not len(self.sign):
            return []
        w = Words(data, off, lower=True)
        runs = {}
        pairs = []
        for n in self.lengths:
            h, _, row = runs[n] = w.shingles(n)
            maybe = np.flatnonzero(self.filter[(h >> np.uint64(48)).astype(np.int64)])
            lo = np.searchsorted(self.sign, h[maybe])
            hi = np.searchsorted(self.sign, h[maybe], "right")
            hit = hi > lo
            for r, a, b in zip(row[maybe[hit]], lo[hit], hi[hit]):
                pairs += [(int(r), int(o)) for o in self.owner[a:b]]
        out, now, grams = [], None, {}
        for r, k in sorted(set(pairs)):
            own = self.sets[k]
            n = next((n for n in self.lengths if n == self.shingle), self.lengths[-1]) if len(own) > 1 else None
            have = 0
            for m in [n] if n else self.lengths:
                h, _, row = runs[m]
                a, b = np.searchsorted(row, [r, r + 1])
                have = max(have, int(np.isin(own, h[a:b]).sum()))
            if have < self.share * len(own) - 1e-9:
                continue
            if now != r:  # the words of the row, once
                now, grams, text = r, {}, data[off[r] : off[r + 1]].tobytes().lower().split()
            want = shingle_set(self.items[k], self.shingle)
            m = len(next(iter(want)))
            if m not in grams:
                grams[m] = set(zip(*(text[i:] for i in range(m))))
            have = len(want & grams[m])
            if have >= self.share * len(want) - 1e-9:
                out.append((r, k, have / len(want)))
        return out


def search(docs: DataFrame, items: DataFrame, share: float = 0.8, shingle: int = SHINGLE, block_items: int = 50_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, containment: every pair whose document holds at least ``share`` of the
    item's distinct shingles (words lower-cased in A-Z)."""
    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bench = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    kind, item_kind = cols.schema["doc_id"].dataType.simpleString(), bench.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, containment double"

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches):
            index = cached(("items", name), lambda: Index(block, share, shingle))
            for part, data, off in blocks(batches):
                found = index.search(data, off)
                if found:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([r for r, _, _ in found])), pa.array([block[k][0] for _, k, _ in found], items_type), pa.array([c for _, _, c in found])], names=["doc_id", "item_id", "containment"])

        return cols.mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    items_type = to_arrow_type(bench.schema["item_id"].dataType)
    out, block = None, []
    for row in bench.toLocalIterator():  # a block at a time, never the whole benchmark
        block.append((row[0], row[1]))
        if len(block) == block_items:
            out = scan(block) if out is None else out.unionByName(scan(block))
            block = []
    return scan(block) if out is None else out.unionByName(scan(block)) if block else out


def clean(docs: DataFrame, items: DataFrame, share: float = 0.8, shingle: int = SHINGLE, block_items: int = 50_000, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The documents without those that hold a test item: row by row, whatever their ids."""
    bench, schema = items.select(F.col(item_text_col).alias("text")).where("text is not null"), docs.schema

    def scan(rows: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches):
            index = cached(("items", name), lambda: Index(block, share, shingle))
            for part, data, off in blocks(batches, text_col):
                keep = np.ones(len(part), bool)
                keep[np.array([r for r, _, _ in index.search(data, off)], np.int64)] = False
                yield part.filter(pa.array(keep))

        return rows.mapInArrow(run, schema)

    block = []
    for row in bench.toLocalIterator():
        block.append((len(block), row[0]))
        if len(block) == block_items:
            docs, block = scan(docs, block), []
    return scan(docs, block) if block else docs
