"""Near-duplicate documents by an LSH forest.

A document is the set of its distinct word shingles. Documents with equal sets fold into one
representative first (partial aggregation by a fingerprint of the set), so copies cost one row each.
Each representative gets a MinHash signature, cut into trees of DEPTH values. Neighbours in a tree's
sorted order that share a prefix of at least MIN_DEPTH values are a region. Pairs whose signatures
already rule a link out are dropped. Three rounds:

1. The rows of all trees are put in one sorted order (range partitioning: a large region is spread over
   tasks). Depth adapts to the region: one of up to REGION members is searched whole, a larger one is
   split by a longer prefix, and what is still larger at full depth is searched in overlapping windows
   along the order, each with the region's hub, the row most like the others. Only candidates that
   would join what a window holds are given. This finds most links cheaply; what it misses depends on
   where windows, batches and partitions end, and is left to the other rounds, which search regions
   whole: there a region is a key.
2. With the components known, members of other components meet. Each row lists those that it may be
   linked with, up to LIST of them, likeliest first; a row with more is marked.
3. Marked rows meet all of each region again, with the sets of both sides, and what is a link on them is
   given, once for two components. So a row's candidates are never cut, and pairs that are no links are
   never written, however many there are.

In rounds 2 and 3 a region too large for one task is dealt out: its searching rows in blocks, all of its
rows in blocks, and every two blocks meet. Rows of the region's largest component needn't search: the
other end of each pair does. So the cost follows what is truly apart, not the square of a group of
copies. Every link is confirmed on the words of both whole texts, so no hash decides one. The result
depends on none of the partitions, batches or blocks.

A pair exactly at the threshold is in no common region with a probability under ``miss``.

Edge cases: a null text, or one without words, has an empty set and links with nothing; a text of
fewer words than a shingle is one shingle of all its words; a null id links with nothing and is
kept; rows that repeat an id are one vertex; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import released, written
from ._words import Words, blocks, exact_sets, mix, row_sets
from .components import components

DEPTH, MIN_DEPTH, REGION = 4, 3, 48
#: MinHash values a similarity is estimated from; those beyond the trees' are kept as a byte each.
ESTIMATE = 128
#: Others that a row of a large region lists in the second round; one with more is searched in the third.
LIST = 32
#: Rows of a region that meet in one place in the second round, and shingles in the third; a larger
#: region is dealt out.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 16
#: Others in the lists of one Arrow batch, about.
HELD = 1 << 18
U = np.uint64


def trees_for(share: float, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log(1 - share**MIN_DEPTH))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(1, 2**64, n, dtype=U) | U(1), rng.integers(1, 2**64, n, dtype=U)


def _sets(data: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    h, _, row = Words(data, off, lower=True).shingles(shingle, whole_if_short=True)
    return row_sets(h, row, len(off) - 1)


def _prints(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each row's set."""
    out = []
    for salt in (U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(sets ^ salt), dtype=U)])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, shingle: int, trees: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, p1, p2 (fingerprint of the set), sig (the trees' values, four bytes each)
    and small (of ESTIMATE values one byte each)."""
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wide = trees * DEPTH
    n_all = max(wide, ESTIMATE)
    mul, xor = _functions(n_all)

    def run(batches):
        for part, data, off in blocks(batches):
            sets, bounds = _sets(data, off, shingle)
            count = np.diff(bounds)
            some = np.flatnonzero(count)
            sig = np.zeros((len(count), wide), ">u4")
            small = np.zeros((len(count), n_all), np.uint8)
            if len(some):
                at = bounds[:-1][some]
                for k in range(n_all):
                    least = np.minimum.reduceat((sets ^ xor[k]) * mul[k], at) >> U(20)
                    small[some, k] = least & U(0xFF)
                    if k < wide:
                        sig[some, k] = least & U(0xFFFFFFFF)
            p1, p2 = _prints(sets, bounds)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count, pa.int64()), pa.array(p1), pa.array(p2), _binary(sig.view(np.uint8).reshape(len(count), -1)), _binary(small)], names=["doc_id", "n_shingles", "p1", "p2", "sig", "small"])

    return cols.mapInArrow(run, "doc_id bigint, n_shingles bigint, p1 bigint, p2 bigint, sig binary, small binary")


def _binary(rows: np.ndarray) -> pa.Array:
    """A matrix of bytes as a binary column."""
    n, wide = rows.shape
    return pa.Array.from_buffers(pa.binary(wide), n, [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)


def _forest(reps: DataFrame, trees: int) -> DataFrame:
    """A row for each tree of each representative, with its key: tree number and DEPTH values. reps: id,
    n, comp, sig, small."""

    def run(batches):
        for b in batches:
            n = len(b)
            if not n:
                continue
            sig, step = _matrix(b.column(3)), 4 * DEPTH
            for t in range(trees):
                key = np.empty((n, 1 + step), np.uint8)
                key[:, 0] = t
                key[:, 1:] = sig[:, t * step : (t + 1) * step]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], _binary(key), b.column(4)], names=["id", "n", "comp", "key", "small"])

    return reps.select("id", "n", "comp", "sig", "small").mapInArrow(run, "id bigint, n bigint, comp bigint, key binary, small binary")


class _Rows:
    """Rows of a stretch of the sorted order; ``comp``: the component so far; ``side``: where a region is dealt out, 1 for its searching rows, 2 for all of
    them, else 0."""

    NAMES = ("ids", "n", "comp", "key", "small", "side")

    def __init__(self, ids, n, comp, key, small, side):
        self.ids, self.n, self.comp, self.key, self.small, self.side = ids, n, comp, key, small, side

    @staticmethod
    def of(b: pa.RecordBatch):
        side = np.asarray(b.column(5)) if b.num_columns > 5 else np.zeros(len(b), np.int32)
        return _Rows(*(np.asarray(b.column(k)) for k in range(3)), _matrix(b.column(3)), _matrix(b.column(4)), side)

    def take(self, at):
        return _Rows(*(getattr(self, x)[at] for x in self.NAMES))

    @staticmethod
    def join(parts):
        return _Rows(*(np.concatenate([getattr(p, x) for p in parts]) for x in _Rows.NAMES))


def _alike(some: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """The estimated similarity of each of some signatures with each of all."""
    return np.concatenate([(some[:, None, :] == all_[None, j : j + 2048, :]).mean(2) for j in range(0, len(all_), 2048)], 1)


class _Search:
    """Candidate pairs in regions. first: pairs that would join what a window holds, in ``out``.
    Otherwise of each searching row those of other components, in a large region the LIST likeliest
    ones, in ``lists`` as (row, others, cut short); ``held``: how many others."""

    def __init__(self, low: float, share: float, first: bool):
        self.low, self.share, self.first, self.out, self.lists = low, share, first, [], []
        self.held = 0

    def window(self, r: _Rows, hubs: int = 0) -> None:
        """Up to REGION rows or so; the first ``hubs`` of them come first in any case."""
        order = np.concatenate([np.arange(hubs), hubs + np.argsort(r.ids[hubs:], kind="stable")])
        r = r.take(order)
        m = len(r.ids)
        like = (r.small[:, None, :] == r.small[None, :, :]).mean(2)
        like[np.minimum.outer(r.n, r.n) < self.share * np.maximum.outer(r.n, r.n) - 1e-9] = 0
        group = np.unique(r.comp, return_inverse=True)[1]
        if self.first:
            for i in range(1, m):
                own = np.where((like[i, :i] >= self.low) & (group[:i] != group[i]), like[i, :i], 0)
                while (j := int(own.argmax())) >= 0 and own[j]:
                    self.out.append((r.ids[j], r.ids[i]))
                    group[group == group[i]] = group[j]
                    own[group[:i] == group[i]] = 0
        else:
            pair = np.triu(like >= self.low, 1) & (group[:, None] != group[None, :])
            self.lists.extend((r.ids[i], r.ids[np.flatnonzero(pair[i])], False) for i in np.flatnonzero(pair.any(1)))

    def region(self, r: _Rows, depth: int) -> None:
        m = len(r.ids)
        if m <= REGION:
            if m > 1:
                self.window(r)
        elif depth < DEPTH:
            k = 1 + 4 * (depth + 1)
            cut = np.flatnonzero((r.key[1:, :k] != r.key[:-1, :k]).any(1)) + 1
            parts = np.split(np.arange(m), cut)
            hubs = []
            for p in parts:
                own = r.take(p)
                self.region(own, depth + 1)
                hubs.append(p[self.hub(own)])
            if len(parts) > 1:
                self.windows(r.take(np.array(hubs)))
        else:
            self.windows(r)

    def apart(self, r: _Rows):
        """Searching rows against all of the region, but for those of the largest component here: the
        other end of each pair searches. Stops now and then for the lists to be taken."""
        _, group, size = np.unique(r.comp, return_inverse=True, return_counts=True)
        if r.side.any():
            mine, pool = np.flatnonzero(r.side == 1), np.flatnonzero(r.side == 2)
        else:
            mine, pool = np.flatnonzero(group != size.argmax()), np.arange(len(r.ids))
        small, n = r.small[pool], r.n[pool]
        for i in range(0, len(mine) if len(pool) else 0, 32):
            own = mine[i : i + 32]
            for x, row in zip(own, _alike(r.small[own], small)):
                row[np.minimum(r.n[x], n) < self.share * np.maximum(r.n[x], n) - 1e-9] = 0
                found = np.flatnonzero((row >= self.low) & (group[pool] != group[x]))
                if len(found):
                    found = found[np.argsort(-row[found], kind="stable")]
                    self.lists.append((r.ids[x], r.ids[pool[found[:LIST]]], len(found) > LIST))
                    self.held += min(len(found), LIST)
            yield

    @staticmethod
    def hub(r: _Rows) -> int:
        """The row most like the others: nearest to the commonest value at each place."""
        if len(r.ids) < 3:
            return 0
        mode = np.array([np.bincount(c).argmax() for c in r.small.T])
        return int((r.small == mode).sum(1).argmax())

    def windows(self, r: _Rows) -> None:
        m, hub = len(r.ids), self.hub(r)
        for i in range(0, max(1, m - REGION // 2), REGION // 2):
            at = np.arange(i, min(m, i + REGION))
            at = np.concatenate([[hub], at[at != hub]])
            if len(at) > 1:
                self.window(r.take(at), 1)


def _region() -> F.Column:
    return F.substring("key", 1, 1 + 4 * MIN_DEPTH)


def _keys(reps: DataFrame, trees: int) -> DataFrame:
    """id, n, comp and region (_r) of each row of the forest."""
    return _forest(reps.withColumn("small", F.lit(bytearray())), trees).select("id", "n", "comp", _region().alias("_r"))


def _number(x: Column) -> Column:
    """A whole number in four bytes."""
    return F.unhex(F.lpad(F.hex(x), 8, "0"))


def _dealt(rows: DataFrame, searching: Column) -> DataFrame:
    """rows with _r, s_parts, p_parts -> key (region and two blocks), side: searching rows (1) of each
    block meet all rows (2) of each block."""
    own = F.when(searching, F.transform(F.sequence(F.lit(0), F.col("p_parts") - 1), lambda p: F.struct(F.pmod(F.xxhash64("id"), F.col("s_parts")).cast("int").alias("s"), p.alias("p"), F.lit(1).alias("side"))))
    all_ = F.transform(F.sequence(F.lit(0), F.col("s_parts") - 1), lambda s: F.struct(s.alias("s"), F.pmod(F.xxhash64("id"), F.col("p_parts")).cast("int").alias("p"), F.lit(2).alias("side")))
    placed = rows.withColumn("_m", F.explode(F.concat(F.coalesce(own, F.array().cast("array<struct<s:int,p:int,side:int>>")), all_)))
    return placed.withColumn("key", F.concat("_r", _number(F.col("_m.s")), _number(F.col("_m.p")))).withColumn("side", F.col("_m.side")).drop("_m")


def _low(share: float, trees: int) -> float:
    """A link is ruled out if the estimate is four standard deviations under the threshold."""
    return share - 4 * math.sqrt(share * (1 - share) / max(trees * DEPTH, ESTIMATE))


def _bounds(rows: _Rows, wide: int) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero((rows.key[1:, :wide] != rows.key[:-1, :wide]).any(1)) + 1, [len(rows.ids)]])


def _pairs_of_two(rows: _Rows, cut: np.ndarray, low: float, share: float) -> tuple[np.ndarray, np.ndarray]:
    two = cut[:-1][np.diff(cut) == 2]
    like = (rows.small[two] == rows.small[two + 1]).mean(1)
    x, y = rows.n[two], rows.n[two + 1]
    ok = (like >= low) & (np.minimum(x, y) >= share * np.maximum(x, y) - 1e-9) & (rows.comp[two] != rows.comp[two + 1])
    return rows.ids[two][ok], rows.ids[two + 1][ok]


def first_candidates(reps: DataFrame, trees: int, share: float) -> DataFrame:
    """Round 1: pairs a < b that may be links, once each."""
    low, wide = _low(share, trees), 1 + 4 * MIN_DEPTH

    def run(batches):
        kept = None  # the end of the last stretch, whose region may go on
        for b in batches:
            if not len(b):
                continue
            rows = _Rows.of(b)
            if kept is not None:
                rows = _Rows.join([kept, rows])
            search, cut = _Search(low, share, True), _bounds(rows, wide)
            search.out.extend(zip(*_pairs_of_two(rows, cut, low, share)))
            for k in np.flatnonzero(np.diff(cut) > 2):
                search.region(rows.take(np.arange(cut[k], cut[k + 1])), MIN_DEPTH)
            last = np.arange(cut[-2], len(rows.ids))  # a large region goes on with its hub and its last rows
            if len(last) > REGION:
                last = np.unique(np.concatenate([last[[search.hub(rows.take(last))]], last[1 - REGION :]]))
            kept = rows.take(last)
            if search.out:
                pairs = np.unique(np.sort(np.array(search.out, np.int64), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    ordered = _forest(reps, trees).repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    return ordered.mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()


def listed_candidates(reps: DataFrame, trees: int, share: float) -> DataFrame:
    """Round 2: a, others (array, once each), cut (there are more)."""
    low, wide = _low(share, trees), 1 + 4 * MIN_DEPTH
    of = _keys(reps, trees).groupBy("_r", "comp").agg(F.count("*").alias("k")).groupBy("_r")
    large = written(of.agg(F.sum("k").alias("k"), F.max("k").alias("most"), F.max_by("comp", F.struct("k", "comp")).alias("main")).where(f"k > {BLOCK} and k > most"))
    dealt = bool(large.limit(1).count())

    def stretches(batches):
        """Rows of whole regions: one that goes on in the next batch waits for it."""
        kept = []
        for b in batches:
            if len(b):
                rows = _Rows.of(b)
                end = len(rows.ids) if not kept or (rows.key[-1] == kept[0].key[-1]).all() else 0
                last = _bounds(rows, rows.key.shape[1])[-2]
                if end and kept and not last:
                    kept.append(rows)  # all of it goes on
                    continue
                rows = _Rows.join([*kept, rows]) if kept else rows
                last = _bounds(rows, rows.key.shape[1])[-2]
                if last:
                    yield rows.take(slice(0, last))
                kept = [rows.take(slice(last, None))]
        if kept:
            yield _Rows.join(kept)

    def run(batches):
        search = _Search(low, share, False)

        def taken():
            lists, search.lists, search.held = search.lists, [], 0
            off = np.concatenate([[0], np.cumsum([len(x) for _, x, _ in lists])]).astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([x for _, x, _ in lists]).astype(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in lists], pa.int64()), others, pa.array([c for _, _, c in lists], pa.bool_())], names=["a", "others", "cut"])

        for rows in stretches(batches):
            cut = _bounds(rows, rows.key.shape[1])
            if not rows.side.any():
                search.lists.extend((i, np.array([j]), False) for i, j in zip(*_pairs_of_two(rows, cut, low, share)))
            for k in np.flatnonzero(np.diff(cut) > (1 if rows.side.any() else 2)):
                own = rows.take(slice(cut[k], cut[k + 1]))
                if len(own.ids) <= REGION and not own.side.any():
                    search.window(own)
                else:
                    for _ in search.apart(own):
                        if search.held > HELD:
                            yield taken()
            if search.lists:
                yield taken()

    def searched(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "a bigint, others array<bigint>, cut boolean")

    forest = _forest(reps, trees).withColumn("key", _region())
    if dealt:
        parts = large.select("_r", "main", F.ceil((F.col("k") - F.col("most")) / BLOCK).cast("int").alias("s_parts"), F.ceil(F.col("k") / BLOCK).cast("int").alias("p_parts"))
        apart = _dealt(forest.join(parts, forest["key"] == parts["_r"]).drop("key"), F.col("comp") != F.col("main")).select("id", "n", "comp", "key", "small", "side")
        whole = large.select(F.col("_r").alias("_l"))
        lists = searched(forest.join(whole, forest["key"] == whole["_l"], "left_anti")).union(searched(apart))
    else:
        lists = searched(forest)
    return lists.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"), F.max("cut").alias("cut"))


def set_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, set: the sorted hashes of the text's shingles, eight bytes each."""

    def run(batches):
        for part, data, off in blocks(batches):
            sets, bounds = _sets(data, off, shingle)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], names=["doc_id", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, set binary")


def region_links(reps: DataFrame, marked: DataFrame, docs: DataFrame, trees: int, shingle: int, percent: int) -> DataFrame:
    """Round 3: links a, b of the marked rows (a) with rows of other components, by their sets; of two
    components that meet in one place, one link."""
    share = percent / 100
    low = _low(share, trees)
    mine = reps.join(marked.select(F.col("a").alias("_m")), reps["id"] == F.col("_m"), "left_semi")
    wanted = written(_keys(mine, trees).groupBy("_r").agg(F.sum("n").alias("s")))
    keys = _keys(reps, trees)
    sizes = keys.join(wanted, "_r").groupBy("_r").agg(F.first("s").alias("s"), F.sum("n").alias("p"))
    parts = written(sizes.select("_r", *(F.ceil(F.col(c) / BLOCK_SHINGLES).cast("int").alias(f"{c}_parts") for c in "sp")))
    used = keys.join(wanted, "_r", "left_semi").select(F.col("id").alias("_u")).distinct()
    sets = written(set_rows(docs.join(used, docs["doc_id"] == used["_u"], "left_semi"), shingle).withColumnRenamed("doc_id", "_s").distinct())
    forest = _forest(reps, trees).withColumn("_r", _region()).drop("key").join(parts, "_r")
    search = marked.select(F.col("a").alias("_m"))
    forest = forest.join(search, forest["id"] == search["_m"], "left")
    forest = _dealt(forest, F.col("_m").isNotNull()).join(sets, F.col("id") == F.col("_s")).select("key", "id", "n", "comp", "small", "side", "set")

    def meet(rows: list) -> list[tuple[int, int]]:
        ids, n, comp = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        small = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        side = np.array([r[5] for r in rows])
        known, group = np.unique(comp, return_inverse=True)
        label, out = np.arange(len(known)), []
        pool = np.flatnonzero(side == 2)
        for x in np.flatnonzero(side == 1):
            like = _alike(small[[x]], small[pool])[0] if len(pool) else np.zeros(0)
            like[np.minimum(n[x], n[pool]) < share * np.maximum(n[x], n[pool]) - 1e-9] = 0
            at = np.flatnonzero(like >= low)
            at = pool[at[np.argsort(-like[at], kind="stable")]]
            own = np.frombuffer(rows[x][6], U)
            while len(at := at[label[group[at]] != label[group[x]]]):
                now, at = at[:64], at[64:]
                other = [np.frombuffer(rows[y][6], U) for y in now]
                found = np.concatenate(other)
                place = np.minimum(np.searchsorted(own, found), len(own) - 1)
                ends = np.concatenate([[0], np.cumsum([len(o) for o in other])])
                common = np.diff(np.concatenate([[0], np.cumsum(own[place] == found)])[ends])
                for y in now[100 * common >= percent * (len(own) + np.diff(ends) - common)]:
                    if label[group[y]] != label[group[x]]:
                        out.append((int(ids[x]), int(ids[y])))
                        label[label == label[group[y]]] = label[group[x]]
        return out

    def run(batches):
        now, rows = None, []
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if rows and r[0] != now:
                    out += meet(rows)
                    rows = []
                now = r[0]
                rows.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
        if rows and (out := meet(rows)):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    found = forest.repartition("key").sortWithinPartitions("key", "id", "side").mapInArrow(run, "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(data_a: np.ndarray, off_a: np.ndarray, i: np.ndarray, data_b: np.ndarray, off_b: np.ndarray, j: np.ndarray, shingle: int, percent: int) -> np.ndarray:
    """Whether row i of the one block and row j of the other (each j once) are a link, by their words."""
    m = len(off_a) - 1
    row, number = exact_sets(np.concatenate([data_a, data_b]), np.concatenate([off_a, off_a[-1] + off_b[1:]]), shingle)
    size, cut = np.bincount(row, minlength=m + len(off_b) - 1), np.searchsorted(row, m)
    pair = np.full(len(off_b) - 1, -1)
    pair[j] = np.arange(len(j))
    of = pair[row[cut:] - m]
    known, wanted = row[:cut] << 40 | number[:cut], (i[of] << 40 | number[cut:])[of >= 0]
    found = np.searchsorted(known, wanted)
    same = known[np.minimum(found, len(known) - 1)] == wanted if len(known) else np.zeros(len(wanted), bool)
    common = np.bincount(of[of >= 0][same], minlength=len(j))
    return (size[i] > 0) & (100 * common >= percent * (size[i] + size[m + j] - common))


def _confirm(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs that are links on their full sets."""
    left = docs.select(F.col("doc_id").alias("_a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("doc_id").alias("_b"), F.col("text").alias("text_b"))
    both = pairs.join(right, pairs["b"] == right["_b"]).select("a", "b", "text_b").join(left, F.col("a") == F.col("_a")).select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            for sub, data_b, off_b in blocks([batch], "text_b"):
                # each text of the other side once: the joins leave its pairs next to each other
                _, first, of = np.unique(np.asarray(sub.column(0)), return_index=True, return_inverse=True)
                head, at = pa.RecordBatch.from_arrays([sub.column(2).take(pa.array(first))], names=["text_a"]), 0
                for part, data_a, off_a in blocks([head], "text_a"):
                    own = np.flatnonzero((of >= at) & (of < at + len(part)))
                    own = own[links(data_a, off_a, of[own] - at, data_b, off_b, own, shingle, percent)]
                    at += len(part)
                    if len(own):
                        keep = pa.array(own)
                        yield pa.RecordBatch.from_arrays([sub.column(0).take(keep), sub.column(1).take(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links), kept (the document
    is its component's smallest). A link: 100 * intersection >= percent * union."""
    share = percent / 100
    trees = trees_for(share, miss)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = written(signatures(own, shingle, trees))
    sets = sigs.where("doc_id is not null and n_shingles > 0")
    reps = sets.groupBy("p1", "p2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("small").alias("small"))
    copies = sets.select("doc_id", "p1", "p2", F.col("n_shingles").alias("n"))
    reps = written(reps)
    texts = own.where("doc_id is not null")

    def known(found: DataFrame | None) -> DataFrame:
        rows = reps.select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "sig", "small")
        if found is None:
            return rows.withColumn("comp", F.col("id"))
        found = found.select(F.col("id").alias("_id"), "component")
        return rows.join(found, rows["id"] == found["_id"], "left").select("id", "n", "sig", "small", F.coalesce("component", "id").alias("comp"))

    tried = written(first_candidates(known(None), trees, share))
    links = written(_confirm(tried, texts, shingle, percent))
    so_far = components(links)
    lists = written(listed_candidates(known(so_far), trees, share))
    pairs = lists.select("a", F.explode("others").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    released(docs.sparkSession)
    new = written(_confirm(pairs.join(tried, ["a", "b"], "left_anti"), texts, shingle, percent))
    if new.limit(1).count():
        links = links.union(new)
        so_far = components(links)
    marked = lists.where("cut")
    if marked.limit(1).count():
        near = written(region_links(known(so_far), marked, texts, trees, shingle, percent))
        released(docs.sparkSession)
        new = written(_confirm(near, texts, shingle, percent))
        if new.limit(1).count():
            links = links.union(new)
            so_far = components(links)
    heads = reps.select("p1", "p2", F.col("n_shingles").alias("n"), "rep")
    joined = written(copies.join(heads, ["p1", "p2", "n"]).select("doc_id", "rep"))
    # an id that repeats with several texts ties their representatives
    tied = written(joined.where("doc_id <> rep").join(joined.groupBy("doc_id").agg(F.countDistinct("rep").alias("k")).where("k > 1").select("doc_id"), "doc_id", "left_semi"))
    found = components(links.union(tied.select("doc_id", "rep"))) if tied.limit(1).count() else so_far
    of = joined.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    of = of.join(found, of["rep"] == found["id"], "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    of = of.withColumnRenamed("doc_id", "_id")
    base = sigs.select("doc_id", "n_shingles")
    out = base.join(of, base["doc_id"] == of["_id"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
