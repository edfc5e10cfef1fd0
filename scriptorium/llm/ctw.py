"""Language-model scores by context-tree weighting, beside a unigram base.

A text is its UTF-8 bytes and an end mark. Each byte is eight binary decisions; each decision has a
context tree over the last ``DEPTH`` bytes. A node mixes its own Krichevsky-Trofimov estimate with
what its children say: its weight is the posterior of stopping there, from the training counts,

    L = log(1/2 exp(KT) + 1/2 exp(sum of L of its children)),  weight = 1/2 exp(KT) / exp(L)

and a text is scored with the trained tree as it is. A context that training never saw passes on the
estimate of its parent, so every text has a probability and they sum to one.

Nothing of the model is broadcast but its two shallowest depths (at most 256 + 65,536 counts, a bound
of the alphabet). Documents are dealt into groups of about ``group_bytes``. Each group sends its
distinct words and its distinct byte (DEPTH + 1)-grams once, with training counts, in packed rows
dealt to buckets: words by hash, grams by their last two context bytes, so that all nodes from depth
two on are inside a bucket. Buckets sum the counts, build the trees and answer every group for what it
sent; groups then score their documents from the answers. Groups and buckets are streamed; a task
holds one group's text, or one bucket's distinct entries.

Edge cases: a null or empty text is the end mark alone; without any training documents all estimates
are 1/2 a bit; repeated rows and ids are scored each; a null id is in no fold, and trains; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import discard, released, written
from ._words import U, Words, blocks

DEPTH = 5
END = 0xFF  # of no UTF-8 text; also stands before a text's first byte
END_WORD = U(0x8A5CD789635D2DFF)
#: As many as there are pairs of context bytes, by which grams are dealt.
MOST_BUCKETS = 1 << 16
PAIR = U(32)  # bits below a gram's last two context bytes


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte and end mark: its contexts, the last byte first, then itself, as one number; and
    the rows' bounds."""
    rows = len(off) - 1
    bounds = off + np.arange(rows + 1)
    ext = np.full(len(data) + rows * (DEPTH + 1), END, np.uint8)
    row = np.repeat(np.arange(rows), np.diff(off))
    ext[np.arange(len(data)) + row * (DEPTH + 1) + DEPTH] = data
    at = np.arange(bounds[-1]) + np.repeat(np.arange(rows), np.diff(bounds)) * DEPTH + DEPTH
    code = ext[at].astype(U)
    for k in range(1, DEPTH + 1):
        code |= ext[at - k].astype(U) << U(8 * (DEPTH + 1 - k))
    return code, bounds


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words (A-Z lower-cased) and its end, and the rows' bounds."""
    w = Words(data, off, lower=True)
    rows = len(off) - 1
    bounds = w.first + np.arange(rows + 1)
    out = np.full(w.n + rows, END_WORD, U)
    out[np.arange(w.n) + w.row()] = w.hash
    return out, bounds


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if counts is None:
        keys = np.sort(keys)
        cut = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        at = np.flatnonzero(cut)
        return keys[at], np.diff(np.concatenate([at, [len(keys)]]))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series from x + 8 on."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    return series - np.log(product)


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with these counts."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - np.log(np.pi)


class Level:
    """The nodes of one depth for one of the eight decisions: key, estimate of a one, and weight."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, k: int):
        key = codes >> U(8 - k)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.key = key[at]
        one = ((codes >> U(7 - k)) & U(1)).astype(np.int64) * counts
        n = np.add.reduceat(counts, at).astype(float) if len(at) else np.zeros(0)
        b = np.add.reduceat(one, at).astype(float) if len(at) else np.zeros(0)
        self.own, self.p = kt(n - b, b), (b + 0.5) / (n + 1)
        self.total, self.weight = self.own, np.ones(len(at))

    def mix(self, below: np.ndarray) -> None:
        """below: the sums of the children's L."""
        self.total = np.logaddexp(self.own, below) - np.log(2)
        self.weight = np.exp(self.own - np.log(2) - self.total)

    def add_up(self, child: Level, k: int) -> None:
        """The children have one context byte more, above the k bits of the decision's prefix."""
        low = child.key & U((1 << k) - 1)
        parent = (child.key >> U(8 + k)) << U(k) | low
        self.mix(np.bincount(np.searchsorted(self.key, parent), child.total, len(self.key)))


def levels(codes: np.ndarray, counts: np.ndarray, top: int) -> list[list[Level]]:
    """[depth - top][decision] from sorted distinct grams with counts; depths top..DEPTH."""
    out = []
    for depth in range(DEPTH, top - 1, -1):
        own = [Level(codes, counts, k) for k in range(8)]
        if out:
            for k in range(8):
                own[k].add_up(out[0][k], k)
        out.insert(0, own)
        if depth > top:
            codes, counts = tally((codes >> U(16)) << U(8) | codes & U(0xFF), counts)
    return out


def cut(codes: np.ndarray, depth: int) -> np.ndarray:
    """Grams with only their last ``depth`` context bytes."""
    return (codes >> U(8 * (DEPTH - depth + 1))) << U(8) | codes & U(0xFF)


class Shallow:
    """Depths 0 and 1, from the counts of (last byte, byte) and the sums of L below depth 1."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, below_key: np.ndarray, below: np.ndarray):
        one = [Level(pairs, counts, k) for k in range(8)]
        for k in range(8):
            own = (below_key >> U(56)) == U(k)
            key = below_key[own] & U((1 << 56) - 1)
            one[k].mix(np.bincount(np.searchsorted(one[k].key, key), below[own], len(one[k].key)))
        x, n = tally(pairs & U(0xFF), counts)
        zero = [Level(x, n, k) for k in range(8)]
        for k in range(8):
            zero[k].add_up(one[k], k)
        self.levels = [zero, one]


def log10_of(codes: np.ndarray, tree: list[list[Level]]) -> np.ndarray:
    """log10 probability of each gram's byte after its contexts; tree: [depth][decision], 0..DEPTH."""
    out = np.zeros(len(codes))
    for k in range(8):
        p, found = np.full(len(codes), 0.5), np.zeros(len(codes), bool)
        for depth in range(DEPTH, -1, -1):
            own, key = tree[depth][k], cut(codes, depth) >> U(8 - k)
            if not len(own.key):
                continue
            at = np.minimum(np.searchsorted(own.key, key), len(own.key) - 1)
            here = own.key[at] == key
            mixed = np.where(found, own.weight[at] * own.p[at] + (1 - own.weight[at]) * p, own.p[at])
            p = np.where(here, mixed, p)
            found |= here
        one = ((codes >> U(7 - k)) & U(1)).astype(bool)
        out += np.log10(np.where(one, p, 1 - p))
    return out


def _bucket(kind: str, keys: np.ndarray, buckets: int) -> np.ndarray:
    if kind == "g":
        keys = (keys >> PAIR) * U(0x9E3779B97F4A7C15) >> U(20)
    return (keys % U(buckets)).astype(np.int64)


def _texts(table: pa.Table):
    """Blocks of a group's rows: part, data, offsets, in the order of the table."""
    yield from blocks(table.to_batches())


SENT = "grp bigint, kind string, bucket bigint, keys binary, counts binary"


def _send(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        rows = []
        for kind, read in (("w", tokens), ("g", grams)):
            keys, counts = [], []
            for part, data, off in _texts(table):
                code, bounds = read(data, off)
                train = np.repeat(np.asarray(part.column(part.schema.get_field_index("train"))), np.diff(bounds))
                for own, times in ((code[train], 1), (code[~train], 0)):
                    k, n = tally(own)
                    keys.append(k)
                    counts.append(n * times)
            k, n = tally(np.concatenate(keys), np.concatenate(counts))
            b = _bucket(kind, k, buckets)
            order = np.argsort(b, kind="stable")
            ends = np.searchsorted(b[order], np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(ends)):
                at = order[ends[i] : ends[i + 1]]
                rows.append({"grp": grp, "kind": kind, "bucket": int(i), "keys": k[at].tobytes(), "counts": n[at].astype(np.int64).tobytes()})
        return pa.Table.from_pylist(rows, schema=pa.schema([("grp", pa.int64()), ("kind", pa.string()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return run


def _sums(batches):
    """Rows sorted by kind and bucket -> the sums of each bucket; for grams also ("p") the counts of
    (last byte, byte) and ("l") the sums of L of depth two by decision and (last byte, prefix)."""

    def done(kind, bucket, keys, counts):
        k, n = tally(np.concatenate(keys), np.concatenate(counts))
        k, n = k[n > 0], n[n > 0]
        yield kind, bucket, k, n
        if kind == "g" and len(k):
            yield "p", bucket, *tally(cut(k, 1), n)
            at, total = [], []
            for d, level in enumerate(levels(k, n, 2)[0]):
                low = level.key & U((1 << d) - 1)
                at.append((level.key >> U(8 + d)) << U(d) | low | U(d) << U(56))
                total.append(level.total)
            at, total = np.concatenate(at), np.concatenate(total)
            order = np.argsort(at, kind="stable")
            at, total = at[order], total[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            yield "l", bucket, at[first], np.add.reduceat(total, first)

    def out(rows):
        rows = list(rows)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].tobytes() for r in rows], pa.binary()), pa.array([r[3].tobytes() for r in rows], pa.binary()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([int(r[3].sum()) if r[3].dtype.kind == "i" else 0 for r in rows], pa.int64())], names=["kind", "bucket", "keys", "counts", "n_keys", "total"])

    now, keys, counts, size = None, [], [], 0
    for b in batches:
        for kind, bucket, k, n in zip(*(b.column(x).to_pylist() for x in ("kind", "bucket", "keys", "counts"))):
            if now is not None and now != (kind, bucket):
                yield out(done(*now, keys, counts))
                keys, counts, size = [], [], 0
            now = kind, bucket
            keys.append(np.frombuffer(k, U))
            counts.append(np.frombuffer(n, np.int64))
            size += len(keys[-1])
            if size > 4_000_000:  # memory follows the distinct keys
                k, n = tally(np.concatenate(keys), np.concatenate(counts))
                keys, counts = [k], [n]
                size = len(k) if len(k) < 2_000_000 else 0
    if now is not None:
        yield out(done(*now, keys, counts))


def _answers(shallow: Shallow):
    """Rows sorted by kind, bucket and group, the sums first (group null) -> for each group's row the
    values of its keys, in their order."""

    def run(batches):
        now, table, value, tree = None, None, None, None
        for b in batches:
            grp, out = b.column("grp").to_pylist(), []
            for g, kind, bucket, k, n in zip(grp, *(b.column(x).to_pylist() for x in ("kind", "bucket", "keys", "counts"))):
                k = np.frombuffer(k, U)
                if now != (kind, bucket):
                    now, table, value, tree = (kind, bucket), np.zeros(0, U), np.zeros(0), None
                if g is None:
                    table, value = k, np.frombuffer(n, np.int64)
                    if kind == "g":
                        tree = shallow.levels + levels(table, value, 2)
                        value = log10_of(table, tree)
                    continue
                got = np.zeros(len(k))
                at = np.minimum(np.searchsorted(table, k), max(0, len(table) - 1))
                here = table[at] == k if len(table) else np.zeros(len(k), bool)
                got[here] = value[at[here]]
                if kind == "g" and not here.all():
                    got[~here] = log10_of(k[~here], tree or shallow.levels + levels(table, np.zeros(0, np.int64), 2))
                out.append((g, kind, bucket, got.astype(np.int64 if kind == "w" else np.float32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out]), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.binary())], names=["grp", "kind", "bucket", "vals"])

    return run


def _score(buckets: int, n_train: int, n_distinct: int):
    def values(kind: str, read, table: pa.Table, answers: dict) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each block, the values of its entries and the rows' bounds."""
        seen = [tally(read(data, off)[0])[0] for _, data, off in _texts(table)]
        keys, _ = tally(np.concatenate(seen))
        b = _bucket(kind, keys, buckets)
        value = np.zeros(len(keys))
        order = np.argsort(b, kind="stable")
        ends = np.searchsorted(b[order], np.arange(buckets + 1))
        for i in np.flatnonzero(np.diff(ends)):
            value[order[ends[i] : ends[i + 1]]] = answers[kind, int(i)]
        out = []
        for _, data, off in _texts(table):
            code, bounds = read(data, off)
            order = np.argsort(code)
            s = code[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            got = np.empty(len(s))
            got[order] = np.repeat(value[np.searchsorted(keys, s[first])], np.diff(np.concatenate([first, [len(s)]])))
            out.append((got, bounds))
        return out

    def run(key, docs: pa.Table, back: pa.Table) -> pa.Table:
        answers = {}
        for kind, bucket, v in zip(*(back.column(x).to_pylist() for x in ("kind", "bucket", "vals"))):
            answers[kind, bucket] = np.frombuffer(v, np.int64 if kind == "w" else np.float32)
        parts = [[], [], [], []]
        if len(docs):
            floor = np.log10(n_train + 0.5 * (n_distinct + 1))
            for c, bounds in values("w", tokens, docs, answers):
                at = bounds[:-1]  # no row is without its end
                parts[0].append(np.diff(bounds))
                parts[1].append(np.add.reduceat((c > 0).astype(np.int64), at))
                parts[2].append(np.add.reduceat(np.log10(c + 0.5) - floor, at))
            for v, bounds in values("g", grams, docs, answers):
                parts[3].append(np.add.reduceat(v, bounds[:-1]))
        whole = [np.concatenate(x) if x else np.zeros(0) for x in parts]
        kinds = pa.int64(), pa.int64(), pa.float64(), pa.float64()
        names = [x for x in docs.column_names if x not in ("grp", "train", "text")]
        cols = [docs.column(x) for x in names] + [pa.array(w, k) for w, k in zip(whole, kinds)]
        t = pa.table(cols, names=[*names, "n_tokens", "n_known", "base_score", "score"])
        return t.append_column("train_tokens", pa.array(np.full(len(t), n_train), pa.int64()))

    return run


def score(docs: DataFrame, train: Column, keep: dict[str, Column] | None = None, group_bytes: int = 6 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the columns of ``keep``, n_tokens, n_known, base_score, score, train_tokens. train: which
    documents the models learn from."""
    spark, keep = docs.sparkSession, keep or {}
    size = docs.agg(F.sum(F.octet_length(text_col)), F.count("*")).first()
    groups = max(1, (size[0] or 0) // group_bytes, size[1] // 20_000)
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups // 4))
    own = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in keep.items()), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    own = own.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(groups)))
    sent = written(own.select("grp", "train", "text").groupBy("grp").applyInArrow(_send(buckets), SENT))
    released(spark)
    sums = sent.select("kind", "bucket", "keys", "counts").repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    sums = written(sums.mapInArrow(_sums, "kind string, bucket bigint, keys binary, counts binary, n_keys bigint, total bigint"))
    released(spark)
    known = sums.where("kind = 'w'").agg(F.sum("n_keys"), F.sum("total")).first()
    # the shallow tree: at most 256 * 256 counts and 255 * 256 sums for each bucket
    small = {"p": [[], []], "l": [[], []]}
    for r in sums.where("kind in ('p', 'l')").select("kind", "keys", "counts").toLocalIterator():
        small[r["kind"]][0].append(np.frombuffer(r["keys"], U))
        small[r["kind"]][1].append(np.frombuffer(r["counts"], np.int64 if r["kind"] == "p" else np.float64))
        if len(small[r["kind"]][0]) == 64:
            k, n = tally(*map(np.concatenate, small[r["kind"]]))
            small[r["kind"]] = [[k], [n]]
    empty = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    p, low = (tally(*map(np.concatenate, small[x] if small[x][0] else empty)) for x in ("p", "l"))
    shallow = Shallow(*p, *low)
    asked = sums.where("kind in ('w', 'g')").select(F.lit(None).cast("long").alias("grp"), "kind", "bucket", "keys", "counts")
    asked = asked.unionByName(sent.withColumn("counts", F.lit(None).cast("binary")))
    asked = asked.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "grp")
    back = written(asked.mapInArrow(_answers(shallow), "grp bigint, kind string, bucket bigint, vals binary"))
    discard(sent)
    discard(sums)
    released(spark)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name not in ("grp", "train", "text"))
    scored = own.groupBy("grp").cogroup(back.groupBy("grp"))
    return scored.applyInArrow(_score(buckets, int(known[1] or 0), int(known[0] or 0)), f"{kinds}, n_tokens bigint, n_known bigint, base_score double, score double, train_tokens bigint")
