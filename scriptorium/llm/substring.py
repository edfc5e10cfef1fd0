"""Substring deduplication with a compressed FM-index per shard.

A passage of ``window`` words that two documents share also shares each of its ``GRAM``-word grams,
and so the gram with the smallest hash: its anchor. Successive windows with one anchor make up a
segment. Documents are dealt into groups of about ``group_bytes``; what groups send and get is packed,
one row for each group and bucket, and summed up inside the group first. Steps:

1. Each group sends its distinct anchors with their smallest and largest document id. Buckets of
   anchors answer which of them occur in two documents; no other segment can hold a shared window.
2. Each group cuts out its segments with such anchors and sends each distinct one once, with its
   smallest and largest document id, to the shard of its anchor: all occurrences of a window meet in
   one shard, and a passage in very many documents is there once a group.
3. Each shard builds an FM-index of its distinct segments: suffix order, Burrows-Wheeler transform,
   wavelet matrix with rank counts. Segments are streamed against it: backward search, all windows of
   a block at once, gives each window's interval; a window whose interval shrinks to one row occurs
   nowhere else and is dropped on the way. The matching length is known up to the threshold,
   ``window``. The smallest document id in an interval is the first document that holds that window.
4. Each group gets the first documents of its segments' windows, and removes the windows whose first
   document is smaller than their own.

Windows are compared by their words: a shard numbers its distinct words. Anchors are 64-bit hashes and
only choose the shard; copies of a segment are recognised by 128 bits. An anchor with very many
different segments makes its shard larger, but never by copies of a segment within a group.

Edge cases: a null or empty text has no words; a text of fewer words than a window is kept; windows
repeated only inside one document are kept; a row with a null id is kept whole and is never an
earlier document; rows that repeat an id are one document; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import discard, released, written
from ._words import BLOCK_BYTES, U, Words, blocks, mix, run_hash

GRAM = 4


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n successive values."""
    k, m = 1, x
    while 2 * k <= n:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[: len(x) - n + 1], m[n - k :]) if n > k else m


def segments(data: np.ndarray, off: np.ndarray, window: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's words; of each segment its anchor, row, first window's first word (in the block)
    and number of windows."""
    w = Words(data, off)
    none = np.zeros(0, np.int64)
    if w.n < window:
        return w, np.zeros(0, U), none, none, none
    row = w.row()
    grams = run_hash(w.hash, np.arange(w.n - GRAM + 1), GRAM)
    anchor = _least(grams, window - GRAM + 1)
    at = np.flatnonzero(row[: w.n - window + 1] == row[window - 1 :])
    if not len(at):
        return w, np.zeros(0, U), none, none, none
    anchor, row = anchor[at], row[at]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    return w, anchor[first], row[first], at[first], np.diff(np.concatenate([first, [len(at)]]))


def segment_keys(w: Words, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of words: the sums of its words, each mixed with its place."""
    out = np.zeros((2, len(begin)), U)
    ends, i = np.concatenate([[0], np.cumsum(size)]), 0
    while i < len(begin):  # in blocks: runs overlap
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + (1 << 20), "right")) - 1)
        first = ends[i:j] - ends[i]
        place = np.arange(ends[j] - ends[i]) - np.repeat(first, size[i:j])
        own = mix(w.hash[np.repeat(begin[i:j], size[i:j]) + place] ^ mix(place.astype(U) * U(0x9E3779B97F4A7C15)))
        for k, salt in enumerate((U(0x2545F4914F6CDD1D), U(0xD1342543DE82EF95))):
            out[k, i:j] = mix(np.add.reduceat(mix(own ^ salt), first) + size[i:j].astype(U) * salt)
        i = j
    return out[0], out[1]


class WaveletMatrix:
    """Rank of any symbol in a sequence of whole numbers, by one bit vector with rank counts a level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels, self.top = len(symbols), [], max(1, int(sigma - 1).bit_length())
        s = symbols
        for k in range(self.top - 1, -1, -1):
            bit = (s >> k) & 1
            full = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
            full[: self.n] = bit
            words = np.packbits(full, bitorder="little").view(U)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int32)
            zeros = int(self.n - ones[-1])
            self.levels.append((k, words, ones, zeros))
            one = bit.astype(bool)
            s = np.concatenate([s[~one], s[one]])

    def rank(self, symbol: np.ndarray, places: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        """For each of the places, how many of symbol[i] are before place[i]."""
        base = np.zeros(len(symbol), np.int32)
        places = [p.astype(np.int32) for p in places]
        for k, words, ones, zeros in self.levels:
            one = ((symbol >> k) & 1).astype(bool)

            def count(p):
                block = p >> 6
                below = words[block] & ((U(1) << (p & 63).astype(U)) - U(1))
                got = ones[block] + np.bitwise_count(below).astype(np.int32)
                return np.where(one, zeros + got, p - got)

            base = count(base)
            places = [count(p) for p in places]
        return [p - base for p in places]


class FMIndex:
    """Of a text of whole numbers from 0 (0 ends a segment), for patterns of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        n = len(text)
        rank, k = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while k < depth:  # prefix doubling, as far as the patterns reach
            after = np.zeros(n, np.int64)
            after[: n - k] = rank[k:] + 1
            key = (rank.astype(U) << U(32)) | after.astype(U)
            order = np.argsort(key)
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]).astype(np.int64)]))
            k *= 2
        self.order = order
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)

    def search(self, text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of text[at : at + length] for each place: the places whose pattern occurs
        twice or more, and their intervals."""
        c = text[at + length - 1]
        lo, hi = self.before[c], self.before[c + 1]
        for k in range(length - 2, -1, -1):
            more = hi - lo > 1
            at, lo, hi = at[more], lo[more], hi[more]
            if not len(at):
                break
            c = text[at + k]
            a, b = self.bwt.rank(c, (lo, hi))
            lo, hi = self.before[c] + a, self.before[c] + b
        more = hi - lo > 1
        return at[more], lo[more], hi[more]


def first_documents(words: np.ndarray, bounds: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """words: codes of the segments' words, one segment after the other; owner: of each segment, its
    smallest document. For each window of each segment, in order, the smallest document that has it."""
    sizes = np.diff(bounds)
    known, code = np.unique(words, return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    inside = np.ones(begin[-1], bool)
    inside[begin[1:] - 1] = False
    text = np.zeros(begin[-1], np.int64)
    text[inside] = code + 1
    index = FMIndex(text, len(known) + 1, window)
    first = np.repeat(owner, sizes + 1)[index.order]
    n = np.maximum(0, sizes - window + 1)
    at = np.repeat(begin[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    least = np.repeat(owner, n)
    for i in range(0, len(at), 1 << 16):  # streamed in blocks
        got, lo, hi = index.search(text, at[i : i + (1 << 16)], window)
        if len(got):
            pair, back = np.unique(lo << 32 | hi, return_inverse=True)
            lo, hi = pair >> 32, pair & 0xFFFFFFFF
            low = np.minimum.reduceat(np.append(first, np.iinfo(np.int64).max), np.stack([lo, hi], 1).ravel())[::2]
            place = np.searchsorted(at[i : i + (1 << 16)], got) + i
            least[place] = low[back]
    return least


def _send_anchors(window: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        anchors, docs = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for part, data, off in blocks(table.select(["doc_id", "text"]).to_batches()):
            _, anchor, row, _, _ = segments(data, off, window)
            anchors.append(anchor)
            docs.append(np.asarray(part.column(0))[row])
        anchor, doc = np.concatenate(anchors), np.concatenate(docs)
        order = np.lexsort((anchor, anchor % U(buckets)))
        anchor, doc = anchor[order], doc[order]
        rows = []
        if len(anchor):
            at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            lo, hi, anchor = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at), anchor[at]
            ends = np.searchsorted(anchor % U(buckets), np.arange(buckets + 1, dtype=U))
            for b in np.flatnonzero(np.diff(ends)):
                own = slice(ends[b], ends[b + 1])
                rows.append({"grp": table.column("grp")[0].as_py(), "bucket": int(b), "anchors": anchor[own].tobytes(), "lo": lo[own].tobytes(), "hi": hi[own].tobytes()})
        return pa.Table.from_pylist(rows, schema=pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("anchors", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary())]))

    return run


def _by_key(batches, key: str):
    """Of rows sorted by the key: all of one key at a time, as a dict of lists."""
    now, rows = None, {}
    for b in batches:
        cols = {n: b.column(n).to_pylist() for n in b.schema.names}
        for i, k in enumerate(cols[key]):
            if rows and k != now:
                yield rows
                rows = {}
            now = k
            for n, c in cols.items():
                rows.setdefault(n, []).append(c[i])
    if rows:
        yield rows


def _many(raw: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind)


def _shared_anchors(batches):
    for rows in _by_key(batches, "bucket"):
        anchor, lo, hi = _many(rows["anchors"], U), _many(rows["lo"], np.int64), _many(rows["hi"], np.int64)
        known, code = np.unique(anchor, return_inverse=True)
        low, high = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
        np.minimum.at(low, code, lo)
        np.maximum.at(high, code, hi)
        good = (low < high)[code]
        at, grps, out = 0, [], []
        for grp, raw in zip(rows["grp"], rows["anchors"]):
            n = len(raw) // 8
            own = anchor[at : at + n][good[at : at + n]]
            at += n
            if len(own):
                grps.append(grp)
                out.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(grps, pa.int64()), pa.array(out, pa.binary())], names=["grp", "anchors"])


def _send_segments(window: int, shards: int):
    names = ["shard", "grp", "k1", "k2", "lo", "hi", "sizes", "words"]
    schema = pa.schema([("shard", pa.int64()), ("grp", pa.int64()), *((n, pa.binary()) for n in names[2:])])

    def run(key, docs: pa.Table, back: pa.Table) -> pa.Table:
        shared = np.sort(_many(back.column("anchors").to_pylist(), U))
        rows = []
        if not len(docs) or not len(shared):
            return pa.Table.from_pylist(rows, schema=schema)
        parts = [[] for _ in range(5)]
        texts = []
        for part, data, off in blocks(docs.select(["doc_id", "text"]).to_batches()):
            w, anchor, row, at, n = segments(data, off, window)
            found = np.searchsorted(shared, anchor)
            good = np.flatnonzero(shared[np.minimum(found, len(shared) - 1)] == anchor)
            if not len(good):
                continue
            anchor, at, size = anchor[good], at[good], n[good] + window - 1
            k1, k2 = segment_keys(w, at, size)
            doc = np.asarray(part.column(0))[row[good]]
            # of equal segments of the block, the text once
            order = np.lexsort((doc, k2, k1))
            new = np.concatenate([[True], (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])])
            at_new = np.flatnonzero(new)
            top = order[at_new]
            for x, v in zip(parts, (k1[top], k2[top], anchor[top], np.minimum.reduceat(doc[order], at_new), np.maximum.reduceat(doc[order], at_new))):
                x.append(v)
            begin, end = w.start[at[top]], w.end[at[top] + size[top] - 1]
            raw = data.tobytes()
            texts += [raw[b:e] for b, e in zip(begin, end)]
        if not texts:
            return pa.Table.from_pylist(rows, schema=schema)
        k1, k2, anchor, lo, hi = map(np.concatenate, parts)
        shard = (mix(anchor) % U(shards)).astype(np.int64)
        order = np.lexsort((k2, k1, shard))
        new = np.concatenate([[True], (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])])
        first = np.flatnonzero(new)
        top = order[first]
        lo, hi = np.minimum.reduceat(lo[order], first), np.maximum.reduceat(hi[order], first)
        k1, k2, shard = k1[top], k2[top], shard[top]
        ends = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        for a, b in zip(ends[:-1], ends[1:]):
            own = [texts[i] for i in top[a:b]]
            rows.append({"shard": int(shard[a]), "grp": key[0].as_py(), "k1": k1[a:b].tobytes(), "k2": k2[a:b].tobytes(), "lo": lo[a:b].tobytes(), "hi": hi[a:b].tobytes(), "sizes": np.array([len(x) for x in own], np.int32).tobytes(), "words": b"".join(own)})
        return pa.Table.from_pylist(rows, schema=schema)

    return run


def _answer(window: int):
    """Shards of segments -> for each group, the windows' first documents of its segments that may lose
    any."""

    def run(batches):
        for rows in _by_key(batches, "shard"):
            k1, k2 = _many(rows["k1"], U), _many(rows["k2"], U)
            lo, hi = _many(rows["lo"], np.int64), _many(rows["hi"], np.int64)
            sizes = _many(rows["sizes"], np.int32).astype(np.int64)
            data = _many(rows["words"], np.uint8)
            rows["words"] = None
            order = np.lexsort((k2, k1))
            new = np.concatenate([[True], (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])])
            first = np.flatnonzero(new)
            code = np.empty(len(k1), np.int64)
            code[order] = np.cumsum(new) - 1
            owner, top = np.minimum.reduceat(lo[order], first), order[first]
            # the words of the distinct segments, coded in blocks: equal codes are equal words
            known: dict[bytes, int] = {}
            off = np.concatenate([[0], np.cumsum(sizes)])
            n = sizes[top]
            ends, codes, bounds, i = np.concatenate([[0], np.cumsum(n)]), [], [np.zeros(1, np.int64)], 0
            while i < len(top):
                j = min(len(top), max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK_BYTES, "right")) - 1))
                own = n[i:j]
                take = np.repeat(off[top[i:j]], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
                w = Words(data[take], ends[i : j + 1] - ends[i])
                code_of, distinct = w.codes()
                own_codes = np.array([known.setdefault(x, len(known)) for x in distinct], np.int64)
                codes.append(own_codes[code_of])
                bounds.append(w.first[1:] + bounds[-1][-1])
                i = j
            del data, take, w, known, distinct
            codes, bounds = np.concatenate(codes), np.concatenate(bounds)
            least = first_documents(codes, bounds, owner, window)
            count = np.maximum(0, np.diff(bounds) - window + 1)
            begin = np.concatenate([[0], np.cumsum(count)])
            smallest = np.minimum.reduceat(least, begin[:-1])  # every segment has a window
            wanted = (hi > lo) | (smallest[code] < lo)
            at, out = 0, [[], [], [], [], []]
            for grp, raw in zip(rows["grp"], rows["k1"]):
                i = at + np.flatnonzero(wanted[at : at + len(raw) // 8])
                at += len(raw) // 8
                if len(i):
                    n = count[code[i]]
                    take = np.repeat(begin[code[i]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    for x, v in zip(out, (grp, k1[i].tobytes(), k2[i].tobytes(), n.astype(np.int32).tobytes(), least[take].tobytes())):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["grp", "k1", "k2", "n", "least"])

    return run


def _remove(window: int, keep: str, names: list[str]):
    def run(key, docs: pa.Table, back: pa.Table) -> pa.Table:
        k1, k2 = _many(back.column("k1").to_pylist(), U), _many(back.column("k2").to_pylist(), U)
        count = _many(back.column("n").to_pylist(), np.int32).astype(np.int64)
        least = _many(back.column("least").to_pylist(), np.int64)
        begin = np.cumsum(count) - count
        order = np.lexsort((k2, k1))
        k1, k2, begin = k1[order], k2[order], begin[order]
        n_words, n_removed, out = [], [], []
        docs = docs.select(names)
        for part, data, off in blocks(docs.to_batches()):
            w, anchor, row, at, n = segments(data, off, window)
            cover = np.zeros(w.n, bool)
            if len(k1) and len(at):
                a, b = segment_keys(w, at, n + window - 1)
                i = np.searchsorted(k1, a)
                i[i == len(k1)] = 0
                doc = part.column(0)
                known = ~np.asarray(doc.is_null())[row]
                good = np.flatnonzero((k1[i] == a) & (k2[i] == b) & known)
                i, at, n, row = i[good], at[good], n[good], row[good]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first = least[np.repeat(begin[i], n) + step]
                gone = (np.repeat(at, n) + step)[first < np.repeat(np.asarray(doc.fill_null(0))[row], n)]
                edge = np.zeros(w.n + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + window, -1)
                cover = np.cumsum(edge[:-1]) > 0
            lost = np.diff(np.concatenate([[0], np.cumsum(cover)])[w.first])
            n_words.append(np.diff(w.first))
            n_removed.append(lost)
            raw = data.tobytes()
            for r in range(len(part)):
                text = raw[off[r] : off[r + 1]]
                if keep == "text":
                    if lost[r]:
                        a, b = w.first[r], w.first[r + 1]
                        good = np.ones(len(text), bool)
                        stop = np.append(w.start[a + 1 : b], off[r + 1]) - off[r]
                        for x, y in zip(w.start[a:b][cover[a:b]] - off[r], stop[cover[a:b]]):
                            good[x:y] = False
                        text = np.frombuffer(text, np.uint8)[good].tobytes()
                    out.append(text.decode())
                else:
                    words = text.split()
                    out.append(hashlib.sha256(b" ".join(compress(words, ~cover[w.first[r] : w.first[r + 1]]) if lost[r] else words)).hexdigest())
        none = np.zeros(0, np.int64)
        cols = [docs.column(0), pa.array(np.concatenate([none, *n_words]), pa.int64()), pa.array(np.concatenate([none, *n_removed]), pa.int64()), pa.array(out, pa.string()), *docs.columns[2:]]
        return pa.table(cols, names=["doc_id", "n_words", "n_removed", "out", *names[2:]])

    return run


def remove(docs: DataFrame, window: int = 13, keep: str = "digest", carry: tuple[str, ...] = (), group_bytes: int = 6 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by spaces), or ``text``
    with keep="text": the document without the removed words, all else as it was. ``carry``: other
    columns of the input, which come as _c0, _c1 and so on."""
    spark = docs.sparkSession
    more = [f"_c{k}" for k in range(len(carry))]
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, more)))
    size = whole.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    groups = max(1, (size[0] or 0) // group_bytes, size[1] // 20_000)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups)
    whole = whole.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(groups)))
    own = whole.where("doc_id is not null").select("grp", "doc_id", "text")
    sent = written(own.groupBy("grp").applyInArrow(_send_anchors(window, parts), "grp bigint, bucket bigint, anchors binary, lo binary, hi binary"))
    released(spark)
    shared = written(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared_anchors, "grp bigint, anchors binary"))
    discard(sent)
    released(spark)
    binary = "k1 binary, k2 binary, lo binary, hi binary, sizes binary, words binary"
    cut = written(own.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(_send_segments(window, parts), f"shard bigint, grp bigint, {binary}"))
    discard(shared)
    released(spark)
    first = written(cut.repartition("shard").sortWithinPartitions("shard").mapInArrow(_answer(window), "grp bigint, k1 binary, k2 binary, n binary, least binary"))
    discard(cut)
    released(spark)
    kinds = "".join(f", {n} {whole.schema[n].dataType.simpleString()}" for n in more)
    name = "text" if keep == "text" else "kept_sha256"
    out = whole.groupBy("grp").cogroup(first.groupBy("grp")).applyInArrow(_remove(window, keep, ["doc_id", "text", *more]), "doc_id bigint, n_words bigint, n_removed bigint, out string" + kinds)
    return out.withColumnRenamed("out", name)
