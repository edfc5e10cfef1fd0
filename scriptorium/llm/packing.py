"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Sizes are whole numbers up to the capacity, so the instance is its histogram: at most ``capacity``
counts, whatever the corpus. The driver plans on that histogram only. Dominance: for the largest
free size j, a set of j and at most two others is fixed in as many copies as there are when no set
with j can do better -- j alone when nothing fits with it; j and an exact complement; j and the
largest that fits when no two fit; j and two others when no three fit and every feasible pair is
dominated. What remains is packed best-fit decreasing, all bins of one residual at once. The plan, a
list of patterns with multiplicities, is then dealt to the pieces by their rank in their size; ranks
come from counts by (size, hash bucket), so a size that a third of all pieces share is spread.

Edge cases: a null or empty text is the end id alone; repeated rows and ids are packed each; a null
id stays null; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import bisect
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import written
from ._words import blocks, cached



class Encoder:
    """Ids of a byte-level BPE vocabulary in the JSON format of ``tokenizers``; a text's special strings
    are special tokens there and here. The merges run in tiktoken's engine, which gives the same ids
    faster (tests compare them); a text that engine refuses, and all texts of a vocabulary whose special
    tokens take white space or words around them along, go through ``tokenizers``."""

    #: Fixed value: the byte-level pre-tokenizer's pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.path, self.slow, self.special = path, None, set(special)
        greedy = any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
        self.fast = None if greedy else tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> list[int]:
        if self.fast:
            try:
                return self.fast.encode(text, allowed_special=self.special, disallowed_special=())
            except BaseException as e:  # the engine's panics aren't Exceptions
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids


def encoder(path: str) -> Encoder:
    return cached(("bpe", path), lambda: Encoder(path))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, with keep_ids) of each piece. A document of
    more than ``capacity`` ids is cut; its first piece is the shorter one."""
    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches):
        encode = encoder(tokenizer)
        for part, data, off in blocks(batches, most=1 << 20):
            raw = data.tobytes()
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for r in range(len(part)):
                own = np.array([*encode(raw[off[r] : off[r + 1]].decode()), end_id], "<u4")
                a, k = 0, 0
                while a < len(own):
                    b = a + ((len(own) - a) % capacity or capacity)
                    chunk = own[a:b].tobytes()
                    rows.append(r)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(chunk))
                    if keep_ids:
                        ids.append(own[a:b].astype(np.int32))
                    a, k = b, k + 1
            out = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids, names=names)

    kind = cols.schema["doc_id"].dataType.simpleString()
    return cols.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)


def reduce_by_dominance(count: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixed (sizes, copies) and the counts that remain."""
    left = {s: n for s, n in count.items() if n > 0}
    sizes = sorted(left)
    fixed = []

    def largest(most: int, used: tuple[int, ...]) -> int:
        """The largest free size up to ``most``, beside those used; 0: none."""
        i = bisect.bisect_right(sizes, most) - 1
        while i >= 0 and left[sizes[i]] <= used.count(sizes[i]):
            i -= 1
        return sizes[i] if i >= 0 else 0

    def smallest(k: int, used: tuple[int, ...]) -> int:
        """The sum of the k smallest free items beside those used; very large if there are fewer."""
        total = 0
        for s in sizes:
            n = min(k, left[s] - used.count(s))
            total, k = total + n * s, k - n
            if not k:
                return total
        return 1 << 62

    def fix(*own: int) -> None:
        m = min(left[s] // own.count(s) for s in set(own))
        fixed.append((tuple(sorted(own, reverse=True)), m))
        for s in own:
            left[s] -= m
        for s in set(own):
            if not left[s]:
                del left[s]
                sizes.remove(s)

    for j in sorted(left, reverse=True):
        while left.get(j):
            room = capacity - j
            a = largest(room, (j,))
            if not a:
                fix(j)
            elif a == room or smallest(2, (j,)) > room:
                fix(j, a)
            elif smallest(3, (j,)) > room and (b := largest(room - a, (j, a))):
                # the largest smaller one of any feasible pair
                y = largest(room // 2, (j,))
                while y and not any(left[x] > (j, y).count(x) for x in sizes[bisect.bisect_left(sizes, y) : bisect.bisect_right(sizes, room - y)]):
                    y = largest(y - 1, (j,))
                if b < y:
                    break
                fix(j, a, b)
            else:
                break
    return fixed, left


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing; bins with the same contents are handled together."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(own: tuple[int, ...], m: int) -> None:
        if m:
            room = capacity - sum(own)
            if room not in by_room:
                by_room[room] = []
                bisect.insort(rooms, room)
            by_room[room].append((own, m))

    for s in sorted(count, reverse=True):
        n = count[s]
        while n:
            i = bisect.bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                own, m = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[i]
            else:
                own, m = (), n  # as many new bins as could be needed
            each = (capacity - sum(own)) // s
            full = min(m, n // each)
            put(own + (s,) * each, full)
            n -= full * each
            if full < m and n:
                put(own + (s,) * n, 1)
                n, full = 0, full + 1
            if own:
                put(own, m - full)
    return [x for room in rooms for x in by_room[room]]


def plan(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (sizes, largest first) and their numbers of sequences."""
    fixed, left = reduce_by_dominance(count, capacity)
    return fixed + best_fit(left, capacity)


def pack(parts: DataFrame, capacity: int = 1024) -> DataFrame:
    """parts with ``length`` -> the same rows with sequence_id and offset (gapless from 0)."""
    spark = parts.sparkSession
    count = {int(r[0]): int(r[1]) for r in parts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if any(not 0 < s <= capacity for s in count):
        raise ValueError("a length isn't from 1 to the capacity")
    uses: dict[int, list[tuple[int, int, int, int]]] = {}  # size: (first rank, first sequence, copies in each, offset of the first)
    used: dict[int, int] = {}
    sequence = 0
    for own, m in plan(count, capacity):
        at = 0
        for s in dict.fromkeys(own):
            c = own.count(s)
            uses.setdefault(s, []).append((used.get(s, 0), sequence, c, at))
            used[s] = used.get(s, 0) + c * m
            at += c * s
        sequence += m
    table = {s: np.array(x, np.int64).T for s, x in uses.items()}
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(count.values()) // 500_000)
    names = parts.columns
    dealt = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = dealt.groupBy("length", "_bucket").count()
    before = before.select("length", "_bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_before"))
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["length", "_bucket"]).select(*names, (F.col("_rank") + F.col("_before")).alias("_rank"))

    def run(batches):
        for b in batches:
            length = np.asarray(b.column(names.index("length")))
            rank = np.asarray(b.column(len(names)))
            seq, off = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            for s in np.unique(length):
                own = length == s
                first, base, copies, at = table[int(s)]
                k = np.searchsorted(first, rank[own], "right") - 1
                d = rank[own] - first[k]
                seq[own] = base[k] + d // copies[k]
                off[own] = at[k] + d % copies[k] * s
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32 (ids), sequence_id, offset."""
    return pack(written(pieces(docs, tokenizer, capacity, end_id, keep_ids, id_col, text_col)), capacity)
