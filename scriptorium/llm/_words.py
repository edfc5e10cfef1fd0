"""Vectorised words, shingles and hashes over whole Arrow string columns.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``; in UTF-8 these bytes
never occur inside another character, so words of bytes and words of characters are the same. All
functions work on blocks of rows of bounded bytes (a single longer text is a block of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of a lane's first 0 to 8 bytes.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
BLOCK_BYTES = 3 << 19
#: Of a block; so a row's number and 52 bits of a hash fit into one sort key.
BLOCK_ROWS = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def blocks(batches, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their text bytes and row offsets (rows + 1); a null text is empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if pa.types.is_large_string(col.type):
            kind = np.int64
        else:
            col, kind = col.cast(pa.string()), np.int32
        if not len(col):
            continue
        _, offs, data = col.buffers()
        off = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        nulls = np.asarray(col.is_null())
        if nulls.any() and (np.diff(off)[nulls] > 0).any():
            col = pa.array([None if v is None else v for v in col.to_pylist()], pa.large_string())
            off = np.frombuffer(col.buffers()[1], np.int64)[: len(col) + 1].copy()
            raw = np.frombuffer(col.buffers()[2], np.uint8)
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            j = min(j, len(col), i + BLOCK_ROWS)
            yield batch.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


class Words:
    """The words of a block: ``start`` and ``end`` in bytes, ``hash``, and ``first`` word of each row (rows + 1)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, hashed: bool = True):
        n = len(data)
        self.data, self.off = data, off
        word = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True  # a row's first byte starts a word if it is of one
        before = np.concatenate([[False], word[:-1]]) if n else word
        after = np.concatenate([word[1:], [False]]) if n else word
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.n = len(self.start)
        if hashed:
            self.hash = self.spans(self.start, self.end, lower)

    def _lanes(self, lower: bool) -> np.ndarray:
        """The eight bytes from each place on as one number."""
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = _LOWER[self.data] if lower else self.data
        return np.ndarray(len(self.data) + 1, "<u8", padded, 0, (1,))

    def spans(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of the byte spans: the sum of their lanes of eight bytes, each mixed with its
        place, and of their length. No span's hash follows from another's by arithmetic."""
        lanes, size = self._lanes(lower), end - start
        left = np.minimum(size, 8)
        h = mix(lanes[start] & _LANE[left]) + size.astype(U) * U(0xD6E8FEB86659FD93)
        long = np.flatnonzero(size > 8)
        if len(long):
            n = (size[long] - 1) // 8  # lanes after the first
            first = np.cumsum(n) - n
            k = np.arange(n.sum()) - np.repeat(first, n) + 1
            rest = np.minimum(np.repeat(size[long], n) - 8 * k, 8)
            more = mix((lanes[np.repeat(start[long], n) + 8 * k] & _LANE[rest]) ^ mix(k.astype(U) * U(0x9E3779B97F4A7C15)))
            h[long] += np.add.reduceat(more, first)
        return mix(h)

    def codes(self, lower: bool = False) -> tuple[np.ndarray, list[bytes]]:
        """A number for each word, equal for equal words only, and the words by number: classes of
        equal hashes, each member compared with the first one byte for byte."""
        if not self.n:
            return np.zeros(0, np.int64), []
        _, at, code = np.unique(self.hash, return_index=True, return_inverse=True)
        lanes, size = self._lanes(lower), self.end - self.start
        head = at[code]
        same = bool((size == size[head]).all())
        todo, k = np.arange(self.n), 0
        while same and len(todo):
            mask = _LANE[np.minimum(size[todo] - 8 * k, 8)]
            same = bool(((lanes[self.start[todo] + 8 * k] & mask) == (lanes[self.start[head[todo]] + 8 * k] & mask)).all())
            k += 1
            todo = todo[size[todo] > 8 * k]
        raw = (_LOWER[self.data] if lower else self.data).tobytes()
        if same:
            return code, [raw[a:b] for a, b in zip(self.start[at], self.end[at])]
        known: dict[bytes, int] = {}
        code = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(self.start, self.end)], np.int64)
        return code, list(known)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))

    def shingles(self, n: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, first words and rows of all runs of n words of one row. whole_if_short: a row of
        1 to n - 1 words gives all its words as one run."""
        row = self.row()
        at = np.arange(max(0, self.n - n + 1))
        at = at[row[at] == row[at + n - 1]]
        h = run_hash(self.hash, at, n)
        if whole_if_short:
            count = np.diff(self.first)
            for k in range(1, n):
                own = self.first[:-1][count == k]
                if len(own):
                    at = np.concatenate([at, own])
                    h = np.concatenate([h, run_hash(self.hash, own, k)])
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order]
        return h, at, row[at]


_model: list = [None, None]


def cached(key, build):
    """build(), kept in this process until another model is asked for: a worker that goes from stage to
    stage holds one model at a time."""
    if _model[0] != key:
        _model[:] = None, None
        _model[:] = key, build()
    return _model[1]


def run_hash(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words from each place."""
    h = np.full(len(at), n, U) * U(0xA0761D6478BD642F)
    for k in range(n):
        h ^= words[at + k]
        h *= U(0xE7037ED1A0B428DB)
        h ^= h >> U(32)
    return mix(h)


def exact_runs(code: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n successive codes, equal for equal runs only; codes under 2^31."""
    out = code[: len(code) - n + 1].astype(np.int64)
    for k in range(1, n):
        if len(out) and int(out.max()) >= 1 << 31:
            out = np.unique(out, return_inverse=True)[1]
        out = out << 31 | code[k : len(code) - n + 1 + k]
    return out


def exact_sets(data: np.ndarray, off: np.ndarray, n: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of n words of each row (all words, in a row of fewer) as (row, number) pairs in
    order: equal numbers are equal words."""
    w = Words(data, off, lower)
    if not w.n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, _ = w.codes(lower)
    row, count, ids, rows, used = w.row(), np.diff(w.first), [], [], 0
    for k in range(1, n + 1):
        if k < n:
            at = w.first[:-1][count == k]
        else:
            at = np.arange(max(0, w.n - n + 1))
            at = at[row[at] == row[at + n - 1]]
        if len(at):
            known, own = np.unique(exact_runs(code, k)[at], return_inverse=True)
            ids.append(own + used)
            rows.append(row[at])
            used += len(known)
    key = np.unique(np.concatenate(rows) << 40 | np.concatenate(ids))
    return key >> 40, key & ((1 << 40) - 1)


def row_sets(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 52-bit hashes of each row, one row after the other, and their bounds (rows + 1)."""
    key = np.sort((row.astype(U) << U(52)) | (h >> U(12)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    bounds = np.searchsorted(key, np.arange(rows + 1, dtype=U) << U(52)) if rows < 4096 else np.concatenate([np.searchsorted(key, np.arange(rows, dtype=U) << U(52)), [len(key)]])
    return key & U((1 << 52) - 1), bounds


def as_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()
