"""Language identification by cross-parsing entropy.

For each language the substrings of a sample of labelled text are indexed by a suffix automaton. A
text is parsed greedily into the longest phrases that occur in that sample; the fewer phrases, the
closer the language. The count is normalised to bits: a phrase costs log2 of the sample's length.

Texts are read as bytes in lower case (ASCII and Latin-1 letters), each run of bytes other than
letters and bytes from 128 as one space, and cut at spaces into stretches of about ``STRETCH`` bytes,
none left out; a phrase does not cross a cut. All stretches of a block and all languages step
through one transition table together.

The fit is on a bounded sample: up to ``rows`` labelled rows a language, ``row_chars`` characters of
each, ``sample_bytes`` bytes in all, for the ``most_languages`` most frequent labels.

Edge cases: a null text or one without a letter is ``und`` with score 0; equal counts go to the label
that sorts first, with score 0; without labelled rows all is ``und``; an only language has score 1;
repeated rows and ids are predicted each; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._words import blocks, cached

STRETCH = 512
_CLASS = np.zeros(256, np.uint8)  # 0: a space
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)
CLASSES = 155


def normalise(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the bytes, runs of spaces as one, and the rows' new offsets."""
    c = _CLASS[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    c[upper] += 32
    keep = c > 0
    keep[1:] |= c[:-1] > 0
    keep[off[1:-1][off[1:-1] < len(c)]] = True  # a row's first byte
    return c[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the start."""
    step, link, size = [{}], [-1], [0]
    last = 0
    for c in text:
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Model:
    """The automata of all languages in one table."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        used = sorted({0} | {c for x in samples.values() for c in x})
        self.code = np.full(256, len(used), np.int32)  # the last code is of bytes no sample has
        self.code[used] = np.arange(len(used))
        self.width = len(used) + 1
        tables, self.roots, at = [], [], 0
        for name in self.names:
            step = automaton(samples[name])
            t = np.zeros((len(step), self.width), np.int32)
            for s, out in enumerate(step):
                for c, to in out.items():
                    t[s, self.code[c]] = (at + to) * self.width
            tables.append(t.ravel())
            self.roots.append(at * self.width)
            at += len(step)
        self.table = np.concatenate(tables)
        self.roots = np.array(self.roots, np.int32)
        self.bits = np.array([np.log2(max(2, len(samples[n]))) for n in self.names])

    def phrases(self, classes: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(languages, rows): the phrases of each row."""
        rows, n_lang = len(off) - 1, len(self.names)
        text = self.code[classes]
        # cut at the first space from every STRETCH bytes on
        space = np.flatnonzero(classes == 0)
        n = np.maximum(1, -(-np.diff(off) // STRETCH))
        row = np.repeat(np.arange(rows), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begin = off[row] + k * STRETCH
        if len(space):
            i = np.searchsorted(space, begin)
            moved = np.where(i < len(space), space[np.minimum(i, len(space) - 1)], len(classes))
            begin = np.where(k > 0, np.minimum(moved, off[row + 1]), begin)
        else:
            begin = np.where(k > 0, off[row + 1], begin)
        end = np.where(np.concatenate([row[1:] == row[:-1], [False]]), np.concatenate([begin[1:], [0]]), off[row + 1])
        size = end - begin
        order = np.argsort(-size, kind="stable")
        begin, size, row = begin[order], size[order], row[order]
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        roots = self.roots[:, None]
        state = np.repeat(roots, len(begin), 1)
        count = np.zeros((n_lang, len(begin)), np.int32)
        for t, m in enumerate(active):
            c = text[begin[:m] + t]
            own = state[:, :m]
            to = self.table[own + c]
            fail = to == 0
            if fail.any():
                again = self.table[roots + c]
                count[:, :m] += fail & (own != roots)
                to = np.where(fail, again, to)
                lost = to == 0
                count[:, :m] += lost
                to = np.where(lost, roots, to)
            state[:, :m] = to
        count += state != roots
        return np.array([np.bincount(row, count[i], rows) for i in range(n_lang)])


def model_of(samples: dict[str, bytes]) -> Model:
    return cached(("language", tuple(sorted(samples.items()))), lambda: Model(samples))


def fit(labelled: DataFrame, rows: int = 256, row_chars: int = 4000, sample_bytes: int = 24_000, most_languages: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A sample of normalised text of each label. Rows are chosen by a hash of their id at a rate that
    follows the label's number of rows; their order is that of the hash."""
    good = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    counts = {r["l"]: r["count"] for r in good.groupBy("l").count().orderBy(F.desc("count"), "l").limit(most_languages).collect()}
    if not counts:
        return {}
    h = F.pmod(F.xxhash64("i", F.lit(9)), F.lit(1 << 40))
    rate = F.create_map(*(x for k, v in counts.items() for x in (F.lit(k), F.lit(int((1 << 40) * min(1.0, rows / v))))))
    some = good.withColumn("h", h).where(F.col("h") < rate[F.col("l")]).select("l", "h", F.left("t", F.lit(row_chars)).alias("t"))
    found: dict[str, list] = {}
    for r in some.toLocalIterator():
        own = found.setdefault(r["l"], [])
        own.append((r["h"], r["t"]))
    out = {}
    for lang, own in found.items():
        own.sort()
        raw = np.frombuffer(" ".join(t for _, t in own).encode(), np.uint8)
        classes, _ = normalise(raw, np.array([0, len(raw)]))
        out[lang] = classes[:sample_bytes].tobytes()
    return {k: v for k, v in out.items() if any(v)}


def predict(docs: DataFrame, samples: dict[str, bytes], keep: dict[str, Column] | None = None, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the columns of ``keep`` (and text), lang_pred, score: 1 - bits of the best / bits of the second."""
    keep = keep or {}
    cols = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in keep.items()), F.col(text_col).alias("text"))

    def run(batches):
        model = model_of(samples) if samples else None
        for part, data, off in blocks(batches):
            ascii_letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122) & (data < 128)
            letter = np.diff(np.concatenate([[0], np.cumsum(ascii_letter)])[off]) > 0
            for r in np.flatnonzero(~letter & (np.diff(off) > 0)):
                letter[r] = any(map(str.isalpha, data[off[r] : off[r + 1]].tobytes().decode()))
            n = len(part)
            if model:
                bits = model.phrases(*normalise(data, off)) * model.bits[:, None]
                best = bits.argmin(0)
                first = bits[best, np.arange(n)]
                if len(bits) > 1:
                    second = np.partition(bits, 1, 0)[1]
                    score = np.where(second > 0, 1 - first / np.maximum(second, 1e-300), 0.0)
                else:
                    score = np.ones(n)
                name = [model.names[i] if ok else "und" for i, ok in zip(best, letter)]
                score = np.where(letter, score, 0.0)
            else:
                name, score = ["und"] * n, np.zeros(n)
            own = part.columns if with_text else part.columns[:-1]
            yield pa.RecordBatch.from_arrays([*own, pa.array(name, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    names = cols.columns if with_text else cols.columns[:-1]
    kinds = ", ".join(f"`{n}` {cols.schema[n].dataType.simpleString()}" for n in names)
    return cols.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def fold(id_col: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
