"""Quality rules with host verdicts.

Each document is measured in one pass; rule failures are summed by host (partial aggregation, so a
host with a third of all rows costs no more than another), each host's failure rate is shrunk with a
beta prior fitted to all hosts by moments, and the verdict is joined back to the documents.

Edge cases: a null or empty text has no words and fails; a null host is the host ``''``; repeated
rows and repeated ids are judged row by row; an empty table gives an empty result; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import written
from ._words import SPACE, Words, blocks, mix

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[off])


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each row of a block."""
    w = Words(data, off)
    rows = len(off) - 1
    lead = (data & 0xC0) != 0x80
    out = {
        "n_words": np.diff(w.first),
        "word_chars": _per_row(lead & ~SPACE[data], off),
        "n_symbols": _per_row(_symbol[data], off),
        "n_upper": _per_row(_upper[data], off),
    }
    # lines
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], breaks + 1]))
    begin = begin[begin < len(data)]
    row = np.searchsorted(off, begin, "right") - 1
    stop = off[row + 1]
    if len(breaks):
        nxt = np.searchsorted(breaks, begin)
        stop = np.minimum(stop, np.where(nxt < len(breaks), breaks[np.minimum(nxt, len(breaks) - 1)], len(data)))
    full = np.searchsorted(w.start, begin) < np.searchsorted(w.start, stop)
    begin, stop, row = begin[full], stop[full], row[full]
    key = mix(w.spans(begin, stop) ^ mix(row.astype(np.uint64)))
    _, kept = np.unique(key, return_index=True)
    out["n_lines"] = np.bincount(row, minlength=rows)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(row[kept], minlength=rows)
    # words in repeated windows
    h, at, row = w.shingles(WINDOW)
    key = mix(h ^ mix(row.astype(np.uint64)))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    again = np.zeros(len(key), bool)
    again[1:] |= same
    again[:-1] |= same
    at = at[order[again]]
    step = np.zeros(w.n + 1, np.int64)
    step[at] += 1
    step[at + WINDOW] -= 1
    covered = np.cumsum(step[:-1]) > 0
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(covered)])[w.first])
    return out


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: its id, host and the measures (long)."""
    cols = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))

    def run(batches):
        for part, data, off in blocks(batches):
            m = measure(data, off)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(m[k], pa.int64()) for k in MEASURES)], names=["doc_id", "host", *MEASURES])

    kind = cols.schema["doc_id"].dataType.simpleString()
    return cols.mapInArrow(run, f"doc_id {kind}, host string, " + ", ".join(f"{k} bigint" for k in MEASURES))


#: Rule -> SQL condition of failure.
BASE_RULES = {"few_words": "n_words < 20", "repeats": "100 * n_repeat_words > 30 * n_words"}
MORE_RULES = {"symbols": "10 * n_symbols > 2 * n_words", "shouting": "10 * n_upper > 3 * word_chars", "same_lines": "2 * n_dup_lines > n_lines"}


def host_rates(judged: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk). Prior: beta-binomial, its intra-class correlation rho
    fitted by moments to all hosts and kept in [0.0001, 0.9999]; the sums of the fit are one row."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    s = hosts.agg(F.count("*").alias("h"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("n2"), F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n_docs")).alias("ff")).first()
    h, n, f = s["h"], s["n"] or 0, s["f"] or 0
    mean = f / n if n else 0.0
    rho = 0.0001
    if 0 < f < n and h > 1:
        spread = (s["ff"] - n * mean * mean) / (mean * (1 - mean))
        room = n - s["n2"] / n - (h - 1)
        rho = (spread - (h - 1)) / room if room > 0 else 0.0001
    rho = min(max(rho, 0.0001), 0.9999)
    k = 1 / rho - 1
    return hosts.withColumn("rate", (F.col("n_failed") + F.lit(mean * k)) / (F.col("n_docs") + F.lit(k)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", worst_rate: float = 0.5) -> DataFrame:
    """The measures, ``base_failed``, ``failed`` (any rule), the host's shrunk failure ``host_rate``
    and ``kept``: no rule fails and the host's rate is at most worst_rate."""
    base = " OR ".join(f"({x})" for x in BASE_RULES.values())
    more = " OR ".join(f"({x})" for x in MORE_RULES.values())
    judged = written(measures(docs, id_col, text_col, host_col).withColumn("base_failed", F.expr(base)).withColumn("failed", F.col("base_failed") | F.expr(more)))
    rates = host_rates(judged).select("host", F.col("rate").alias("host_rate"))
    return judged.join(rates, "host").withColumn("kept", ~F.col("failed") & (F.col("host_rate") <= worst_rate))
