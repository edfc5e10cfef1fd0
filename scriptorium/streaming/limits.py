"""Rate limits, sessions and time to live over events (key, ts)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, WINDOW_S = 10, 3600.0
_FORM = "event_id bigint, key bigint, t double, allowed boolean, retry_after double"


def admit(times: list[float], hits: list[float], limit: int, window: float) -> tuple[list[bool], list[float], list[float]]:
    """Sliding log: hits at or before now - window are dropped; under the limit the event is allowed and
    recorded, else it must wait for the oldest hit to leave. Denied events aren't recorded."""
    ok, wait = [], []
    for t in times:
        while hits and hits[0] <= t - window:
            hits.pop(0)
        if len(hits) >= limit:
            ok.append(False)
            wait.append(hits[0] + window - t)
        else:
            hits.append(t)
            ok.append(True)
            wait.append(0.0)
    return ok, wait, hits


def rate_limit(events: DataFrame, limit: int = LIMIT, window: float = WINDOW_S) -> DataFrame:
    """event_id, key, ts -> allowed and retry_after (seconds). Each decision depends on the ones before,
    so a key's events are streamed in order of time; a task keeps one key's last ``limit`` hits."""
    own = events.select("event_id", F.col("key").cast("long").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    own = own.repartition("key").sortWithinPartitions("key", "t", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, hits = None, []
        for b in batches:
            parts = []
            for key, rows in b.groupby("key", sort=False, dropna=False):
                if key != now:
                    now, hits = key, []
                ok, wait, hits = admit(rows["t"].tolist(), hits, limit, window)
                parts.append(rows.assign(allowed=ok, retry_after=wait))
            if parts:
                yield pd.concat(parts)

    return own.mapInPandas(run, _FORM)


def rate_limit_stream(events: DataFrame, limit: int = LIMIT, window: float = WINDOW_S, late: str = "10 minutes") -> DataFrame:
    """The same over a stream of (event_id, key, ts); the state is a key's last hits, and goes once the
    watermark shows that they have all left the window."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches, state: GroupState):
        hits = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        ok, wait, hits = admit(rows["t"].tolist(), hits, limit, window)
        state.update((hits,))
        gone = int(((hits or rows["t"].tolist())[-1] + window) * 1000) + 1
        state.setTimeoutTimestamp(max(gone, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(allowed=ok, retry_after=wait)[["event_id", "key", "t", "allowed", "retry_after"]]

    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")
    own = events.withWatermark("ts", late).select("event_id", F.col("key").cast("long").alias("key"), seconds, "ts")
    return own.groupBy("key").applyInPandasWithState(run, _FORM, "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, gap_s: int = 120) -> DataFrame:
    """Events of a key belong to one session while no gap is over gap_s (a gap of just gap_s is in)."""
    by = Window.partitionBy("key").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by).cast("timestamp"))) > gap_s * 1_000_000
    runs = events.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("session", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("key", "session").agg(F.count("*").alias("n"), F.min("ts").alias("begin"), F.max("ts").alias("end"))


def sessions_stream(events: DataFrame, gap_s: int = 120, late: str = "10 minutes") -> DataFrame:
    """Over a stream, with a watermark; session_window closes at the gap itself, so a microsecond is
    added to keep a gap of just gap_s inside."""
    span = F.session_window("ts", f"{gap_s} seconds 1 microseconds")
    return events.withWatermark("ts", late).groupBy("key", span.alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("begin"), F.max("ts").alias("end")).select("key", "n", "begin", "end")


def expired(events: DataFrame, now, ttl_s: int = 3600) -> DataFrame:
    """key, last access, and whether it is more than ttl_s ago."""
    last = events.groupBy("key").agg(F.max("ts").alias("last"))
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    return last.withColumn("expired", age > ttl_s * 1_000_000)


def least_recent_out(events: DataFrame, most: int = 32, *by: str) -> DataFrame:
    """The ``most`` keys with the latest access (in each group of ``by``, or in all: a global top-k)."""
    last = events.groupBy(*by, "key").agg(F.max("ts").alias("last"))
    if not by:
        return last.orderBy(F.desc("last"), "key").limit(most)
    return last.withColumn("_no", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("last"), "key"))).where(F.col("_no") <= most).drop("_no")
