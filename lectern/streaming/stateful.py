"""Keyed state over event streams: a token-bucket limiter and a response cache, in batch and streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECIDED = "key long, event_id long, at double, tokens double, allowed boolean"


def refill(tokens: float, before: float, now: float, most: float, rate: float) -> float:
    return min(most, tokens + max(0.0, now - before) * rate)


def limited(events: DataFrame, key: str, id_col: str, time_col: str, most: float = 60, rate: float = 1.0) -> DataFrame:
    """Decisions of a token bucket per key in time order (ties by id): the first event fills the bucket and takes nothing; each later one takes a token if there is one.

    State is folded over sorted partitions, batch by batch, so a key of any size needs only its bucket in memory.
    """
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(id_col).cast("long").alias("event_id"), (F.unix_micros(F.col(time_col).cast("timestamp")) / 1e6).alias("at")).filter("key is not null and at is not null")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, before = None, 0.0, 0.0
        for pdf in batches:
            left, allowed = [], []
            for k, t in zip(pdf["key"].to_numpy(), pdf["at"].to_numpy()):
                if k != current:
                    current, tokens, ok = k, float(most), True
                else:
                    tokens = refill(tokens, before, t, most, rate)
                    ok = tokens >= 1
                    tokens -= ok
                before = t
                left.append(tokens)
                allowed.append(ok)
            yield pdf.assign(tokens=left, allowed=allowed)

    return rows.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(fold, DECIDED)


def limited_stream(events: DataFrame, key: str, id_col: str, time_col: str, most: float = 60, rate: float = 1.0, idle: str = "300 seconds") -> DataFrame:
    """The same over a stream. Buckets of keys without events for ``idle`` beyond the watermark are dropped; events are ordered within each micro-batch."""
    seconds = int(idle.split()[0])
    rows = events.withWatermark(time_col, "1 minute").select(F.col(key).cast("long").alias("key"), F.col(id_col).cast("long").alias("event_id"), F.col(time_col).alias("ts"))

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        at = pdf["ts"].astype("int64").to_numpy() / {"ns": 1e9, "us": 1e6, "ms": 1e3}[getattr(pdf["ts"].dtype, "unit", "ns")]
        tokens, before = state.get if state.exists else (None, None)
        left, allowed = [], []
        for t in at:
            if tokens is None:
                tokens, ok = float(most), True
            else:
                tokens = refill(tokens, before, t, most, rate)
                ok = tokens >= 1
                tokens -= ok
            before = t
            left.append(float(tokens))
            allowed.append(bool(ok))
        state.update((float(tokens), float(before)))
        state.setTimeoutTimestamp(max(int(before * 1000) + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": k[0], "event_id": pdf["event_id"].to_numpy(), "at": at, "tokens": left, "allowed": allowed})

    return rows.groupBy("key").applyInPandasWithState(fold, DECIDED, "tokens double, before double", "append", GroupStateTimeout.EventTimeTimeout)


def cache_hits(requests: DataFrame, id_col: str, text: str, register: str, time_col: str, ttl: int = 3600) -> DataFrame:
    """Whether each request finds a fresh answer to the same text and register: the last miss of its key lies at most ``ttl`` seconds back. A miss starts a new answer.

    Requests of one key are grouped by a fold in time order like the limiter's: sequential by definition, so the requests
    of one key pass through one task, which holds one number for them. Null and empty texts are one key, as the
    definition has it.
    """
    rows = requests.select(F.col(id_col).cast("long").alias("event_id"), F.md5(F.concat_ws("||", F.coalesce(text, F.lit("")), F.coalesce(register, F.lit("")))).alias("key"), (F.unix_micros(F.col(time_col).cast("timestamp")) / 1e6).alias("at")).filter("at is not null")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stored = None, 0.0
        for pdf in batches:
            hit = []
            for k, t in zip(pdf["key"].to_numpy(), pdf["at"].to_numpy()):
                ok = k == current and t - stored <= ttl
                if not ok:
                    current, stored = k, t
                hit.append(ok)
            yield pdf.assign(hit=hit)

    return rows.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(fold, "event_id long, key string, at double, hit boolean")


def first_of_key_stream(events: DataFrame, keys: list[str], time_col: str, ttl: str = "1 hour") -> DataFrame:
    """Stream deduplication: the first event of each key within the time to live."""
    return events.withWatermark(time_col, ttl).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time_col: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by time window; works on batches and, with a watermark for late events, on streams."""
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    return rows.groupBy(F.window(time_col, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def latest(df: DataFrame, key: str, time_col: str) -> DataFrame:
    """The last row of each key by time; of equal times the one with the largest other values. A hash aggregate with map-side combine instead of a window."""
    rest = [c for c in df.columns if c not in (key, time_col)]
    g = df.groupBy(key).agg(F.max(F.struct(time_col, *rest)).alias("_r"))
    return g.select(key, "_r.*").select(*df.columns)


__all__ = ["cache_hits", "first_of_key_stream", "latest", "limited", "limited_stream", "windowed_counts"]
