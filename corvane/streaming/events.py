"""Streams: rate limits with keyed state, monthly usage, first-seen texts, sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.functions import text as T
from corvane.operators.metering import take


def limited(calls: DataFrame, per_minute: float = 60, burst: float = 5, cost: float = 1.0, late: str = "1 hour") -> DataFrame:
    """caller, n_allowed, n_refused per caller and micro-batch of a stream of calls (caller, ts); buckets are kept in keyed state.

    A bucket that the watermark leaves behind for as long as it takes to fill is dropped.
    """
    rate, capacity = per_minute / 60.0, per_minute + burst
    idle = int(1000 * capacity / rate)

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        tokens, at = state.get if state.exists else (capacity, None)
        ok = no = 0
        for b in batches:
            for t in b.ts.sort_values().astype("int64") / 1e9:
                tokens, allowed, _ = take(tokens, 0.0 if at is None else t - at, cost, rate, capacity)
                at = max(t, at or t)
                ok, no = ok + allowed, no + (not allowed)
        state.update((tokens, at))
        state.setTimeoutTimestamp(max(int(1000 * at) + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"caller": [key[0]], "n_allowed": [ok], "n_refused": [no]})

    kind = calls.schema["caller"].dataType.simpleString()
    return calls.select("caller", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).groupBy("caller").applyInPandasWithState(
        step, f"caller {kind}, n_allowed long, n_refused long", "tokens double, at double", "update", GroupStateTimeout.EventTimeTimeout
    )


def monthly_usage(events: DataFrame, key: str = "user_id", late: str = "1 day") -> DataFrame:
    """key, period, metric, used of a stream (ts, event_type); state of a month is dropped when the watermark passes it."""
    # the month's first moment is the event time of its state: a window has no calendar months
    e = events.withColumn("month", F.date_trunc("month", F.col("ts").cast("timestamp"))).withWatermark("month", f"{late} 31 days")
    return e.groupBy("month", key, F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("used")).select(key, F.date_format("month", "yyyy-MM").alias("period"), "metric", "used")


def first_seen(docs: DataFrame, at: str = "fetched_at", late: str = "1 day") -> DataFrame:
    """Documents whose text (white space aside) was not seen within the watermark."""
    return docs.withColumn("fp", T.fingerprint(F.col("text"))).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(["fp"]).drop("fp")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("w.start").alias("started"), "n_events")
