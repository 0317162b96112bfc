"""Counters, buckets and sessions over events, and the relational shapes the service's reads have."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usage(events: DataFrame, key: str = "user_id", at: str = "ts", metric: str = "event_type", amount: str | None = None) -> DataFrame:
    """key, period (yyyy-MM), metric, used: sums of ``amount`` (default: one each) per calendar month. Negative amounts are an error; null keys stay."""
    a = F.lit(1).cast("double") if amount is None else F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    a = F.when(a < 0, F.raise_error(F.lit("amounts must not be negative")).cast("double")).otherwise(a)
    return events.groupBy(key, F.date_format(at, "yyyy-MM").alias("period"), F.col(metric).alias("metric")).agg(F.round(F.sum(a), 6).alias("used"))


def zero_filled(counters: DataFrame, keys: DataFrame, metrics: list[str], key: str, value: str = "used") -> DataFrame:
    """key, metric, value for every key and each of ``metrics``, 0 where there is no counter."""
    want = keys.select(key).distinct().withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
    return want.join(counters.groupBy(key, "metric").agg(F.sum(value).alias(value)), [key, "metric"], "left").select(key, "metric", F.coalesce(value, F.lit(0.0)).alias(value))


def newest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key with the greatest ``by`` (nulls least); one row even among repeated ones."""
    rest = [c for c in rows.columns if c not in (*keys, *by)]
    return rows.groupBy(*keys).agg(F.max(F.struct(*by, *rest)).alias("r")).select(*keys, "r.*")


def page_of(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of a listing: rows ``offset`` to ``offset + limit`` in a total order."""
    if offset < 0 or not 1 <= limit <= 100:
        raise ValueError("need offset >= 0 and 1 <= limit <= 100")
    return rows.orderBy(*order).offset(offset).limit(limit)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not deleted; null keys stay."""
    return rows.join(gone.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """key, started, last, n_events: runs of events of a key without a pause of ``gap``."""
    w = F.session_window(F.col(at), gap)
    return events.where(F.col(at).isNotNull()).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.max(at).alias("last")).select(key, F.col("w.start").alias("started"), "last", "n_events")


def caller_key(credential, ip):
    """The key a limit counts by: a hash of the credential, else the address."""
    return F.when(credential.isNotNull() & (credential != ""), F.concat(F.lit("k:"), F.substring(F.sha2(credential, 256), 1, 24))).otherwise(F.concat(F.lit("ip:"), F.coalesce(ip, F.lit("unknown"))))


def take(tokens: float, passed: float, cost: float, rate: float, capacity: float) -> tuple[float, bool, int]:
    """A bucket after ``passed`` seconds and one call: tokens left, whether it was allowed, seconds until it would be."""
    tokens = min(capacity, tokens + max(0.0, passed) * rate)
    if tokens >= cost:
        return tokens - cost, True, 0
    return tokens, False, max(1, int((cost - tokens) / rate) + 1)


def token_bucket(calls: DataFrame, per_minute: float = 60, burst: float = 5, cost: float = 1.0) -> DataFrame:
    """call_id, caller, allowed, retry_after of calls (call_id, caller, ts), in order of ts, then call_id, of each caller.

    Buckets start full. Calls are dealt by caller and sorted in the partition; batches stream through one running state,
    so even a caller with a third of all calls needs the memory of one batch. Null callers share a bucket, calls without
    ts are left out.
    """
    rate, capacity = per_minute / 60.0, per_minute + burst

    def run(batches):
        who, tokens, at = object(), capacity, 0.0
        for b in batches:
            t = b.column("us").to_numpy() / 1e6
            ok, retry = np.empty(b.num_rows, bool), np.empty(b.num_rows, np.int32)
            for i, caller in enumerate(b.column("caller").to_pylist()):
                if caller != who:
                    who, tokens, at = caller, capacity, t[i]
                tokens, ok[i], retry[i] = take(tokens, t[i] - at, cost, rate, capacity)
                at = t[i]
            yield pa.RecordBatch.from_arrays([b.column("call_id"), b.column("caller"), pa.array(ok), pa.array(retry)], names=["call_id", "caller", "allowed", "retry_after"])

    kinds = {f.name: f.dataType.simpleString() for f in calls.schema}
    dealt = calls.where("ts is not null").select("call_id", "caller", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).repartition("caller").sortWithinPartitions("caller", "us", "call_id")
    return dealt.mapInArrow(run, f"call_id {kinds['call_id']}, caller {kinds['caller']}, allowed boolean, retry_after int")


def latest_state(changes: DataFrame, key: str, version: str) -> DataFrame:
    """Changes that were not stale when they came: those of the greatest ``version`` of their key so far, by (arrived, id)."""
    w = Window.partitionBy(key).orderBy("arrived", "id").rowsBetween(Window.unboundedPreceding, -1)
    known = F.max(version).over(w)
    return changes.withColumn("stale", F.coalesce(F.col(version) < known, F.lit(False)))
