"""Problem 8: mixing sources to target weights under a cap on repeats.

Capped water-filling: a source whose share of the total would need more than its most epochs is clamped there, and what
it leaves is shared by the others in proportion to their weights until nothing changes. A source then comes whole as
often as its epochs have whole parts, and a seeded part of its documents once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corvane.llm.tokens import VOCABULARY, with_tokens
from corvane.runtime import materialize

SEED = 20240501
BUCKETS = 4096


def canonical(source: Column) -> Column:
    """Canonical spelling of a source: trimmed, lower case, words joined by ``_``."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))), r"(?U)[\s\-_]+", "_")


def water_fill(weights: dict[str, float], room: dict[str, float], total: float) -> dict[str, float]:
    """Tokens per source: shares of ``total`` by weight, none above its room; less than ``total`` only if all rooms are full."""
    out = {s: 0.0 for s in weights}
    open_ = {s for s in weights if weights[s] > 0 and room[s] > 0}
    left = total
    while open_ and left > 0:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w >= room[s]}
        if not over:
            for s in open_:
                out[s] = left * weights[s] / w
            break
        for s in over:
            out[s] = room[s]
        left -= sum(room[s] for s in over)
        open_ -= over
    return out


def mixtures(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = SEED, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """``(list, shares)``. list: mix, source, doc_id, repeats (at least 1). shares: mix, source, target_share,
    available_tokens, epochs, tokens, share, capped.

    The total of a mix is ``total_tokens``, or else all tokens of its sources once. Weights are divided by their sum; a
    null, negative or NaN weight counts as 0, a null cap as none, repeated target rows of a mix and source are added.
    Documents without text, source or doc_id are never drawn; a source without documents gets 0 and its share goes to
    the others. ``targets`` is a parameter table that is read on the driver (one row a mix and source).
    """
    spark = docs.sparkSession
    sized = with_tokens(docs.where("doc_id is not null and source is not null").select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.col("source")).alias("source"), "text"), ["doc_id", "source"], vocabulary)
    sized = materialize(sized.where("n_tokens > 0").withColumn("h", F.xxhash64("doc_id", F.lit(seed))), "p8-sizes")
    w = F.when((F.col("target_weight") > 0) & ~F.isnan("target_weight"), F.col("target_weight")).otherwise(0.0)
    # one more than the rows a driver should be given: a parameter table is far smaller
    wanted = targets.where("mix is not null and source is not null").groupBy("mix", canonical(F.col("source")).alias("source")).agg(F.sum(w).alias("w"), F.max("max_repeats").alias("cap"), F.count_if(F.col("max_repeats").isNull()).alias("free")).limit(100_001).collect()
    if len(wanted) > 100_000:
        raise ValueError("more than 100,000 targets")
    names = spark.createDataFrame([(s,) for s in sorted({r.source for r in wanted})], "source string")
    have = {r.source: r.n for r in sized.join(F.broadcast(names), "source").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    plan = []
    for mix in sorted({r.mix for r in wanted}):
        rows = [r for r in wanted if r.mix == mix]
        total_w = sum(r.w for r in rows)
        avail = {r.source: float(have.get(r.source, 0)) for r in rows}
        room = {r.source: avail[r.source] * (float("inf") if r.free else max(0, r.cap)) if avail[r.source] else 0.0 for r in rows}
        got = water_fill({r.source: r.w for r in rows}, room, sum(avail.values()) if total_tokens is None else total_tokens)
        for r in rows:
            e = got[r.source] / avail[r.source] if avail[r.source] else 0.0
            whole = int(e + 1e-9)
            plan.append((mix, r.source, r.w / total_w if total_w else 0.0, int(avail[r.source]), e, whole, max(0.0, got[r.source] - whole * avail[r.source]), bool(r.w > 0 and got[r.source] >= room[r.source])))
    plan = spark.createDataFrame(plan, "mix string, source string, target_share double, available_tokens long, epochs double, whole int, rest double, capped boolean")
    # where the fractional repetition ends: a histogram of BUCKETS rows a source, then the documents of one bucket
    bucket = F.shiftrightunsigned("h", 52).cast("int")
    hist = sized.join(F.broadcast(names), "source").groupBy("source", bucket.alias("b")).agg(F.sum("n_tokens").alias("t"))
    hist = hist.withColumn("before", F.sum("t").over(Window.partitionBy("source").orderBy("b")) - F.col("t"))
    ends = F.broadcast(plan).join(hist, "source").where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest"))).select("mix", "source", F.col("b").alias("end_b"), "before")
    ends = plan.join(ends, ["mix", "source"], "left").select("mix", "source", "whole", "rest", F.coalesce("end_b", F.when(F.col("rest") > 0, F.lit(BUCKETS)).otherwise(F.lit(-1))).alias("end_b"), F.coalesce("before", F.lit(0)).alias("before"))
    ends = materialize(ends, "p8-ends")
    each = sized.withColumn("b", bucket).join(F.broadcast(ends), "source")
    inside = each.where("b != end_b").withColumn("extra", (F.col("b") < F.col("end_b")).cast("int"))
    edge = each.where("b = end_b").withColumn("sofar", F.sum("n_tokens").over(Window.partitionBy("mix", "source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("extra", (F.col("before") + F.col("sofar") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int")).drop("sofar")
    drawn = inside.unionByName(edge).select("mix", "source", "doc_id", (F.col("whole") + F.col("extra")).alias("repeats"), "n_tokens").where("repeats > 0")
    drawn = materialize(drawn, "p8-drawn")
    got = drawn.groupBy("mix", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    shares = plan.join(got, ["mix", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long"))
    whole = F.sum("tokens").over(Window.partitionBy("mix"))
    shares = shares.withColumn("share", F.coalesce(F.try_divide("tokens", whole), F.lit(0.0))).select("mix", "source", "target_share", "available_tokens", "epochs", "tokens", "share", "capped")
    return drawn.drop("n_tokens"), shares
