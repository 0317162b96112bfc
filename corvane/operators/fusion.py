"""Fusing and reranking ranked lists (query_id, item_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.lexical import ranked


def reciprocal_rank(*arms: DataFrame, k: int = 60, top: int | None = None) -> DataFrame:
    """Sum over the arms of 1 / (k + rank)."""
    rows = arms[0].select("query_id", "item_id", "rank")
    for a in arms[1:]:
        rows = rows.unionByName(a.select("query_id", "item_id", "rank"))
    s = rows.groupBy("query_id", "item_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"))
    return ranked(s, top or 2**31 - 1)


def _scaled(arm: DataFrame, name: str) -> DataFrame:
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return arm.select("query_id", "item_id", F.when(hi == lo, 1.0).otherwise(F.try_divide(F.col("score") - lo, hi - lo)).alias(name))


def weighted(dense: DataFrame, lexical: DataFrame, alpha: float | list[float] = 0.5, top: int | None = None) -> DataFrame:
    """alpha dense + (1 - alpha) lexical of scores scaled to 0..1 per query and arm (all equal: 1); missing counts as 0.

    A list of alphas gives all of them at once, with a column alpha.
    """
    many = isinstance(alpha, list)
    if not all(0 <= a <= 1 for a in (alpha if many else [alpha])):
        raise ValueError("alpha must lie in [0, 1]")
    both = _scaled(dense, "d").join(_scaled(lexical, "l"), ["query_id", "item_id"], "full")
    a = F.explode(F.array(*[F.lit(float(x)) for x in alpha])) if many else F.lit(float(alpha))
    both = both.withColumn("alpha", a)
    s = both.select("alpha", "query_id", "item_id", F.round(F.col("alpha") * F.coalesce("d", F.lit(0.0)) + (1 - F.col("alpha")) * F.coalesce("l", F.lit(0.0)), 9).alias("score"))
    return ranked(s, top or 2**31 - 1, ["alpha"]) if many else ranked(s.drop("alpha"), top or 2**31 - 1)


def hybrid(dense_search, lexical_search, k: int = 10, factor: int = 4, fuse=reciprocal_rank, **options) -> DataFrame:
    """Both arms to k * factor candidates, fused, cut to k. The arms are functions of their depth."""
    return fuse(dense_search(k * factor), lexical_search(k * factor), top=k, **options)


def term_overlap(query, passage):
    """The default pair score: share of the query's content terms in the passage."""
    return T.lexical_overlap(query, passage)


def rerank(base: DataFrame, queries: DataFrame, items: DataFrame, k: int = 10, scorer=term_overlap) -> DataFrame:
    """Candidates of ``base`` scored again by ``scorer`` (query text, item text -> double), the k best; texts are joined by id only here."""
    pair = base.select("query_id", "item_id").join(queries.select("query_id", F.col("text").alias("q")), "query_id").join(items.select("item_id", F.col("text").alias("p")), "item_id")
    return ranked(pair.select("query_id", "item_id", F.round(scorer(F.col("q"), F.col("p")), 9).alias("score")), k)


def renumbered(ranking: DataFrame) -> DataFrame:
    """Ranks from 1 without gaps, in the order they had."""
    w = Window.partitionBy("query_id").orderBy("rank", "item_id")
    return ranking.withColumn("rank", F.row_number().over(w))
