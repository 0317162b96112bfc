"""The experiment plan: every condition's ranking, judged by projected spans, scored per query and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import embedding, fusion, lexical, relevance, statistics, vector
from corvane.runtime import materialize


def lexical_rankings(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """condition, query_id, item_id, score, rank: BM25 within each strategy's chunks, all strategies in one plan."""
    items = chunks.select(F.col("strategy").alias("condition"), F.col("chunk_id").alias("item_id"), "text")
    return lexical.search(queries, items, k, by=["condition"])


def dense_rankings(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """condition, query_id, item_id, score, rank: cosine of the hashing embeddings within each strategy's chunks."""
    embed = embedding.embedder()
    asks = materialize(queries.select("query_id", embed(F.col("text")).alias("vec")), "asks")
    items = materialize(chunks.select("strategy", F.col("chunk_id").alias("item_id"), embed(F.col("text")).alias("vec")), "vectors")
    out = None
    for r in items.select("strategy").distinct().collect() or [(None,)]:  # a row a chunker
        name = F.lit(r[0]).cast("string")
        found = vector.search(asks, items.where(F.col("strategy").eqNullSafe(name)), k, "cosine").select(name.alias("condition"), "query_id", "item_id", "score", "rank")
        out = found if out is None else out.unionByName(found)
    return out


def grid(queries: DataFrame, spans: DataFrame, chunks: DataFrame, k: int = 10, factor: int = 4, least: float = 0.5) -> DataFrame:
    """Scores per query of every strategy with dense search and with its rank fusion with BM25 (both to k * factor candidates).

    Conditions are named strategy+dense and strategy+hybrid.
    """
    key = F.concat_ws("\u0001", "condition", "query_id")
    dense = materialize(dense_rankings(queries, chunks, k * factor), "dense")
    arms = [a.withColumn("query_id", key) for a in (dense, lexical_rankings(queries, chunks, k * factor))]
    parts = F.split("query_id", "\u0001")
    hybrid = fusion.reciprocal_rank(*arms, top=k).select(parts[0].alias("condition"), parts[1].alias("query_id"), "item_id", "score", "rank")
    named = lambda df, arm: df.withColumn("condition", F.concat("condition", F.lit(f"+{arm}")))
    rankings = named(dense.where(F.col("rank") <= k), "dense").unionByName(named(hybrid, "hybrid"))
    q = materialize(judgments(spans, chunks, least), "judged")
    return scores(rankings, named(q, "dense").unionByName(named(q, "hybrid")))


def judgments(spans: DataFrame, chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """condition, query_id, item_id, grade over the chunks of all strategies at once."""
    q = relevance.covered(spans, chunks, least)
    return q.join(chunks.select("chunk_id", F.col("strategy").alias("condition")), "chunk_id").select("condition", "query_id", F.col("chunk_id").alias("item_id"), "grade")


def scores(rankings: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10), metrics: tuple[str, ...] = ("precision", "recall", "mrr", "ndcg")) -> DataFrame:
    """condition, query_id, metric, k, score. The condition is part of the key, so one pass serves all of them."""
    key = F.concat_ws("\u0001", "condition", "query_id")
    m = relevance.ranking_metrics(rankings.withColumn("query_id", key), qrels.withColumn("query_id", key), cutoffs, metrics)
    parts = F.split("query_id", "\u0001")
    return m.select(parts[0].alias("condition"), parts[1].alias("query_id"), "metric", "k", "score")


def run(queries: DataFrame, spans: DataFrame, chunks: DataFrame, k: int = 10, least: float = 0.5) -> DataFrame:
    if k < 10:
        raise ValueError("k must reach the greatest cutoff")
    return scores(lexical_rankings(queries, chunks, k), judgments(spans, chunks, least))


def means(per_query: DataFrame) -> DataFrame:
    """condition, metric, k, mean over its queries."""
    return per_query.groupBy("condition", "metric", "k").agg(F.round(F.avg("score"), 9).alias("mean"), F.count(F.lit(1)).alias("n_queries"))


def table(per_query: DataFrame, k: int = 10) -> DataFrame:
    """One row a condition, a column per metric at ``k``."""
    return per_query.where(F.col("k") == k).groupBy("condition").pivot("metric", ["precision", "recall", "mrr", "ndcg"]).agg(F.round(F.avg("score"), 6))


def comparisons(per_query: DataFrame, metric: str = "ndcg", k: int = 10, baseline: str | None = None, resamples: int = statistics.RESAMPLES) -> DataFrame:
    s = per_query.where((F.col("metric") == metric) & (F.col("k") == k)).select("condition", "query_id", "metric", "score")
    return statistics.compared(s, baseline, resamples=resamples)


def markdown(rows: list, columns: list[str]) -> str:
    """A table of a few rows as text."""
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *[line([r[c] for c in columns]) for r in rows]])
