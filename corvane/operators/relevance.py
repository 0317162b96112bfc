"""Judgments: spans of documents projected onto chunks, and ranking metrics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

METRICS = ("precision", "recall", "mrr", "ndcg", "hit", "map")


def covered(spans: DataFrame, chunks: DataFrame, least: float | list[float] = 0.5) -> DataFrame:
    """least, query_id, chunk_id, grade: chunks that carry enough of a span of their document.

    By offsets (overlap of at least ``least`` of the span), else by text: the chunk holds the span's text, or a prefix or
    suffix of it of at least that share (all normalised). Spans without text go by offsets only. Of several spans the
    highest grade counts; grades of 0 give no row.
    """
    many = least if isinstance(least, list) else [least]
    if not all(0 < x <= 1 for x in many):
        raise ValueError("coverage must lie in (0, 1]")
    s = spans.select("query_id", "doc_id", F.col("start_char").alias("s0"), F.col("end_char").alias("s1"), "grade", F.col("text").alias("gold"))
    c = chunks.select("chunk_id", "doc_id", F.col("start_char").alias("c0"), F.col("end_char").alias("c1"), F.col("text").alias("hay"))
    pair = s.join(c, "doc_id").withColumn("least", F.explode(F.array(*[F.lit(float(x)) for x in many])))
    share = F.coalesce(F.try_divide(F.least("c1", "s1") - F.greatest("c0", "s0"), F.col("s1") - F.col("s0")), F.lit(0.0))
    by_text = (T.normalised(F.col("gold")) != "") & (F.contains(T.normalised(F.col("hay")), T.normalised(F.col("gold"))) | (T.edge_coverage(F.col("gold"), F.col("hay")) >= F.col("least")))
    hit = F.when((share > 0) & (share >= F.col("least")), True).when(F.col("gold").isNull() | (F.col("gold") == ""), False).otherwise(by_text)
    return pair.where(hit).groupBy("least", "query_id", "chunk_id").agg(F.max("grade").alias("grade")).where("grade > 0")


def projection_summary(spans: DataFrame, qrels: DataFrame) -> DataFrame:
    """least, n_queries, n_projected, n_unmatched, n_judgments, mean_judgments_per_query, match_rate."""
    n = spans.agg(F.countDistinct("query_id").alias("n_queries"))
    per = qrels.groupBy("least").agg(F.countDistinct("query_id").alias("n_projected"), F.count(F.lit(1)).alias("n_judgments"))
    return per.crossJoin(F.broadcast(n)).select(  # one row
        "least", "n_queries", "n_projected", (F.col("n_queries") - F.col("n_projected")).alias("n_unmatched"), "n_judgments",
        F.round(F.try_divide("n_judgments", "n_queries"), 6).alias("mean_judgments_per_query"), F.round(F.try_divide("n_projected", "n_queries"), 6).alias("match_rate"),
    )


def judged(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with a relevant item."""
    return queries.join(qrels.where("grade > 0").select("query_id"), "query_id", "left_semi")


def ranking_metrics(ranking: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10), metrics: tuple[str, ...] = METRICS, linear: bool = False) -> DataFrame:
    """query_id, metric, k, score of every judged query, 0 for one whose ranking is empty.

    qrels: query_id, item_id, grade. precision divides by k, recall by the relevant items, ndcg uses gains 2^grade - 1
    (or the grade) over all judged items cut at k, mrr the first relevant rank within k, map the precision at each
    relevant rank within k. Unjudged queries have no row.
    """
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"no metric {', '.join(sorted(unknown))}")
    rel = qrels.where("grade > 0").select("query_id", "item_id", "grade")
    gain = F.col("grade").cast("double") if linear else F.pow(F.lit(2.0), F.col("grade")) - 1
    deepest = max(cutoffs)
    hits = ranking.select("query_id", "item_id", "rank").where(F.col("rank") <= deepest).join(rel, ["query_id", "item_id"]).withColumn("g", gain)
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    ideal = rel.withColumn("g", gain).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "item_id")))
    log = F.log2(F.col("rank") + 1.0)
    base = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("rank") <= k, F.col("g") / log)).alias(f"i{k}") for k in cutoffs])
    at = []
    for k in cutoffs:
        inside = F.col("rank") <= k
        at += [F.count_if(inside).alias(f"h{k}"), F.min(F.when(inside, F.col("rank"))).alias(f"f{k}"), F.sum(F.when(inside, F.col("g") / log)).alias(f"d{k}"), F.sum(F.when(inside, F.col("nth") / F.col("rank"))).alias(f"a{k}")]
    all_ = base.join(hits.groupBy("query_id").agg(*at), "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    of = {
        "precision": lambda k: zero(F.col(f"h{k}") / k), "recall": lambda k: zero(F.col(f"h{k}") / F.col("n")), "hit": lambda k: zero((F.col(f"h{k}") > 0).cast("double")),
        "mrr": lambda k: zero(1.0 / F.col(f"f{k}")), "map": lambda k: zero(F.col(f"a{k}") / F.col("n")), "ndcg": lambda k: zero(F.try_divide(F.col(f"d{k}"), F.col(f"i{k}"))),
    }
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.round(of[m](k), 9).alias("score")) for m in metrics for k in cutoffs])
    return all_.select("query_id", F.explode(cells).alias("x")).select("query_id", "x.*")


def pooled(rankings: DataFrame, depth: int) -> DataFrame:
    """query_id, item_id, place: the union of the first ``depth`` of all systems, by first appearance (system_no, rank)."""
    first = rankings.where(F.col("rank") <= depth).groupBy("query_id", "item_id").agg(F.min(F.struct("system_no", "rank")).alias("at"))
    return first.select("query_id", "item_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("place"))


def agreement(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """both, only_a, only_b, neither, observed, expected, kappa, label over rows of two boolean judgments.

    Rows with a null are left out; without rows kappa is NaN, with certain agreement (expected 1) it is 1.
    """
    x, y = F.col(a), F.col(b)
    n = pairs.where(x.isNotNull() & y.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))
    pa_, pb = (F.col("both") + F.col("only_a")) / F.nullif("n", F.lit(0)), (F.col("both") + F.col("only_b")) / F.nullif("n", F.lit(0))
    n = n.withColumn("observed", F.try_divide(F.col("both") + F.col("neither"), "n")).withColumn("expected", pa_ * pb + (1 - pa_) * (1 - pb))
    k = F.when(F.col("n") == 0, float("nan")).when(F.col("expected") >= 1, 1.0).otherwise(F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")))
    n = n.withColumn("kappa", k)
    band = F.lit("almost perfect")
    #: Bands of Landis and Koch.
    for top, name in ((0.8, "substantial"), (0.6, "moderate"), (0.4, "fair"), (0.2, "slight")):
        band = F.when(F.col("kappa") <= top, name).otherwise(band)
    return n.withColumn("label", F.when(F.isnan("kappa"), None).when(F.col("kappa") < 0, "poor").otherwise(band))
