"""Generated answers: prompts, citations and how much of an answer each source contributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

#: Characters of a source that go into a prompt.
SOURCE_CHARS = 1500


def prompts(ranking: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """query_id, sources: numbered blocks of the k best items (item_id, url, text) in order of rank; the width is a limit of the prompt, not of the search."""
    top = ranking.where(F.col("rank") <= k).join(items.select("item_id", "url", "text"), "item_id")
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.coalesce("url", F.lit("")), F.lit(")\n"), F.substring("text", 1, SOURCE_CHARS))
    listed = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("s"))
    return listed.select("query_id", F.array_join(F.col("s.b"), "\n\n").alias("sources"))


def answer_sentences(answers: DataFrame, ranking: DataFrame, k: int = 5) -> DataFrame:
    """query_id, sent_no (from 1), text, cited: sentences of answers (query_id, answer_text) with the distinct items their [n] marks name.

    A mark belongs to the sentence it stands in; marks beyond the k retrieved items are dropped. An empty answer has no row.
    """
    names = ranking.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("r")).select("query_id", F.col("r.item_id").alias("items"))
    s = answers.select("query_id", F.posexplode(T.sentences(F.col("answer_text"))).alias("p", "text")).join(names, "query_id", "left")
    marks = F.transform(F.regexp_extract_all("text", F.lit(r"\[(\d{1,6})\]"), F.lit(1)), lambda m: F.get(F.col("items"), m.cast("int") - 1))
    return s.select("query_id", (F.col("p") + 1).alias("sent_no"), "text", F.coalesce(F.array_distinct(F.filter(marks, lambda x: x.isNotNull())), F.array().cast("array<string>")).alias("cited"))


def _decay(kind: str, half_life: float):
    i = F.col("sent_no") - 1
    if kind == "none":
        return F.lit(1.0)
    if kind == "linear":
        return 1.0 / (i + 1)
    if kind == "exponential" and half_life > 0:
        return F.pow(F.lit(2.0), -i / half_life)
    raise ValueError(f"no decay {kind!r} with half-life {half_life}")


def impressions(sentences: DataFrame, targets: DataFrame, decay: str = "exponential", half_life: float = 5.0) -> DataFrame:
    """query_id, target, n_sentences, n_words, word_share, position_share, citation_share, first_position of targets (target, item_id).

    A sentence counts for a target that it cites, once however often; words are lower-case runs of letters and digits.
    Targets that no sentence of a query cites have no row.
    """
    s = sentences.select("query_id", "sent_no", "cited", F.size(T.tokens(F.col("text"), stop=False)).alias("w"), _decay(decay, half_life).alias("d"))
    whole = s.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("w").alias("n_words"), F.sum(F.col("w") * F.col("d")).alias("ww"), F.sum(F.size("cited")).alias("nc"))
    cites = s.select("query_id", "sent_no", "w", "d", F.explode("cited").alias("item_id")).join(targets, "item_id")
    per = cites.groupBy("query_id", "target", "sent_no").agg(F.first("w").alias("w"), F.first("d").alias("d"), F.count(F.lit(1)).alias("c"))
    hit = per.groupBy("query_id", "target").agg(F.sum("w").alias("hw"), F.sum(F.col("w") * F.col("d")).alias("hww"), F.sum("c").alias("hc"), F.min("sent_no").alias("first_position"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 9)
    return hit.join(whole, "query_id").select(
        "query_id", "target", "n_sentences", "n_words", share("hw", "n_words").alias("word_share"), share("hww", "ww").alias("position_share"), share("hc", "nc").alias("citation_share"), "first_position"
    )


def visibility(shares: DataFrame, targets: DataFrame, n_queries: DataFrame) -> DataFrame:
    """target, visibility: mean position share over all queries of ``n_queries`` (query_id), uncited ones as 0; every target has a row."""
    n = n_queries.agg(F.countDistinct("query_id").alias("n"))
    total = shares.groupBy("target").agg(F.sum("position_share").alias("s"))
    return targets.select("target").distinct().join(total, "target", "left").crossJoin(F.broadcast(n)).select("target", F.round(F.coalesce(F.try_divide(F.coalesce("s", F.lit(0.0)), "n"), F.lit(0.0)), 9).alias("visibility"))  # one row
