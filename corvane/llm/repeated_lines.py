"""Problem 6: lines that one site repeats over many documents.

First pass: summaries of each source, hashed counters of (site, line) that merge by addition (map-side combine); every
document adds a line once. Second pass: lines whose counter reaches the limit are read again and counted exactly by their
full key. A summary of fewer counters cannot miss no line here: the limit is a number of documents and no share of them, so a
Misra-Gries summary would need a counter for every fifth line of a source, which is more than it has distinct lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.urls import site_of
from corvane.runtime import materialize, small_or_none

MIN_DOCS = 5


def line_key(line: Column) -> Column:
    """What makes two lines the same: lower case, letters only."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def _sited(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", site_of(F.col("url")).alias("site"), "text").where("site is not null and text is not null and doc_id is not null")


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """``(lines, occurrences)`` of lines found in at least ``min_docs`` documents of one site.

    lines: site, line_key, n_docs, n_occurrences. occurrences: doc_id, line_no (from 0, blank lines counted), site, line_key.
    A document without url or text has no lines here; a line without a letter is never counted. Repeated rows of one
    doc_id count as one document. An empty table gives empty results; extra columns are ignored.
    """
    base = _sited(docs)
    marks = F.array_distinct(F.transform(F.split("text", "\n", -1), lambda x: F.xxhash64("site", line_key(x))))
    summary = base.select(F.explode(marks).alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    hot = summary.where(F.col("n") >= min_docs).select("mark")
    hot = materialize(hot, "p6-candidates")
    lines = (
        base.select("doc_id", "site", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .select("doc_id", "site", "line_no", line_key(F.col("line")).alias("line_key"))
        .where("line_key != ''")
        .withColumn("mark", F.xxhash64("site", "line_key"))
    )
    near = F.broadcast(hot) if small_or_none(hot) else hot
    found = materialize(lines.join(near, "mark", "left_semi"), "p6-lines")
    # one row per document and line first: a hot line of a large site is then counted in many partial sums
    counted = (
        found.groupBy("mark", "site", "line_key", "doc_id").agg(F.countDistinct("line_no").alias("k"))
        .groupBy("mark", "site", "line_key").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("k").alias("n_occurrences"))
    )
    counted = materialize(counted, "p6-counted")
    exact = counted.where(F.col("n_docs") >= min_docs)
    # only 64-bit marks are sent, at most BROADCAST_ROWS of them; should two lines share one, their keys are compared
    shared = counted.groupBy("mark").agg(F.max("n_docs").alias("most"), F.min("n_docs").alias("least")).where((F.col("least") < min_docs) & (F.col("most") >= min_docs))
    by = ["site", "line_key"] if shared.head(1) else ["mark"]
    sure = exact.select(*by).distinct()
    sure = F.broadcast(sure) if by == ["mark"] and small_or_none(sure) else sure
    return exact.drop("mark"), found.join(sure, by, "left_semi").select("doc_id", "line_no", "site", "line_key").distinct()


def without_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text without the site's repeated lines, n_removed. Null text stays null; order of lines is kept."""
    _, occ = repeated_lines(docs, min_docs)
    gone = occ.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(
        F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i)
    )
    return docs.select("doc_id", "text").join(gone, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
    )
