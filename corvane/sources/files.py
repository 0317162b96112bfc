"""Tables, page caches and judged query sets on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Explicit schemas of line-delimited query sets and of exported runs.
QUERY_SET = "query_id string, text string, provenance string, source_doc_id long, spans array<struct<doc_id:long,start_char:int,end_char:int,grade:int,text:string>>, metadata map<string,string>"
RUNS = "condition string, query_id string, metric string, k int, score double"
MAX_BYTES = 5 * 1024 * 1024


def append_experiment(per_query: DataFrame, path: str, experiment_id: str) -> None:
    """Append an experiment: ``runs`` (experiment_id, run_id, condition) and ``records`` (experiment_id, run_id, query_id, metric, k, score).

    A run is a condition of an experiment; its id is made of both, so a second writing of the same gives the same ids.
    """
    run_id = F.substring(F.sha1(F.concat_ws("|", F.lit(experiment_id), "condition")), 1, 16)
    rows = per_query.select(F.lit(experiment_id).alias("experiment_id"), run_id.alias("run_id"), "condition", "query_id", "metric", "k", "score")
    rows.drop("condition").write.mode("append").partitionBy("experiment_id").parquet(f"{path}/records")
    rows.select("experiment_id", "run_id", "condition").distinct().write.mode("append").partitionBy("experiment_id").parquet(f"{path}/runs")


def read_experiment(spark: SparkSession, path: str, experiment_id: str) -> tuple[DataFrame, DataFrame]:
    """(runs, records) of one experiment, only its partition read; empty for an id that was never written."""
    mine = F.col("experiment_id") == experiment_id
    runs = spark.read.schema("run_id string, condition string, experiment_id string").parquet(f"{path}/runs").where(mine)
    return runs, spark.read.schema("run_id string, query_id string, metric string, k int, score double, experiment_id string").parquet(f"{path}/records").where(mine)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_query_set(queries: DataFrame, path: str) -> None:
    """One JSON object a line; columns as in QUERY_SET."""
    queries.write.mode("overwrite").json(path)


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY_SET).json(path)


def write_runs(scores: DataFrame, path: str) -> None:
    """Per-query scores, a folder per condition, so reads of one condition are pruned."""
    scores.write.mode("overwrite").partitionBy("condition").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(path)


def cache_name(url):
    """File name of a page in a cache folder."""
    return F.concat(F.sha1(url), F.lit(".html"))


def read_page_cache(spark: SparkSession, folder: str, urls: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """url, html, status of urls: ok, missing (no file) or too_large. Invalid bytes are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")
    both = urls.select("url").distinct().withColumn("name", cache_name(F.col("url"))).join(files, "name", "left")
    ok = F.col("length") <= max_bytes
    return both.select("url", F.when(ok, decoded(F.col("content"))).alias("html"), F.when(F.col("length").isNull(), "missing").when(ok, "ok").otherwise("too_large").alias("status"))


@F.pandas_udf(StringType())
def decoded(content):
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def write_page_cache(pages: DataFrame, folder: str) -> DataFrame:
    """Write url, html as one file each into a folder all executors share; returns url, name of what was written."""

    def put(batches):
        import hashlib
        from pathlib import Path

        import pyarrow as pa

        Path(folder).mkdir(parents=True, exist_ok=True)
        for b in batches:
            names = []
            for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                names.append(hashlib.sha1((url or "").encode()).hexdigest() + ".html")
                (Path(folder) / names[-1]).write_text(html or "", encoding="utf-8")
            yield pa.RecordBatch.from_arrays([b.column("url"), pa.array(names, pa.string())], names=["url", "name"])

    return pages.select("url", "html").mapInArrow(put, "url string, name string")
