import importlib.util
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from corvane import cli
from corvane.plans import experiment
from corvane.runtime import materialize, shared_dir, small_or_none
from corvane.sources import files, page_cache
from corvane.streaming import events as streams

ROOT = Path(__file__).resolve().parents[1]


def test_materialized_tables_live_in_the_shared_folder(spark):
    df = spark.range(10).withColumn("a", F.array("id"))
    back = materialize(df, "t")
    assert back.schema.simpleString() == df.schema.simpleString() and back.count() == 10 and "FileScan parquet" in back._jdf.queryExecution().toString()
    assert Path(shared_dir(spark).removeprefix("file://")).is_dir()
    assert small_or_none(df, 10) and not small_or_none(df, 9)


def test_query_sets(spark, tmp_path):
    span = "array(named_struct('doc_id', 1L, 'start_char', 0, 'end_char', 5, 'grade', 1, 'text', 'x'))"
    q = spark.range(2).select(F.col("id").cast("string").alias("query_id"), F.lit("t\n\"é").alias("text"), F.lit("human").alias("provenance"), F.lit(1).cast("long").alias("source_doc_id"), F.expr(span).alias("spans"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"))
    files.write_query_set(q, str(tmp_path / "q"))
    assert sorted(map(str, files.read_query_set(spark, str(tmp_path / "q")).collect())) == sorted(map(str, q.collect()))


def test_runs_are_pruned_by_condition(spark, tmp_path):
    df = spark.createDataFrame([("a", "q", "ndcg", 10, 0.5), ("b", "q", "ndcg", 10, 0.25)], files.RUNS)
    files.write_runs(df, str(tmp_path / "r"))
    one = files.read_runs(spark, str(tmp_path / "r")).where("condition = 'b'")
    assert [r.score for r in one.collect()] == [0.25] and "PartitionFilters: [isnotnull(condition" in one._jdf.queryExecution().toString()


def test_page_cache(spark, tmp_path):
    pages = spark.createDataFrame([("http://a.test/", "<p>é</p>"), ("http://b.test/", "x" * 100), ("http://c.test/", None)], "url string, html string")
    files.write_page_cache(pages.where("html is not null"), str(tmp_path)).count()
    got = {r.url: (r.html, r.status) for r in files.read_page_cache(spark, str(tmp_path), pages, 50).collect()}
    assert got == {"http://a.test/": ("<p>é</p>", "ok"), "http://b.test/": (None, "too_large"), "http://c.test/": (None, "missing")}
    page_cache.register(spark)
    df = spark.read.format("page_cache").option("folder", str(tmp_path)).load()
    assert sorted(r.status for r in df.collect()) == ["ok", "ok"]


def stream(spark, tmp_path, df):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def run(spark, out, name, mode):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streamed_limit_equals_the_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t0)] * 70 + [("b", t0 + timedelta(seconds=1))], "caller string, ts timestamp")
    got = {r.caller: (r.n_allowed, r.n_refused) for r in run(spark, streams.limited(stream(spark, tmp_path, df)), "limited", "update")}
    assert got == {"a": (65, 5), "b": (1, 0)}


def test_streamed_usage_and_first_seen(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "x", t0), (1, "x", t0 + timedelta(hours=3)), (2, "y", t0 + timedelta(days=1))], "user_id int, event_type string, ts timestamp")
    got = {(r.user_id, r.period): r.used for r in run(spark, streams.monthly_usage(stream(spark, tmp_path, df)), "usage", "complete")}
    assert got == {(1, "2024-01"): 2, (2, "2024-01"): 1}
    docs = spark.createDataFrame([(1, "a  b", t0), (2, "a b", t0), (3, "c", t0)], "doc_id int, text string, fetched_at timestamp")
    assert len(run(spark, streams.first_seen(stream(spark, tmp_path / "d", docs)), "first", "append")) == 2


def test_entry_and_queries(spark):
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    df = entry.entry(spark)
    assert df.count() > 0 and "score" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_core_does_not_import_the_training_subpackage():
    for p in (ROOT / "corvane").rglob("*.py"):
        if "llm" not in p.parts:
            assert "corvane.llm" not in p.read_text(), p


def test_markdown():
    assert experiment.markdown([{"a": 1, "b": "x"}], ["a", "b"]).splitlines() == ["| a | b |", "| --- | --- |", "| 1 | x |"]


def test_cli(spark, capsys):
    assert cli.main(["check-metrics", "/root/testdata/sf0.001"]) == 0
    assert "identical_rate" in capsys.readouterr().out
    assert cli.main(["audit", "/root/testdata/sf0.001", "--top", "3"]) == 0
    assert cli.main(["nothing"]) == 2
