import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.operators import answers, chunking, embedding, equivalence, extraction, fusion, lexical, metering, questions, relevance, signals, statistics, vector
from corvane.queries import audits, evaluation, retrieval


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


PAGE = "<html><title>T</title><nav>menu</nav>Lead<h1>A</h1>one<h2>B</h2>two<h3>C</h3>three<h2>D</h2>four<h2></h2>five</html>"


def test_sections(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "no heading"), (3, None)], "id int, html string")
    got = extraction.sections(df, "id").orderBy("section_no").collect()
    assert [(r.heading_path, r.text) for r in got] == [
        ([], "T menu Lead".replace(" menu", "")), (["A"], "one"), (["A", "B"], "two"), (["A", "B", "C"], "three"), (["A", "D"], "four"), (["A"], "five")]
    first = len(got[0].text)
    assert [r.start_char for r in got] == [0, first, first + 4, first + 8, first + 14, first + 19]


def test_crawl_order(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4)], "src int, dst int")
    assert rows(extraction.reachable(e, spark.createDataFrame([(1,)], "node int"))) == [(1, 0), (2, 1), (3, 2), (4, 1)]
    assert extraction.reachable(e.limit(0), spark.createDataFrame([], "node int")).count() == 0


def test_redirects(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", None), ("x", "y"), ("y", "x")], "url string, location string")
    assert rows(extraction.redirect_chains(hops)) == [("a", "b", 1, "ok"), ("b", "b", 0, "ok"), ("x", None, 5, "too_many_redirects"), ("y", None, 5, "too_many_redirects")]


def test_robots(spark):
    rules = spark.createDataFrame([(None, 1, "/private/", False), ("b.test", 1, "", False), ("c.test", 1, "/a", True), ("c.test", 2, "/", False)], "host string, rule_no int, path string, allow boolean")
    urls = spark.createDataFrame([("http://a.test/private/x",), ("http://a.test/",), ("http://b.test/private/",), ("http://c.test/abc",), ("http://c.test/z",)], "url string")
    assert rows(extraction.robots_allowed(urls, rules)) == [("http://a.test/", True), ("http://a.test/private/x", False), ("http://b.test/private/", True), ("http://c.test/abc", True), ("http://c.test/z", False)]


DOC = "word " * 600


def test_fixed(spark):
    df = spark.createDataFrame([(1, DOC), (2, ""), (3, "a b")], "doc_id long, text string")
    got = chunking.fixed(df, 256, 0).orderBy("doc_id", "ordinal").collect()
    assert " ".join(r.text for r in got if r.doc_id == 1).split() == DOC.split() and len(got) == 4
    text = " ".join(DOC.split())
    assert all(text[r.start_char : r.end_char] == r.text for r in got if r.doc_id == 1)
    with pytest.raises(ValueError):
        chunking.fixed(df, 10, 10)


def test_sentence_packing():
    s = [" ".join(["w"] * 10)] * 5
    assert [len(g) for g in chunking.pack_sentences(s, 20, 1, 0)] == [2, 2, 2, 2]
    assert [len(g) for g in chunking.pack_sentences(s, 20, 0, 16)] == [2, 3]
    assert chunking.pack_sentences(["x " * 50], 20, 1, 16) == [["x " * 50]]
    assert chunking.pack_sentences([], 20, 1, 16) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=20), st.integers(5, 40))
def test_packing_covers(sizes, most):
    s = [f"{i} " + "x " * (n - 1) for i, n in enumerate(sizes)]
    flat = [x for g in chunking.pack_sentences(s, most, 0, 4) for x in g]
    assert flat == s


def test_packing_goes_on_where_an_overlap_and_the_next_sentence_pass_the_limit():
    s = [f"{i} " + "x " * 11 for i in range(4)]
    assert chunking.pack_sentences(s, 20, 1, 0) == [s[:1], s[:2], s[1:3], s[2:]]


def test_packing_keeps_a_short_tail_after_a_group_shorter_than_the_overlap():
    assert chunking.pack_sentences(["a b c d", "e"], 4, 3, 9) == [["a b c d", "e"]]


def packed_by_a_fold(sentences, most, overlap, least):
    groups, held, first = [], [], 0
    for i, s in enumerate(sentences):
        if held and sum(len(x.split()) for x in [*held, s]) > most:
            groups.append(held)
            held, first = held[-overlap:] if overlap else [], i
        held = [*held, s]
    if groups and sum(len(x.split()) for x in held) < least:
        return [*groups[:-1], groups[-1] + sentences[first:]]
    return [*groups, held] if held else groups


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=20), st.integers(5, 40), st.integers(0, 3), st.integers(0, 20))
def test_packing_is_a_fold_with_overlaps(sizes, most, overlap, least):
    s = [f"{i} " + "x " * (n - 1) for i, n in enumerate(sizes)]
    assert chunking.pack_sentences(s, most, overlap, least) == packed_by_a_fold(s, most, overlap, least)


def test_section_chunkers(spark):
    rows_ = [(1, 0, "Alpha one here. Alpha two here.", ["A"], 0), (1, 1, "Beta one here. Beta two here.", ["B"], 40), (2, 0, None, None, 0)]
    df = spark.createDataFrame(rows_, "doc_id long, section_no int, text string, heading_path array<string>, start_char int")
    got = chunking.sentence(df, 6, 0, 1).orderBy("ordinal").collect()
    assert {tuple(r.heading_path) for r in got} == {("A",), ("B",)} and [r.ordinal for r in got] == [0, 1]
    kids = chunking.parent_child(df, child_most=3).orderBy("ordinal").collect()
    assert [r.ordinal for r in kids] == list(range(len(kids))) and all(r.text in r.parent_text for r in kids)
    assert chunking.semantic(df, least=1).count() >= 2
    with pytest.raises(ValueError):
        chunking.chunker("none")


def test_parents_of_sentences_meet_no_join(spark):
    text = " ".join(f"Sentence {i} has {'many ' * (i % 9)}words." for i in range(60))
    rows_ = [(d, n, text[d * 7 :], ["A"], 5) for d in range(3) for n in range(2)] + [(4, 0, None, None, 0), (5, 0, "", None, 0)]
    df = spark.createDataFrame(rows_, "doc_id long, section_no int, text string, heading_path array<string>, start_char int")
    other = lambda rows, most: chunking.sentence(rows, most)
    got, want = (chunking.parent_child(df, c, c, parent_most=100, child_most=30) for c in (chunking.sentence, other))
    assert got.schema == want.schema and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 60
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_semantic_cut():
    s = ["drain drain pipe", "drain pipe drain", "tax form tax", "tax form form"]
    assert chunking.semantic_groups(s, embedding.hash_embedding, 60, 0, 100, 2) == [s[:2], s[2:]]


def test_hash_embedding():
    v = embedding.hash_embedding("a b c")
    assert v.shape == (384,) and abs(np.linalg.norm(v) - 1) < 1e-6 and not embedding.hash_embedding("!").any()


def test_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "item_id int, vec array<float>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 100, 200)], "query_id int, vec array<float>")
    for metric in vector.METRICS:
        got = {(r.query_id, r["rank"]): r.item_id for r in vector.search(q, base, 5, metric).collect()}
        s = vector.scores(x[[0, 100, 200]].astype(float), x.astype(float), metric)
        for j, i in enumerate((0, 100, 200)):
            assert [got[i, r] for r in range(1, 6)] == list(np.argsort(-np.round(s[j], 9), kind="stable")[:5])
    assert all(r.query_id != r.item_id for r in vector.search(q, base, 3, skip_self=True).collect())
    assert vector.scores(np.array([[3.0, 4.0]]), np.array([[0.0, 0.0]]), "euclidean")[0, 0] == -5
    assert vector.scores(np.array([[0.0, 0.0]]), np.array([[1.0, 0.0]]), "cosine")[0, 0] == 0
    assert vector.search(q.limit(0), base, 3).count() == 0


def test_upsert(spark):
    w = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [2.0]), ("b", None, [3.0])], "chunk_id string, upserted_at int, vec array<float>")
    assert {r.chunk_id: r.vec for r in vector.upserted(w).collect()} == {"a": [2.0], "b": [3.0]}


def test_bm25(spark):
    items = spark.createDataFrame([(1, "drain drain repair"), (2, "drain"), (3, "tap"), (4, None)], "item_id int, text string")
    q = spark.createDataFrame([("q", "drain drain"), ("z", "unknown"), ("s", "repair")], "query_id string, text string")
    got = {(r.query_id, r.item_id): r.score for r in lexical.search(q, items, 10).collect()}
    assert set(got) == {("q", 1), ("q", 2), ("s", 1)} and min(got.values()) > 0
    n, mean = 4, (3 + 1 + 1) / 4
    idf = math.log(1 + (n - 2 + 0.5) / 2.5)
    want = 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / mean))
    assert abs(got["q", 1] - want) < 1e-8


@pytest.mark.parametrize("cells", [40, 2_000_000])
def test_bm25_scores_where_items_lie(spark, monkeypatch, cells):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{i}" for i in rng.zipf(1.4, n) % 40)
    texts = [text(1 + i % 9) for i in range(90)]
    made = [(["x", "y", None][i % 3], f"i{i * 7 % 300:03}", None if i == 5 else texts[i % 90]) for i in range(300)]  # equal texts tie
    items = spark.createDataFrame(made, "part string, item_id string, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", text(5)) for i in range(12)] + [("none", "zzz"), ("null", None)], "query_id string, text string")
    conditions = {"a": (1.5, 0.75), "b": (0.4, 0.0)}
    monkeypatch.setattr(lexical, "CELLS", cells)

    def got():
        best = lexical.ranked(lexical.scores(queries, items.drop("part"), settings=conditions, k=4), 4, ["condition"])
        every = lexical.scores(queries, items, by=["part"])
        return every, [rows(every), rows(lexical.search(queries, items, 4, ["part"])), rows(best)]

    here, one = got()
    assert "Exchange" not in here._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lexical, "ASKED_ROWS", 0)
    joined, other = got()
    assert "Exchange" in joined._jdf.queryExecution().executedPlan().toString()
    for x, y in zip(one, other):
        assert len(x) > 80 and [r[:-2] for r in x] == [r[:-2] for r in y]
        assert all(a == pytest.approx(b, abs=2e-9) for r, q in zip(x, y) for a, b in zip(r[-2:], q[-2:]) if isinstance(a, float))


def test_bm25_counts_a_repeated_item_once_and_exchanges_no_text(spark, monkeypatch):
    made = [("x", f"i{i}", f"tap w{i % 3}") for i in range(20)]
    queries = spark.createDataFrame([("q", "tap w1"), ("r", "w2")], "query_id string, text string")
    once, twice = (spark.createDataFrame(m, "part string, item_id string, text string").repartition(4) for m in (made, made + made))
    plans, written = [], lexical.materialize

    def kept(df, tag):
        plans.append((tag, df._jdf.queryExecution().optimizedPlan().toString()))
        return written(df, tag)

    monkeypatch.setattr(lexical, "materialize", kept)
    for bound in (lexical.ASKED_ROWS, 0):
        monkeypatch.setattr(lexical, "ASKED_ROWS", bound)
        assert rows(lexical.scores(queries, twice, by=["part"], repeated=True)) == rows(lexical.scores(queries, once, by=["part"]))
        assert rows(lexical.search(queries, twice, 5, repeated=True)) == rows(lexical.search(queries, once, 5))
    plan = next(p for tag, p in plans if tag == "words")
    assert plan.index("RepartitionByExpression") < plan.index("MapInArrow")  # the exchange is above the counting


@pytest.mark.parametrize("read", ["evaluation", "audits"])
def test_searched_chunks_are_exchanged_as_counts(spark, tmp_path, monkeypatch, read):
    made = [(f"{i}:x", i, "fixed", f"tap w{i % 3}", 0, 9) for i in range(200)]
    spark.createDataFrame(made + made, "chunk_id string, doc_id long, strategy string, text string, start_char int, end_char int").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(i, f"tap w{i % 3}", "tap") for i in range(200)], "doc_id long, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = "doc_id long, fetched_at timestamp, id long, url string, title string, sections array<struct<heading_path: array<string>, start_char: int, end_char: int>>"
    spark.createDataFrame([], pages).write.parquet(f"{tmp_path}/pages.parquet")
    plans, written = {}, lexical.materialize

    def kept(df, tag):
        plans[tag] = df._jdf.queryExecution().optimizedPlan().toString()
        return written(df, tag)

    monkeypatch.setattr(lexical, "materialize", kept)
    if read == "evaluation":
        assert {r.score for r in evaluation._ndcg(spark, str(tmp_path)).collect()} <= {0.0, 1.0}
    else:
        assert [(r.item_id, r.rank) for r in audits._retrieved(spark, str(tmp_path)).where("query_id = 'q0'").orderBy("rank").collect()] == [(f"{i}:x", r + 1) for r, i in enumerate([0, 102, 105, 108, 111])]
    below = plans["words"][plans["words"].index("MapInArrow"):]
    assert "Aggregate" not in below and "Repartition" not in below


def test_bm25_lists_an_item_in_one_run_with_equal_scores_together(spark):
    queries = spark.createDataFrame([(f"q{i}", f"tap w{i % 3}" if i % 2 else "drain") for i in range(12)], "query_id string, text string")
    items = spark.createDataFrame([(i, f"tap drain w{i % 3}") for i in range(40)], "item_id int, text string").coalesce(1)
    got = [(r.item_id, r.score) for r in lexical.scores(queries, items).collect()]
    runs = [x for i, x in enumerate(got) if i == 0 or x != got[i - 1]]
    assert len(got) == 480 and len(runs) == len(set(runs)) == len(set(got))


def test_bm25_without_rows(spark):
    items, queries = spark.createDataFrame([(1, "a tap")], "item_id long, text string"), spark.createDataFrame([("q", "tap")], "query_id string, text string")
    assert lexical.search(queries.limit(0), items).count() == lexical.search(queries, items.limit(0)).count() == 0
    assert lexical.search(queries, items).count() == 1


def ranking(spark, spec):
    return spark.createDataFrame([("q", i, s, r + 1) for r, (i, s) in enumerate(spec)], "query_id string, item_id string, score double, rank int")


def test_fusion(spark):
    a, b = ranking(spark, [("x", 9.0), ("y", 5.0), ("z", 1.0)]), ranking(spark, [("z", 3.0), ("x", 2.0)])
    rrf = fusion.reciprocal_rank(a, b).orderBy("rank").collect()
    assert [r.item_id for r in rrf] == ["x", "z", "y"] and abs(rrf[0].score - (1 / 61 + 1 / 62)) < 1e-9
    assert [r.item_id for r in fusion.weighted(a, b, 1.0).orderBy("rank").collect()][:2] == ["x", "y"]
    assert fusion.weighted(a, b, 0.0).orderBy("rank").first().item_id == "z"
    tied = ranking(spark, [("x", 1.0), ("y", 1.0)])
    assert all(r.score > 0 for r in fusion.weighted(tied, tied, 0.5).collect())
    with pytest.raises(ValueError):
        fusion.weighted(a, b, 1.5)


def test_metrics(spark):
    r = ranking(spark, [(x, 1.0) for x in "abcde"])
    rel = spark.createDataFrame([("q", x, 1) for x in "bdf"] + [("empty", "a", 1)], "query_id string, item_id string, grade int")
    got = {(x.query_id, x.metric, x.k): x.score for x in relevance.ranking_metrics(r, rel, (1, 2, 5, 10)).collect()}
    assert got["q", "precision", 5] == pytest.approx(0.4) and got["q", "precision", 10] == pytest.approx(0.2) and got["q", "precision", 1] == 0
    assert got["q", "recall", 5] == pytest.approx(2 / 3) and got["q", "mrr", 5] == 0.5 and got["q", "mrr", 1] == 0
    assert got["q", "map", 5] == pytest.approx((1 / 2 + 2 / 4) / 3) and got["q", "hit", 2] == 1 and got["q", "hit", 1] == 0
    assert got["q", "ndcg", 5] == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3) + 1 / 2))
    assert got["empty", "ndcg", 10] == 0
    with pytest.raises(ValueError):
        relevance.ranking_metrics(r, rel, metrics=("f1",))


def test_projection(spark):
    spans = spark.createDataFrame([("q1", 1, 10, 20, 1, None), ("q2", 1, 0, 0, 2, "third fact here"), ("q3", 1, 500, 600, 1, None)], "query_id string, doc_id int, start_char int, end_char int, grade int, text string")
    chunks = spark.createDataFrame([("c1", 1, 0, 16, "first fact"), ("c2", 1, 16, 40, "the THIRD fact  here")], "chunk_id string, doc_id int, start_char int, end_char int, text string")
    got = rows(relevance.covered(spans, chunks, [0.5, 0.7]).select("least", "query_id", "chunk_id", "grade"))
    assert got == [(0.5, "q1", "c1", 1), (0.5, "q2", "c2", 2), (0.7, "q2", "c2", 2)]
    s = {r.least: r for r in relevance.projection_summary(spans, relevance.covered(spans, chunks, [0.5, 0.7])).collect()}
    assert s[0.5].n_unmatched == 1 and s[0.7].match_rate == pytest.approx(1 / 3, abs=1e-6)
    with pytest.raises(ValueError):
        relevance.covered(spans, chunks, 0.0)


def test_agreement(spark):
    k = lambda p: relevance.agreement(spark.createDataFrame(p, "a boolean, b boolean")).first()
    assert k([(True, True), (False, False), (True, True)]).kappa == 1 and k([(False, False)] * 10).kappa == 1
    assert k([(True, False), (False, True)]).kappa < 0 and math.isnan(k([]).kappa)
    c = k([(True, True), (True, False), (False, True), (False, False)])
    assert (c.both, c.only_a, c.only_b, c.neither) == (1, 1, 1, 1)


def test_pooling(spark):
    r = spark.createDataFrame([("q", 1, "a", 1), ("q", 1, "b", 2), ("q", 2, "b", 1), ("q", 2, "c", 2)], "query_id string, system_no int, item_id string, rank int")
    assert [x.item_id for x in relevance.pooled(r, 2).orderBy("place").collect()] == ["a", "b", "c"]


def test_holm(spark):
    t = lambda ps: [round(r.p_adjusted, 9) for r in statistics.holm(spark.createDataFrame(list(enumerate(ps)), "i int, p_value double"), order=["i"]).orderBy("i").collect()]
    assert t([0.01, 0.04, 0.05]) == [0.03, 0.08, 0.08] and t([0.05, 0.01]) == [0.05, 0.02] and t([0.03]) == [0.03]
    with pytest.raises(Exception, match="p-values"):
        t([1.5])


def test_wilcoxon():
    # by enumeration of all sign patterns
    for n in (3, 5, 6):
        d = np.arange(1, n + 1) * np.where(np.arange(n) % 3 == 0, -1, 1).astype(float)
        plus = d[d > 0].sum()
        all_ = [sum(r for r, bit in zip(range(1, n + 1), format(m, f"0{n}b")) if bit == "1") for m in range(2**n)]
        lo, hi = np.mean(np.array(all_) <= plus), np.mean(np.array(all_) >= plus)
        assert statistics.wilcoxon_p(d)[1] == pytest.approx(min(1, 2 * min(lo, hi)))
        assert statistics.wilcoxon_p(d, "greater")[1] == pytest.approx(hi)
    assert statistics.wilcoxon_p(np.zeros(20)) == (0.0, 1.0)
    assert statistics.wilcoxon_p(np.r_[np.ones(40), -np.ones(3)])[1] < 1e-6


def test_bootstrap():
    assert statistics.bootstrap_interval(np.full(30, 0.2)) == (0.2, 0.2)
    d = np.random.default_rng(1).normal(size=30)
    assert statistics.bootstrap_interval(d) == statistics.bootstrap_interval(d)
    assert math.isnan(statistics.bootstrap_interval(np.zeros(0))[0])


def test_comparison(spark):
    s = [(c, f"q{i}", "ndcg", float(v)) for i in range(12) for c, v in (("a", i / 12), ("b", i / 12 + (0.1 if i % 4 else 0)), ("c", i / 12))]
    got = {(r.a, r.b): r for r in statistics.compared(spark.createDataFrame(s, "condition string, query_id string, metric string, score double")).collect()}
    assert got["a", "c"].p_value == 1 and got["a", "c"].n_ties == 12 and got["a", "b"].significant and got["a", "b"].n_wins_b == 9
    pairs = spark.createDataFrame([("m", "a", "b", str(i), float(i + 4), float(i + 1)) for i in range(0, 1)] + [("m", "a", "b", "x", 9.0, 2.0)], "metric string, a string, b string, query_id string, x double, y double")
    assert statistics.cliffs_delta(pairs).first().delta == 1


def test_nnls(spark):
    rng = np.random.default_rng(2)
    x = rng.random((60, 4))
    y = x @ np.array([0.7, 0.0, 0.3, 0.0]) - 0.2 * x[:, 1]
    w = statistics.nnls(x.T @ x, x.T @ y)
    g = x.T @ y - x.T @ x @ w
    assert (w >= 0).all() and (g <= 1e-7).all() and abs(w @ g) < 1e-7
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, y double")
    fit = statistics.fitted_weights(df, ["a", "b", "c", "d"], "y")
    assert abs(sum(fit["weights"].values()) - 1) < 1e-9 and fit["weights"]["a"] > fit["weights"]["c"] > 0
    assert statistics.fitted_weights(df.limit(4), ["a", "b", "c", "d"], "y")["weights"] is None


def test_correlations(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0)], "a double, b double, c double")
    got = {(r.a, r.b): r.r for r in statistics.correlations(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == 1 and math.isnan(got["a", "c"])


def test_signals(spark):
    page = '<html><script type="application/ld+json">{"@type":"LocalBusiness","address":{"@type":"PostalAddress"}}</script><script type="application/ld+json">{bad</script><h1>A</h1><h2>B</h2><p>x</p><a href="https://b.example/">l</a></html>'
    df = spark.createDataFrame([(1, "u", "Drain repair is quick. According to us, 82 percent in 2021.", page), (2, "u", None, None)], "doc_id int, url string, text string, html string")
    chunks = spark.createDataFrame([(1, "Drains are here."), (1, "It also works."), (1, " ")], "doc_id int, text string")
    got = {r.doc_id: r for r in signals.measured(df, chunks, "html").collect()}
    a = got[1]
    assert a.schema_coverage == 0.5 and a.heading_structure == 1 and a.self_containedness == pytest.approx(1 / 3) and a.freshness == 0.5 and a.n_citations == 2 and a.n_statistics == 1 and a.answer_directness == 0.5
    assert all(0 <= got[2][n] <= 1 for n in signals.NAMES) and got[2].warnings
    s = signals.scored(signals.measured(df, chunks, "html")).where("doc_id = 1").first()
    assert abs(sum(s.contributions.values()) - s.score) < 0.05 and set(s.advice) == {n for n in signals.NAMES if a[n] < 0.5}
    dated = df.withColumn("published_at", F.lit("2024-01-01"))
    assert signals.measured(dated).where("doc_id = 1").first().freshness == 1


def test_answers(spark):
    r = ranking(spark, [("c0", 1.0), ("c1", 1.0), ("c2", 1.0)])
    a = spark.createDataFrame([("q", "It is fast [1]. They vary [2][3]. Odd [7]. Twice [1][1]."), ("e", "")], "query_id string, answer_text string")
    s = answers.answer_sentences(a, r)
    assert [x.cited for x in s.orderBy("sent_no").collect()] == [["c0"], ["c1", "c2"], [], ["c0"]]
    t = spark.createDataFrame([("T", "c0"), ("O", "c1")], "target string, item_id string")
    v = {x.target: x for x in answers.impressions(s, t, "none").collect()}
    assert v["T"].first_position == 1 and v["T"].word_share == v["T"].position_share and v["T"].citation_share == 0.5
    q = spark.createDataFrame([("q",), ("e",)], "query_id string")
    vis = {x.target: x.visibility for x in answers.visibility(answers.impressions(s, t), t.unionByName(spark.createDataFrame([("N", "z")], "target string, item_id string")), q).collect()}
    assert vis["N"] == 0 and 0 < vis["O"] < vis["T"] < 1


def test_questions(spark):
    p = spark.createDataFrame(
        [("u1", 1, 0, 0, 9, "Drain repair costs 90 credits within hours and more words follow", ["Drains"]), ("u2", 2, 0, 0, 9, "The boiler boiler valve sits quietly", None), ("u3", 3, 0, 0, 9, "Separate rates without a digit", ["Drains"])],
        "chunk_id string, doc_id int, ordinal int, start_char int, end_char int, text string, heading_path array<string>")
    got = {r.text: r.doc_id for r in questions.generated(p).collect()}
    assert got["how much does drains cost"] == 1 and got["how long does drains take"] == 1 and got["what is drains"] == 3 and got["what is boiler sits quietly"] == 2
    assert [r.focus for r in questions.focus(p).where("chunk_id = 'u2'").collect()] == ["boiler sits quietly"]
    raw = spark.createDataFrame([('```json\n["a", "b"]\n```',), ("Sure: [\"c\"]",), ("none",)], "r string")
    assert [r[0] for r in raw.select(questions.answers_of(F.col("r"))).collect()] == [["a", "b"], ["c"], None]


def test_crawl_follows_long_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(53)], "src int, dst int").coalesce(1)
    assert rows(extraction.reachable(e, spark.createDataFrame([(0,)], "node int"))) == [(i, i) for i in range(54)]


def test_questions_of_headless_passages(spark, monkeypatch):
    words = "Quartz marble granite sits here " + "and more plain words follow " * 3
    made = [("a", 1, ["Drains"]), ("b", 2, None), ("c", 3, []), ("d", 4, None)]
    texts = {"a": words, "b": words, "c": "Copper brass bronze tin lies here " + "so other plain words stand " * 3, "d": "Too short"}
    chunks = spark.createDataFrame([(c, i, "sentence", 0, 0, 9, texts[c], h) for c, i, h in made], "chunk_id string, doc_id int, strategy string, ordinal int, start_char int, end_char int, text string, heading_path array<string>")
    monkeypatch.setattr(retrieval.C, "chunks", lambda s, d: chunks)
    got = {r.chunk_id: r.text for r in retrieval.qg_heuristic(spark, "").collect()}
    # the first sentence's terms by count times idf, in reading order
    assert set(got) == {"a", "b", "c"} and got["a"] == "what is drains" and got["b"] == "what is granite more follow" and got["c"] == "what is so other stand"
    r = retrieval.qg_report(spark, "").first()
    assert (r.n_units, r.n_units_too_short, r.n_generated + r.n_dropped_overlap) == (3, 1, 3)


def test_collinear_leaves_out_signals_without_variance(spark, monkeypatch):
    rows_ = [(float(i), float(i % 3), *[1.0] * 8) for i in range(30)]
    monkeypatch.setattr(audits, "_measured", lambda s, d: s.createDataFrame(rows_, list(audits.FITTED)))
    got = audits.cal_collinear(spark, "").collect()
    assert [(r.a, r.b) for r in got] == [tuple(audits.FITTED[:2])] and 0.05 <= got[0].r < 1


def test_grid_crosses_chunkers_with_dense_and_hybrid(spark, monkeypatch):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"w{i}" for i in rng.zipf(1.5, n) % 60)
    made = [(f"{s}{i:02}", i, s, text(12), 0, 100) for s in ("fixed", "parent") for i in range(60)]
    chunks = spark.createDataFrame(made, "chunk_id string, doc_id int, strategy string, text string, start_char int, end_char int")
    asked = [(f"q{i}", text(4), i) for i in range(6)]
    queries = spark.createDataFrame(asked, "query_id string, text string, doc_id int")
    spans = queries.select("query_id", "doc_id", F.lit(0).alias("start_char"), F.lit(100).alias("end_char"), F.lit(1).alias("grade"), F.lit(None).cast("string").alias("text"))
    for name, df in (("chunks", chunks), ("query_set", queries), ("span_set", spans)):
        monkeypatch.setattr(evaluation.C, name, lambda s, d, df=df: df)
    got = {(r.condition, r.k): r["mean"] for r in evaluation.hx_grid(spark, "").collect() if r.metric == "mrr"}
    bm = {}
    for r in lexical.search(queries, chunks.select("strategy", F.col("chunk_id").alias("item_id"), "text"), 40, by=["strategy"]).collect():
        bm.setdefault((r.strategy, r.query_id), {})[r.item_id] = r["rank"]
    want = {}
    for s in ("fixed", "parent"):
        for q, words, i in asked:
            v = embedding.hash_embedding(words)
            near = sorted((-round(float(v @ embedding.hash_embedding(m[3])), 6), m[0]) for m in made if m[2] == s)
            dense = {c: n for n, (_, c) in enumerate(near[:40], 1)}
            both = sorted((-round(sum(1 / (60 + a[c]) for a in (dense, bm[s, q]) if c in a), 12), c) for c in {*dense, *bm[s, q]})
            fused = {c: n for n, (_, c) in enumerate(both[:10], 1)}
            for arm, at in (("dense", dense), ("hybrid", fused)):
                n = at.get(f"{s}{i:02}", 99)
                want.setdefault(f"{s}+{arm}", []).append(1 / n if n <= 10 else 0)
    assert {c for c, _ in got} == set(want) and len(got) == 16
    assert all(got[c, 10] == pytest.approx(np.mean(x), abs=1e-6) for c, x in want.items()) and sum(map(sum, want.values())) > 0


def test_approximate_recall(spark):
    x = np.random.default_rng(6).normal(size=(1000, 64))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id int, vec array<double>")
    queries = base.where("item_id < 100").withColumnRenamed("item_id", "query_id")
    true = {(r.query_id, r.item_id) for r in vector.search(queries, base, 10, skip_self=True).collect()}
    got = {(r.query_id, r.item_id) for r in vector.approximate(queries, base, 10).collect()}
    assert len(true & got) / len(true) >= 0.95


def test_equivalence(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(25, 6))
    x[:20] = x[0]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "item_id int, vec array<double>")
    r = equivalence.compared(base.limit(1).withColumnRenamed("item_id", "query_id"), base).first()
    assert r.tied and r.identical and r.tau == 1
    assert equivalence.kendall_tau(np.array([1.0, 2, 3]), np.array([3.0, 2, 1])) == -1 and equivalence.kendall_tau(np.ones(3), np.arange(3.0)) == 1


def test_equivalence_takes_every_item(spark):
    rng = np.random.default_rng(3)
    # half the items lie across the query's direction and are long: their dot products lead, their cosines trail
    x = rng.normal(size=(2400, 6)) * np.where(np.arange(2400) % 2, 1.0, 40.0)[:, None]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id int, vec array<double>")
    r = equivalence.compared(base.limit(1).withColumnRenamed("item_id", "query_id"), base).first()
    a, b = (equivalence.quantised(np.round(vector.scores(x[:1], x, m)[0], 12)) for m in ("cosine", "dot"))
    s = np.sign(a[:, None] - a) * np.sign(b[:, None] - b)
    tied = np.sqrt(float((a[:, None] != a).sum()) * float((b[:, None] != b).sum()))
    assert r.tau == pytest.approx(s.sum() / tied, abs=1e-9) and not r.identical
    for n in (1, 2, 7, 300):
        a, b = rng.integers(0, 9, n).astype(float), rng.integers(0, 9, n).astype(float)
        s = np.sign(a[:, None] - a) * np.sign(b[:, None] - b)
        tied = np.sqrt(float((a[:, None] != a).sum()) * float((b[:, None] != b).sum()))
        assert equivalence.kendall_tau(a, b) == pytest.approx(s.sum() / tied if tied else 1.0)


def test_quantised_scores_of_every_item(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(1500, 64))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.query_id, r.item_id): r.quantised for r in evaluation.eq_quant(spark, str(tmp_path)).collect()}
    assert len(got) == 15 * 1500
    for i in range(0, 1500, 500):
        want = equivalence.quantised(np.round(vector.scores(x[i : i + 1], x, "dot")[0], 9))
        assert np.allclose([got[i, j] for j in range(1500)], want, atol=1e-9)


def calls(spark, spec):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, c, t0 + timedelta(seconds=s)) for i, (c, s) in enumerate(spec)], "call_id int, caller string, ts timestamp")


def test_bucket(spark):
    got = metering.token_bucket(calls(spark, [("a", 0)] * 70 + [("b", 0), (None, 5)]), 60, 5).orderBy("call_id").collect()
    assert [r.allowed for r in got[:70]] == [True] * 65 + [False] * 5 and got[69].retry_after >= 1 and got[70].allowed
    assert metering.token_bucket(calls(spark, []), 60, 5).count() == 0
    got = metering.token_bucket(calls(spark, [("a", 0), ("a", 0), ("a", 61)]), 1, 0).orderBy("call_id").collect()
    assert [r.allowed for r in got] == [True, False, True]


def test_counters(spark):
    e = spark.createDataFrame([(1, "x", datetime(2024, 1, 31)), (1, "x", datetime(2024, 2, 1)), (2, "y", None)], "user_id int, event_type string, ts timestamp")
    assert {(r.user_id, r.period, r.metric): r.used for r in metering.usage(e).collect()}[1, "2024-02", "x"] == 1
    z = rows(metering.zero_filled(metering.usage(e), e, ["x", "y", "z"], "user_id"))
    assert z == [(1, "x", 2.0), (1, "y", 0.0), (1, "z", 0.0), (2, "x", 0.0), (2, "y", 1.0), (2, "z", 0.0)]
    with pytest.raises(ValueError):
        metering.page_of(e, ["user_id"], 0, 101)


def test_stale_changes(spark):
    c = spark.createDataFrame([(1, "o", 1, 10), (2, "o", 2, 30), (3, "o", 3, 20), (4, "p", 1, None)], "id int, org string, arrived int, version int")
    assert [r.stale for r in metering.latest_state(c, "org", "version").orderBy("id").collect()] == [False, False, True, False]
