"""Queries of judgments, ranking metrics, statistics, experiments, agreement and metric equivalence."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.operators import equivalence, lexical, relevance, statistics
from corvane.plans import experiment
from corvane.queries import common as C
from corvane.queries.retrieval import _embedded
from corvane.runtime import materialize, shared_dir
from corvane.sources import files
from corvane.sources.files import table


def _qrels(s, d, least=0.5):
    return relevance.covered(C.span_set(s, d), C.chunks(s, d), least)


def prj_covers(s, d):
    """Spans that have a text only: titles found whole or in part in the chunks of their document."""
    spans = C.query_set(s, d).select("query_id", "doc_id", F.lit(0).alias("start_char"), F.lit(0).alias("end_char"), F.lit(1).alias("grade"), "text")
    return relevance.covered(spans, C.chunks(s, d), 0.5).drop("least")


def prj_query(s, d):
    return _qrels(s, d).drop("least")


def prj_set(s, d):
    q = materialize(_qrels(s, d, [0.3, 0.5, 0.7]), "qrels")
    return relevance.projection_summary(C.span_set(s, d), q)


def qr_sens(s, d):
    return _qrels(s, d, [0.3, 0.5, 0.7]).groupBy("least").agg(F.count(F.lit(1)).alias("n"), F.sum("grade").alias("grades"))


def qr_judged(s, d):
    return relevance.judged(C.query_set(s, d), _qrels(s, d)).select("query_id")


def qr_prov(s, d):
    q = C.query_set(s, d).withColumn("provenance", F.when(F.col("doc_id") % 200 == 0, "human").otherwise("synthetic"))
    return q.where("provenance = 'human'").select("query_id", "provenance")


def _scores(s, d, metrics=relevance.METRICS):
    chunks = C.chunks(s, d)
    return experiment.scores(experiment.lexical_rankings(C.query_set(s, d), chunks), experiment.judgments(C.span_set(s, d), chunks), metrics=metrics)


def met_precision(s, d):
    return _scores(s, d, ("precision",))


def met_recall(s, d):
    return _scores(s, d, ("recall",))


def met_hit(s, d):
    return _scores(s, d, ("hit",))


def met_mrr(s, d):
    return _scores(s, d, ("mrr",))


def met_map(s, d):
    return _scores(s, d, ("map",))


def met_ndcg(s, d):
    return _scores(s, d, ("ndcg",))


def met_eval(s, d):
    return _scores(s, d)


#: Conditions that are compared on one collection: BM25 with these k1 and b.
CONDITIONS = {"b75": (1.5, 0.75), "flat": (1.5, 0.0), "low": (0.4, 0.75)}


def _ndcg(s, d):
    """Per-query ndcg at 10 of the conditions over all chunks."""
    items = table(s, d, "chunks").select(F.col("chunk_id").alias("item_id"), "text")
    qrels = relevance.covered(C.span_set(s, d), C.chunks(s, d)).select("query_id", F.col("chunk_id").alias("item_id"), "grade")
    names = F.explode(F.array(*[F.lit(n) for n in CONDITIONS]))
    rankings = lexical.ranked(lexical.scores(C.query_set(s, d), items, settings=CONDITIONS, k=10, repeated=True).where("score > 0"), 10, ["condition"])
    judged = qrels.withColumn("condition", names)
    per = experiment.scores(rankings, judged, metrics=("ndcg",))
    return materialize(per.where("k = 10").select("condition", "query_id", "metric", "score"), "ndcg")


def st_paired(s, d):
    return statistics.described(statistics.paired(_ndcg(s, d)))


def st_wilcoxon(s, d):
    return statistics.signed_ranks(statistics.paired(_ndcg(s, d)))


def st_bootstrap(s, d):
    return statistics.tested(statistics.paired(_ndcg(s, d)))


def st_cliffs(s, d):
    return statistics.cliffs_delta(statistics.paired(_ndcg(s, d)))


def st_holm(s, d):
    p = table(s, d, "sites").select("id", "org_id", ((F.col("id") * 37 % 101) / 2020).alias("p_value"))
    return statistics.holm(p, family=["org_id"], order=["id"]).select("id", "org_id", F.round("p_adjusted", 9).alias("p_adjusted"))


def st_correct(s, d):
    p = statistics.holm(table(s, d, "sites").select("id", "org_id", ((F.col("id") * 37 % 101) / 2020).alias("p_value"), ((F.col("id") * 13 % 21 - 10) / 10).alias("delta")), family=["org_id"], order=["id"])
    return p.select("id", (F.col("p_adjusted") < 0.05).alias("significant"), statistics.effect_label(F.col("delta")).alias("effect"))


def st_summary(s, d):
    c = statistics.described(statistics.paired(_ndcg(s, d)))
    return c.select("a", "b", F.format_string("%s vs %s on %s: %d queries, %d ties", "a", "b", "metric", "n", "n_ties").alias("line"))


def hx_run(s, d):
    return experiment.run(C.query_set(s, d), C.span_set(s, d), C.chunks(s, d))


def hx_common(s, d):
    return statistics.common_queries(_ndcg(s, d))


def hx_compare(s, d):
    """All pairs of the BM25 settings of CONDITIONS with tests, effect sizes and adjusted p-values."""
    return statistics.compared(_ndcg(s, d))


def hx_agg(s, d):
    return experiment.means(hx_run(s, d))


def hx_report(s, d):
    return experiment.table(hx_run(s, d))


def hx_grid(s, d):
    """Means of every strategy under dense search and under its fusion with BM25."""
    return experiment.means(experiment.grid(C.query_set(s, d), C.span_set(s, d), C.chunks(s, d)))


def snk_runs(s, d):
    """Per-query scores written by condition and read back."""
    path = f"{shared_dir(s)}/runs-{uuid.uuid4().hex}"
    files.write_runs(hx_run(s, d), path)
    return files.read_runs(s, path)


def snk_exp(s, d):
    """Experiments kept as two tables, a row per condition and a row per query and metric, appended and read back joined."""
    path = f"{shared_dir(s)}/experiments-{uuid.uuid4().hex}"
    files.append_experiment(hx_run(s, d), path, "e1")
    runs, records = files.read_experiment(s, path, "e1")
    return records.join(runs.select("run_id", "condition"), "run_id").groupBy("condition", "metric", "k").agg(F.count(F.lit(1)).alias("n_records"), F.round(F.avg("score"), 9).alias("mean"))


def rel_experiment(s, d):
    """A stored experiment read by its id: its conditions compared in pairs over the queries they share."""
    path = f"{shared_dir(s)}/experiments-{uuid.uuid4().hex}"
    files.append_experiment(_ndcg(s, d).withColumn("k", F.lit(10)), path, "e1")
    runs, records = files.read_experiment(s, path, "e1")
    return statistics.described(statistics.paired(records.join(runs.select("run_id", "condition"), "run_id").select("condition", "query_id", "metric", "score")))


def _labels(s, d):
    return C.documents(s, d).select((F.col("n_chars") > 3000).alias("a"), (F.char_length("title") > 50).alias("b"))


def ag_kappa(s, d):
    return relevance.agreement(_labels(s, d)).select(F.round("observed", 9).alias("observed"), F.round("expected", 9).alias("expected"), F.round("kappa", 9).alias("kappa"))


def ag_cells(s, d):
    return relevance.agreement(_labels(s, d)).select("n", "both", "only_a", "only_b", "neither")


def ag_interp(s, d):
    return relevance.agreement(_labels(s, d)).select("label")


def ag_pool(s, d):
    r = experiment.lexical_rankings(C.query_set(s, d), C.chunks(s, d))
    no = F.when(F.col("condition") == "fixed", 1).when(F.col("condition") == "parent", 2).when(F.col("condition") == "semantic", 3).otherwise(4)
    return relevance.pooled(r.withColumn("system_no", no), 5)


def eq_tau(s, d):
    q, b = _embedded(s, d)
    return equivalence.compared(q, b, "cosine", "dot").select("query_id", F.round("tau", 6).alias("tau"))


def eq_order(s, d):
    q, b = _embedded(s, d)
    return equivalence.compared(q, b, "cosine", "dot").select("query_id", "identical")


def eq_ties(s, d):
    q, b = _embedded(s, d)
    return equivalence.compared(q, b, "cosine", "dot").select("query_id", "tied")


def eq_verify(s, d):
    q, b = _embedded(s, d)
    return equivalence.verdict(equivalence.compared(q, b, "cosine", "dot")).withColumn("mean_tau", F.round("mean_tau", 6))


def eq_quant(s, d):
    """The dot products of each query with every item, quantised to a millionth of the greatest."""
    q, b = _embedded(s, d)
    return equivalence.quantised_scores(q, b, "dot").withColumn("quantised", F.round("quantised", 6))


_SHARE = "(least(c.end_char, sp.end_char) - greatest(c.start_char, sp.start_char))"
_PAIRS = f"{C.CHUNKS}, {C.SPANS}, pr AS (SELECT strategy, query_id, chunk_id, grade, {_SHARE} AS o, sp.end_char - sp.start_char AS l FROM sp JOIN c USING (doc_id))"
_REL = f"{C.CHUNKS}, {C.SPANS}, rel AS (SELECT strategy, query_id, chunk_id AS item_id, MAX(grade) AS grade FROM (SELECT strategy, query_id, chunk_id, grade, {_SHARE} AS o, sp.end_char - sp.start_char AS l FROM sp JOIN c USING (doc_id)) WHERE l > 0 AND o > 0 AND o / l >= 0.5 GROUP BY 1, 2, 3)"
_MET = f"""{C.BM25}, {_REL.replace(C.QUERIES + ',', '').replace(C.CHUNKS + ',', '')},
ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
ideal AS (SELECT strategy, query_id, grade, ROW_NUMBER() OVER (PARTITION BY strategy, query_id ORDER BY grade DESC, item_id) AS rank FROM rel),
i AS (SELECT strategy, query_id, k, COUNT(*) AS n, SUM(CASE WHEN rank <= k THEN (2 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS idcg FROM ideal, ks GROUP BY 1, 2, 3),
hits AS (SELECT bm.strategy, bm.query_id, bm.rank, grade, ROW_NUMBER() OVER (PARTITION BY bm.strategy, bm.query_id ORDER BY rank) AS nth FROM bm JOIN rel ON rel.strategy = bm.strategy AND rel.query_id = bm.query_id AND rel.item_id = bm.item_id),
h AS (SELECT i.strategy, i.query_id, i.k, n, idcg, COUNT(hits.rank) AS h, MIN(hits.rank) AS f, SUM((2 ** grade - 1) / log2(hits.rank + 1)) AS d, SUM(nth / hits.rank) AS a
  FROM i LEFT JOIN hits ON hits.strategy = i.strategy AND hits.query_id = i.query_id AND hits.rank <= i.k GROUP BY 1, 2, 3, 4, 5),
met AS (SELECT strategy AS condition, query_id, k::INTEGER AS k, m.metric, round(m.score, 9) AS score FROM h, LATERAL (SELECT unnest([
  {{'metric': 'precision', 'score': (h.h / h.k)::DOUBLE}}, {{'metric': 'recall', 'score': (h.h / h.n)::DOUBLE}}, {{'metric': 'hit', 'score': (CASE WHEN h.h > 0 THEN 1 ELSE 0 END)::DOUBLE}}, {{'metric': 'mrr', 'score': coalesce(1.0 / h.f, 0)::DOUBLE}},
  {{'metric': 'map', 'score': coalesce(h.a / h.n, 0)::DOUBLE}}, {{'metric': 'ndcg', 'score': coalesce(h.d / nullif(h.idcg, 0), 0)::DOUBLE}}]) AS m))"""
_COND = ", ".join(f"('{n}', {k1}::DOUBLE, {b}::DOUBLE)" for n, (k1, b) in CONDITIONS.items())
_ND = f"""{_REL},
cond AS (SELECT * FROM (VALUES {_COND}) AS t(condition, k1, b)),
tok AS (SELECT chunk_id, {C.sql_tokens("text")} AS t FROM c), tot AS (SELECT COUNT(*) AS n, AVG(len(t)) AS mean FROM tok),
qt AS (SELECT query_id, term, COUNT(*) AS qtf FROM (SELECT query_id, unnest({C.sql_tokens("text")}) AS term FROM q) GROUP BY 1, 2),
post AS (SELECT chunk_id, len, term, COUNT(*) AS tf FROM (SELECT chunk_id, len(t) AS len, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
idf AS (SELECT term, ln(1 + (n - COUNT(*) + 0.5) / (COUNT(*) + 0.5)) AS idf, mean FROM post, tot GROUP BY term, n, mean),
sc AS (SELECT condition, query_id, chunk_id AS item_id, round(SUM(qtf * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / mean))), 9) AS score FROM cond, qt JOIN post USING (term) JOIN idf USING (term) GROUP BY 1, 2, 3),
bm AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY condition, query_id ORDER BY score DESC, item_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 10),
r1 AS (SELECT query_id, item_id, MAX(grade) AS grade FROM rel GROUP BY 1, 2),
idl AS (SELECT query_id, SUM((2 ** grade - 1) / log2(rank + 1)) AS idcg FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY grade DESC, item_id) AS rank FROM r1) WHERE rank <= 10 GROUP BY 1),
dcg AS (SELECT condition, bm.query_id, SUM((2 ** grade - 1) / log2(rank + 1)) AS d FROM bm JOIN r1 USING (query_id, item_id) GROUP BY 1, 2),
nd AS (SELECT condition, query_id, 'ndcg' AS metric, round(coalesce(d / idcg, 0), 9) AS score FROM idl CROSS JOIN cond LEFT JOIN dcg USING (condition, query_id)),
prs AS (SELECT x.metric, x.condition AS a, y.condition AS b, x.query_id, x.score AS x, y.score AS y FROM nd x JOIN nd y ON x.query_id = y.query_id AND x.condition < y.condition)"""
_HOLM = "SELECT id, org_id, delta, least(1.0, MAX((m - i + 1) * p) OVER (PARTITION BY org_id ORDER BY i)) AS p_adjusted FROM (SELECT id, org_id, (id * 37 % 101) / 2020.0::DOUBLE AS p, (id * 13 % 21 - 10) / 10.0::DOUBLE AS delta, COUNT(*) OVER (PARTITION BY org_id) AS m, ROW_NUMBER() OVER (PARTITION BY org_id ORDER BY id * 37 % 101, id) AS i FROM sites)"
_LAB = "SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE a AND b) AS \"both\", COUNT(*) FILTER (WHERE a AND NOT b) AS only_a, COUNT(*) FILTER (WHERE NOT a AND b) AS only_b, COUNT(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM (SELECT n_chars > 3000 AS a, length(title) > 50 AS b FROM documents) WHERE a IS NOT NULL AND b IS NOT NULL"
_KAP = f"SELECT *, (o - e) / (1 - e) AS kappa FROM (SELECT *, (\"both\" + neither) / n AS o, ((\"both\" + only_a) / n) * ((\"both\" + only_b) / n) + (1 - (\"both\" + only_a) / n) * (1 - (\"both\" + only_b) / n) AS e FROM ({_LAB}))"
_EQ = """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE)::DOUBLE[64] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(array_cosine_similarity(a.v, b.v), 12) AS x, round(array_inner_product(a.v, b.v), 12) AS y FROM e a JOIN e b ON a.vec_id % 100 = 0),
z AS (SELECT query_id, item_id, round(x / MAX(abs(x)) OVER (PARTITION BY query_id) / 1e-6) AS x, round(y / MAX(abs(y)) OVER (PARTITION BY query_id) / 1e-6) AS y FROM s),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY x DESC, item_id) AS rx, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY y DESC, item_id) AS ry FROM z),
idn AS (SELECT query_id, bool_and(coalesce(i1 = i2, FALSE)) AS identical FROM (SELECT a.query_id, a.item_id AS i1, b.item_id AS i2 FROM r a JOIN r b ON a.query_id = b.query_id AND a.rx = b.ry AND a.rx <= 10) GROUP BY 1),
tie AS (SELECT query_id, bool_or(t) AS tied FROM (SELECT query_id, rx <= 11 AND x = lag(x) OVER (PARTITION BY query_id ORDER BY rx) OR ry <= 11 AND y = lag(y) OVER (PARTITION BY query_id ORDER BY ry) AS t FROM r) GROUP BY 1),
tau AS (SELECT a.query_id, SUM(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(SUM(abs(sign(a.x - b.x)))::DOUBLE * SUM(abs(sign(a.y - b.y)))) AS tau FROM z a JOIN z b ON a.query_id = b.query_id AND a.item_id < b.item_id GROUP BY 1)"""


def sql() -> dict[str, str]:
    met = {f"met_{m}": f"WITH {_MET} SELECT condition, query_id, metric, k, score FROM met WHERE metric = '{m}'" for m in relevance.METRICS}
    run = f"WITH {_MET}, run AS (SELECT condition, query_id, metric, k, score FROM met WHERE metric IN ('precision', 'recall', 'mrr', 'ndcg'))"
    return met | {
        "prj_covers": f"""
WITH {C.CHUNKS}, {C.QUERIES}, p AS (SELECT query_id, chunk_id, {C.sql_norm("q.text")} AS g, string_split({C.sql_norm("q.text")}, ' ') AS w, {C.sql_norm("c.text")} AS h FROM q JOIN c USING (doc_id))
SELECT query_id, chunk_id, 1 AS grade FROM p WHERE g <> '' AND (contains(h, g) OR
  greatest(coalesce(list_max(list_filter(range(1, len(w) + 1), lambda i: contains(h, array_to_string(w[1:i], ' ')))), 0), coalesce(list_max(list_filter(range(1, len(w) + 1), lambda i: contains(h, array_to_string(w[len(w) - i + 1:len(w)], ' ')))), 0)) / len(w) >= 0.5)""",
        "prj_query": f"WITH {_PAIRS} SELECT query_id, chunk_id, MAX(grade) AS grade FROM pr WHERE l > 0 AND o > 0 AND o / l >= 0.5 GROUP BY 1, 2",
        "prj_set": f"WITH {_PAIRS}, t AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS least), g AS (SELECT least, query_id, chunk_id FROM pr, t WHERE l > 0 AND o > 0 AND o / l >= least GROUP BY 1, 2, 3), n AS (SELECT COUNT(DISTINCT query_id) AS n FROM sp) SELECT least, n AS n_queries, COUNT(DISTINCT query_id) AS n_projected, n - COUNT(DISTINCT query_id) AS n_unmatched, COUNT(*) AS n_judgments, round(COUNT(*) / n, 6) AS mean_judgments_per_query, round(COUNT(DISTINCT query_id) / n, 6) AS match_rate FROM g, n GROUP BY least, n",
        "qr_sens": f"WITH {_PAIRS}, t AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS least), g AS (SELECT least, query_id, chunk_id, MAX(grade) AS grade FROM pr, t WHERE l > 0 AND o > 0 AND o / l >= least GROUP BY 1, 2, 3) SELECT least, COUNT(*) AS n, SUM(grade)::BIGINT AS grades FROM g GROUP BY 1",
        "qr_judged": f"WITH {_PAIRS} SELECT DISTINCT query_id FROM pr WHERE l > 0 AND o > 0 AND o / l >= 0.5",
        "qr_prov": f"WITH {C.QUERIES} SELECT query_id, 'human' AS provenance FROM q WHERE doc_id % 200 = 0",
        "met_eval": f"WITH {_MET} SELECT condition, query_id, metric, k, score FROM met",
        "st_paired": f"WITH {_ND} SELECT metric, a, b, COUNT(*) AS n, round(AVG(x), 9) AS mean_a, round(AVG(y), 9) AS mean_b, round(AVG(x - y), 9) AS mean_diff, round(median(x - y), 9) AS median_diff, COUNT(*) FILTER (WHERE x = y) AS n_ties, COUNT(*) FILTER (WHERE x > y) AS n_wins_a, COUNT(*) FILTER (WHERE x < y) AS n_wins_b FROM prs GROUP BY 1, 2, 3",
        "st_wilcoxon": f"WITH {_ND}, dd AS (SELECT metric, a, b, round(x - y, 12) AS d FROM prs WHERE round(x - y, 12) <> 0), rr AS (SELECT metric, a, b, d, RANK() OVER (PARTITION BY metric, a, b ORDER BY abs(d)) + (COUNT(*) OVER (PARTITION BY metric, a, b, abs(d)) - 1) / 2 AS r FROM dd) SELECT metric, a, b, COUNT(*) AS n_used, coalesce(SUM(r) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(SUM(r) FILTER (WHERE d < 0), 0) AS w_minus FROM rr GROUP BY 1, 2, 3",
        "st_cliffs": f"WITH {_ND} SELECT p.metric, p.a, p.b, round(AVG(sign(p.x - o.y)), 9) AS delta FROM prs p JOIN prs o ON o.a = p.a AND o.b = p.b GROUP BY 1, 2, 3",
        "st_holm": f"SELECT id, org_id, round(p_adjusted, 9) AS p_adjusted FROM ({_HOLM})",
        "st_correct": f"SELECT id, p_adjusted < 0.05 AS significant, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS effect FROM ({_HOLM})",
        "st_summary": f"WITH {_ND} SELECT a, b, a || ' vs ' || b || ' on ' || metric || ': ' || COUNT(*)::VARCHAR || ' queries, ' || COUNT(*) FILTER (WHERE x = y)::VARCHAR || ' ties' AS line FROM prs GROUP BY a, b, metric",
        "hx_run": f"{run} SELECT * FROM run",
        "snk_runs": f"{run} SELECT * FROM run",
        "hx_common": f"WITH {_ND} SELECT query_id FROM nd GROUP BY 1 HAVING COUNT(DISTINCT condition) = (SELECT COUNT(DISTINCT condition) FROM nd)",
        "hx_agg": f"{run} SELECT condition, metric, k, round(AVG(score), 9) AS mean, COUNT(*) AS n_queries FROM run GROUP BY 1, 2, 3",
        "hx_report": f"{run} SELECT condition, round(AVG(score) FILTER (WHERE metric = 'precision'), 6) AS precision, round(AVG(score) FILTER (WHERE metric = 'recall'), 6) AS recall, round(AVG(score) FILTER (WHERE metric = 'mrr'), 6) AS mrr, round(AVG(score) FILTER (WHERE metric = 'ndcg'), 6) AS ndcg FROM run WHERE k = 10 GROUP BY 1",
        "ag_kappa": f"SELECT round(o, 9) AS observed, round(e, 9) AS expected, round(kappa, 9) AS kappa FROM ({_KAP})",
        "ag_cells": _LAB,
        "ag_interp": f"SELECT CASE WHEN kappa < 0 THEN 'poor' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' ELSE 'almost perfect' END AS label FROM ({_KAP})",
        "ag_pool": f"WITH {C.BM25}, f AS (SELECT query_id, item_id, MIN((CASE strategy WHEN 'fixed' THEN 1 WHEN 'parent' THEN 2 WHEN 'semantic' THEN 3 ELSE 4 END) * 1000 + rank) AS place_of FROM bm WHERE rank <= 5 GROUP BY 1, 2) SELECT query_id, item_id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY place_of) AS place FROM f",
        "eq_tau": f"WITH {_EQ} SELECT query_id, round(tau, 6) AS tau FROM tau",
        "eq_order": f"WITH {_EQ} SELECT query_id, identical FROM idn",
        "eq_ties": f"WITH {_EQ} SELECT query_id, coalesce(tied, FALSE) AS tied FROM tie",
        "eq_verify": f"WITH {_EQ} SELECT COUNT(*) AS n_queries, round(AVG(tau), 6) AS mean_tau, round(AVG(identical::INTEGER), 9) AS identical_rate, COUNT(*) FILTER (WHERE tied) AS n_tied FROM tau JOIN idn USING (query_id) JOIN tie USING (query_id)",
        "eq_quant": f"WITH {_EQ} SELECT query_id, item_id, round(round(y / MAX(abs(y)) OVER (PARTITION BY query_id) / 1e-6) * 1e-6, 6) AS quantised FROM s",
        "snk_exp": f"{run} SELECT condition, metric, k, COUNT(*) AS n_records, round(AVG(score), 9) AS mean FROM run GROUP BY 1, 2, 3",
        "rel_experiment": f"WITH {_ND} SELECT metric, a, b, COUNT(*) AS n, round(AVG(x), 9) AS mean_a, round(AVG(y), 9) AS mean_b, round(AVG(x - y), 9) AS mean_diff, round(median(x - y), 9) AS median_diff, COUNT(*) FILTER (WHERE x = y) AS n_ties, COUNT(*) FILTER (WHERE x > y) AS n_wins_a, COUNT(*) FILTER (WHERE x < y) AS n_wins_b FROM prs GROUP BY 1, 2, 3",
    }
